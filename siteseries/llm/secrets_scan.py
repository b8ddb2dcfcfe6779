"""Secret scans with a recursive decoding worklist.

A text is scanned for assignments, access keys and long hexadecimal runs. Then its layers are unwrapped until nothing new
appears: percent escapes, Unicode escapes and character references are decoded over the whole layer, base64 runs become
layers of their own, on one line or wrapped over several, and compressed bytes in them are inflated, all their members.
Every layer is scanned and unwrapped again, whatever its bytes are; its spans are mapped back to code points of the original
text (of a base64 run: the whole run). A layer that was already seen at the same place is not entered again, so texts that
unpack to themselves end.

Null texts count as empty and have no spans; redaction leaves null as null. Equal spans of several layers count once.
Repeated rows get equal results; an empty table gives an empty result. Inflated layers have no limit: they are read as a
stream, in windows that end at characters no pattern contains, so memory is bounded and time follows what is inflated. Only of
a compressed layer whose own base64 run is unbroken for over `MAX_RUN` characters inside another layer is the beginning read.
Extra columns are not read by `find_secrets` and carried unchanged by `redact_secrets`, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import html
import re
import zlib
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import packed, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|&(?:quot|apos|amp|lt|gt|equals|colon);")
BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
LINE = re.compile(r"\\[rn]|([A-Za-z0-9+/_-]+)")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
PARTING = re.compile(r"""[^A-Za-z0-9+/_=.%\\&#;:{}"'\s-]""", re.A)
SHORTEST = 14  # characters of the shortest secret
PIECE, WINDOW, MAX_RUN, OVERLAP = 1 << 20, 1 << 20, 1 << 26, 1 << 16
MASK = "[REDACTED]"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _unescape(m: re.Match) -> str | None:
    s = m[0]
    try:
        if s[0] == "%":
            return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")
        if s.startswith("\\u{"):
            return chr(int(s[3:-1], 16))
        if s.startswith("\\u"):
            return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")
        if s.startswith("\\x"):
            raw = bytes.fromhex(s.replace("\\x", ""))
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        return html.unescape(s)
    except (ValueError, OverflowError):
        return None


def rewritten(text: str, starts, ends, pattern: re.Pattern):
    """The layer with every match of `pattern` decoded, and where each of its characters lies in the original."""
    parts, new_starts, new_ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        plain = _unescape(m)
        if plain is None or plain == m[0]:
            continue
        parts += [text[at:m.start()], plain]
        if isinstance(starts, Same):
            at = m.end()
            continue
        new_starts += [*(starts[k] for k in range(at, m.start())), *[starts[m.start()]] * len(plain)]
        new_ends += [*(ends[k] for k in range(at, m.start())), *[ends[m.end() - 1]] * len(plain)]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    if isinstance(starts, Same):
        return "".join(parts), starts, ends
    new_starts += [starts[k] for k in range(at, len(text))]
    new_ends += [ends[k] for k in range(at, len(text))]
    return "".join(parts), new_starts, new_ends


def _decompressor(head: bytes):
    """A decompressor for bytes that open like this, and how much may be fed at once; None if they are not compressed."""
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj(), 256  # a short input can give 128 KB for every four bytes
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(47), 1 << 16
    return None


def _until_error(d, fed: bytes):
    """What a zlib decompressor gives before the byte it fails at."""
    for k in range(len(fed)):
        some = fed[k:k + 1]
        while True:
            try:
                out = d.decompress(some, PIECE)
            except zlib.error:
                return
            yield out
            some = d.unconsumed_tail
            if d.eof or not some and len(out) < PIECE:
                break


def inflated(chunks):
    """(member, bytes) of all members or frames in `chunks`, and what follows them as it is; nothing if none opens there.

    Of a damaged or unfinished member comes what can be inflated.
    """
    chunks, rest, member = iter(chunks), b"", -1
    while True:
        while len(rest) < 4 and (more := next(chunks, None)) is not None:
            rest += more
        if not rest:
            return
        if (made := _decompressor(rest)) is None:
            if member >= 0:
                yield member + 1, rest
                for more in chunks:
                    yield member + 1, more
            return
        d, step = made
        member += 1
        try:
            while not d.eof:
                if not rest and (rest := next(chunks, b"")) == b"":
                    break
                some, rest = rest[:step], rest[step:]
                if step == 256:
                    yield member, d.decompress(some)
                    continue
                before, fed, given = d.copy(), some, 0
                while True:
                    try:
                        out = d.decompress(some, PIECE)
                    except zlib.error:
                        for out in _until_error(before, fed):
                            yield member, out[max(0, given):]
                            given -= len(out)
                        raise
                    yield member, out
                    given += len(out)
                    some = d.unconsumed_tail
                    if d.eof or not some and len(out) < PIECE:
                        break
            rest = d.unused_data + rest
        except Exception as e:  # zlib.error, or ZstdError of a module that may be absent
            if type(e).__name__ not in ("error", "ZstdError"):
                raise
            return


def deeper(pieces):
    """(member, bytes) of all members inside the members of `pieces`."""
    opened = 0
    for _, member in groupby(pieces, lambda x: x[0]):
        last = -1
        for last, piece in inflated(x[1] for x in member):
            yield opened + last, piece
        opened += last + 1


def windows(chunks):
    """Text of a byte stream in windows that part no pattern, run or escape; invalid bytes become U+FFFD one by one.

    Windows end at characters that no pattern contains. Where none comes for MAX_RUN characters, the next window repeats the
    last ones, in step with the base64 groups of the run it lies in.
    """
    reader, held, looked = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for chunk in chunks:
        held.append(reader.decode(chunk))
        looked += len(held[-1])
        if looked < WINDOW:
            continue
        cut = next((len(held[-1]) - m.start() for m in PARTING.finditer(held[-1][::-1])), 0)
        if cut:
            last = held.pop()
            yield "".join([*held, last[:cut]])
            held, looked = [last[cut:]], len(last) - cut
        elif looked >= MAX_RUN:
            text = "".join(held)
            at = len(text) - OVERLAP
            run = at
            while run and text[run - 1] in RUN:
                run -= 1
            yield text
            held = [text[at - (at - run) % 4:]]
            looked = len(held[0])
    held.append(reader.decode(b"", True))
    if any(held):
        yield "".join(held)


def unpacked(run: str):
    """The text in a base64 run, in windows, and in what it inflates to as often as it is compressed."""
    body = run.rstrip("=").translate({45: 43, 95: 47})
    body = body[:len(body) - (len(body) % 4 == 1)]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    # Compressed bytes are no text themselves; a text may open with x and one of four characters like a zlib stream.
    coded = _decompressor(raw[:4]) is not None
    seen, depth, more = set(), int(coded and raw[1:2] not in (b" ", b"?", b"^", b"}")), True
    while more:
        pieces = iter([(0, raw)])
        for _ in range(depth):
            pieces = deeper(pieces)
        digest, size, heads = hashlib.md5(), 0, [b"", None]

        def noted(pieces=pieces, digest=digest, heads=heads):
            nonlocal size, more
            more = False
            for member, piece in pieces:
                digest.update(piece)
                size += len(piece)
                if heads[1] != member:
                    heads[:] = b"", member
                if len(heads[0]) < 4:
                    heads[0] += piece[:4]
                    more |= _decompressor(heads[0]) is not None
                yield piece

        yield from windows(noted())
        mark = size, digest.digest()
        more &= mark not in seen
        seen.add(mark)
        depth += 1


def base64_runs(text: str):
    """(start, end, run) of unbroken base64 runs, and of those wrapped over lines: all lines, and lines of one width."""
    for pattern in BASE64:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), m[0]
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in LINE.finditer(m[0]) if x[1]]
        yield lines[0][0], m.end(), "".join(x[2] for x in lines)
        k = 0
        while k < len(lines):
            end = k + 1
            while end < len(lines) and len(lines[end][2]) == len(lines[k][2]):
                end += 1
            same = end
            if end < len(lines) and len(lines[end][2]) < len(lines[k][2]):
                end += 1
            if end - k > 1 and (k or end < len(lines)):
                yield lines[k][0], lines[end - 1][1], "".join(x[2] for x in lines[k:end])
            k = same


class Same:
    """One place for every character of a layer."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, k: int) -> int:
        return self.place


def _layers(text: str, starts, ends):
    """The layers directly inside a layer, one at a time: text, and the first and last place of each character."""
    for pattern, hint in ((PERCENT, "%"), (ESCAPES, "\\"), (ESCAPES, "&")):
        if hint in text and (hint != "&" or "\\" not in text) and (made := rewritten(text, starts, ends, pattern)):
            yield made
    for a, b, run in base64_runs(text):
        for inner in unpacked(run):
            yield inner, Same(starts[a]), Same(ends[b - 1])


def secrets_of(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, layer), sorted; layer 0 are the base spans, others count how often the text was unwrapped."""
    found = {span: 0 for span in scan(text)}
    work = [_layers(text, range(len(text)), range(1, len(text) + 1))]
    seen = set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        inner, s, e = layer
        if len(inner) < SHORTEST:
            continue
        key = (hashlib.md5(inner.encode("utf-8", "surrogatepass")).digest(), s[0], e[-1])
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in scan(inner):
            span = (s[a], kind, e[b - 1])
            found[span] = min(found.get(span, len(work)), len(work))
        work.append(_layers(inner, s, e))
    return sorted((a, kind, b, layer) for (a, kind, b), layer in found.items())


def redacted(text: str) -> str:
    """The text with every span, overlapping ones together, replaced by a mask."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b, _ in secrets_of(text):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def spans_column(text: Column) -> Column:
    """array<struct<kind, start, end, layer>> of a text column."""
    @F.pandas_udf("array<struct<kind:string,start:int,end:int,layer:int>>")
    def spans(texts):
        import pandas as pd

        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "layer": layer} for a, k, b, layer in secrets_of(t)] for t in texts])

    return spans(text)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end in code points, layer)."""
    return docs.select(F.col(f"`{id}`").alias("doc_id"), spans_column(text_of(text)).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns, secrets masked in the text, and the column of text sizes brought up to date where it changed."""
    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        return pd.Series([None if t is None else redacted(t) for t in texts], dtype=object)

    made = docs.select(packed(docs), clean(F.col(f"`{text}`")).alias("clean"))
    cols = []
    for c, kind in docs.dtypes:
        old = F.col("row")[c]
        if c == text:
            old = F.col("clean")
        elif c == size:
            old = F.when(F.col("clean") != F.col("row")[text], F.length("clean")).otherwise(old).cast(kind)
        cols.append(old.alias(c))
    return made.select(*cols)


def op10_secret_scans(spark, folder: str) -> DataFrame:
    """The digest of the contract, from the operator's spans."""
    found = find_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
    base = F.filter("spans", lambda s: s["layer"] == 0)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return (found.withColumn("base", base)
            .select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")))
