"""Fuzzy line dedup: near-equal lines across all documents, one occurrence kept.

Lines are compared in normal form: lower case, with ASCII marks and white space made one blank. Equal ones are one node.
Nodes link at an edit similarity of 0.8 or more. Candidates meet on pigeonhole blocks of what they are made of: the word pairs
(words, in lines under 16) of a line are dealt to blocks by their hashes, as many blocks as suit its length, and a block's key
sums what was dealt to it. A changed word touches four blocks at most, so lines that differ a little agree in the others;
each line brings ten of its blocks, and also those of the length class below if its length is near. Lines of up to nine words
meet without one of their words, lines of up to 24 characters without one of their characters. Of two nodes that meet on
blocks, the 64-bit SimHashes of their word pairs may differ in 22 bits before the edit distance decides. Keys that bring the
same nodes together are visited once. The verified links' connected groups are what counts. Of each group the occurrence with
the smallest doc_id (nulls last) and line number stays. Equal lines always meet; a similar pair may be missed where changes
touch every block, which tests bound by a recall of 0.9 against brute-force edit similarity.

Lines of marks and white space alone are never dropped. Null texts stay null. Rows that repeat with equal id and text are one
document and keep the same lines. An empty table gives an empty result. Extra columns of any name are carried unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import BROADCAST_ROWS, packed, sized, staged, text_of
from siteseries.llm.components import components
from siteseries.llm.simhash import cells_of

MIN_WORDS, BITS, SIMILARITY = 5, 22, 0.8
BLOCKS = 10                 # blocks that a line brings
DEALT, SHORT, TINY = 8, 9, 24  # words from which a line is dealt, words up to which one is left out, characters likewise


#: Everything in ASCII but letters and digits becomes a blank; A-Z are lowered afterwards.
MARKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(line: bytes) -> list[bytes]:
    """The words of a line's normal form."""
    return line.translate(MARKS).lower().split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = xxh64_intdigest(word, 42)
        return h


def normal(text: bytes) -> bytes:
    """A text with each of its lines in normal form."""
    a = np.frombuffer(text.translate(FORM), np.uint8)
    gap = a <= 32
    keep = a != 32
    keep[1:] |= ~gap[:-1]
    return a[keep].tobytes().replace(b" \n", b"\n").rstrip(b" ")


#: As `words_of` has them, but line feeds stay.
FORM = bytes(10 if c == 10 else MARKS.lower()[c] for c in range(256))


def word_hashes(text: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the words of a text that start at `starts` and have `size` bytes."""
    from xxhash import xxh64_intdigest

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(text) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) + (p5 + np.uint64(42))
    at, left = starts.copy(), np.where(size < 32, size, 0)
    while len(some := np.flatnonzero(left >= 8)):
        h[some] = turned(h[some] ^ turned(eight[at[some]] * p2, 31) * p1, 27) * p1 + p4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = turned(h[some] ^ (eight[at[some]] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    at[some] += 4
    left[some] -= 4
    some = np.flatnonzero(left)
    while len(some):
        h[some] = turned(h[some] ^ padded[at[some]].astype(np.uint64) * p5, 11) * p1
        at[some] += 1
        left[some] -= 1
        some = some[left[some] > 0]
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxh64_intdigest(text[starts[k]:starts[k] + size[k]].tobytes(), 42)
    return h


class LineReader:
    """Fingerprints and block keys of lines."""

    def fingerprints(self, lines: list[list[bytes]]) -> list[int | None]:
        """The SimHash of each line's word pairs; None below MIN_WORDS."""
        return self.read(lines)[0]

    def read(self, lines: list[list[bytes]]) -> tuple[list[int | None], list[list[int]]]:
        """The SimHash and the block keys of each line of words."""
        fps, known, line, key = self.read_text(b"\n".join(map(b" ".join, lines)))
        keys: list[list[int]] = [[] for _ in lines]
        for k, x in zip(line.tolist(), key.tolist()):
            keys[k].append(x)
        return [fp if has else None for fp, has in zip(fps.tolist(), known.tolist())], keys

    def read_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The SimHash of each line of a text in normal form and whether it has one, and (line, key) of the lines' keys."""
        a = np.frombuffer(text, np.uint8)
        inside = a > 32
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts, ends, breaks = np.flatnonzero(first), np.flatnonzero(last) + 1, np.flatnonzero(a == 10)
        of = np.diff(np.searchsorted(starts, np.r_[0, breaks, len(a)]))
        fps, known = np.zeros(len(of), np.int64), of >= MIN_WORDS
        left = [(k, left_out(text[i:j].split(b" "))) for k, i, j in zip(*(x[(of > 0) & (of <= SHORT)].tolist() for x in (
            np.arange(len(of)), np.r_[0, breaks + 1], np.r_[breaks, len(a)])))]
        line = [np.repeat([k for k, _ in left], [len(x) for _, x in left]).astype(np.int64)]
        key = [np.array([y for _, x in left for y in x], np.int64)]
        long = np.flatnonzero(known)
        if len(long):
            size, use = of[long], np.repeat(known, of)
            h = word_hashes(a, starts[use], (ends - starts)[use])
            fps[long], more = self.read_words(h, size)
            line.append(long[more[0]])
            key.append(more[1])
        return fps, known, np.concatenate(line), np.concatenate(key)

    def read_words(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The SimHashes and (line, key) of the blocks of lines of `size` words with the hashes h."""
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
        pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        pair ^= pair >> np.uint64(32)
        inner = np.ones(len(pair), bool)
        inner[np.cumsum(size)[:-1] - 1] = False  # pairs across two lines
        pair = pair[inner]
        keys = dealt(h, pair, size)
        size = size - 1
        # Eight counters of eight bits in a word: runs of at most 255 pairs are added at once, then the runs of a line.
        runs = -(-size // 255)
        line = np.repeat(np.arange(len(size)), runs)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = (np.cumsum(size) - size)[line] + 255 * nth
        counts = np.empty((len(starts), 64), np.uint8)
        for lo in range(0, len(starts), 512):
            some = starts[lo:lo + 512]
            end = starts[lo + 512] if lo + 512 < len(starts) else len(pair)
            lanes = LANES[pair[some[0]:end].view(np.uint8).reshape(-1, 8)]
            counts[lo:lo + 512] = np.add.reduceat(lanes, some - some[0], axis=0).view(np.uint8).reshape(-1, 64)
        total = np.add.reduceat(counts, np.flatnonzero(nth == 0), axis=0, dtype=np.int64)
        return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<i8")[:, 0], keys


def left_out(words: list[bytes]) -> list[int]:
    """Even keys of a short line: whole, without each of its words and, if tiny, without each of its characters."""
    from xxhash import xxh64_intdigest

    forms = {b"w" + b" ".join(words)} | {b"w" + b" ".join(words[:k] + words[k + 1:]) for k in range(len(words)) if len(words) > 1}
    form = b" ".join(words).decode("utf-8", "surrogatepass")
    if len(form) <= TINY:
        forms |= {("c" + form[:k] + form[k + 1:]).encode("utf-8", "surrogatepass") for k in range(len(form))}
        forms.add(b"c" + b" ".join(words))
    return [(xxh64_intdigest(f, 7) & ~1) - (1 << 63) for f in sorted(forms)]


def dealt(words: np.ndarray, pairs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, odd key) of the blocks of lines given by the hashes of their words and word pairs, one line after the other.

    Lines of 2^c to 2^(c+1) words are dealt to 2^(c-1) blocks, again with other draws while they are fewer than BLOCKS; lines near
    the lower end also as the class below. Blocks with one item say too little and bring no key.
    """
    of = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), size - 1)
    level = np.frexp(size.astype(float))[1] - 1
    line, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for c in range(3, int(level.max()) + 1):
        member = (size >= DEALT) & ((level == c) | (level == c + 1) & (size < 1.25 * 2.0 ** (c + 1)))
        item, at, blocks = (words, of[0], 4) if c == 3 else (pairs, of[1], 1 << c - 1)
        use = member[at]
        item, at = item[use], at[use]
        for draw in range(-(-BLOCKS // blocks)):
            mixed = (item ^ np.uint64(0x9E3779B97F4A7C15 * (draw + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            block = (mixed & np.uint64(blocks - 1)).astype(np.int64)
            here = block < BLOCKS - draw * blocks
            slot = at[here] * BLOCKS + block[here]
            total = np.zeros(len(size) * BLOCKS, np.uint64)
            np.add.at(total, slot, mixed[here])
            place = np.flatnonzero(np.bincount(slot, minlength=len(total)) > 1)
            total = total[place] + (place % BLOCKS + BLOCKS * (draw + BLOCKS * c)).astype(np.uint64)
            total = (total ^ total >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
            line.append(place // BLOCKS)
            key.append(((total ^ total >> np.uint64(32)) | np.uint64(1)).view(np.int64))
    return np.concatenate(line), np.concatenate(key)


WORDS_KEPT = 600_000  # for a keeper of word hashes; a memory bound only
LANES = np.array([sum(1 << 8 * b for b in range(8) if c >> b & 1) for c in range(256)], np.uint64)
LOT = 1 << 19  # bytes of lines that are read at once


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Key, id and text of every document."""
    body = text_of(text)
    return docs.select(F.xxhash64(F.col(f"`{id}`").cast("string"), body).alias("doc"), F.col(f"`{id}`").alias("doc_id"), body.alias("body"))


def lots_of(bodies) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts with their lines in normal form, cut and joined at line ends to lots of about LOT bytes, and what is in each: the number
    of the text, of its first line in the lot and of its lines there."""
    parts, spans, size = [], [], 0
    for d, body in enumerate(bodies):
        whole, k, at = normal(body), 0, 0
        while at <= len(whole):
            end = whole.find(b"\n", at + LOT - size - 1) if at + LOT - size <= len(whole) else -1
            part = whole[at:end] if end >= 0 else whole[at:]
            parts.append(part)
            spans.append((d, k, n := part.count(b"\n") + 1))
            k, at, size = k + n, at + len(part) + 1, size + len(part) + 1
            if size >= LOT:
                yield b"\n".join(parts), spans
                parts, spans, size = [], [], 0
    if parts:
        yield b"\n".join(parts), spans


def lines_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, doc_id, k, node, fp, keys) of every line that has words: document key and id, line number, checksum, fingerprint, block keys."""
    kind = dict(docs.dtypes)[id]

    def read(batches):
        from hashlib import md5

        import pyarrow as pa

        reader = LineReader()
        for batch in batches:
            for lot, spans in lots_of(body.as_py() for body in batch.column("body")):
                fps, known, line, key = reader.read_text(lot)
                forms = lot.split(b"\n")
                has = np.flatnonzero(np.fromiter(map(len, forms), np.int64, len(forms)))
                d, first, n = np.array(spans).T
                at = np.repeat(d, n)[has]
                k = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n))[has]
                order = np.argsort(line, kind="stable")
                ends = np.cumsum(np.bincount(line, minlength=len(forms))[has])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").take(pa.array(at)), batch.column("doc_id").take(pa.array(at)), pa.array(k.astype(np.int32)),
                    pa.array([md5(forms[j]).digest() for j in has.tolist()], pa.binary()), pa.array(fps[has], mask=~known[has]),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(key[order]))],
                    ["doc", "doc_id", "k", "node", "fp", "keys"])

    made = keyed(docs, id, text).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("body", F.col("body").cast("binary"))
    made = made.mapInArrow(read, "doc long, doc_id string, k int, node binary, fp long, keys array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def forms_of(docs: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, form): the normal form of wanted lines (node, doc, k), one place per node. A document is read once for all its lines."""
    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("k", "node")).alias("at"))
    places = F.broadcast(places) if wanted.count() <= BROADCAST_ROWS else places
    rows = keyed(docs, id, text).select("doc", F.col("body").cast("binary").alias("body")).join(places, "doc").select("body", "at.k", "at.node")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, forms = [], []
            for d in range(batch.num_rows):
                lines = batch.column("body")[d].as_py().split(b"\n")
                nodes += batch.column("node")[d].as_py()
                forms += normal(b"\n".join([lines[k] for k in batch.column("k")[d].as_py()])).split(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(forms, pa.binary()).cast(pa.string())], ["node", "form"])

    # Documents that are equal to the last character bring their lines again.
    return rows.mapInArrow(read, "node binary, form string").groupBy("node").agg(F.first("form").alias("form"))


def shared_start(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def places_of(a: str) -> dict[str, int]:
    """The places of each character of a text, as bits."""
    chars = list(set(a))
    if len(a) < 48 or len(chars) * len(a) > 1 << 22:  # a matrix does not pay, or takes much room
        where = dict.fromkeys(chars, 0)
        for k, c in enumerate(a):
            where[c] |= 1 << k
        return where
    at, of = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, "".join(chars)))
    rows = np.packbits(at == of[:, None], axis=1, bitorder="little")
    return {c: int.from_bytes(row, "little") for c, row in zip(chars, map(bytes, rows))}


def in_common(same_as: list[int], n: int, least: int = 0) -> int:
    """Length of the longest common subsequence of a text of n characters and another one, for each character of which `same_as`
    has the places in the first one as bits. It ends early, with the most it can be, once that is below `least`."""
    open_ = all_ = (1 << n) - 1
    left_over = len(same_as)
    for lo in range(0, len(same_as), 32):
        for same in same_as[lo:lo + 32]:
            same &= open_
            open_ = open_ + same | open_ - same
        left_over -= 32
        if left_over > 0 and (most := n - (open_ & all_).bit_count() + left_over) < least:
            return most
    return n - (open_ & all_).bit_count()


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`: a column of the table at a time in the bits of one number.

    Each further column changes the last row by one at most, so it ends as soon as the answer can no longer change. The longest
    common subsequence, which takes a quarter of the steps, mostly tells before: whatever of the longer text is not in it takes
    an edit, and one for each character of either text that is not in it is enough.
    """
    same = shared_start(a, b)
    a, b = a[same:], b[same:]
    same = shared_start(a[::-1], b[::-1])
    a, b = a[:len(a) - same], b[:len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= limit or len(a) - len(b) > limit:
        return len(a) <= limit
    if not b:
        return False
    same_as = list(map(places_of(a).get, b, repeat(0)))
    both = in_common(same_as, len(a), len(a) - limit)
    if len(a) - both > limit or len(a) + len(b) - 2 * both <= limit:
        return len(a) - both <= limit
    all_, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score, left_over = all_, 0, len(a), len(b)
    for same in same_as:
        free = same | down
        diagonal = ((same & up) + up ^ up) | same
        right, left = down | ~(diagonal | up) & all_, up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        left_over -= 1
        if score + left_over <= limit:
            return True
        if score - left_over > limit:
            return False
        right, left = (right << 1 | 1) & all_, left << 1 & all_
        up, down = left | ~(free | right) & all_, right & free
    return score <= limit


def edits_by_words(a: list[str], b: list[str], most: float = math.inf) -> int:
    """Characters that one way of turning the words of a into those of b edits, hence no less than the edit distance.

    Where words differ, the next place at which they agree again, up to three words ahead on either side, decides what is
    replaced, left out or put in. Beyond `most` it is only counted that there are more.
    """
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        for p, q in AHEAD:
            if i + p < n and j + q < m and a[i + p] == b[j + q]:
                break
        else:
            p = q = 1
        p, q = i + p, j + q
        while i < p and j < q:
            x, y = len(a[i]), len(b[j])
            cost += x if x > y else y
            i += 1
            j += 1
        while i < p:
            cost += len(a[i]) + 1
            i += 1
        while j < q:
            cost += len(b[j]) + 1
            j += 1
        if cost > most:
            return cost
    return cost + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:])


#: Steps on both sides to where words may agree again, the shortest first.
AHEAD = sorted(((p, q) for p in range(4) for q in range(4) if p or q), key=lambda s: (max(s), sum(s)))


def edits_allowed(a: str, b: str, least: float) -> int:
    """Edits of at most 1 - least of the longer text; -1 if its length alone takes more."""
    longest = max(len(a), len(b))
    limit = math.floor(longest - least * longest + 1e-9)  # a similarity of exactly `least` counts
    return limit if longest - min(len(a), len(b)) <= limit else -1


def few_changes(a: str, b: str, least: float) -> bool:
    """Whether few changed words show that the texts are similar."""
    limit = edits_allowed(a, b, least)
    return limit >= 0 and edits_by_words(a.split(" "), b.split(" "), limit) <= limit


def few_edits(a: str, b: str, least: float) -> bool:
    """Whether the texts are similar by their edit distance."""
    limit = edits_allowed(a, b, least)
    return limit >= 0 and within(a, b, limit)


def similar(a: str, b: str, least: float) -> bool:
    """Whether edits of at most 1 - least of the longer text turn one into the other; few changed words show it at once."""
    return few_changes(a, b, least) or few_edits(a, b, least)


class Decided:
    """What is known of nodes that meet at several anchors: those joined so far, by `links`, and pairs that are not similar."""

    def __init__(self, links: list[tuple[bytes, bytes]]) -> None:
        self.links, self.roots, self.apart = links, {}, set()

    def root(self, a: bytes) -> bytes:
        up = self.roots
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    def joined(self, a, b, test, least: float, last: bool) -> bool:
        """Whether (node, fp, form) a and b are joined already, or now by the test; a pair that fails the last test is kept in mind."""
        x, y = self.root(a[0]), self.root(b[0])
        if x == y:
            return True
        pair = (a[0], b[0]) if a[0] < b[0] else (b[0], a[0])
        if pair in self.apart:
            return False
        if test(a[2], b[2], least):
            self.roots[x] = y
            self.links.append(pair)
            return True
        if last:
            self.apart.add(pair)
            if len(self.apart) > KEPT:
                self.apart.clear()
        return False

    def forest(self, homes: list, guests: list, bits: int, least: float) -> None:
        """Join all similar pairs of a home and a guest, both (node, fp, form); homes among themselves if they are the guests.

        Few changed words join what they can first, so that edit distances are left to what is still apart.
        """
        if len(self.roots) > KEPT:
            self.roots.clear()
        if homes is guests and len(homes) == 2:  # as most anchors are
            (_, x, a), (_, y, b) = homes
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= bits and edits_allowed(a, b, least) >= 0:
                self.joined(*homes, few_changes, least, False) or self.joined(*homes, few_edits, least, True)
            return
        pools = homes, guests
        if len({self.root(x[0]) for x in (homes if homes is guests else homes + guests)}) == 1:
            return
        fps = [np.array([x[1] for x in pool], np.int64).view(np.uint64) for pool in pools]
        sizes = [np.array([len(x[2]) for x in pool], np.int64) for pool in pools]

        def close(fp, size, fps, sizes):
            # Lengths that differ by more than the edits allowed (and one more, for rounding) need no test.
            return (np.bitwise_count(fps ^ fp) <= bits) & (np.abs(sizes - size) <= (1 - least) * np.maximum(sizes, size) + 1)

        near = None
        if homes is guests and len(homes) <= LED:
            table = close(fps[0][:, None], sizes[0][:, None], fps[0], sizes[0])
            np.fill_diagonal(table, False)
            if not table.any():
                return
            near = [np.flatnonzero(row).tolist() for row in table]
        for test, last in ((few_changes, False), (few_edits, True)):
            if last and len({self.root(x[0]) for pool in pools for x in pool}) == 1:
                return
            free = set(range(len(homes))), set(range(len(guests)))
            if homes is guests:
                free = free[0], free[0]
            while free[0]:
                queue = [(0, free[0].pop())]
                while queue:
                    side, k = queue.pop()
                    me, pool, left, of = pools[side][k], pools[1 - side], free[1 - side], fps[1 - side]
                    if not left:
                        continue
                    if near:
                        at = [j for j in near[k] if j in left]
                    else:
                        at = np.fromiter(left, np.int64, len(left))
                        at = at[close(fps[side][k], sizes[side][k], of[at], sizes[1 - side][at])].tolist()
                    for j in at:
                        if self.joined(me, pool[j], test, least, last):
                            left.discard(j)
                            queue.append((1 - side, j))


LED = 64        # nodes up to which an anchor comes to its lead; others spread over the tasks by themselves
KEPT = 300_000  # nodes and pairs kept in mind; a memory bound only


def verified_links(visits: DataFrame, bits: int, least: float) -> DataFrame:
    """(a, b) nodes of rows (anchor, lead, own, node, fp, form) that are close and similar, enough of them to connect all that are.

    Anchors of one lead, which mostly bring the same nodes together, come to one task one after the other, and what one of them
    decides is not asked again.
    """
    cells = cells_of(visits, "node", 512, alike=True, lead="lead")

    def compare(batches):
        import pandas as pd

        key, lead, homes, guests, met, found = None, None, [], [], False, []
        known = Decided(found)

        def ended():
            # Without guests the homes of an undivided anchor meet each other.
            if homes and (guests or not met):
                known.forest(homes, guests or homes, bits, least)

        for pdf in batches:
            for of, anchor, part, own, node, fp, form in pdf.itertuples(index=False):
                if key != (anchor, part):
                    ended()
                    key, homes, guests, met = (anchor, part), [], [], False
                    if lead != of:
                        lead, known = of, Decided(found)
                if own:
                    homes.append((bytes(node), fp, form))
                else:
                    guests.append((bytes(node), fp, form))
                    if len(guests) >= 4096:
                        ended()
                        guests, met = [], True
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
                found.clear()
        ended()
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    return cells.select("lead", "anchor", "part", "own", "node", "fp", "form").mapInPandas(compare, "a binary, b binary")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = BITS, least: float = SIMILARITY) -> DataFrame:
    """(doc, k) of every line to drop: document key and line number."""
    seen = staged(lines_of(docs, id, text), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "doc")
    nodes = staged(seen.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(order).alias("at"),
                                            F.count("*").alias("n")), "line-nodes")
    visits = nodes.select(F.explode("keys").alias("anchor"), "node", "fp", "at.doc", "at.k")
    dealt_key, hashed = F.col("anchor").bitwiseAND(F.lit(1)) == 1, F.col("hashed")
    # Hashed before the keys are dealt out: only eight bytes a node go along.
    met = nodes.select("keys", F.xxhash64("node").alias("hashed")).select(F.explode("keys").alias("anchor"), "hashed")
    meets = met.groupBy("anchor").agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("who"), F.min(hashed).alias("lead")).where("n > 1")
    meets = staged(meets.groupBy("n", "who", dealt_key.alias("dealt")).agg(F.min("anchor").alias("anchor"), F.min("lead").alias("lead"))
                   .select("anchor", F.when(F.col("n") <= LED, F.col("lead")).otherwise(F.xxhash64("anchor")).alias("lead")), "line-meets")
    # Keys of lines left short are exact enough; their nodes meet whatever their fingerprints.
    visits = staged(visits.join(sized(meets), "anchor")
                    .select("anchor", "lead", F.lit(True).alias("own"), "node", F.when(dealt_key, F.col("fp")).otherwise(0).alias("fp"), "doc", "k"), "line-visits")
    # The lines that meet others are fetched from the documents in which they come first.
    wanted = staged(visits.select("node", "doc", "k").distinct(), "line-candidates")
    texts = staged(forms_of(docs, id, text, wanted), "line-texts")
    groups = staged(components(verified_links(visits.drop("doc", "k").join(texts, "node"), bits, least)), "line-groups")
    rooted = nodes.join(groups, "node", "left").select("node", "at", "n", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("at").alias("first"), F.sum("n").alias("of")).where("of > 1")
    crowd = staged(rooted.join(first, "root").select("node", "first"), "line-crowds")
    return seen.join(crowd, "node").where(~((F.col("doc") == F.col("first.doc")) & (F.col("k") == F.col("first.k")))).select("doc", "k")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = BITS, least: float = SIMILARITY) -> DataFrame:
    """All rows and columns; the text keeps its other lines. `n_lines` and `n_dropped` are added (replacing such columns)."""
    gone = staged(repeated_lines(docs, id, text, bits, least).groupBy("doc").agg(F.collect_set("k").alias("gone")), "lines-gone")
    body, at = text_of(text), F.col(f"`{text}`")
    rows = docs.select(packed(docs), at.alias("body"), F.xxhash64(F.col(f"`{id}`").cast("string"), body).alias("doc"),
                       F.when(at.isNull(), 0).otherwise(F.size(F.split(body, "\n"))).alias("n_lines"))
    rows = rows.join(sized(gone), "doc", "left")
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda x, k: ~F.array_contains("gone", k)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept)
    cols = [new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*cols, F.col("n_lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def op9_line_dedup(spark, folder: str) -> DataFrame:
    """Per document, how many lines it has and lost, and the checksum of what is left."""
    out = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
