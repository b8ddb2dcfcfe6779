"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised where they lie and cut into pieces of at most `capacity` tokens; only their lengths matter from then
on. The histogram of lengths has at most `capacity` entries however large the corpus is. Over it the driver solves the
configuration linear program (how often to use each multiset of lengths that fits into a sequence) by multiplicative
weights: a length covered ahead of schedule gets cheaper, one behind gets dearer, and a knapsack dynamic program finds the
best-paid configurations at the current prices. The fractional solution is rounded down and the bounded remainder is completed,
by the fullest complement of the longest open length or by best fit, whichever takes fewer sequences. The plan is then a table
of a few thousand ranges of ranks per length, and every piece finds its place from its rank among the pieces of its length
alone.

Null texts count as empty: their one piece holds the end id only. Equal lengths are interchangeable, so ties follow the
order in which rows were written. Repeated rows, null ids and extra columns of any name are kept apart by row, not by id.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteseries.llm.common import id_text, staged, text_of, tokenizer_path

CAPACITY = 2048
#: Bytes of chunks of odd texts and of words, with their ids, that a worker remembers. A memory bound only: forgotten ones are
#: encoded again.
CHUNKS, WORDS = 8 << 20, 112 << 20
#: Marks that may be cut off behind an ASCII letter or digit: there a new token begins in any case.
MARKS = ".,!?;:*$%&#"
#: Texts without any of these hold printable Latin-1 characters and ASCII blanks only: they are in normal form, every character is
#: lowered by itself, and `PARTS` are the words that the tokenizer file cuts the lowered text into.
ODD = re.compile(r"[^\t\n\x20-\x7e\xa1-\xac\xae-\xff]|<\|")
LETTERS, DIGITS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t\n\x20{LETTERS}{DIGITS}]+")


class Recent(dict):
    """What `make` gave for the texts asked for lately: two generations of half the room each, the older one forgotten first."""

    def __init__(self, make, room: int) -> None:
        super().__init__()
        self.make, self.room, self.held, self.older = make, room // 2, 0, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.pop(text, None)
        if ids is None:
            ids = self.make(text)
        size = 250 + 2 * len(text) + len(ids)  # with both objects' heads and their places in the table
        if size > self.room // 64:
            return ids
        if self.held + size > self.room:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[text] = ids
        return ids


class WordEncoder:
    """Token ids (packed little-endian) of texts, for a tokenizer file that drops white space and lower-cases.

    No token of it spans a blank or two of its words. Texts and chunks of plain characters are cut into words by one expression,
    and each word is encoded once and looked up afterwards. Lower-case words, which normalisation and pre-tokenisation would
    leave as they are, go straight to the library's model; chunks with odd characters take its full way.
    """

    def __init__(self, tokenizer: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(tokenizer)
        self.model = self.library.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {}  # how the library writes each byte, as far as characters below U+0530 have it
        for c in map(chr, range(0x530)):
            shown |= zip(c.encode(), "".join(p for p, _ in level.pre_tokenize_str(c)))
        self.shown = shown
        self.chunks, self.words = Recent(self.chunk, CHUNKS), Recent(self.word, WORDS)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PARTS.findall(text.lower())))

    def chunk(self, chunk: str) -> bytes:
        if not ODD.search(chunk):
            return self.plain(chunk)
        word = chunk.rstrip(MARKS)
        if "<|" in chunk or len(word) == len(chunk) or not (word[-1:].isascii() and word[-1:].isalnum()):
            return self.word(chunk)
        return self.words[word] + self.plain(chunk[len(word):])

    def word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha() and word.islower():
                return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        elif word.isalpha() and max(word) < "\u0530" and word == word.lower() and is_normalized("NFC", word):
            plain = word.encode().decode("latin-1").translate(self.shown)
            return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return self.whole(word)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not ODD.search(text):
            return self.plain(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, packed little-endian, if `keep_ids`),
    with `bucket` and `nth`: the task that made the piece and its number among that task's pieces of its length.

    `tokenizer` is the path of a tokenizer file whose pre-tokenizer drops white space.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast({"file": f.read()})
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import zlib

        import pandas as pd
        from pyspark import TaskContext

        state = model.value  # stays in the worker between tasks, and with it what the encoder has learned
        if "encoder" not in state:
            state["encoder"] = WordEncoder(state["file"])
        encode, seen, bucket = state["encoder"].encode, defaultdict(int), TaskContext.get().partitionId()
        for pdf in batches:
            ids, rows = pdf["doc_id"], []
            for k, text in enumerate(pdf["body"].tolist()):
                packed_ids = encode(text) + tail
                n = len(packed_ids) // 4
                for p, start in enumerate(range(0, n, capacity)):
                    part = packed_ids[4 * start:4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((ids.iat[k], p, start, length, zlib.crc32(part), bucket, seen[length], part if keep_ids else None))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "nth", "ids"])
            yield out if keep_ids else out.drop(columns="ids")

    kind = dict(docs.dtypes)[id]
    schema = ("doc_id string, piece int, start long, length long, ids_crc32 long, bucket int, nth long" + ", ids binary" * keep_ids)
    made = docs.select(id_text(id), text_of(text).alias("body")).mapInPandas(cut, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every room up to `capacity` with any number of each length, and the last length used (0: waste)."""
    value = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = prices
    for room in range(1, capacity + 1):
        gain = value[:room][::-1] + worth[1:room + 1]
        best = int(gain.argmax())
        value[room] = value[room - 1]
        if gain[best] > value[room] + 1e-12:
            value[room], last[room] = gain[best], best + 1
    return value, last


def unfold(last: np.ndarray, room: int) -> list[int]:
    """The lengths that the table chose for `room`."""
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def counted(items: list[int]) -> tuple[tuple[int, int], ...]:
    n: dict[int, int] = defaultdict(int)
    for x in items:
        n[x] += 1
    return tuple(sorted(n.items(), reverse=True))


def fractional(need: dict[int, int], capacity: int, share: float = 1 / 12, columns: int = 64, rate: float = 0.25,
               slack: float = 0.002, rounds: int = 600) -> dict[tuple, float]:
    """Multiplicative weights for the configuration program: the fractional use of each configuration.

    A round prices all lengths, and the configurations within `slack` of the best value are each used until a `share` of
    their scarcest length is covered. The price of a length is its size times exp(-rate * (covered share - overall share)).
    """
    lengths = np.array(sorted(need), dtype=np.int64)
    demand = np.array([need[int(x)] for x in lengths], dtype=float)
    at = {int(x): i for i, x in enumerate(lengths)}
    left, used = demand.copy(), defaultdict(float)
    mass = float((lengths * demand).sum())
    base = lengths / capacity * (1 + 0.03 * lengths / capacity)
    for _ in range(rounds):
        open_ = left > 1e-9 * demand
        if not open_.any():
            break
        done = 1 - float((lengths * left).sum()) / mass
        price = base * np.exp(-rate * ((1 - left / demand) - done))
        value, last = knapsack(price[open_], lengths[open_], capacity)
        worth = price[open_] + value[capacity - lengths[open_]]
        order = np.argsort(-worth, kind="stable")
        tried = 0
        for k in order:
            if tried and (worth[k] < (1 - slack) * worth[order[0]] or tried >= columns):
                break
            x = int(lengths[open_][k])
            config = counted([x, *unfold(last, capacity - x)])
            step = min(left[at[l]] / a for l, a in config)
            if step <= 0:
                continue
            step = min(step, max(share * min(demand[at[l]] / a for l, a in config), 1.0))
            used[config] += step
            for l, a in config:
                left[at[l]] = max(0.0, left[at[l]] - a * step)
            tried += 1
        if not tried:
            break
    return used


def completed(left: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Whole configurations for what rounding leaves: the longest open length with the fullest complement, repeated."""
    out: list[tuple[tuple, int]] = []
    left = {l: n for l, n in left.items() if n > 0}
    last, gone = None, 0
    while left:
        longest = max(left)
        if last is None or gone >= 12:
            lengths = np.array(sorted(left), dtype=np.int64)
            _, last = knapsack(lengths * (1 + 0.02 * lengths / capacity), lengths, capacity)
            gone = 0
        config: dict[int, int] = defaultdict(int)
        config[longest] = 1
        room = capacity - longest
        for x in unfold(last, room):
            if left.get(x, 0) > config[x]:
                config[x] += 1
                room -= x
        while fitting := [x for x in left if x <= room and left[x] > config[x]]:
            config[max(fitting)] += 1
            room -= max(fitting)
        config = {x: a for x, a in config.items() if a}
        times = min(left[x] // a for x, a in config.items())
        out.append((tuple(sorted(config.items(), reverse=True)), times))
        for x, a in config.items():
            left[x] -= a * times
            if not left[x]:
                del left[x]
                gone += 1
    return out


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Configurations for what rounding leaves, piece by piece: the longest first, each where the least room stays."""
    rooms: list[tuple[int, int]] = []  # sorted (room, sequence)
    held: list[list[int]] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            k = bisect_left(rooms, (length, 0))
            if k < len(rooms):
                room, sequence = rooms.pop(k)
            else:
                room, sequence = capacity, len(held)
                held.append([])
            held[sequence].append(length)
            insort(rooms, (room - length, sequence))
    return list(Counter(counted(items) for items in held).items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Configurations ((length, how many), ...) and how many sequences use each; together they place every piece.

    The fractional solution is rounded down, at some tries by a few uses of each configuration more, and what is left is
    completed in two ways; the try with the fewest sequences counts. What is left is bounded by the configurations, not by
    the corpus.
    """
    out = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    need = {l: n for l, n in histogram.items() if 0 < l < capacity and n > 0}
    if not need:
        return out
    least = -(-sum(l * n for l, n in need.items()) // capacity)
    used, best = sorted(fractional(need, capacity).items(), key=lambda c: -c[1]), None
    for fewer in (0, 1, 2, 4, 8, 16):
        left, whole = dict(need), []
        for config, x in used:
            times = min(int(x + 1e-9) - fewer, *(left.get(l, 0) // a for l, a in config))
            if times > 0:
                whole.append((config, times))
                for l, a in config:
                    left[l] -= a * times
        for complete in (completed, best_fit):
            tried = whole + complete(left, capacity)
            if best is None or sum(t for _, t in tried) < sum(t for _, t in best):
                best = tried
            if sum(t for _, t in best) == least:
                return out + best
    return out + best


def ranges(plan_: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences: sorted by (length, first rank)."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, times in plan_:
        offset = 0
        for length, a in config:
            rows.append((length, taken[length], sequence, a, offset))
            taken[length] += a * times
            offset += a * length
        sequence += times
    rows.sort()
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(("length", "rank", "sequence", "per", "offset"))}


RANKS = 1 << 44  # more pieces than one length can have


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written `pieces` (each row's bucket and nth give its rank without a sort)."""
    spark = made.sparkSession
    counts = staged(made.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    where = spark.sparkContext.broadcast(ranges(plan(histogram, capacity)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = made.join(counts.select("length", "bucket", before.alias("before")), ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = where.value
        n, r = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(t["length"] * RANKS + t["rank"], n * RANKS + r, side="right") - 1
        nth = r - t["rank"][k]
        return pd.DataFrame({"sequence_id": t["sequence"][k] + nth // t["per"][k], "offset": t["offset"][k] + nth % t["per"][k] * n})

    spot = ranked.withColumn("spot", place("length", F.col("before") + F.col("nth")))
    return spot.select(*[c for c in made.columns if c not in ("bucket", "nth")], "spot.sequence_id", "spot.offset")


def pack_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(staged(pieces(docs, tokenizer, id, text, capacity, end_id, keep_ids), "pack-pieces"), capacity)


def op2_pack_documents(spark, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
