"""Exact token counts of a byte-level BPE tokenizer by a compiled finite-state transducer.

The tokenizer is compiled, state by state as texts need it, into a deterministic transducer over characters whose
transitions say by how many tokens the encoding of what has been read grows (or shrinks). A state joins the state of the
pre-tokenizer with that of the pair encoding: for every place where a vocabulary entry may still be under way, its trie node,
the last token of the encoding up to there, and how many tokens ago that was. Whether a token may follow another is decided
once per pair, by encoding both together. Words that stand between single blanks start and end at token boundaries, so their
counts are remembered as a whole.

Long texts are cut into chunks. A chunk's map from entry state to exit state and count is kept as the part before its first
white space after other text, which depends on the entry, and the part from there on, which does not; maps compose by a
prefix scan, pairwise and in any grouping.

Null texts count as empty: no bytes, no tokens. Special strings in texts count as one token each, the library's default.
Repeated rows get equal counts, an empty table an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import text_of, tokenizer_path

LIMIT = 512
CHUNK = 1 << 16
#: States that a worker keeps. A memory bound only: forgotten states are compiled again.
STATES = 400_000
#: Words whose counts a worker remembers, likewise.
WORDS = 500_000
#: White space before a blank: the blank is no sure boundary.
LOOSE = re.compile(r"\s ")
BOUNDARY = re.compile(r"(?<=\S) ")

# Fixed values of the tokenizer family: white space, the endings that follow an apostrophe, and the bytes that its files
# write as themselves (the others are written as the characters from 256 on, in order).
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

# A state of the pair encoding: for each place where an entry is under way, in order, trie node, last token and tokens since
# then, packed into one number.
Pair = tuple
LAST, NODE, ZERO = 12, 32, 1 << 11


def byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairEncoding:
    """The pair encoding of growing byte strings. Within an encoding every two neighbours are the encoding of their joined
    bytes, and only one token can end at each place so that this holds; so the last token is all there is to know."""

    EMPTY: Pair = (ZERO,)

    def __init__(self, library) -> None:
        to_byte = byte_of()
        self.model = library.model
        self.written = {i: token for token, i in library.get_vocab(with_added_tokens=False).items() if all(c in to_byte for c in token)}
        self.child: dict[int, int] = {}  # by node and byte
        self.ends, self.inner = [-1], [True]
        for i, token in self.written.items():
            if self.encoded(token) != [i]:
                continue  # never the result of an encoding
            node = 0
            for c in token:
                self.inner[node] = True
                node = self.child.setdefault(node << 8 | to_byte[c], len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = i
        self.known: dict[tuple[int, int], bool] = {}

    def encoded(self, written: str) -> list[int]:
        return [t.id for t in self.model.tokenize(written)]

    def follows(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        known = self.known.get((last, token))
        if known is None:
            known = self.known[last, token] = self.encoded(self.written[last] + self.written[token]) == [last, token]
        return known

    def feed(self, state: Pair, data: bytes) -> tuple[Pair, int]:
        """The state after more bytes, and the change of the number of tokens."""
        total, of, ends, inner = 0, self.child.get, self.ends, self.inner
        for b in data:
            moved, new, grown = [], -1, 0
            for x in state:  # longest token first
                child = of(x >> NODE << 8 | b)
                if child is None:
                    continue
                if new < 0 <= ends[child] and self.follows((x >> LAST & 0xFFFFF) - 1, ends[child]):
                    new, grown = ends[child], (x & 0xFFF) - ZERO + 1
                if inner[child]:
                    moved.append(child << NODE | x & 0xFFFFFFFF)
            state = (*[x - grown for x in moved], new + 1 << LAST | ZERO)
            total += grown
        return state, total


class Transducer:
    """States are numbers; `steps` maps a state and a character to the next state and the change of the count."""

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.special = [t["content"] for t in json.loads(tokenizer)["added_tokens"] if t["special"]]
        self.pairs = PairEncoding(Tokenizer.from_str(tokenizer))
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.about: list[tuple[str, Pair, str]] = []
        self.final: list[int] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.start = self.state("start", PairEncoding.EMPTY, "")

    def state(self, mode: str, pair: Pair, extra: str) -> int:
        """Modes: start (at a token boundary), L, N, O (runs of letters, numbers, others), apostrophe (with the begun ending),
        space (a run of white space without its last character, which is `extra`)."""
        key = (mode, pair, extra)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.about)
            self.about.append(key)
            # What is added if the text ends here: the held-back part.
            if mode == "space":
                self.final.append(self.pairs.feed(pair, extra.encode())[1])
            elif mode == "apostrophe" and extra:
                self.final.append(self.pairs.feed(PairEncoding.EMPTY, extra.encode())[1])
            else:
                self.final.append(0)
        return found

    @staticmethod
    def kind(char: str) -> str:
        if char in SPACES:
            return "space"
        major = unicodedata.category(char)[0]
        return major if major in "LN" else "O"

    def begin(self, char: str, before: Pair, grown: int, after_space: bool) -> tuple[int, int]:
        """Enter a new pre-token with `char`; `before` has read the blank that belongs to it, if one does."""
        kind = self.kind(char)
        if kind == "space":
            return self.state("space", PairEncoding.EMPTY, char), grown
        pair, more = self.pairs.feed(before, char.encode("utf-8", "surrogatepass"))
        if char == "'" and not after_space:
            return self.state("apostrophe", pair, ""), grown + more
        return self.state(kind, pair, ""), grown + more

    def step(self, s: int, char: str) -> tuple[int, int]:
        mode, own, held = self.about[s]
        kind, data, feed = self.kind(char), char.encode("utf-8", "surrogatepass"), self.pairs.feed
        if mode == "start":
            return self.begin(char, PairEncoding.EMPTY, 0, False)
        if mode == "space":
            if kind == "space":
                pair, grown = feed(own, held.encode())
                return self.state("space", pair, char), grown
            pair, grown = feed(PairEncoding.EMPTY, held.encode())
            if held == " ":
                return self.begin(char, pair, grown, True)
            return self.begin(char, PairEncoding.EMPTY, grown, False)
        if mode == "apostrophe":
            begun = held + char
            if begun in ENDINGS:
                return self.start, feed(own, begun.encode())[1]
            if any(e.startswith(begun) for e in ENDINGS):
                return self.state("apostrophe", own, begun), 0
            if held:  # the apostrophe stood alone, and letters have begun
                pair, grown = feed(PairEncoding.EMPTY, held.encode())
                after, more = self.step(self.state("L", pair, ""), char)
                return after, grown + more
            if kind == "O":
                pair, grown = feed(own, data)
                return self.state("O", pair, ""), grown
            return self.begin(char, PairEncoding.EMPTY, 0, False)
        if kind == mode:
            pair, grown = feed(own, data)
            return self.state(kind, pair, ""), grown
        return self.begin(char, PairEncoding.EMPTY, 0, False)

    def run(self, state: int, text: str) -> tuple[int, int]:
        n, known = 0, self.steps.get
        for char in text:
            key = state << 21 | ord(char)
            step = known(key)
            if step is None:
                step = self.steps[key] = self.step(state, char)
            state, grown = step
            n += grown
        return state, n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if len(self.about) > STATES:
            self.forget()
        parts = [text]
        for special in self.special:
            parts = [p for part in parts for p in part.split(special)]
        total = sum(1 for _ in parts) - 1
        return total + sum(self.plain(p) for p in parts)

    def plain(self, text: str) -> int:
        first, *rest = BOUNDARY.split(text) if LOOSE.search(text) else text.split(" ")
        total, words = self.whole(first), self.words
        for word in rest:
            n = words.get(word)
            if n is None:
                if len(words) >= WORDS:
                    words.clear()
                n = words[word] = self.whole(" " + word)
            total += n
        return total

    def whole(self, text: str) -> int:
        """Tokens of a text that starts and ends at boundaries."""
        if len(text) <= CHUNK:
            state, n = self.run(self.start, text)
            return n + self.final[state]
        maps = [ChunkMap.of(self, text[k:k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [a.then(b, self) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1:]
        return maps[0].total(self)


@dataclass
class ChunkMap:
    """What a chunk does to any entry state: `head` is read from it; from the first sure boundary on, exit and count are fixed."""

    head: str
    exit: int | None
    count: int

    @classmethod
    def of(cls, machine: Transducer, chunk: str) -> ChunkMap:
        for k in range(1, len(chunk)):
            if chunk[k] in SPACES and chunk[k - 1] not in SPACES:
                return cls(chunk[:k], *machine.run(machine.start, chunk[k:]))
        return cls(chunk, None, 0)

    def then(self, other: ChunkMap, machine: Transducer) -> ChunkMap:
        if self.exit is None:
            return ChunkMap(self.head + other.head, other.exit, other.count)
        state, n = machine.run(self.exit, other.head)
        if other.exit is None:
            return ChunkMap(self.head, state, self.count + n)
        return ChunkMap(self.head, other.exit, self.count + n + machine.final[state] + other.count)

    def total(self, machine: Transducer) -> int:
        state, n = machine.run(machine.start, self.head)
        return n + machine.final[state] + (self.count + machine.final[self.exit] if self.exit is not None else 0)


def count_tokens(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `tokenizer` is the path of a byte-level BPE file."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast({"file": f.read()})

    @F.pandas_udf("long")
    def tokens(texts):
        import pandas as pd

        state = model.value  # stays in the worker between tasks, and with it the states compiled so far
        if "machine" not in state:
            state["machine"] = Transducer(state["file"])
        return pd.Series([state["machine"].count(t) for t in texts], dtype="int64")

    body = text_of(text)
    counted = docs.select(F.col(f"`{id}`").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), tokens(body).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, folder: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
