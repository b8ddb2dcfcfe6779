"""Sampled SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a model that spell a text form a lattice. Going forward, the log weight of all ways to reach each place is
summed; going backward from the end, each piece is drawn with its share of that sum. Draws come from a hash of the row key,
the word's number and the step, so a row's segmentation depends on nothing else. No piece spans the boundary before a blank
that follows other text, so the lattice is filtered word by word, once for each distinct word that a worker meets, and all
words of a batch are sampled together, one backward step at a time.

A piece weighs 1 / (2 + rank) ** sharpness, by its rank in the model: small values spread over many segmentations, large ones
approach a single best. Characters without a piece, and the model's own blank mark where it stands in a text, become byte
pieces, so every text decodes to itself. Null texts count as empty and have the pieces of the mark before the text only. Rows
with equal keys and texts get equal pieces; null keys share one seed. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import id_text, text_of, tokenizer_path

MARK = "▁"
SET_ASIDE = "\ud800"  # in no valid text: stands for a mark in the text until it is spelled in bytes
#: Words whose filtered lattices a worker keeps. A memory bound only: forgotten ones are filtered again.
WORDS = 120_000
BOUNDARY = re.compile("(?<=[^ ]) ")
GRID = 2.0**24  # shares and draws are multiples of its inverse
CHARS = 700_000  # characters that are sampled together


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary: texts, weights and bytes of pieces."""

    def __init__(self, model: bytes, sharpness: float) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=model)
        self.bytes: list[bytes] = []
        self.of_byte: dict[int, int] = {}
        beginnings: dict[str, int] = {}
        weight: list[float] = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            weight.append(0.0)
            if p.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes.append(b"" if p.is_control(i) or p.is_unknown(i) else piece.replace(MARK, " ").encode())
            if self.bytes[i]:
                assert not re.search("[^▁]▁|\n", piece), "pieces span word boundaries"
                weight[i] = (2.0 + len(beginnings)) ** -sharpness
                beginnings[piece] = i
        self.longest = max(map(len, beginnings))
        # Every beginning of a piece by its hash: the piece it is, or -1.
        for piece in list(beginnings):
            for k in range(1, len(piece)):
                beginnings.setdefault(piece[:k], -1)
        hashes = np.array([hashed(x) for x in beginnings], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece_of, self.weight = hashes[order], np.array(list(beginnings.values()))[order], np.array(weight)


BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def hashed(text: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes(text):
        h = h * BASE + c
    return h[0]


class Sampler:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.spelled: list[list[int]] = []  # byte pieces of characters that have several, numbered after the vocabulary
        self.spelling: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}  # number
        self.first, self.last = np.empty(0, np.int64), np.empty(0, np.int64)  # first and last node of each word
        self.nodes = 0
        self.bound, self.piece, self.back = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)

    def filter(self, words: list[str]) -> None:
        """Number the places (nodes) of new words and keep, for each, what may end there and its cumulated share.

        All words advance together, place by place. Shares lie on a grid, so that adding a node's number keeps them exact.
        """
        p, text = self.pieces, "".join(words)
        size = np.array([len(w) for w in words])
        code, word = codes(text), np.repeat(np.arange(len(words)), size)
        local = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        left = size[word] - local
        alive, h, single = np.arange(len(code)), np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
        starts, lengths, found_pieces = [], [], []
        for length in range(1, p.longest + 1):
            keep = left[alive] >= length
            alive, h = alive[keep], h[keep]
            if not len(alive):
                break
            h = h * BASE + code[alive + (length - 1)]
            k = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
            known = p.hashes[k] == h
            alive, h, k = alive[known], h[known], k[known]
            whole = p.piece_of[k] >= 0
            starts.append(alive[whole])
            lengths.append(np.full(int(whole.sum()), length))
            found_pieces.append(p.piece_of[k][whole])
            if length == 1:
                single[alive[whole]] = True
        bare = np.flatnonzero(~single)
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        found_pieces.append(np.array([self.fallback(text[g]) for g in bare], np.int64))
        start, length, piece = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, found_pieces))
        weight = np.ones(len(piece))
        weight[:len(piece) - len(bare)] = p.weight[piece[:len(piece) - len(bare)]]
        place = local[start] + length
        order = np.lexsort((length, word[start], place))
        start, length, piece, weight, place = (x[order] for x in (start, length, piece, weight, place))
        from_, to = start + word[start], start + word[start] + length  # each word has one node more than characters
        mass = np.zeros(len(code) + len(words))
        first = np.cumsum(size + 1) - (size + 1)
        mass[first] = 1.0
        share = np.empty(len(piece))
        cuts = np.searchsorted(place, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            share[a:b] = mass[from_[a:b]] * weight[a:b]
            np.add.at(mass, to[a:b], share[a:b])
            share[a:b] /= mass[to[a:b]]
            # Later places need masses relative to each other only, as far back as a piece reaches within the word.
            for node in np.unique(to[a:b][mass[to[a:b]] < 1e-200]):
                mass[max(node - place[a], node - p.longest + 1):node + 1] *= 1e200
        order = np.lexsort((length, to))
        share, to, piece, length = share[order], to[order], piece[order], length[order]
        opens = np.r_[True, to[1:] != to[:-1]] if len(to) else np.zeros(0, bool)
        nth = np.arange(len(to)) - np.maximum.accumulate(np.where(opens, np.arange(len(to)), 0))
        for k in range(1, int(nth.max(initial=0)) + 1):
            at = np.flatnonzero(nth == k)
            share[at] += share[at - 1]
        share[np.r_[opens[1:], True] if len(to) else opens] = 1.0
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.first, self.last = np.r_[self.first, first + self.nodes], np.r_[self.last, first + size + self.nodes]
        self.bound = np.r_[self.bound, to + self.nodes + np.ceil(share * GRID) / GRID]
        self.piece, self.back = np.r_[self.piece, piece.astype(np.int32)], np.r_[self.back, length.astype(np.int32)]
        self.nodes += len(mass)

    def fallback(self, char: str) -> int:
        data = (MARK if char == SET_ASIDE else char).encode("utf-8", "surrogatepass")
        if len(data) == 1:
            return self.pieces.of_byte[data[0]]
        if char not in self.spelling:
            self.spelling[char] = len(self.pieces.bytes) + len(self.spelled)
            self.spelled.append([self.pieces.of_byte[b] for b in data])
        return self.spelling[char]

    def words_of(self, text: str) -> list[str]:
        """The words of a text, each with its mark. Line feeds, which no piece holds, are words of their own."""
        text = text.replace(MARK, SET_ASIDE)
        words: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                words.append("\n")
            parts = BOUNDARY.split(line) if "  " in line or line[:1] == " " else line.split(" ")
            words += [MARK + p.replace(" ", MARK) for p in parts] if k == 0 else self.later(line, parts)
        return words

    @staticmethod
    def later(line: str, parts: list[str]) -> list[str]:
        """The words of a further line: what comes first has no mark of its own."""
        head = [parts[0].replace(" ", MARK)] if parts[0] else []
        return head + [MARK + p.replace(" ", MARK) for p in parts[1:]]

    def sample(self, keys: np.ndarray, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, drawn by its key."""
        if len(self.words) > WORDS:
            self.forget()
        parts = [self.words_of(t) for t in texts]
        new = [w for w in dict.fromkeys(w for words in parts for w in words) if w not in self.words]
        if new:
            self.filter(new)
        counts = np.array([len(words) for words in parts])
        starts = np.cumsum(counts) - counts
        of = self.words.__getitem__
        at = np.fromiter((of(w) for words in parts for w in words), np.int64, int(counts.sum()))
        node, root = self.last[at], self.first[at]
        number = np.arange(len(node)) - np.repeat(starts, counts)
        seed = mixed(np.repeat(keys, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # equal words lie together, so that looking up their shares stays in the cache
        alive, taken, step = np.argsort(at, kind="stable"), [], 0
        while len(alive):
            u = (mixed(seed[alive] + np.uint64(step)) >> np.uint64(40)).astype(np.float64) / GRID
            k = np.searchsorted(self.bound, node[alive] + u, side="right")
            taken.append((alive, self.piece[k]))
            node[alive] -= self.back[k]
            alive = alive[node[alive] > root[alive]]
            step += 1
        length = np.zeros(len(node), dtype=np.int64)
        for at, _ in taken:
            length[at] += 1
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (at, piece) in enumerate(taken):
            out[ends[at] - 1 - step] = piece
        borders = np.r_[0, ends[starts + counts - 1]] if len(texts) else np.zeros(1, np.int64)
        return [self.spell(out[a:b]) for a, b in zip(borders, borders[1:])]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = len(self.pieces.bytes)
        if not len(ids) or ids.max() < size:
            return ids
        return np.array([x for i in ids.tolist() for x in ([i] if i < size else self.spelled[i - size])], np.int32)


def model_of(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast({"file": f.read()})


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", sharpness: float = 1.0, seed: int = 0,
           verify: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit) of one sampled segmentation of every row, and its text.

    With `verify` the text is replaced by `lossless`: whether the ids decode to it, found where they are made.
    """
    shared = model_of(docs, model)

    def sample(batches):
        import pandas as pd

        state = shared.value  # stays in the worker between tasks, and with it the words filtered so far
        if "sampler" not in state:
            state["sampler"] = Sampler(Pieces(state["file"], sharpness))
        sampler = state["sampler"]
        for pdf in batches:
            ids, keys, texts, at = pdf["doc_id"], pdf["key"].to_numpy().astype(np.int64).view(np.uint64), pdf["text"].tolist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS):
                    size += len(texts[to])
                    to += 1
                made, lot = sampler.sample(keys[at:to], texts[at:to]), texts[at:to]
                out = pd.DataFrame({"doc_id": ids.iloc[at:to].array, "ids": [x.astype("<i4").tobytes() for x in made]})
                if verify:
                    out["lossless"] = [spelling(sampler.pieces.bytes, x) == t for x, t in zip(made, lot)]
                else:
                    out["text"] = lot
                yield out
                at = to

    # Not a column function: Spark would evaluate one again for every function that is applied to its result.
    key = F.xxhash64(F.col(f"`{id}`").cast("string"), F.lit(seed))
    rows = docs.select(id_text(id), text_of(text).alias("text"), key.alias("key"))
    made = rows.mapInPandas(sample, "doc_id string, ids binary, " + ("lossless boolean" if verify else "text string"))
    return made.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id]))


def decode(docs: DataFrame, ids: Column, model: str) -> Column:
    """The text that packed ids spell."""
    shared = model_of(docs, model)

    @F.pandas_udf("string")
    def spelled(packed):
        import pandas as pd

        state = shared.value
        if "bytes" not in state:
            state["bytes"] = Pieces(state["file"], 1.0).bytes
        return pd.Series([spelling(state["bytes"], np.frombuffer(x, "<i4")) for x in packed], dtype=object)

    return spelled(ids)


def spelling(pieces: list[bytes], ids: np.ndarray) -> str:
    """The text of ids, without the mark before it."""
    return plain(b"".join(map(pieces.__getitem__, ids.tolist())))


def plain(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")[1:]


def op5_sentencepiece_sampling(spark, folder: str) -> DataFrame:
    """Per document, the number and checksum of its sampled pieces, and whether they decode to its whole text."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = encode(docs, model, verify=True)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "lossless")
