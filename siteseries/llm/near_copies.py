"""Near-dedup by SimHash candidates and the Jaccard similarity of five-word shingles, verified on the whole shingle sets.

Equal shingle sets are one node, with a SimHash of 256 bits of its distinct shingles; at a Jaccard similarity of 0.8 a bit of two
nodes differs with probability 0.15 at most. Nodes meet at anchors, which are drawn subsets of those bits: as many bits as leave
some 256 nodes at an anchor, and as many anchors as a pair at exactly 0.8 misses altogether with probability 0.001 or less (48 at
least, which miss 0.0001 up to 260,000 nodes). Fingerprints that differ in 66 bits or fewer are candidates (38.8 expected at
0.8, standard deviation 5.7), and the components of candidates are compared on the sets themselves: a link is never made or
refused by a sketch, and a set travels once.

Of a component only a spanning forest of the similar pairs is emitted, and crowded ones are split over several tasks (`crowds`). Words are
those of `simhash`: A-Z lowered, split at ASCII white space. A text of fewer than five words is one shingle; texts without
words, null among them, have the empty set and equal each other only. Of each component the row with the smallest doc_id
(nulls last) stays. An empty table gives an empty result. Other columns are carried unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm import crowds
from siteseries.llm.common import packed, sized, staged, text_of
from siteseries.llm.components import components
from siteseries.llm.crowds import LEAST, strangers, verified
from siteseries.llm.line_dedup import WORDS_KEPT, WordHashes
from siteseries.llm.simhash import cells_of

WORDS, PERCENT = 5, 80
LANES, LIMIT = 4, 66  # 64-bit words of a fingerprint, and the bits in which candidates may differ
ANCHORS, CROWD, MISSED = 48, 8, 0.001  # least anchors of a node, log2 of the nodes of one, and pairs at the threshold that may miss
APART = 0.1516  # of the bits of two sets of equal size, at a similarity of 0.8
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOT = 1 << 20  # pairs compared at once
GUESTS = 1 << 17  # visitors of an anchor that a task holds at once


class ShingleReader:
    """Sorted distinct hashes of a text's shingles; the hash of a word is kept for later texts."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, WordHashes()

    def shingles(self, text: str) -> np.ndarray:
        ws = text.encode("utf-8", "surrogatepass").lower().split()
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        width = min(self.words, len(h))
        if not width:
            return h
        count = len(h) - width + 1
        made = np.full(count, width, np.uint64)
        for k in range(width):
            made = (made ^ h[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
            made ^= made >> np.uint64(29)
        return np.unique(made)


def fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of a set: a bit is set if it is set in over half of the shingles, mixed anew for every word of it."""
    counts = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(shingles), 4096):
        h = shingles[at:at + 4096]
        h = (h[None, :] ^ (h[None, :] >> np.uint64(31))) * FACTORS[:, None]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))).astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(LANES, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").tobytes()


def layout(nodes: int) -> tuple[int, int]:
    """(bits of an anchor, anchors of a node) for that many nodes."""
    bits = max(8, int(nodes).bit_length() - CROWD)
    return bits, max(ANCHORS, int(np.ceil(np.log(MISSED) / np.log1p(-(1 - APART) ** bits))))


def words_of(column) -> np.ndarray:
    """The fingerprints of an Arrow column as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, LANES)


def anchored(fps: DataFrame, bits: int, anchors: int) -> DataFrame:
    """(anchor, own, fp): each fingerprint at the anchors of its drawn bits."""
    rng = np.random.default_rng(13)
    drawn = np.array([rng.permutation(64 * LANES)[:bits] for _ in range(anchors)])

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fp = batch.column("fp").slice(at, 1000)
                set_ = np.unpackbits(words_of(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                anchor = np.zeros((len(fp), anchors), np.int64)
                for k in range(bits):
                    anchor += set_[:, drawn[:, k]].astype(np.int64) << k
                anchor = anchor * anchors + np.arange(anchors)
                rows = pa.array(np.repeat(np.arange(len(fp)), anchors))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.ravel()), pa.array(np.ones(anchor.size, bool)), fp.take(rows)], ["anchor", "own", "fp"])

    return fps.select("fp").mapInArrow(visit, "anchor long, own boolean, fp binary")


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n items linked by i and j, the least item that each is connected to."""
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root.copy())
        root = root[root]
        if (root == before).all():
            return root


def close(homes: np.ndarray, others: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows of words) that connect all close pairs of a home and another, or of two homes."""
    right = homes if others is None else others
    found = [np.empty((2, 0), np.int64)]
    step = max(1, LOT // max(1, len(right)))
    for at in range(0, len(homes), step):
        some = homes[at:at + step]
        d = np.zeros((len(some), len(right)), np.uint16)
        for lane in range(LANES):
            d += np.bitwise_count(some[:, lane, None] ^ right[None, :, lane])
        i, j = np.nonzero((d <= LIMIT) & (d > 0))
        found.append(np.stack([i + at, j]))
        if others is None:
            found[-1] = found[-1][:, i + at < j]
    i, j = np.concatenate(found, axis=1)
    if others is None:
        root = joined(len(homes), i, j)
        linked = np.flatnonzero(root != np.arange(len(homes)))
        return homes[linked], homes[root[linked]]
    both = np.concatenate([homes, others])
    root = joined(len(both), i, j + len(homes))
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[linked], both[root[linked]]


def candidates(fps: DataFrame) -> DataFrame:
    """(node, root) of the components of close fingerprints (column fp, distinct)."""
    cells = cells_of(staged(anchored(fps, *layout(fps.count())), "near-anchors"), "fp", alike=True)

    def compare(batches):
        import pyarrow as pa

        def found(own, words):
            a, b = close(words[own], None if own.all() else words[~own])
            a, b = (pa.array([row.tobytes() for row in side], pa.binary()) for side in (a, b))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        key, own, words = np.empty((0, 2), np.int64), np.empty(0, bool), np.empty((0, LANES), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "own")]
            key = np.concatenate([key, np.stack(more[:2], axis=1).astype(np.int64)])
            own, words = np.concatenate([own, more[2].astype(bool)]), np.concatenate([words, words_of(batch.column("fp"))])
            edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1]
            for first, last in zip(edge, edge[1:]):
                if last - first > 1:
                    yield found(own[first:last], words[first:last])
            key, own, words = key[edge[-1]:], own[edge[-1]:], words[edge[-1]:]
            if len(own) - own.sum() >= GUESTS:  # its homes stay for the visitors to come
                yield found(own, words)
                key, words, own = key[own], words[own], own[own]
        if len(own) > 1:
            yield found(own, words)

    links = cells.select("anchor", "part", "own", "fp").mapInArrow(compare, "a binary, b binary")
    return components(links)


def marked_column(text: Column, words: int) -> Column:
    """The node of a text (digest of its shingle set) and its fingerprint, null for the empty set."""
    @F.pandas_udf("node binary, fp binary")
    def marked(texts):
        import hashlib

        import pandas as pd

        reader, nodes, fps = ShingleReader(words), [], []
        for t in texts:
            found = reader.shingles(t)
            nodes.append(hashlib.md5(found.tobytes()).digest())
            fps.append(fingerprint(found) if len(found) else None)
        return pd.DataFrame({"node": nodes, "fp": fps})

    return marked(text)


def set_column(text: Column, words: int) -> Column:
    @F.pandas_udf("binary")
    def sets(texts):
        import pandas as pd

        reader = ShingleReader(words)
        return pd.Series([reader.shingles(t).tobytes() for t in texts], dtype=object)

    return sets(text)


def similar_nodes(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the rows' (node, fp, body) nodes that have a similar one."""
    nodes = staged(rows.where("fp IS NOT NULL").groupBy("node").agg(F.min("fp").alias("fp")), "near-fingerprints")
    roots = staged(candidates(nodes.select("fp").distinct()), "near-candidates")
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    placed = staged(placed.select("node", F.coalesce("root", "fp").alias("anchor")), "near-placed")
    shared = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    visits = staged(placed.join(shared, "anchor", "left_semi"), "near-visits")
    body = rows.join(sized(visits.select("node")), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    sets = body.select("node", set_column(F.col("body"), words).alias("set")).withColumn("size", F.greatest(F.length("set"), F.lit(LEAST)))
    sets = staged(sets, "near-sets")

    def links(some: DataFrame, name: str) -> DataFrame:
        return staged(verified(sized(some).join(sets, "node").select("anchor", "node", "guest", "set", "size"), percent, F.col("size")), name)

    first = links(visits.select("anchor", "node", F.lit(False).alias("guest")), "near-first")
    crowded = visits.join(sets.select("node", "size"), "node")
    crowded = crowded.groupBy("anchor").agg(F.sum("size").alias("all")).where(F.col("all") > crowds.BYTES).select("anchor")
    again = visits.join(crowded, "anchor", "left_semi")  # others were compared whole
    second = links(staged(strangers(again, staged(components(first), "near-joined")), "near-again"), "near-second")
    return components(first.unionByName(second))


def similar_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one with the smallest doc_id (nulls last)."""
    rows = docs.select(packed(docs), F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("body"))
    rows = rows.withColumn("marked", marked_column(F.col("body"), words))
    rows = staged(rows.select("row", "doc_id", "marked.node", "marked.fp"), "near-rows")
    roots = staged(similar_nodes(rows.withColumn("body", text_of_row(text)), words, percent), "near-roots")
    order = F.struct(F.col("first").isNull().alias("none"), "first", "node")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "near-nodes")
    where = nodes.join(roots, "node", "left").select("node", "n", "first", F.coalesce("root", "node").alias("root"))
    keep = where.groupBy("root").agg(F.min(order).alias("k")).select("k.node", F.lit(True).alias("stays"))
    where = where.join(keep, "node", "left").select("node", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    changed = sized(staged(where.where("n > 1 OR NOT stays").select("node", "stays"), "near-changed"))
    alone = rows.join(changed, "node", "left_anti").select("row.*")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    folded = (rows.join(changed.where("stays"), "node", "left_semi").groupBy("node")
              .agg(F.min_by("row", order).alias("row")).select("row.*"))
    return alone.unionByName(folded)


def text_of_row(text: str) -> Column:
    """The text inside a packed row; null counts as empty."""
    return F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
