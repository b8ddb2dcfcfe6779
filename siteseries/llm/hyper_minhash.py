"""MinHash near-dedup on HyperMinHash sketches, verified on the whole shingle sets.

A text's set holds its distinct five-word shingles (fewer words: the whole sequence is one). Equal sets are one node. The
shingles of a set are dealt to 128 buckets by their hash; of the least hash of each bucket a register of two bytes keeps the
number of leading zeros (six bits) and the ten bits behind the first one. 25 bands of five registers are the keys under which
nodes meet; an empty bucket takes the register of the next filled one, with its distance. Registers of a band are spread over
the buckets, so a pair at exactly 0.85 shares no key with probability (1 - 0.85^5)^25, about 4e-7, and closer pairs less. That
holds for sets that fill the buckets. Small sets, whose registers are few and repeat, meet under their least hashes instead, as
many as make it certain: a set of n hashes shares one of its least n - ceil(0.85 n) + 1 with every set similar to it.

Nodes that meet are compared by their registers first: equal registers, less the collisions expected of two-byte registers for
sets of that size, over the registers filled in either, estimate the similarity. Only nodes with a partner whose estimate lies
no more than six standard errors below the threshold go on, and are decided on their whole sets; a sketch alone never makes
a link and refuses one that holds with a probability of 1e-9.

Two rounds keep crowds of near copies linear. The first takes a few keys of each node and cuts crowded ones into parts that
are compared on their own. The second takes all keys whose nodes are not yet in one component: there the nodes outside the
key's largest component are shown to every part, so that any two nodes of different components meet, and no others need to.
At a key a spanning forest of the similar pairs is emitted, never all of them.

Words are split at ASCII white space after A-Z were lowered. Texts without words, null among them, have an empty set and are
linked with nothing: each is its own component. Repeated rows, same doc_id or not, share a node. A null doc_id never names a
component unless all its rows have none. Ties need no rule: components do not depend on order. An empty table gives an
empty result. Extra columns are not read by `hyper_groups` and carried unchanged by `hyper_dedup`, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import packed, sized, staged, text_of
from siteseries.llm.components import components
from siteseries.llm.crowds import by_part, dealt, strangers, verified
from siteseries.llm.near_copies import ShingleReader, set_column

WORDS, PERCENT = 5, 85
BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS, FIRST = 25, 5, 4  # keys of a node, registers of a key, and keys of the first round
ERRORS = 6  # standard errors below the threshold at which a pair is still verified
SMALL = 80  # hashes up to which a set meets others by its least hashes
HOMES, LOT = 2048, 1 << 16  # sketches of a part, and visitors, that one task compares at once
#: The buckets of each band, spread so that neighbours, which may share a borrowed register, are in different bands.
SPREAD = np.random.default_rng(5).permutation(BUCKETS)[:BANDS * ROWS].reshape(BANDS, ROWS)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes: (leading zeros + 1) and mantissa of the least rest; 0 of an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    at = np.searchsorted(shingles, _EDGES)
    filled = np.flatnonzero(np.diff(at, append=len(shingles)))
    if len(filled):
        # 53 of the 57 bits behind the bucket number, which a double holds exactly.
        rest = (shingles[at[filled]] << np.uint64(BUCKET_BITS)) >> np.uint64(11)
        size = np.frexp(rest.astype(np.float64))[1]
        whole = (rest << (53 - size).astype(np.uint64)) & np.uint64((1 << 52) - 1)
        out[filled] = ((54 - size) << MANTISSA) | (whole >> np.uint64(52 - MANTISSA)).astype(np.int64)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """The keys under which a sketch meets similar ones; none for the empty set."""
    filled = np.flatnonzero(registers)
    if not len(filled):
        return np.empty(0, np.int64)
    after = np.searchsorted(filled, np.arange(BUCKETS))
    source = filled[after % len(filled)]
    distance = (source - np.arange(BUCKETS)) % BUCKETS
    value = (registers[source].astype(np.uint64) | (distance.astype(np.uint64) << np.uint64(16)))[SPREAD]
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in value.T:
        key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def keys_of(shingles: np.ndarray, registers: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys and the least hashes under which a set meets similar ones. Of two similar sets either both have all
    band keys or both have the least hashes they need; between the two sizes a set has both."""
    n = len(shingles)
    bands = band_keys(registers) if n > SMALL else np.empty(0, np.int64)
    least = shingles[:n - -(-percent * n // 100) + 1].view(np.int64) if 0 < percent * n <= 100 * SMALL else np.empty(0, np.int64)
    return bands, least


@lru_cache(maxsize=512)
def _chance(quarter_octaves: int) -> float:
    """Probability that a register of two unrelated sets of 2^(quarter_octaves / 4) hashes collides."""
    n = 2.0 ** (quarter_octaves / 4)
    zeros = np.arange(1, 54)[:, None]
    low = (2.0 ** MANTISSA + np.arange(2 ** MANTISSA)[None, :]) / 2.0 ** (BUCKET_BITS + MANTISSA + zeros)
    high = low + 2.0 ** -(BUCKET_BITS + MANTISSA + zeros)
    return float(((np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-high))) ** 2).sum())


def collision_chance(n: int) -> float:
    return _chance(round(4 * np.log2(max(n, 1))))


def estimates(one: np.ndarray, many: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of one sketch with many, and how many registers it rests on."""
    either = np.maximum(((many != 0) | (one != 0)).sum(axis=1), 1)
    equal = ((many == one) & (one != 0)).sum(axis=1)
    return (equal - either * chance) / (either * (1 - chance)), either


def plausible(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of many sketches may belong to a set similar to one's: sizes exactly, registers within the errors."""
    fits = (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
    at = np.flatnonzero(fits)
    if len(at):
        p = percent / 100
        guess, n = estimates(one, many[at], collision_chance(size))
        fits[at] = guess >= p - ERRORS * np.sqrt(p * (1 - p) / n)
    return fits


def clusters(homes: tuple[np.ndarray, np.ndarray], guests: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster numbers (-1: none) of homes and guests, both (sizes, sketches), that plausible pairs of a home and a guest connect."""
    labels = np.full(len(homes[0]), -1), np.full(len(guests[0]), -1)
    now = 0
    for seed in range(len(homes[0])):
        if labels[0][seed] >= 0:
            continue
        labels[0][seed], queue = now, [(0, seed)]
        while queue:
            side, k = queue.pop()
            me, you = ((homes, guests), (guests, homes))[side]
            free = np.flatnonzero(labels[1 - side] < 0)
            if len(free):
                hit = free[plausible(me[1][k], int(me[0][k]), you[1][free], you[0][free], percent)]
                labels[1 - side][hit] = now
                queue += [(1 - side, int(j)) for j in hit]
        now += 1
    return labels


def marked_column(text: Column, words: int, percent: int) -> Column:
    """The node of a text (digest of its set), the set's size, its registers, its band keys and its least hashes."""
    @F.pandas_udf("node binary, n long, sketch binary, keys array<long>, least array<long>")
    def marked(texts):
        import hashlib

        import pandas as pd

        reader, rows = ShingleReader(words), []
        for t in texts:
            found = reader.shingles(t)
            registers = sketch(found)
            rows.append((hashlib.md5(found.tobytes()).digest(), len(found), registers.tobytes(), *keys_of(found, registers, percent)))
        return pd.DataFrame(rows, columns=["node", "n", "sketch", "keys", "least"])

    return marked(text)


def promising(visits: DataFrame, percent: int) -> DataFrame:
    """Visits (anchor, node, guest) whose anchors are the clusters of plausible pairs of visits (anchor, node, guest, n, sketch)."""
    cells = dealt(visits, F.lit(1), HOMES)

    def split(batches):
        import pandas as pd

        out, lots = [], 0
        for key, homes, guests in by_part(batches, lambda item: 1, LOT):
            both = homes, homes if guests is None else guests
            arrays = [(np.array([x[2] for x in some], np.int64), np.frombuffer(b"".join(bytes(x[3]) for x in some), np.uint16).reshape(-1, BUCKETS))
                      for some in both]
            lots += 1
            for some, labels in zip(both[:1] if guests is None else both, clusters(*arrays, percent)):
                out.extend((*key, lots, k, bytes(x[0]), x[1]) for x, k in zip(some, labels.tolist()) if k >= 0)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["anchor", "part", "lot", "label", "node", "guest"])
                out = []
        yield pd.DataFrame(out, columns=["anchor", "part", "lot", "label", "node", "guest"])

    found = cells.select("anchor", "part", "own", "node", "guest", "n", "sketch").mapInPandas(
        split, "anchor long, part int, lot long, label int, node binary, guest boolean")
    return found.groupBy(F.xxhash64("anchor", "part", "lot", "label").alias("anchor"), "node").agg(F.max("guest").alias("guest"))


def similar_nodes(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the written rows' (node, n, sketch, keys, least, body) nodes that have a similar one."""
    filled = rows.where("n > 0")
    nodes = staged(filled.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
                                              F.first("least").alias("least")), "hyper-nodes")

    def links(some: DataFrame, name: str) -> DataFrame:
        meet = staged(promising(some.join(nodes.select("node", "n", "sketch"), "node"), percent), f"{name}-meet")
        several = meet.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        meet = meet.join(several, "anchor", "left_semi")
        wanted = staged(meet.select("node").distinct(), f"{name}-wanted")
        body = filled.join(sized(wanted), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
        sets = staged(body.select("node", set_column(F.col("body"), words).alias("set")), f"{name}-sets")
        return staged(verified(meet.join(sets, "node").select("anchor", "node", "guest", "set"), percent), f"{name}-links")

    visits = nodes.select("node", F.posexplode("keys").alias("band", "anchor")).unionByName(
        nodes.select("node", F.lit(0).alias("band"), F.explode("least").alias("anchor")))
    early = visits.where(F.col("band") < FIRST).select("node", "anchor")
    shared = early.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    first = links(staged(early.join(shared, "anchor").select("anchor", "node", F.lit(False).alias("guest")), "hyper-first"), "hyper-first")

    joined = staged(components(first), "hyper-joined")
    second = strangers(visits, joined)
    return components(first.unionByName(links(staged(second, "hyper-second"), "hyper-second")))


def component_map(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root, component_id) of the nodes that more than one row or a similar node shares."""
    roots = staged(similar_nodes(rows, words, percent), "hyper-roots")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    where = staged(nodes.join(roots, "node", "left").where("n > 1 OR root IS NOT NULL")
                   .select("node", "first", F.coalesce("root", "node").alias("root")), "hyper-shared")
    least = where.groupBy("root").agg(F.min("first").alias("component_id"))
    return staged(where.join(least, "root").select("node", "root", "component_id"), "hyper-map")


def _marked(docs: DataFrame, id: str, text: str, words: int, percent: int, *more: Column) -> DataFrame:
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("body"), *more)
    rows = rows.withColumn("marked", marked_column(F.col("body"), words, percent))
    return staged(rows.select("*", "marked.*").drop("marked"), "hyper-rows")


def hyper_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept."""
    rows = _marked(docs, id, text, words, percent)
    where = sized(component_map(rows, words, percent).select("node", "component_id", F.lit(True).alias("shared")))
    named = rows.where("n > 0").select("doc_id", "n", "node").join(where, "node", "left")
    named = named.select("doc_id", "n", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    named = named.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def hyper_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: of each component one with the smallest doc_id (nulls last)."""
    rows = _marked(docs, id, text, words, percent, packed(docs))
    where = sized(component_map(rows, words, percent).select("node", "root"))
    some = rows.select("row", "doc_id", "node", "n")
    alone = some.where("n = 0").select("row.*").unionByName(some.where("n > 0").join(where, "node", "left_anti").select("row.*"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    first = some.where("n > 0").join(where, "node").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row.*")
    return alone.unionByName(first)


def op13_hyper_minhash(spark, folder: str) -> DataFrame:
    return hyper_groups(spark.read.parquet(f"{folder}/documents.parquet"))
