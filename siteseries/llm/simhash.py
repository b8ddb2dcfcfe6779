"""SimHash near-dedup by anchor points of a covering code.

Each text gets a 64-bit fingerprint of its word shingles, and equal fingerprints are one node from then on. The bits are cut
into blocks such that two fingerprints within the threshold differ by at most t bits in some block. A block's anchors are
the words of a covering code: Hamming (15, 11) codes, whose radius is one, side by side with free bits. The home of a
fingerprint is the anchor its block decodes to; it is also replicated to every anchor that is the home of a block within t
bits, which are the anchors within covering radius plus t that can matter. Fingerprints are compared at each anchor, its own
against all that were sent there, so no close pair is missed whatever the anchors hold.

At an anchor only a spanning forest of the close pairs is emitted, never all of them, and the homes of crowded anchors are
split over several tasks. A crowd of near copies cannot grow without end: copies of one fingerprint are one node.

Null and empty texts have fingerprint zero and are linked like others. A null doc_id never names a component unless its
whole component has none. Repeated rows get the same fingerprint and component. An empty table gives an empty result. Extra
columns are not read by `near_groups` and carried unchanged by `near_dedup`, whatever their names.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import packed, sized, staged, text_of
from siteseries.llm.components import components

WORDS, THRESHOLD, SEED = 4, 4, 42
#: Homes of one anchor that one task compares at once; crowded anchors are split, their visitors go to each part.
HOMES = 4096
#: Distinct fingerprints up to which three blocks are used; beyond, two wider blocks have shorter anchor lists. Both are exact.
WIDE_FROM = 1 << 26
SMALL, LOT = 1 << 13, 1 << 20  # pairs of a small anchor, and pairs compared at once


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is set if it is set in over half the shingle hashes; no words: zero."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the white space of the contract.
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    parts = iter(zip(*(ws[k:] for k in range(words))) if len(ws) >= words else [ws])
    while some := [xxh64_intdigest(b" ".join(p), SEED) for p in islice(parts, 1 << 16)]:
        h = np.array(some, dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(words: int = WORDS):
    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return fp


def blocks_of(count: int, threshold: int, wide_from: int = WIDE_FROM) -> list[tuple[int, int]]:
    """(first bit, width) of each block: as many as leave one differing bit at most in some block, or half of that."""
    n = (threshold + 2) // 2 if count <= wide_from else (threshold + 3) // 3
    n = max(2, n)
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _syndromes() -> np.ndarray:
    """Of each 15-bit word, the position (1 to 15) of the bit that the Hamming code flips, or 0."""
    word, s = np.arange(1 << 15), np.zeros(1 << 15, dtype=np.int64)
    for bit in range(15):
        s ^= np.where(word >> bit & 1, bit + 1, 0)
    return s


def homes(block: np.ndarray, width: int, syndromes: np.ndarray) -> np.ndarray:
    """The anchors that blocks decode to: every whole group of 15 bits goes to its code word, other bits stay."""
    out = block.copy()
    for at in range(0, width - 14, 15):
        s = syndromes[(block >> at) & 0x7FFF]
        out ^= np.where(s > 0, np.int64(1) << (np.maximum(s, 1) - 1 + at), 0)
    return out


def flips(width: int, t: int) -> np.ndarray:
    """All masks of at most t bits, none first."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], dtype=np.int64)


def anchored(fps: DataFrame, blocks: list[tuple[int, int]], threshold: int) -> DataFrame:
    """(anchor, own, fp): each fingerprint once at its home in every block, and once at every other anchor it must visit."""
    t = threshold // len(blocks)

    def visit(batches):
        import pyarrow as pa

        syndromes = _syndromes()
        masks = [flips(width, t) for _, width in blocks]
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False)
            for part in range(0, len(whole), 4000):
                fp = whole[part:part + 4000]
                for k, (first, width) in enumerate(blocks):
                    block = (fp.view(np.uint64) >> np.uint64(first)).view(np.int64) & ((1 << width) - 1)
                    near = homes((block[:, None] ^ masks[k][None, :]), width, syndromes)
                    own = near[:, 0].copy()
                    near.sort(axis=1)
                    new = np.ones(near.shape, dtype=bool)
                    new[:, 1:] = near[:, 1:] != near[:, :-1]
                    row, col = np.nonzero(new)
                    anchor = near[row, col]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor * len(blocks) + k), pa.array(anchor == own[row]), pa.array(fp[row])], ["anchor", "own", "fp"])

    return fps.select("fp").mapInArrow(visit, "anchor long, own boolean, fp long")


def forest(own: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (i, j) spanning the components of the close pairs between own[i] and others[j]."""
    out, free_own, free_others = [], np.ones(len(own), dtype=bool), np.ones(len(others), dtype=bool)
    for seed in range(len(own)):
        if not free_own[seed]:
            continue
        free_own[seed] = False
        queue = [(True, seed)]
        while queue:
            mine, k = queue.pop()
            pool, left = (others, free_others) if mine else (own, free_own)
            at = np.flatnonzero(left)
            if not len(at):
                continue
            hit = at[np.bitwise_count(pool[at] ^ (own if mine else others)[k]) <= threshold]
            left[hit] = False
            out += [(k, int(j)) if mine else (int(j), k) for j in hit]
            queue += [(not mine, int(j)) for j in hit]
    return out


def cells_of(visits: DataFrame, item: str, homes: int = HOMES, alike: bool = False, lead: str | None = None) -> DataFrame:
    """Split the anchors (column anchor) into cells (anchor, part): every row of an anchor meets each of its homes (own) in one.

    A home goes to one part of its anchor, chosen by its `item`; every row, homes too, visits each part. Rows of a cell come
    together, its homes first. If all visits are homes (`alike`), an undivided anchor gets no other rows: its homes meet
    each other. Undivided anchors with the same `lead`, a column of whole numbers, come one after the other in one task; the
    lead of a divided one is made its own.
    """
    crowded = (visits.where("own").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > homes)
               .select("anchor", F.ceil(F.col("n") / homes).cast("int").alias("parts")))
    visits = visits.join(sized(staged(crowded, "anchors-crowded")), "anchor", "left")
    if lead:
        visits = visits.withColumn(lead, F.when(F.col("parts").isNull(), F.col(lead)).otherwise(F.xxhash64("anchor")))
    parts, rest = F.coalesce(F.col("parts"), F.lit(1)), [c for c in visits.columns if c not in ("anchor", "own", "parts")]
    home = visits.where("own").select("anchor", F.pmod(F.xxhash64(item), parts).cast("int").alias("part"), F.lit(True).alias("own"), *rest)
    guest = visits.select("anchor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("own"), *rest)
    if alike:
        guest = visits.where("parts IS NOT NULL").select(*[F.col(c) for c in visits.columns])
        guest = guest.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("own"), *rest)
    n = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [lead] if lead else ["anchor"]
    return home.unionByName(guest).repartition(n, *first, "part").sortWithinPartitions(*first, *(["anchor"] if lead else []), "part", F.col("own").desc())


def close_links(visits: DataFrame, threshold: int, alike: bool = False) -> DataFrame:
    """(a, b) fingerprints that are close, enough of them to connect all that are."""
    cells = cells_of(visits, "fp", alike=alike)

    def compare(batches):
        import pyarrow as pa

        key, homes_ = None, np.empty(0, dtype=np.uint64)

        def found(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part, own, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "own", "fp"))
            fp = fp.view(np.uint64)  # bits are counted on unsigned numbers
            edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(fp)]
            n_own = np.add.reduceat(own.astype(np.int64), starts)
            first = key == (anchor[0], part[0])
            # Runs that lie within the batch and are small are compared all at once, a lot of them at a time.
            m = ends - starts - n_own
            alone = m == 0  # homes that meet each other, unless the run goes on
            guests, n_guests = np.where(alone, starts, starts + n_own), np.where(alone, n_own, m)
            small = (n_own * n_guests <= SMALL) & (n_own > 0)
            small[0] &= not first
            small[-1] = False
            run = np.flatnonzero(small & (n_own + n_guests > 1))
            lots = np.cumsum(n_own[run] * n_guests[run]) // LOT if len(run) else run
            for lot in np.unique(lots):
                r = run[lots == lot]
                home = np.repeat(starts[r], n_own[r]) + np.arange(n_own[r].sum()) - np.repeat(np.cumsum(n_own[r]) - n_own[r], n_own[r])
                of = np.repeat(r, n_own[r])
                a = np.repeat(fp[home], n_guests[of])
                opens = np.cumsum(n_guests[of]) - n_guests[of]
                b = fp[np.arange(len(a)) + np.repeat(guests[of] - opens, n_guests[of])]
                hit = np.flatnonzero(np.bitwise_count(a ^ b) <= threshold)
                hit = hit[a[hit] != b[hit]]
                if alike:
                    hit = hit[a[hit] > b[hit]]
                if len(hit):
                    yield found(a[hit], b[hit])
            rest = ~small & (n_own > 0)
            rest[[0, -1]] = True
            for r in np.flatnonzero(rest):
                mine = fp[starts[r]:starts[r] + n_own[r]]
                homes_ = np.r_[homes_, mine] if r == 0 and first else mine
                others = fp[starts[r] + n_own[r]:ends[r]]
                if not len(others) and alike:
                    others = mine  # in a run over several batches, each lot of homes meets all before it
                if len(homes_) and len(others):
                    pairs = [(i, j) for i, j in forest(homes_, others, threshold) if homes_[i] != others[j]]
                    # What several visiting lots share is one home, so their forests join up.
                    if pairs:
                        i, j = zip(*pairs)
                        yield found(homes_[list(i)], others[list(j)])
            key = (anchor[-1], part[-1])

    return cells.mapInArrow(compare, "a long, b long").where("a <> b")


def near_fingerprints(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root) for fingerprints (column fp, distinct) that have another within the threshold."""
    blocks = blocks_of(fps.count(), threshold)
    visits = staged(anchored(fps, blocks, threshold), "anchors")
    return components(close_links(visits, threshold))


def component_map(marked: DataFrame, threshold: int) -> DataFrame:
    """(fp, n, first, root, component_id) of all fingerprints of rows (doc_id, fp); root is a fingerprint of the component."""
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints")
    roots = staged(near_fingerprints(nodes, threshold), "roots")
    linked = roots.join(nodes.select(F.col("fp").alias("node"), "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    return staged(nodes.join(named, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"),
                                                         F.coalesce("least", "first").alias("component_id")), "component-map")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component)."""
    fp = fingerprint_column(words)
    marked = staged(docs.select(F.col(f"`{id}`").alias("doc_id"), fp(text_of(text)).alias("fp")), "fingerprinted")
    where = component_map(marked, threshold).select("fp", "component_id")
    return marked.join(where, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one with the smallest doc_id (nulls last)."""
    fp = fingerprint_column(words)
    rows = staged(docs.select(packed(docs), F.col(f"`{id}`").alias("doc_id"), fp(text_of(text)).alias("fp")), "fingerprinted-rows")
    where = component_map(rows.select("doc_id", "fp"), threshold)
    # One fingerprint of each component stays: that of the smallest id, then the smallest fingerprint.
    order = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    keep = where.groupBy("root").agg(F.min(order).alias("k")).select("k.fp")
    changed = where.join(keep.withColumn("stays", F.lit(True)), "fp", "left").select("fp", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    changed = sized(staged(changed.where("n > 1 OR NOT stays").select("fp", "stays"), "near-changed"))
    alone = rows.join(changed, "fp", "left_anti").select("row.*")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    folded = (rows.join(changed.where("stays"), "fp", "left_semi").groupBy("fp")
              .agg(F.min_by("row", order).alias("row")).select("row.*"))
    return alone.unionByName(folded)


def op4_simhash_near_dedup(spark, folder: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{folder}/documents.parquet"))
