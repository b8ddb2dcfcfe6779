"""Comparing the nodes that meet at a key, crowds of any size among them, without all pairs of a crowd.

Nodes meet at anchors. A crowded anchor is cut into parts, and only flagged guests visit all of them; the others meet their own
part. Two rounds lose no link: the first without guests joins most of a crowd; in the second the nodes outside an anchor's largest
component are its guests, so any two nodes of different components meet. Work grows with the nodes and with those strangers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import sized, staged

BYTES, LEAST = 1 << 26, 1 << 16  # of sets that one task compares at once, and what a set counts for at least


def strangers(visits: DataFrame, joined: DataFrame) -> DataFrame:
    """Visits (anchor, node, guest) of the anchors whose nodes are not in one component of `joined` (node, root): guests are
    the nodes outside the anchor's largest component."""
    rooted = staged(visits.join(joined, "node", "left").select("anchor", "node", F.coalesce("root", "node").alias("root")), "crowd-rooted")
    apart = rooted.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("anchor")
    apart = staged(rooted.join(apart, "anchor", "left_semi"), "crowd-apart")
    main = (apart.groupBy("anchor", "root").agg(F.count("*").alias("n")).groupBy("anchor")
            .agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    return apart.join(main, "anchor").select("anchor", "node", (F.col("root") != F.col("main")).alias("guest"))


def dealt(visits: DataFrame, size: Column, room: int) -> DataFrame:
    """Cut the anchors of visits (anchor, node, guest, ...) into parts of about `room` in `size`: rows with part and own.

    Every node is at home (own) in one part of each of its anchors. If an anchor has several parts, its guests come to each of
    them too. Rows of a part come together, those at home first.
    """
    crowded = visits.groupBy("anchor").agg(F.sum(size).alias("all")).where(F.col("all") > room)
    crowded = crowded.select("anchor", F.ceil(F.col("all") / room).cast("int").alias("parts"))
    visits = visits.join(sized(staged(crowded, "crowd-parts")), "anchor", "left")
    rest = [c for c in visits.columns if c not in ("anchor", "parts")]
    home = visits.select("anchor", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(True).alias("own"), *rest)
    more = visits.where("parts IS NOT NULL AND guest").select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                                             F.lit(False).alias("own"), *rest)
    n = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return home.unionByName(more).repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", F.col("own").desc())


def by_part(batches, weight, lot):
    """(key, homes, guests) of each part of sorted rows (anchor, part, own, *item): guests None where homes meet each other,
    else in lots of at most `lot` in `weight`. Homes also meet each other where a part has guests."""
    key, homes, guests, full, met = None, [], [], 0, False
    for pdf in batches:
        for anchor, part, own, *item in pdf.itertuples(index=False):
            if key != (anchor, part):
                if homes and not met:
                    yield key, homes, None
                if homes and guests:
                    yield key, homes, guests
                key, homes, guests, full, met = (anchor, part), [], [], 0, False
            if own:
                homes.append(item)
                continue
            if not met:
                met = True
                yield key, homes, None
            guests.append(item)
            full += weight(item)
            if full >= lot:
                yield key, homes, guests
                guests, full = [], 0
    if homes and not met:
        yield key, homes, None
    if homes and guests:
        yield key, homes, guests


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least `percent` of their union in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning(homes: list, guests: list, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect all similar pairs of a home and a guest, both (node, set)."""
    out, free_homes = [], set(range(len(homes)))
    free = np.ones(len(guests), bool), np.ones(len(homes), bool)
    sizes = np.array([len(g[1]) for g in guests]), np.array([len(h[1]) for h in homes])
    while free_homes:
        queue = [(True, free_homes.pop())]
        free[1][queue[0][1]] = False
        while queue:
            mine, k = queue.pop()
            me, pool, left, size = (homes[k], guests, free[0], sizes[0]) if mine else (guests[k], homes, free[1], sizes[1])
            n = len(me[1])
            for j in np.flatnonzero(left & (100 * size >= percent * n) & (percent * size <= 100 * n)).tolist():
                you = pool[j]
                if you[0] == me[0] or similar(me[1], you[1], percent):
                    left[j] = False
                    if not mine:
                        free_homes.discard(j)
                    queue.append((not mine, j))
                    if you[0] != me[0]:
                        out.append((me[0], you[0]))
    return out


def verified(visits: DataFrame, percent: int, size: Column | None = None) -> DataFrame:
    """(a, b) nodes of visits (anchor, node, guest, set) that are similar, enough of them to connect all that are.

    `size` is what a set counts for, if a column of the visits has it: then sets are not read for the sizes of parts.
    """
    cells = dealt(visits, F.greatest(F.length("set"), F.lit(LEAST)) if size is None else size, BYTES)

    def compare(batches):
        import pandas as pd

        out = []
        for _, homes, guests in by_part(batches, lambda item: max(len(item[1]), LEAST), BYTES):
            both = [[(bytes(node), np.frombuffer(bytes(whole), np.uint64)) for node, whole in some] for some in (homes, guests or [])]
            out.extend(spanning(both[0], both[0] if guests is None else both[1], percent))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    return cells.select("anchor", "part", "own", "node", "set").mapInPandas(compare, "a binary, b binary")
