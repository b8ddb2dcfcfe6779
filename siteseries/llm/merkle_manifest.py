"""Merkle manifest of a dataset: per-group hash trees stored as blocks in van Emde Boas order.

A row is a leaf: the hash of its fields. The leaves of a group, in key order, are cut into aligned blocks of 4096; a block is
a subtree of three levels above its leaves, and the roots of the blocks are the leaves of the next tier of blocks, until one
node of the group is left. The roots of the groups form one more tree of the same kind. Within a block the nodes are stored
in van Emde Boas order: a tree of L levels is cut at half its height, the upper half comes first, then the lower subtrees
from left to right, each laid out likewise. So a run of siblings lies in a few neighbouring stretches at every scale of
memory, and the place of a node follows from its level and number alone (`address`), for building and for reading siblings.

A proof is read top down: the tiers above give each block the runs on its way to the root, and one task per block adds the
runs inside it for every leaf. No task holds more than one block, however large a group is.

Fields: null is `-`, anything else its UTF-8 byte count, `:` and its value. Null groups are one group, apart from the empty
text. Null keys come first, rows of equal key are ordered by their leaf, so repeated rows give the same tree in any order.
Empty and very long texts are hashed like others. An empty table has no tree and gives an empty result. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import staged
from siteseries.llm.ranks import ranked

FAN = 16
HEIGHT = 3  # levels of a block above its leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- layout of a block ------------------------------------------------------------------------------------------------

def levels_of(leaves: int) -> int:
    """Levels of the smallest tree over so many leaves, the leaves counted."""
    n = 1
    while leaves > FAN ** (n - 1):
        n += 1
    return n


def stored(leaves: int, levels: int) -> int:
    """Nodes of a tree of so many levels over so many leaves (runs may be short only at the right end)."""
    return sum(-(-leaves // FAN ** k) for k in range(levels))


def address(leaves: int, levels: int, level: int, number: int) -> int:
    """Place of a node in van Emde Boas order; level 0 are the leaves."""
    if levels == 1:
        return number
    low = (levels + 1) // 2  # levels of the lower subtrees
    span = FAN ** (low - 1)  # leaves of a lower subtree
    roots = -(-leaves // span)
    above = -(-roots // FAN)  # leaves of the upper tree: the parents of the lower roots
    if level >= low:
        return address(above, levels - low, level - low, number)
    tree = number // FAN ** (low - 1 - level)
    inside = min(span, leaves - tree * span)
    return (stored(above, levels - low) + tree * stored(span, low)
            + address(inside, low, level, number - tree * FAN ** (low - 1 - level)))


@lru_cache(maxsize=256)
def addresses(leaves: int, levels: int) -> tuple[np.ndarray, ...]:
    """`address` of every node: one array per level."""
    if levels == 1:
        return (np.arange(leaves),)
    low = (levels + 1) // 2
    span = FAN ** (low - 1)
    roots = -(-leaves // span)
    upper = addresses(-(-roots // FAN), levels - low)
    first, full = sum(map(len, upper)), stored(span, low)
    lower = [addresses(min(span, leaves - t * span), low) for t in range(roots)]
    return tuple(np.concatenate([first + t * full + own[k] for t, own in enumerate(lower)]) for k in range(low)) + upper


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def built(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes over the leaves in van Emde Boas order, the root first: lower subtrees, then the tree over their roots."""
    if levels == 1:
        return leaves
    low = (levels + 1) // 2
    span = FAN ** (low - 1)
    below = [built(leaves[at:at + span], low) for at in range(0, len(leaves), span)]
    roots = [b[0] for b in below]
    out = built([parent(roots[at:at + FAN]) for at in range(0, len(roots), FAN)], levels - low)
    return [*out, *(cell for b in below for cell in b)]


class Block:
    """A stored block: reads the runs of siblings on the way from a leaf to the block's root."""

    def __init__(self, leaves: int, levels: int, cells: bytes) -> None:
        self.levels, self.cells, self.at = levels, cells, addresses(leaves, levels)
        self.runs: dict[tuple[int, int], list[str]] = {}

    def run(self, level: int, number: int) -> list[str]:
        """The digests, as text, of the run with this number on a level."""
        if (found := self.runs.get((level, number))) is None:
            places = self.at[level][number * FAN:(number + 1) * FAN].tolist()
            found = self.runs[level, number] = [self.cells[32 * p:32 * p + 32].hex() for p in places]
        return found

    def way(self, leaf: int) -> list[tuple[int, list[str]]]:
        """(place in the run, run) of each level from the leaf up to below the root."""
        out = []
        for level in range(self.levels - 1):
            out.append((leaf % FAN, self.run(level, leaf // FAN)))
            leaf //= FAN
        return out


def siblings(way: list[tuple[int, list[str]]]) -> str:
    return "".join("".join(run[:place]) + "".join(run[place + 1:]) for place, run in way)


def folded(leaf: str, way: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for place, run in way:
        leaf = hashlib.sha256("".join([*run[:place], leaf, *run[place + 1:]]).encode()).hexdigest()
    return leaf


def written(way: list[tuple[int, list[str]]]) -> str:
    return ";".join(f"{place}:{''.join(run)}" for place, run in way)


def read(way: str) -> list[tuple[int, list[str]]]:
    steps = [s.split(":") for s in way.split(";")] if way else []
    return [(int(place), [run[at:at + 64] for at in range(0, len(run), 64)]) for place, run in steps]


# --- distributed trees ------------------------------------------------------------------------------------------------

BLOCK = "tree string, block long, of long, n int, levels int, cells binary, top string"


def tiers_of(nodes: DataFrame, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """Written blocks, tier by tier, of the trees over nodes (tree, rank, of, digest); `top` is a block's root."""
    span = FAN ** height

    def build(batches):
        import pandas as pd

        key, leaves = None, []

        def done():
            tree, block, of = key
            levels = height + 1 if of > span else levels_of(of)
            cells = built(leaves, levels)
            return tree, block, of, len(leaves), levels, b"".join(cells), cells[0].hex()

        for pdf in batches:
            out = []
            for tree, block, of, digest in zip(pdf["tree"].tolist(), pdf["block"].tolist(), pdf["of"].tolist(), pdf["digest"].tolist()):
                if key != (tree, block, of):
                    if leaves:
                        out.append(done())
                    key, leaves = (tree, block, of), []
                leaves.append(bytes.fromhex(digest))
            yield pd.DataFrame(out, columns=["tree", "block", "of", "n", "levels", "cells", "top"])
        if leaves:
            yield pd.DataFrame([done()], columns=["tree", "block", "of", "n", "levels", "cells", "top"])

    tiers = []
    while True:
        dealt = (nodes.select("tree", F.floor(F.col("rank") / span).cast("long").alias("block"), "rank", "of", "digest")
                 .repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").select("tree", "block", "of", "digest"))
        tiers.append(staged(dealt.mapInPandas(build, BLOCK), f"{name}-{len(tiers)}"))
        above = tiers[-1].where(F.col("of") > span)
        if above.isEmpty():
            return tiers
        nodes = above.select("tree", F.col("block").alias("rank"), F.ceil(F.col("of") / span).cast("long").alias("of"),
                             F.col("top").alias("digest"))


def roots_of(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, root)."""
    out = [t.where(F.col("of") <= FAN ** height).select("tree", F.col("top").alias("root")) for t in tiers]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def ways_of(tiers: list[DataFrame], above: DataFrame | None, name: str, height: int = HEIGHT, leaves: bool = False) -> DataFrame:
    """The blocks of the lowest tier with `root`, that of their tree, and `way`, the runs from their own root upwards.

    `above` (tree, way) is what lies above the trees' roots. With `leaves`: (tree, rank, root, way) of every leaf instead.
    """
    span, carried = FAN ** height, None

    def descend(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                block = Block(r.n, r.levels, bytes(r.cells))
                for k in range(r.n):
                    own = written(block.way(k))
                    out.append((r.tree, r.block * span + k, r.root, ";".join(x for x in (own, r.way) if x)))
            yield pd.DataFrame(out, columns=["tree", "block", "root", "way"])

    for k in range(len(tiers) - 1, -1, -1):
        whole = tiers[k].where(F.col("of") <= span).withColumn("root", F.col("top"))
        whole = whole.withColumn("way", F.lit("")) if above is None else whole.join(above, "tree")
        here = whole if carried is None else whole.unionByName(tiers[k].where(F.col("of") > span).join(carried, ["tree", "block"]))
        if k == 0 and not leaves:
            return here
        some = here.select("tree", "block", "n", "levels", "cells", "root", "way")
        carried = staged(some.mapInPandas(descend, "tree string, block long, root string, way string"), f"{name}-ways-{k}")
    return carried.withColumnRenamed("block", "rank")


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row's fields."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, fields)), 256)


@dataclass
class Manifest:
    """Written tables of a dataset's trees. `leaves`: key, tree, leaf, rank, of and what was asked for beside them; `blocks`:
    the tiers over the leaves; `groups`: the tiers over the groups' roots; `places`: tree, rank of each group; `root`: the
    digest of everything, None of an empty table."""

    leaves: DataFrame
    blocks: list[DataFrame]
    groups: list[DataFrame]
    places: DataFrame
    root: str | None
    height: int = HEIGHT


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
             height: int = HEIGHT, **beside: Column) -> Manifest:
    """Build the trees over all rows. `beside` are further columns to keep with the leaves."""
    # A null group sorts before all others, as its name is shorter than theirs.
    tree = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), tree.alias("tree"), leaf_of([F.col(f"`{f}`") for f in fields]).alias("leaf"),
                       F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in beside.items()])
    leaves = staged(ranked(staged(rows, "merkle-rows"), "tree", ["doc_id", "leaf", "row"], "merkle-sorted"), "merkle-leaves")
    blocks = tiers_of(leaves.select("tree", "rank", "of", F.col("leaf").alias("digest")), "merkle-blocks", height)
    roots = staged(roots_of(blocks, height).withColumn("all", F.lit("")), "merkle-roots")
    places = staged(ranked(roots, "all", ["tree"], "merkle-places"), "merkle-groups")
    groups = tiers_of(places.select(F.col("all").alias("tree"), "rank", "of", F.col("root").alias("digest")), "merkle-top", height)
    top = groups[-1].first()
    return Manifest(leaves, blocks, groups, places.select("tree", "rank"), top and top["top"], height)


def proofs(made: Manifest, claimed: str | None = None) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `claimed` names a column of the leaves whose value, where not null, is folded in place of the leaf.
    """
    span, whole = FAN ** made.height, made.root
    tops = ways_of(made.groups, None, "merkle-top", made.height, leaves=True)
    blocks = ways_of(made.blocks, made.places.join(tops.select("rank", "way"), "rank").select("tree", "way"), "merkle", made.height)
    empty = F.lit(None)
    kind = dict(made.leaves.dtypes)["doc_id"]
    rows = made.leaves.select("tree", F.floor(F.col("rank") / span).cast("long").alias("block"), "rank",
                              F.col("doc_id").cast("string").alias("doc_id"), "leaf",
                              (F.col(claimed) if claimed else empty).cast("string").alias("claimed"), empty.cast("int").alias("n"),
                              empty.cast("int").alias("levels"), empty.cast("binary").alias("cells"), empty.cast("string").alias("root"),
                              empty.cast("string").alias("way"))
    heads = blocks.select("tree", "block", F.lit(-1).cast("long").alias("rank"), empty.cast("string").alias("doc_id"),
                          empty.cast("string").alias("leaf"), empty.cast("string").alias("claimed"), "n", "levels", "cells", "root", "way")
    dealt = rows.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")

    def prove(batches):
        import pandas as pd

        block = upper = subroot = text = None
        for pdf in batches:
            out = []
            for rank, doc_id, leaf, other, n, levels, cells, root, way in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if rank < 0:
                    block, subroot, upper = Block(int(n), int(levels), bytes(cells)), root, read(way)
                    text = siblings(upper)
                    continue
                inside = block.way(rank % span)
                top = folded(other or leaf, inside + upper)
                out.append((doc_id, leaf, subroot, whole, hashlib.sha256((siblings(inside) + text).encode()).hexdigest(), top, top == whole))
            yield pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = dealt.drop("tree", "block").mapInPandas(prove, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def tampered(key: str, text: str, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf after A-Z of the text were lower-cased, of rows whose key's crc32 is a multiple of 5; else null."""
    changed = [F.translate(F.col(f"`{f}`"), UPPER, LOWER) if f == text else F.col(f"`{f}`") for f in fields]
    return F.when(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, leaf_of(changed))


def op12_merkle_manifest(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return proofs(manifest(docs, tampered=tampered("doc_id", "text")), "tampered")


_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_PART.format(f) for f in FIELDS) + ")"
_CHANGED = _LEAF.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')")
#: crc32 of the decimal digits, bit by bit.
_CRC = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), "
        "lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)")
SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_CHANGED} ELSE {_LEAF} END AS claimed FROM documents)),
inner_nodes AS (
  SELECT source, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM inner_nodes WHERE n > 1 GROUP BY source, level, place // 16, n),
tops AS MATERIALIZED (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, place, n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM outer_nodes WHERE n > 1 GROUP BY level, place // 16, n),
nodes AS MATERIALIZED (
  SELECT source, level, place, n, h FROM inner_nodes WHERE n > 1
  UNION ALL
  SELECT t.source, t.height + o.level, o.place, o.n, o.h FROM outer_nodes o CROSS JOIN tops t WHERE o.n > 1),
runs AS MATERIALIZED (SELECT source, level, place // 16 AS run, list(h ORDER BY place) AS hs FROM nodes GROUP BY ALL),
folds AS (
  SELECT l.doc_id, l.leaf, l.source, l.place AS low, l.place, 0 AS level, t.height, t.place AS top, t.subroot, l.claimed AS h, '' AS proof
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT f.doc_id, f.leaf, f.source, f.low, f.at // 16, f.level + 1, f.height, f.top, f.subroot,
         sha256(array_to_string(list_concat(r.hs[1:f.at % 16], [f.h], r.hs[f.at % 16 + 2:]), '')),
         f.proof || array_to_string(list_concat(r.hs[1:f.at % 16], r.hs[f.at % 16 + 2:]), '')
  FROM (SELECT *, CASE WHEN level = height THEN top ELSE place END AS at FROM folds) f
  JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.level = f.level AND r.run = f.at // 16)
SELECT doc_id, leaf, subroot, (SELECT h FROM outer_nodes WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM outer_nodes WHERE n = 1) AS verified
FROM folds QUALIFY level = max(level) OVER (PARTITION BY source, low)
"""
