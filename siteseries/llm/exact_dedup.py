"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Only documents whose length and beginning are shared by another document get their whole text hashed and grouped, so the
bulk of the rows never takes part in the last shuffle. White space does not count. Everything runs on built-in functions.

Null texts count as empty, and empty texts equal each other. Of equal texts the row with the most code points in the
original text stays, then the smallest doc_id (a null id comes last), then the first row as written. Rows repeated with the
same doc_id are copies like any others: one stays. An empty table gives an empty result. Other columns are never read by
`exact_groups` and are carried unchanged by `exact_dedup`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import SPACE, packed, sized, staged, text_of

HEAD = 48  # code points of the normalised text that the second key covers


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _keys(text: str) -> list[Column]:
    plain = normalised(text_of(text))
    return [F.length(plain).cast("long").alias("size"), F.xxhash64(F.substring(plain, 1, HEAD)).alias("head")]


def shared_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """(size, head) pairs that at least two documents share: the groups that survive the first two refinements."""
    light = staged(docs.select(*_keys(text)).groupBy("size", "head").agg(F.count("*").alias("n")), "exact-keys")
    sizes = light.groupBy("size").agg(F.sum("n").alias("of_size")).where("of_size > 1").select("size")
    return staged(light.join(sizes, "size", "left_semi").where("n > 1").select("size", "head"), "exact-shared")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    `text_sha256` is the hash of the normalised text; of documents without a partner it is null unless `digest_all`.
    """
    plain = normalised(text_of(text))
    keyed = docs.select(F.col(f"`{id}`").alias("doc_id"), F.length(text_of(text)).alias("n_chars"), plain.alias("plain"),
                        *_keys(text))
    alive = F.coalesce(F.col("alive"), F.lit(False))
    hashed = (keyed.join(sized(shared_keys(docs, text)).withColumn("alive", F.lit(True)), ["size", "head"], "left")
              .select("doc_id", "n_chars", "size", alive.alias("alive"),
                      F.when(F.lit(digest_all) | alive, F.sha2("plain", 256)).alias("sha"),
                      F.monotonically_increasing_id().alias("rid")))
    hashed = staged(hashed, "exact-hashed")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"),
                     F.col("rid").alias("keep_rid"))
    groups = (hashed.where("alive").groupBy("size", "sha").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
              .select("size", "sha", "group_size", "first.keep_id", "first.keep_rid"))
    many = (hashed.where("alive").join(groups, ["size", "sha"])
            .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")))
    single = hashed.where("NOT alive").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                              F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(many)


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Groups are folded by a partial aggregate that carries one row per group and task, so a group of any size costs no
    task more than its own input.
    """
    keyed = docs.select(packed(docs), F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("body"), *_keys(text))
    shared = sized(shared_keys(docs, text))
    alone = keyed.join(shared, ["size", "head"], "left_anti").select("row.*")
    order = F.struct((-F.length("body")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = (keyed.join(shared, ["size", "head"], "left_semi")
             .groupBy("size", F.sha2(normalised(F.col("body")), 256).alias("sha"))
             .agg(F.min_by("row", order).alias("row")).select("row.*"))
    return alone.unionByName(first)


def op8_exact_dedup(spark, folder: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{folder}/documents.parquet"), digest_all=True)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
g AS (SELECT doc_id, sha256(plain) AS text_sha256, length(body) AS n FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM g WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
