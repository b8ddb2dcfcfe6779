"""Group comparisons from aggregated moments and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.functions.numeric import normal_quantile, ratio
from siteseries.operators.joins import natural_join
from siteseries.operators.ranking import cumulative_counts
from siteseries.stats.moments import corr


def welch_vs_baseline(df: DataFrame, keys: list[str], group: str, value: str, is_base: Column) -> DataFrame:
    """Each group's mean against the pooled baseline rows of the same key: t and Welch df.

    Both sides are aggregated first, so the join is between result rows. The baseline pool has one row per
    key; a group made of baseline rows only is left out.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_b": F.coalesce(is_base, F.lit(False)), "_all": F.lit(1)})
    keys = keys or ["_all"]
    stats = lambda tag: (F.avg(value).alias(f"mu_{tag}"), F.var_samp(value).alias(f"var_{tag}"),
                         F.count(value).alias(f"n_{tag}"))
    x = rows.filter(~F.col("_b")).groupBy(*keys, group).agg(*stats("x"))
    b = rows.filter("_b").groupBy(*keys).agg(*stats("b"))
    out = natural_join(x, b, "inner", keys)
    vx, vb = F.col("var_x") / F.col("n_x"), F.col("var_b") / F.col("n_b")
    return out.withColumns({
        "t_stat": ratio(F.col("mu_x") - F.col("mu_b"), F.sqrt(vx + vb)),
        "df": ratio(F.pow(vx + vb, 2), F.pow(vx, 2) / F.nullif(F.col("n_x") - 1, F.lit(0))
                    + F.pow(vb, 2) / F.nullif(F.col("n_b") - 1, F.lit(0)))}).drop("_all")


def sidak_threshold(alpha: float = 0.05, tests: int = 6) -> float:
    """Per-test level that keeps the family-wise level at alpha."""
    return 1.0 - (1.0 - alpha) ** (1.0 / tests)


def flag_significant(df: DataFrame, p: str = "p_value", alpha: float = 0.05, tests: int = 6) -> DataFrame:
    return df.withColumn("significant", F.when(F.col(p) < sidak_threshold(alpha, tests), "yes").otherwise("no"))


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way ANOVA per key: sums of squares, degrees of freedom and F."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(
        F.avg(value).alias("mu"), F.count(value).alias("n"), F.var_pop(value).alias("v"))
    # Group means are taken from the grand mean before they are squared: sums of raw squares cancel far from 0.
    n = F.col("n")
    grand = g.groupBy(*keys).agg((F.sum(n * F.col("mu")) / F.sum("n")).alias("_grand"))
    g = natural_join(g.withColumn("_one", F.lit(1)), grand.withColumn("_one", F.lit(1)), "inner", [*keys, "_one"])
    out = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("nobs"), F.sum(n * F.col("v")).alias("ss_within"),
        F.sum(n * F.pow(F.col("mu") - F.col("_grand"), 2)).alias("ss_between"))
    return out.withColumns({
        "df_between": F.col("groups") - 1, "df_within": F.col("nobs") - F.col("groups"),
    }).withColumn("f_stat", ratio(F.col("ss_between") * F.col("df_within"), F.col("ss_within") * F.col("df_between")))


def tukey_pairs(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Difference and studentised-range statistic of every pair of groups (result rows only)."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1))
    keys = keys or ["_all"]
    g = rows.groupBy(*keys, group).agg(F.avg(value).alias("mu"), F.count(value).alias("n"))
    fit = anova(rows, keys, group, value).select(
        *keys, "groups", "df_within", ratio("ss_within", "df_within").alias("ms_within"))
    a = g.select(*keys, F.col(group).alias("group_a"), F.col("mu").alias("mu_a"), F.col("n").alias("n_a"))
    b = g.select(*keys, F.col(group).alias("group_b"), F.col("mu").alias("mu_b"), F.col("n").alias("n_b"))
    pairs = natural_join(a, b, "inner", keys).filter(F.col("group_a") < F.col("group_b"))
    out = natural_join(pairs, fit, "inner", keys)
    scale = F.sqrt(F.col("ms_within") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    return out.select(*keys, "group_a", "group_b", (F.col("mu_b") - F.col("mu_a")).alias("diff"),
                      ratio(F.abs(F.col("mu_b") - F.col("mu_a")), scale).alias("q_stat"), "groups", "df_within").drop("_all")


def rank_sum_vs(df: DataFrame, keys: list[str], group: str, value: str, reference: str, others: list[str]) -> DataFrame:
    """Rank-sum test of each group against a reference group: U, and z with tie and continuity correction.

    Values are folded to counts per (key, pair, value) and ranked by `cumulative_counts`.
    """
    rows = df.filter(F.col(group).isin(reference, *others) & F.col(value).isNotNull())
    pair = F.when(F.col(group) == reference, F.array(*[F.lit(o) for o in others])).otherwise(F.array(F.col(group)))
    rows = rows.select(*keys, F.explode(pair).alias("versus"), (F.col(group) == reference).alias("is_ref"), value)
    by = [*keys, "versus"]
    counts = cumulative_counts(rows, by, value)
    ours = rows.filter("is_ref").groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ours"))
    rank = F.col("below") + (F.col("n") + 1.0) / 2.0
    joined = natural_join(counts, ours, "left", [*by, value])
    out = joined.groupBy(*by).agg(
        F.sum(rank * F.col("_ours")).alias("rank_sum"), F.sum("_ours").alias("n_ref"), F.max("total").alias("n_all"),
        F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    n1, n = F.col("n_ref"), F.col("n_all")
    n2 = n - n1
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    centre = u - n1 * n2 / 2.0
    spread = F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - F.col("ties") / (n * (n - 1.0))))
    return out.select(*by, n1.alias("n_ref"), n2.alias("n_versus"), u.alias("u_stat"),
                      ratio(centre - F.signum(centre) * 0.5, spread).alias("z_stat"))


SCORE_CHUNK = 10_000


def normal_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per value with its position in the group order and the normal score of that position.

    Scores use (position - 3/8) / (n + 1/4). Equal values take consecutive positions; they are unfolded in
    two steps, so that a value shared by very many rows never needs one long array.
    """
    counts = cumulative_counts(df, keys, value)
    last = F.col("n") - 1
    step = F.lit(SCORE_CHUNK)
    out = counts.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / step))))
    inner = F.sequence(F.col("_c") * step, F.least(last, F.col("_c") * step + (step - 1)))
    out = out.withColumn("_i", F.explode(inner)).withColumn("position", F.col("below") + F.col("_i") + 1)
    return out.select(*keys, value, "position", "total",
                      normal_quantile((F.col("position") - 0.375) / (F.col("total") + 0.25)).alias("score"))


def shapiro_francia(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """W' = squared correlation of ordered values with normal scores, and its normalised z.

    z uses the published approximation in ln n (valid for 5 <= n <= 5000; beyond that read W').
    """
    s = normal_scores(df, keys, value)
    out = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("nobs"), F.pow(corr(value, "score"), 2).alias("w_stat"))
    n = F.col("nobs")
    ln_n = F.ln(n)
    mean = -1.2725 + 1.0521 * (F.ln(ln_n) - ln_n)
    sd = 1.0308 - 0.26758 * (F.ln(ln_n) + 2.0 / ln_n)
    return out.withColumn("z_stat", F.when((n >= 5) & (F.col("w_stat") < 1.0),
                                           (F.ln(1.0 - F.col("w_stat")) - mean) / sd))


