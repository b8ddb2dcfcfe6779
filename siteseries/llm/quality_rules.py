"""Quality rules: a decision list learned by sequential covering over document statistics.

Rules are conjunctions of thresholds. A rule is grown on one part of the labelled documents, condition by condition with the
best information gain for label 0, pruned on another part, and then what it covers is set aside before the next one is
grown. Spark counts label and bin of every statistic in one aggregate a step; only those counts (statistics x bins x labels)
reach the driver. The list is emitted as one ordered conditional expression. Everything runs on built-in functions.

Null texts have no words and fail the base rules, and so do empty ones. Labels other than 0 and 1 are ignored; without labels
of both kinds the list is empty and only the base rules decide. Repeated rows get equal results. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import SPACE, WORD, staged, text_of

BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8
STATISTICS = ("symbol_rate", "bang_rate", "bar_rate", "upper_rate", "repeat_rate", "same_as_last", "repeated_line_rate",
              "word_length", "distinct_rate", "line_words", "n_words")
BINS = 24
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PURITY = 12, 3, 5, 0.7


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the STATISTICS."""
    body = text_of(text)
    trimmed = F.btrim(body, F.lit(BLANK))
    kept = lambda pattern: F.length(F.regexp_replace("body", pattern, "")).cast("long")
    df = docs.select(F.col(f"`{id}`").alias("doc_id"), body.alias("body"),
                     F.when(trimmed == "", F.array().cast("array<bigint>"))
                     .otherwise(F.transform(F.split(trimmed, SPACE + "+"), lambda w: F.xxhash64(w))).alias("words"))
    df = df.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), kept(SPACE + "+").alias("word_chars"),
                   kept(r"[^#*$%&|<>]+").alias("n_symbols"), kept("[^!]+").alias("bangs"), kept(r"[^|]+").alias("bars"),
                   kept("[^A-Z]+").alias("uppers"), F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    df = df.withColumn("windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Only where some window repeats are the windows sorted with their places.
    sorted_ = F.array_sort(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(repeats, sorted_))
    last = F.size("sorted") - 1
    same = lambda j, k: F.coalesce(F.get("sorted", j)["h"] == F.get("sorted", k)["h"], F.lit(False))
    twins = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(same(j, F.greatest(j - 1, F.lit(0))) & (j > 0) | same(j, j + 1), F.get("sorted", j)["p"]))
    df = df.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.filter(twins, lambda p: p.isNotNull()))))
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    safe = F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.greatest(F.size("lines"), F.lit(1))
    beside = F.size(F.filter(F.transform("words", lambda w, k: w == F.get("words", k + 1)), lambda x: x))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols",
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
                   "bangs", "bars", "uppers", n_lines.alias("n_lines"), beside.alias("beside"), F.size(F.array_distinct("words")).alias("n_distinct"))
    rate = lambda c, of=safe: (F.col(c) / of).cast("double").alias
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     rate("n_symbols")("symbol_rate"), rate("bangs")("bang_rate"), rate("bars")("bar_rate"),
                     rate("uppers", F.greatest("word_chars", F.lit(1)))("upper_rate"), rate("n_repeat_words")("repeat_rate"), rate("beside")("same_as_last"),
                     rate("n_dup_lines", F.col("n_lines"))("repeated_line_rate"), rate("word_chars")("word_length"), rate("n_distinct")("distinct_rate"),
                     (F.col("n_words") / F.col("n_lines")).cast("double").alias("line_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float
    index: int   # of the statistic
    bin: int     # thresholds up to this value

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= self.threshold if self.at_least else c < self.threshold

    def on_bins(self) -> Column:
        b = F.get("bins", F.lit(self.index))
        return b >= self.bin if self.at_least else b < self.bin


def all_of(conditions: list[Condition], on_bins: bool = False) -> Column:
    return reduce(lambda a, b: a & b, [c.on_bins() if on_bins else c.column() for c in conditions], F.lit(True))


def cut_points(rows: DataFrame) -> list[list[float]]:
    """Per statistic, distinct quantiles of each label's documents: at most 2 x BINS thresholds."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    quantiles = rows.groupBy("label").agg(*[F.percentile_approx(s, at, 10000).alias(s) for s in STATISTICS]).collect()
    return [sorted({x for r in quantiles for x in r[s]}) for s in STATISTICS]


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _grow(rows: DataFrame, cuts: list[list[float]]) -> list[Condition]:
    chosen: list[Condition] = []
    while len(chosen) < MAX_CONDITIONS:
        here = rows.where(all_of(chosen, on_bins=True))
        counts = here.select("label", F.posexplode("bins").alias("s", "b")).groupBy("s", "b").agg(
            F.sum(1 - F.col("label")).alias("p"), F.sum("label").alias("n")).collect()
        if not counts:
            break
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            table.setdefault(r["s"], {})[r["b"]] = (r["p"], r["n"])
        p0, n0 = (sum(x[k] for x in table[0].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        options = []
        for s, cells in table.items():
            for b in range(1, len(cuts[s]) + 1):
                high = [sum(x[k] for v, x in cells.items() if v >= b) for k in (0, 1)]
                for at_least, (p1, n1) in ((True, high), (False, [p0 - high[0], n0 - high[1]])):
                    if p1 >= MIN_COVER:
                        options.append((_gain(p0, n0, p1, n1), p1, -s, -b, at_least))
        best = max(options, default=(0.0,))
        if best[0] <= 1e-9:
            break
        _, _, s, b, at_least = best
        chosen.append(Condition(STATISTICS[-s], at_least, cuts[-s][-b - 1], -s, -b))
    return chosen


def _prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The shortest head of the rule with the best (p - n) / (p + n), and its smoothed purity."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = [F.sum(F.when(all_of(h, on_bins=True) & (F.col("label") == q), 1).otherwise(0)).alias(f"c{k}_{q}") for k, h in enumerate(heads) for q in (0, 1)]
    r = rows.agg(*sums).first()
    counts = [(r[f"c{k}_0"] or 0, r[f"c{k}_1"] or 0) for k in range(len(heads))]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
    k = max(range(len(heads)), key=lambda i: (worth[i], -i))
    return heads[k], (counts[k][0] + 1) / (sum(counts[k]) + 2)


def learn(measures: DataFrame, labels: DataFrame, label: str = "quality") -> list[list[Condition]]:
    """Ordered rules that mark documents of label 0, from documents that pass the base rules."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1)")
    rows = measures.where(~base_failed()).join(known, "doc_id")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    rows = staged(rows.select("label", part.alias("part"), *STATISTICS).where("part > 0"), "rules-labelled")
    cuts = cut_points(rows)
    if any(not c for c in cuts):
        return []
    bins = F.array(*[reduce(lambda a, b: a + b, [(F.col(s) >= t).cast("int") for t in c]) for s, c in zip(STATISTICS, cuts)])
    rows = staged(rows.select("label", "part", bins.alias("bins")), "rules-binned")
    grow, check, rules = rows.where("part > 1"), rows.where("part = 1"), []
    while len(rules) < MAX_RULES:
        rule = _grow(grow, cuts)
        if not rule:
            break
        rule, purity = _prune(check, rule)
        if purity < MIN_PURITY:
            break
        rules.append(rule)
        grow, check = (x.where(~all_of(rule, on_bins=True)) for x in (grow, check))
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression: false at the first rule that holds, true if none does."""
    if not rules:
        return F.lit(True)
    out = F.when(all_of(rules[0]), False)
    for rule in rules[1:]:
        out = out.when(all_of(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept."""
    measures = staged(measured(docs, id, text), "rules-measured")
    rules = learn(measures, labels)
    return measures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           base_failed().alias("base_failed"), (~base_failed() & decision(rules)).alias("kept"))


def op3_quality_rules(spark, folder: str) -> DataFrame:
    return judge(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
