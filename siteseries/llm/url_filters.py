"""URL filters by path-template trees.

Rules decide first: the longest rule whose host fits (itself or a parent domain) and whose path begins the URL's path. For
the rest, a tree of path templates is learned per host, one segment a level, for as long as a branch has pages enough. A
segment stays literal on evidence that does not fade with the size of its host: it has some pages of its own, and either
the values at its place repeat (each has that many pages on average) or its labelled share of bad pages differs significantly
from that of its siblings. All others become the wildcard `*`, so ids, dates and slugs generalise by themselves; under a
branch with fewer pages than a literal needs everything is `**`. Sibling templates whose shares do not differ significantly
from those of the other siblings together are one branch; those that do stand apart, pooled with siblings of like share only.
A branch's purity, its share of bad labels, is smoothed towards its host's and that towards the whole table's; pages of
branches whose purity is too high are blocked. All steps are aggregates and joins on built-in functions. A level is one pass
over the pages that reach it.

Null URLs and those without `://` have empty host and path, no rule, and meet in one template. Rows repeat as they come.
Without labels nothing but rules blocks. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteseries.llm.common import sized, staged, text_of

LITERAL_PAGES = 8               # pages of its own that a literal segment needs, and pages a value that make values repeat
LITERAL_Z, MERGE_Z = 3.0, 1.96  # standard errors; children are many, so a literal needs more of them
SHARES = 8                      # classes of bad share that siblings which stand apart are pooled in
HOST_WEIGHT, BRANCH_WEIGHT = 20.0, 10.0
MAX_BAD = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (`host/path` to verdict) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # longer ones are tried first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def differs(bad: Column, known: Column, all_bad: Column, all_known: Column, z: float) -> Column:
    """Whether a part's share of bad labels lies more than `z` standard errors from that of the rest; false without labels."""
    rest = all_known - known
    gap = bad * rest - (all_bad - bad) * known
    return gap * gap * all_known > F.lit(z * z) * known * rest * all_bad * (all_known - all_bad)


def counts() -> list[Column]:
    """Pages, labelled ones and bad ones, as doubles (products of them are compared)."""
    bad = F.sum(F.when(F.col("label") == 0, 1.0).otherwise(0.0))
    return [F.count("*").cast("double").alias("n"), F.count("label").cast("double").alias("known"), bad.alias("bad")]


def templated(pages: DataFrame) -> DataFrame:
    """Add `template` to rows with host, path, label: literal segments where there is evidence for them, `*` elsewhere."""
    rows = pages.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    ended, level, node = [], 0, ["host", "template"]
    while True:
        rows = staged(rows.withColumn("segment", F.get("segments", F.lit(level))), f"templates-{level}")
        ended.append(rows.where("segment IS NULL"))
        rows = rows.where("segment IS NOT NULL")
        if rows.isEmpty():
            break
        children = staged(rows.groupBy(*node, "segment").agg(*counts()), f"children-{level}")
        nodes = children.groupBy(*node).agg(F.sum("n").alias("pages"), F.count("*").alias("values"), F.sum("known").alias("of"), F.sum("bad").alias("worse"))
        nodes = sized(staged(nodes.where(F.col("pages") >= LITERAL_PAGES), f"nodes-{level}"))
        repeat = F.col("pages") >= LITERAL_PAGES * F.col("values")
        literal = (children.where(F.col("n") >= LITERAL_PAGES).join(nodes, node)
                   .where(repeat | differs(F.col("bad"), F.col("known"), F.col("worse"), F.col("of"), LITERAL_Z))
                   .select(*node, "segment", F.lit(True).alias("literal")))
        rows = (rows.join(nodes.select(*node, F.lit(True).alias("wide")), node, "left")
                .join(sized(staged(literal, f"literals-{level}")), [*node, "segment"], "left"))
        step = F.when(F.col("wide").isNull(), "/**").when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        rows = (rows.withColumn("template", F.concat("template", step))
                .withColumn("segments", F.when(F.col("wide"), F.col("segments"))).drop("wide", "literal"))
        level += 1
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return staged(out.drop("segments", "segment"), "templates")


def branches(rows: DataFrame, host_weight: float = HOST_WEIGHT, branch_weight: float = BRANCH_WEIGHT, merge_z: float = MERGE_Z) -> DataFrame:
    """(host, template, branch, bad_share) from rows with host, template and label (1 good, 0 bad, null unknown).

    Siblings share all segments but the last. Those within `merge_z` standard errors of the pooled share of the others are one
    branch (0); the rest are pooled by classes of their share.
    """
    place = ["host", "parent"]
    leaves = rows.groupBy("host", "template").agg(*counts())
    leaves = staged(leaves.withColumn("parent", F.regexp_extract("template", r"^(.*)/[^/]*$", 1)), "leaves")
    whole = leaves.agg(((F.sum("bad") + 1) / (F.sum("known") + 2)).alias("bad_all")).first()["bad_all"]
    whole = 0.5 if whole is None else whole
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + host_weight * whole) / (F.sum("known") + host_weight)).alias("bad_host"))
    pooled = sized(staged(leaves.groupBy(*place).agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad")), "siblings"))
    apart = differs(F.col("bad"), F.col("known"), F.col("all_bad"), F.col("all_known"), merge_z)
    branch = F.when(apart, 1 + F.floor(SHARES * F.col("bad") / F.col("known"))).otherwise(F.lit(0))
    cut = leaves.join(pooled, place).withColumn("branch", branch.cast("int"))
    merged = sized(staged(cut.groupBy(*place, "branch").agg(F.sum("known").alias("of"), F.sum("bad").alias("n_bad")), "branches"))
    smooth = (F.col("n_bad") + branch_weight * F.col("bad_host")) / (F.col("of") + branch_weight)
    return (cut.select(*place, "branch", "template").join(merged, [*place, "branch"]).join(sized(staged(hosts, "hosts")), "host")
            .select("host", "template", "branch", smooth.alias("bad_share")))


def filter_urls(pages: DataFrame, labels: DataFrame | None, rules: dict[str, str], id: str = "page_id", url: str = "url",
                max_bad: float = MAX_BAD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share. `labels`: (key, label) of known pages."""
    u = text_of(url)
    rows = pages.select(F.col(f"`{id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"),
                        *([] if labels is None else [F.col("key")]))
    rows = rows.withColumn("label", F.lit(None).cast("int")) if labels is None else rows.join(labels, "key", "left").drop("key")
    rows = templated(rows)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("string")
    for text, word in rules.items():
        verdict = F.when(F.col("rule") == text, word).otherwise(verdict)
    by_tree = F.when(F.col("bad_share") > max_bad, "block").otherwise("allow")
    return (rows.join(sized(staged(branches(rows), "purities")), ["host", "template"]).withColumn("rule", rule)
            .select("page_id", "host", "path", "rule", F.coalesce(verdict, by_tree).alias("verdict"), "template", "bad_share"))


#: The rules of the query, in their order.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
HEADING = 60  # where the given pages cut longer headings


def title_of(html: Column) -> Column:
    """A page's first heading, whole, with the common character references resolved."""
    title = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(name), F.lit(mark))
    return F.trim(title)


def title_labels(docs: DataFrame, labels: DataFrame, cut: int = HEADING) -> DataFrame:
    """(key, label): pages carry no labels of their own, so a page inherits the majority quality of the labelled documents
    whose first line is its heading, whole or cut as the pages cut it."""
    line = F.substring_index(F.ltrim(text_of()), "\n", 1)
    light = docs.select("doc_id", F.explode(F.array_distinct(F.array(F.trim(line), F.trim(F.substring(line, 1, cut))))).alias("key")).where("key <> ''")
    votes = light.join(labels.where("quality IN (0, 1)").select("doc_id", "quality"), "doc_id").groupBy("key").agg(F.avg("quality").alias("good"))
    return votes.select("key", (F.col("good") >= 0.5).cast("int").alias("label"))


def op1_url_filters(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", title_of(text_of("html")).alias("key"))
    return filter_urls(pages, title_labels(docs, labels), RULES)


#: Levels written out in the SQL; the operator itself goes on for as long as paths do.
SQL_LEVELS = 8


def _oracle() -> str:
    """The query in DuckDB SQL: the same levels, siblings and smoothing over whole tables."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    title = "regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        title = f"replace({title}, '{name}', '{mark}')"
    line = "split_part(ltrim(coalesce(text, ''), ' '), chr(10), 1)"
    apart = "(({0}) * ({3} - {1}) - ({2} - {0}) * {1}) ** 2 * {3} > {4}::DOUBLE * {1} * ({3} - {1}) * {2} * ({3} - {2})".format
    tally = "count(*)::DOUBLE AS n, count(label)::DOUBLE AS known, (count(*) FILTER (label = 0))::DOUBLE AS bad"
    steps = [f"""
openings AS (SELECT doc_id, trim({line}, ' ') AS key FROM documents UNION SELECT doc_id, trim(substring({line}, 1, {HEADING}), ' ') FROM documents),
votes AS (SELECT key, (avg(quality) >= 0.5)::INT AS label FROM openings JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND key <> '' GROUP BY 1),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                 trim(coalesce({title}, ''), ' ') AS key FROM pages),
t0 AS (SELECT page_id, host, path, label, list_filter(str_split(path, '/'), lambda s: s <> '') AS segments, '' AS template
       FROM parts LEFT JOIN votes USING (key))"""]
    for k in range(1, SQL_LEVELS + 1):
        steps.append(f"""
s{k} AS (SELECT *, segments[{k}] AS segment FROM t{k - 1}),
c{k} AS (SELECT host, template, segment, {tally} FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT host, template, sum(n) AS pages, count(*) AS vals, sum(known) AS of, sum(bad) AS worse, true AS wide FROM c{k} GROUP BY ALL HAVING sum(n) >= {LITERAL_PAGES}),
l{k} AS (SELECT host, template, segment, true AS literal FROM c{k} JOIN n{k} USING (host, template)
         WHERE n >= {LITERAL_PAGES} AND (pages >= {LITERAL_PAGES} * vals OR {apart('bad', 'known', 'worse', 'of', LITERAL_Z ** 2)})),
t{k} AS (SELECT page_id, host, path, label, CASE WHEN wide THEN segments END AS segments,
                s.template || CASE WHEN segment IS NULL THEN '' WHEN wide IS NULL THEN '/**' WHEN literal THEN '/' || segment ELSE '/*' END AS template
         FROM s{k} s LEFT JOIN n{k} USING (host, template) LEFT JOIN l{k} USING (host, template, segment))""")
    fits = {r: f"((host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[len(r.split('/')[0]):]}'))" for r in RULES}
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in sorted(RULES, key=len, reverse=True))
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    steps.append(f"""
leaves AS (SELECT host, template, regexp_extract(template, '^(.*)/[^/]*$', 1) AS parent, {tally} FROM t{SQL_LEVELS} GROUP BY host, template),
whole AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(known) + 2) AS w FROM leaves),
hosts AS (SELECT host, (sum(bad) + {HOST_WEIGHT}::DOUBLE * any_value(w)) / (sum(known) + {HOST_WEIGHT}::DOUBLE) AS bad_host FROM leaves, whole GROUP BY host),
pooled AS (SELECT *, sum(known) OVER (PARTITION BY host, parent) AS all_known, sum(bad) OVER (PARTITION BY host, parent) AS all_bad FROM leaves),
cuts AS (SELECT *, CASE WHEN {apart('bad', 'known', 'all_bad', 'all_known', MERGE_Z ** 2)} THEN 1 + floor({SHARES} * bad / known) ELSE 0 END AS branch FROM pooled),
merged AS (SELECT *, sum(known) OVER (PARTITION BY host, parent, branch) AS of, sum(bad) OVER (PARTITION BY host, parent, branch) AS n_bad FROM cuts),
scored AS (SELECT host, template, (n_bad + {BRANCH_WEIGHT}::DOUBLE * bad_host) / (of + {BRANCH_WEIGHT}::DOUBLE) AS bad_share FROM merged JOIN hosts USING (host)),
ruled AS (SELECT *, CASE {rule} END AS rule FROM t{SQL_LEVELS} JOIN scored USING (host, template))
SELECT page_id, host, path, rule, coalesce(CASE rule {verdict} END, CASE WHEN bad_share > {MAX_BAD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       template, bad_share FROM ruled""")
    return "WITH" + ",".join(steps)


SQL = _oracle()
