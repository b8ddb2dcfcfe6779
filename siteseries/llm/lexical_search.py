"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to owners, rare terms first, each owner holding the posting lists of its terms. Items travel
in bundles of up to 256; a bundle's accumulators of one slice of 4096 documents go from owner to owner. At each owner they are
cogrouped with the owner's postings of that slice, the integer contributions of its terms are added, and the bundle goes on.
The last owner keeps the best of each slice and the final selection takes the best of all slices.

Between two owners an accumulator is left out when its score plus the most that its item can still gain lies below the
score that at least `k` documents already have: such a document can never be among the best, so results stay exact. Scores are
sums of integers and do not depend on the order of owners, slices or bundles.

Terms are counted in one pass over the texts, which keeps only the item terms of a document; the dictionary of item terms is
broadcast in parts of bounded bytes, with one pass for each part. Null texts have no terms. Empty texts and texts without
terms match nothing and count for nothing in N. Texts of any length are read whole, a stretch at a time. Equal scores go by
ascending doc_id, null ids last, then by row, so repeated rows are documents of their own; repeated items get rows of their own.
Empty tables give an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteseries.llm.common import staged, table, text_of
from siteseries.llm.ranks import ranked

K = 10
LOW_PERCENT, HIGH = 90, 100  # a document's m is HIGH - LOW_PERCENT + LOW_PERCENT of its length over the mean length
SCALE = 1_000_000_000
BUNDLE, SLICE, LOT = 256, 4096, 512  # items of a bundle; documents of a slice, and of a dense block inside a task
VOCABULARY = 32 << 20  # bytes of item terms that are broadcast at once; further ones take a further pass
#: Of all postings of item terms, the share that the owners up to each hold: rare terms first, the frequent ones last.
OWNERS = (0.03, 0.15, 0.45, 1.0)
STRETCH = 1 << 22
#: ASCII letters and digits stay, A-Z lowered, other ASCII parts words; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    raw = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(raw):
        end = at + STRETCH
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            end = cut if cut > at else (raw.find(b" ", end) + 1 or len(raw) + 1) - 1
        yield raw[at:end].split()
        at = end


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """(item, term) of items (item, body): their distinct terms."""
    def split(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for item, body in zip(pdf["item"].tolist(), pdf["body"].tolist()):
                found = {w for ws in words_of(body) for w in ws}
                out.extend((item, w.decode("utf-8", "surrogatepass")) for w in found)
            yield pd.DataFrame(out, columns=["item", "term"])

    return items.select("item", text_of(text).alias("body")).mapInPandas(split, "item long, term string")


def counted(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(doc_id, row, n, hits) of docs (doc_id, row, body): n terms, and for the given words pairs of number and occurrences, packed."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        from collections import Counter

        import pandas as pd

        number = known.value.get
        for pdf in batches:
            ns, hits = [], []
            for body in pdf["body"].tolist():
                found: Counter = Counter()
                for ws in words_of(body):
                    found.update(map(number, ws))
                ns.append(found.total())
                found.pop(None, None)
                hits.append(np.array([*found.items()], np.uint32).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n": ns, "hits": hits})

    return docs.select("doc_id", "row", "body").mapInPandas(count, "doc_id string, row long, n long, hits binary")


def impacts(pairs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each (number, occurrences) adds to a score, before its term's weight; m is that of its document."""
    tf = pairs[:, 1].astype(np.int64)
    return SCALE * tf // (1000 * tf + 8 * m)


def _pairs(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of some documents, and the place of each pair's document."""
    each = np.array([len(b) // 8 for b in blobs])
    return np.frombuffer(b"".join(map(bytes, blobs)), np.uint32).reshape(-1, 2), np.repeat(np.arange(len(blobs)), each)


def term_statistics(hits: DataFrame, terms: int) -> DataFrame:
    """(number, df, most) of the hits (m, hits): documents with the term, and the most it adds before its weight."""
    def fold(batches):
        import pandas as pd

        df, most = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        for pdf in batches:
            pairs, of = _pairs(pdf["hits"].tolist())
            df += np.bincount(pairs[:, 0], minlength=terms)
            np.maximum.at(most, pairs[:, 0], impacts(pairs, pdf["m"].to_numpy()[of]))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"number": at, "df": df[at], "most": most[at]})

    parts = hits.select("m", "hits").mapInPandas(fold, "number long, df long, most long")
    return parts.groupBy("number").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def postings(hits: DataFrame, owner_of: np.ndarray, first: int) -> DataFrame:
    """(owner, slice, places, ids, counts, pairs): for each owner the pairs (number, impact) of its terms in some documents of a slice.

    The last owner's rows name every document that has a hit, with its id: those with the best scores are chosen there.
    """
    owners = hits.sparkSession.sparkContext.broadcast(owner_of)

    def deal(batches):
        import pandas as pd

        owner_of = owners.value
        last = len(OWNERS) - 1
        for pdf in batches:
            row, m, out = pdf["row"].to_numpy(), pdf["m"].to_numpy(), []
            pairs, of = _pairs(pdf["hits"].tolist())
            made = np.stack([pairs[:, 0] + np.uint32(first), impacts(pairs, m[of]).astype(np.uint32)], axis=1) if len(pairs) else pairs
            who = owner_of[pairs[:, 0]]
            ids = pdf["doc_id"].tolist()
            part = row // SLICE
            for s in np.unique(part):
                inside = part[of] == s
                held = np.unique(of[inside])
                for o in np.unique(np.append(who[inside], last)).tolist():
                    mine = inside & (who == o)
                    docs = held if o == last else np.unique(of[mine])
                    if len(docs):
                        counts = np.searchsorted(of[mine], docs, "right") - np.searchsorted(of[mine], docs)
                        out.append((o, int(s), (row[docs] % SLICE).astype(np.uint16).tobytes(), [ids[d] for d in docs] if o == last else None,
                                    counts.astype(np.uint32).tobytes(), made[mine].tobytes()))
            yield pd.DataFrame(out, columns=["owner", "slice", "places", "ids", "counts", "pairs"])

    return hits.select("row", "doc_id", "m", "hits").mapInPandas(
        deal, "owner int, slice long, places binary, ids array<string>, counts binary, pairs binary")


ENTRY = np.dtype([("item", "<u2"), ("doc", "<u2"), ("score", "<i8")])
NEED = np.dtype([("item", "<u2"), ("owner", "<u2"), ("number", "<u4"), ("weight", "<i8"), ("most", "<i8")])


def added(need: np.ndarray, owner: int, entries: np.ndarray, parts: list[tuple], least: np.ndarray) -> Iterator[np.ndarray]:
    """Accumulators after an owner: `entries` plus its terms' contributions, a block of documents at a time.

    `need` lists the terms of the bundle's items, `parts` the owner's (places, counts, pairs), `least` the score that each
    item's k-th best is known to reach, 1 at least. What cannot reach it any more is left out.
    """
    mine = need[need["owner"] == owner]
    rest = np.zeros(int(need["item"].max()) + 1, np.int64)
    later = need[need["owner"] > owner]
    np.add.at(rest, later["item"], later["most"])
    bar = least[:len(rest)] - rest
    numbers, first = np.unique(mine["number"], return_index=True)
    weight = mine["weight"][first]
    # The terms of each item, as rows of the block's matrix.
    of_item = [np.searchsorted(numbers, mine["number"][mine["item"] == i]) for i in range(len(rest))]
    docs = np.concatenate([np.repeat(np.frombuffer(p, np.uint16), np.frombuffer(c, np.uint32)) for p, c, _ in parts] or [np.empty(0, np.uint16)])
    pairs = np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 2) for *_, x in parts] or [np.empty((0, 2), np.uint32)])
    at = np.minimum(np.searchsorted(numbers, pairs[:, 0]), max(len(numbers) - 1, 0))
    held = numbers[at] == pairs[:, 0] if len(numbers) else np.zeros(len(pairs), bool)
    docs, at, value = docs[held], at[held], pairs[held, 1].astype(np.int64)
    value *= weight[at] if len(at) else 1
    order = np.argsort(docs // LOT, kind="stable")
    docs, at, value = docs[order], at[order], value[order]
    entries = entries[np.argsort(entries["doc"] // LOT, kind="stable")]
    for block in np.unique(np.append(docs // LOT, entries["doc"] // LOT)).tolist():
        lo, hi = np.searchsorted(docs // LOT, [block, block + 1])
        matrix = np.zeros((len(numbers), LOT), np.int64)
        matrix[at[lo:hi], docs[lo:hi] % LOT] = value[lo:hi]
        total = np.zeros((len(rest), LOT), np.int64)
        for i, rows in enumerate(of_item):
            if len(rows):
                matrix[rows].sum(axis=0, out=total[i])
        a, b = np.searchsorted(entries["doc"] // LOT, [block, block + 1])
        total[entries["item"][a:b], entries["doc"][a:b] % LOT] += entries["score"][a:b]
        item, doc = np.nonzero((total > 0) & (total >= bar[:, None]))
        out = np.empty(len(item), ENTRY)
        out["item"], out["doc"], out["score"] = item, block * LOT + doc, total[item, doc]
        yield out


def best(entries: np.ndarray, k: int, tie: np.ndarray | None = None) -> np.ndarray:
    """The k entries of each item with the highest scores, equal ones by `tie`, the order of the documents."""
    by = (-entries["score"], entries["item"]) if tie is None else (tie[entries["doc"]], -entries["score"], entries["item"])
    entries = entries[np.lexsort(by)]
    start = np.searchsorted(entries["item"], entries["item"])
    return entries[np.arange(len(entries)) - start < k]


def need_of(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(bundle, need) of wanted (item, term) and terms (term, number, weight, most, owner): what each bundle looks for."""
    def fold(pdf):
        import pandas as pd

        out = np.empty(len(pdf), NEED)
        for name in NEED.names:
            out[name] = pdf[name]
        return pd.DataFrame({"bundle": [pdf["bundle"].iat[0]], "need": [out.tobytes()]})

    rows = wanted.join(terms, "term").select(F.floor(F.col("item") / BUNDLE).cast("long").alias("bundle"), (F.col("item") % BUNDLE).alias("item"),
                                             "owner", "number", "weight", (F.col("weight") * F.col("most")).alias("most"))
    return staged(rows.groupBy("bundle").applyInPandas(fold, "bundle long, need binary"), "search-need")


def met(state: DataFrame, need: DataFrame) -> DataFrame:
    """Give each (bundle, slice) its bundle's need: by broadcast up to a size, else by a join that spreads a bundle's slices."""
    size = need.agg(F.sum(F.length("need") + F.length("least"))).first()[0] or 0
    if size <= VOCABULARY:
        return state.join(F.broadcast(need), "bundle")
    spread = need.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return state.withColumn("salt", F.pmod("slice", F.lit(256)).cast("int")).join(spread, ["bundle", "salt"]).drop("salt")


def stage_of(owner: int, k: int, numeric: bool):
    """The cogrouped step of one owner: a bundle's accumulators of a slice beside the owner's postings of that slice."""
    last = owner == len(OWNERS) - 1

    def step(left, right):
        import pandas as pd

        out = []
        parts = list(zip(right["places"], right["counts"], right["pairs"])) if len(right) else []
        for bundle, part, entries, need, least in zip(*[left[c] for c in ("bundle", "slice", "entries", "need", "least")]):
            need = np.frombuffer(bytes(need), NEED)
            bar = np.frombuffer(bytes(least), np.int64)
            entries = np.frombuffer(bytes(entries), ENTRY) if entries is not None else np.empty(0, ENTRY)
            blocks = list(added(need, owner, entries, [tuple(map(bytes, x)) for x in parts], bar))
            entries = np.concatenate(blocks) if blocks else np.empty(0, ENTRY)
            if last:
                ids = {}
                for places, names in zip(right["places"], right["ids"]):
                    ids.update(zip(np.frombuffer(bytes(places), np.uint16).tolist(), names))
                order = sorted(ids, key=lambda p: (ids[p] is None, (int(ids[p]) if numeric else ids[p]) if ids[p] is not None else 0, p))
                tie = np.zeros(SLICE, np.int64)
                tie[order] = np.arange(len(order))
                top = best(entries, k, tie)
                out.append((bundle, part, None, top["item"].tolist(), top["score"].tolist(), top["doc"].tolist(), [ids[p] for p in top["doc"].tolist()]))
                continue
            top = best(entries, k)
            items, counts = np.unique(top["item"], return_counts=True)
            reached = np.zeros(BUNDLE, np.int64)  # the k-th best of this slice, where it has one
            ends = np.cumsum(counts) - 1
            reached[items[counts == k]] = top["score"][ends[counts == k]]
            rest = np.zeros(BUNDLE, np.int64)
            later = need[need["owner"] > owner]
            np.add.at(rest, later["item"], later["most"])
            entries = entries[entries["score"] + rest[entries["item"]] >= reached[entries["item"]]]
            out.append((bundle, part, entries.tobytes(), top["item"].tolist(), top["score"].tolist(), None, None))
        return pd.DataFrame(out, columns=["bundle", "slice", "entries", "items", "scores", "places", "ids"])

    return step


STATE = "bundle long, slice long, entries binary, items array<int>, scores array<long>, places array<int>, ids array<string>"


def least_of(state: DataFrame, k: int) -> DataFrame:
    """(bundle, least): for each item of a bundle the score that at least k documents have by now, packed."""
    def fold(pdf):
        import pandas as pd

        out = np.ones(BUNDLE, np.int64)
        out[pdf["item"].to_numpy()] = np.maximum(pdf["score"].to_numpy(), 1)
        return pd.DataFrame({"bundle": [pdf["bundle"].iat[0]], "least": [out.tobytes()]})

    scores = state.select("bundle", F.explode(F.arrays_zip("items", "scores")).alias("e")).select("bundle", "e.items", "e.scores")
    # The filter on the row number keeps k rows an item and task before they are shuffled.
    place = F.row_number().over(W.partitionBy("bundle", "items").orderBy(F.desc("scores")))
    kth = scores.withColumn("place", place).where(F.col("place") <= k).groupBy("bundle", "items").agg(
        F.count("*").alias("n"), F.min("scores").alias("score")).where(F.col("n") == k)
    return kth.select("bundle", F.col("items").alias("item"), "score").groupBy("bundle").applyInPandas(fold, "bundle long, least binary")


def search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = K) -> DataFrame:
    """The `k` documents with the highest scores above 0 for each item: item_id, rank, doc_id, score."""
    kind, item_kind = dict(docs.dtypes)[id], dict(items.dtypes)[item_id]
    numeric = kind in ("tinyint", "smallint", "int", "bigint")

    # Items and their distinct terms get dense numbers.
    asked = staged(items.select(F.col(f"`{item_id}`").alias("item_id"), text_of(item_text).alias("body"), F.lit("").alias("all"),
                                F.monotonically_increasing_id().alias("at")), "search-asked")
    asked = staged(ranked(asked, "all", ["at"], "search-order").select("item_id", "body", F.col("rank").alias("item")), "search-items")
    wanted = staged(item_terms(asked, "body"), "search-wanted")
    words = staged(wanted.select(F.lit("").alias("all"), "term").distinct(), "search-words")
    words = staged(ranked(words, "all", ["term"], "search-numbers").select("term", F.col("rank").alias("number")), "search-terms")
    size, n_terms = words.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)), F.count("*")).first()
    width = max(1, -(-n_terms // max(1, -(-size // VOCABULARY))))
    parts = range(0, max(1, n_terms), width)  # first numbers of the parts of the dictionary

    def part_of(first: int) -> list:
        return terms_.where((F.col("number") >= first) & (F.col("number") < first + width)).collect()  # bounded by VOCABULARY

    # One pass over the texts for each part, usually one.
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("doc_id"), text_of(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    rows = rows if len(parts) == 1 else staged(rows, "search-rows")
    terms_, hits = words, []
    for first in parts:
        hits.append(staged(counted(rows, {r["term"].encode("utf-8", "surrogatepass"): r["number"] - first for r in part_of(first)}), "search-hits"))
    n_docs, total = hits[0].agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    length = F.expr(f"cast({HIGH - LOW_PERCENT} + ({LOW_PERCENT}L * n * {n_docs}L) div {max(total, 1)}L as long)")
    hits = [h.where(F.length("hits") > 0).select("doc_id", "row", length.alias("m"), "hits") for h in hits]

    # Weights, and owners by falling weight so that each has its share of the postings.
    found = None
    for first, h in zip(parts, hits):
        some = term_statistics(h, min(width, max(1, n_terms - first))).withColumn("number", F.col("number") + first)
        found = some if found is None else found.unionByName(some)
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    found = staged(found.withColumn("weight", weight), "search-weights")
    by_weight = found.groupBy("weight").agg(F.sum("df").alias("n")).orderBy(F.desc("weight")).collect()  # 1000 ln(2 N + 2) rows at most
    passed, all_, cuts = 0, sum(r["n"] for r in by_weight), []
    for r in by_weight:
        while len(cuts) < len(OWNERS) - 1 and passed >= OWNERS[len(cuts)] * all_:
            cuts.append(r["weight"])
        passed += r["n"]
    owner = F.lit(0)
    for cut in cuts:
        owner = owner + (F.col("weight") <= cut).cast("int")
    terms_ = staged(words.join(found.withColumn("owner", owner), "number"), "search-owned")

    posted = None
    for first, h in zip(parts, hits):
        owner_of = np.zeros(width, np.int64)
        for r in part_of(first):
            owner_of[r["number"] - first] = r["owner"]
        some = postings(h, owner_of, first)
        posted = some if posted is None else posted.unionByName(some)
    posted = staged(posted, "search-postings")

    need = need_of(wanted, terms_.select("term", "number", "weight", "most", "owner"))
    bundles = -(-asked.count() // BUNDLE)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(bundles, 1) - 1).cast("long"))).alias("bundle")
    state = staged(posted.select("slice").distinct().select(every, "slice").withColumn("entries", F.lit(None).cast("binary")), "search-slices")
    none = F.lit(np.ones(BUNDLE, np.int64).tobytes())
    least = None
    for o in range(len(OWNERS)):
        known = need.withColumn("least", none) if least is None else need.join(least, "bundle", "left").withColumn("least", F.coalesce("least", none))
        left = met(state.select("bundle", "slice", "entries"), staged(known, "search-known"))
        right = posted.where(F.col("owner") == o).select(every, "slice", "places", "ids", "counts", "pairs")
        state = staged(left.groupBy("bundle", "slice").cogroup(right.groupBy("bundle", "slice")).applyInPandas(stage_of(o, k, numeric), STATE),
                       f"search-state-{o}")
        least = staged(least_of(state, k), "search-least")

    chosen = state.select("bundle", "slice", F.explode(F.arrays_zip("items", "scores", "places", "ids")).alias("e"))
    chosen = chosen.select((F.col("bundle") * BUNDLE + F.col("e.items")).alias("item"), F.col("e.scores").alias("score"),
                           F.col("e.ids").cast(kind).alias("doc_id"), (F.col("slice") * SLICE + F.col("e.places")).alias("row"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return chosen.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce({_TERMS}, []) AS ws FROM documents),
total AS MATERIALIZED (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_all FROM d),
tf AS MATERIALIZED (
  SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
items AS (SELECT DISTINCT item_id, i, unnest(ws) AS term FROM (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS ws FROM benchmark)),
scored AS (
  SELECT item_id, i, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * ({HIGH - LOW_PERCENT} + ({LOW_PERCENT} * n * n_docs) // n_all))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
