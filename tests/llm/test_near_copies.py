"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from siteseries.llm import crowds as C
from siteseries.llm import near_copies as N
from siteseries.llm import simhash as S
from tests.llm.test_dedup import docs_of

FOLDER = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(pairs):
    sets = [plain_shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            holders.setdefault(x, []).append(i)
    for i, j in {(i, j) for own in holders.values() for i in own for j in own if i < j}:
        if jaccard(sets[i], sets[j]) >= 0.8:
            root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(pairs):
        best[find(k)] = min(best.get(find(k), (True, 0)), (i is None, i or 0))
    return sorted(str(None if none else i) for none, i in best.values())


@pytest.mark.parametrize("sets", [2, 1024])
def test_near_stage_equals_brute_force_jaccard(spark, monkeypatch, sets):
    """Also with keys cut into parts of two sets."""
    monkeypatch.setattr(C, "BYTES", sets * C.LEAST)
    rng = random.Random(7)
    pairs = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (None, "only without an id"), (None, "w " * 3000)]
    for k in range(40):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice((6, 30, 120, 700)))]
        for n in range(4):
            words = list(base)
            for at in rng.sample(range(len(words)), min(len(words), round(len(words) * rng.choice((0, 0.01, 0.02, 0.03))))):
                words[at] = f"x{rng.randrange(10**5)}"
            pairs.append((10 * k + n, " ".join(words)))
    rng.shuffle(pairs)
    docs = docs_of(spark, pairs)
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    want = kept_by_brute_force(pairs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert S.near_dedup(docs).count() > len(want)
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_near_stage_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near(spark, docs, FOLDER).collect()) == kept_by_brute_force(pairs)


def test_similarity_is_decided_on_the_sets():
    reader, rng = N.ShingleReader(), random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = [str(rng.randrange(30)) for _ in range(n)]
        b = a[:rng.randrange(1, n + 1)] + [str(rng.randrange(30)) for _ in range(rng.randrange(6))]
        x, y = " ".join(a), " \n".join(b)
        assert C.similar(reader.shingles(x), reader.shingles(y), N.PERCENT) == (jaccard(plain_shingles(x), plain_shingles(y)) >= 0.8)


def test_candidates_come_from_simhash_anchors(spark, monkeypatch):
    """Also with the anchors of twelve million nodes, at a similarity of 0.8 just met; unlike texts are no candidates."""
    rng = np.random.default_rng(5)
    pairs = []
    for n in rng.choice([9, 45, 90, 900], 300):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[n // 9:], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]
        pairs.append((N.fingerprint(a), N.fingerprint(b)))
    fps = spark.createDataFrame([(bytearray(f),) for f in sorted({f for p in pairs for f in p})], "fp binary")
    for nodes in (600, 12_000_000):
        monkeypatch.setattr(N, "layout", lambda _, made=N.layout(nodes) if nodes == 600 else (16, 93): made)
        root = {bytes(r.node): bytes(r.root) for r in N.candidates(fps).collect()}
        same = [root.get(a, a) == root.get(b, b) for a, b in pairs]
        assert np.mean(same) >= 0.97
        groups = {}
        for a, b in pairs:
            groups.setdefault(root.get(a, a), set()).add(a)
        assert max(map(len, groups.values())) == 1


def test_anchors_follow_the_number_of_nodes():
    assert N.layout(200) == (8, 48) and N.layout(12_000_000) == (16, 93)


def test_sets_travel_only_to_their_parts(spark, monkeypatch):
    """Neither their sizes nor the join with few visits has the sets shuffled, whatever the size estimates say."""
    plans, made = [], N.verified

    def verified(visits, *rest):
        plans.append(visits._jdf.queryExecution().executedPlan().toString())
        assert "size" in visits.columns and len(rest) == 2
        return made(visits, *rest)

    monkeypatch.setattr(N, "verified", verified)
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w", "a b c d e f g h i j k l m n o p q r s t u v", "other words here and no more of them", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.doc_id for r in N.similar_dedup(docs).collect()) == [0, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p for p in plans)
