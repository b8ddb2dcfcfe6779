"""The pipeline's stages, one after the other, against a plain version in Python; and the queries on the small tables."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siteseries.llm import quality_classifier as Q
from siteseries.llm import secrets_scan as X
from siteseries.llm.common import tokenizer_path
from siteseries.llm.queries import QUERIES, SQL
from tests.llm.test_near_copies import kept_by_brute_force
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def plain_quality(docs, labels):
    x = {i: np.array(Q.statistics(t or "")) for i, t in docs.items()}
    known = {q: np.array([x[i] for i, y in labels if y == q and i in x and zlib.crc32(str(i).encode()) % 5]) for q in (0, 1)}
    model = Q.discriminant({q: (len(v), v.sum(0), v.T @ v) for q, v in known.items() if len(v)})
    return {i: t for i, t in docs.items() if model.score(x[i][None])[0] >= 0.3}


def plain_exact(docs):
    best = {}
    for i, t in docs.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i)) if key in best else (-len(t or ""), i)
    return {i: docs[i] for _, i in best.values()}


def plain_near(docs):
    """Brute-force Jaccard similarity of five-word shingles, 0.8 or more; the smallest id of each group stays."""
    return {int(i): docs[int(i)] for i in kept_by_brute_force(list(docs.items()))}


def test_pipeline_equals_plain_version(spark):
    tokenizers = pytest.importorskip("tokenizers")
    con = duckdb.connect()
    docs = dict(con.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    labels = con.execute(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall()
    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = now.columns
    steps = [lambda d: plain_quality(d, labels), plain_exact, plain_near, lambda d: {i: t if t is None else X.redacted(t) for i, t in d.items()}]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps):
        now, docs = stage(spark, now, FOLDER), plain(docs)
        now = corpus_pipeline.staged(now, "test-stage")
        assert now.columns == columns, name
        assert {r.doc_id: r.text for r in now.collect()} == docs, name
        assert now.count() == len(docs)
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = defaultdict(list)
    filled = defaultdict(int)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        out[r.doc_id].append(r)
        filled[r.sequence_id] += r.length
    assert set(out) == set(docs)
    for i, parts in out.items():
        ids = np.array(library.encode(docs[i] or "", add_special_tokens=False).ids + [0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids)
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[k:k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 3


def test_registered(spark):
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    status, _ = compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert status.startswith("ok"), status
