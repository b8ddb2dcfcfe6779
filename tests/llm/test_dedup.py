"""Exact, near and line dedup against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siteseries.llm import exact_dedup as E
from siteseries.llm import line_dedup as L
from siteseries.llm import simhash as S
from siteseries.llm.components import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, size int, fp long, n_lines int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, f"r{k}", k, k, k) for k, (i, t) in enumerate(pairs)], SCHEMA)


CASES = [(5, "a b c"), (3, "abc"), (9, " a  b c "), (1, None), (2, ""), (4, " \n\t"), (None, "abc"), (7, "x" * 200_000 + " y"), (8, "x" * 200_000 + "y"),
         (11, "abd"), (11, "abd"), (12, "é è"), (13, "éè")]


def exact_truth(pairs):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(pairs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = {}
    for plain, rows in groups.items():
        best = min(rows)
        for r in rows:
            out[r[3]] = (pairs[best[3]][0], len(rows), hashlib.sha256(plain.encode()).hexdigest())
    return out


def test_exact_groups(spark):
    got = E.exact_groups(docs_of(spark, CASES), digest_all=True).collect()
    truth = exact_truth(CASES)
    want = sorted((str(CASES[k][0]), str(v[0]), v[1], v[2]) for k, v in truth.items())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_hashes_survivors_only(spark):
    got = {r.doc_id: r for r in E.exact_groups(docs_of(spark, CASES[:3] + [(20, "alone")])).collect()}
    assert got[20].text_sha256 is None and got[20].kept and got[3].text_sha256 is not None


def test_exact_dedup_keeps_whole_rows(spark):
    docs = docs_of(spark, CASES)
    got = E.exact_dedup(docs)
    assert got.columns == docs.columns
    truth = exact_truth(CASES)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted({v[2]: str(v[0]) for v in truth.values()}.values())
    assert E.exact_dedup(docs.limit(0)).count() == 0 and E.exact_groups(docs.limit(0)).count() == 0


def simple_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40):
        text = " \t".join(rng.choice(["A", "bÉ", "Cc", "d e", "漢"]) for _ in range(n))
        assert S.fingerprint(text) == simple_fingerprint(text)
    assert S.fingerprint(" ".join(map(str, range(70_000)))) == simple_fingerprint(" ".join(map(str, range(70_000))))


@pytest.mark.parametrize("wide_from", [1 << 26, 0])
def test_close_fingerprints_form_all_components(spark, monkeypatch, wide_from):
    monkeypatch.setattr(S, "blocks_of", lambda n, t, f=S.blocks_of: f(n, t, wide_from))
    monkeypatch.setattr(S, "cells_of", lambda v, item, homes=7, alike=False, f=S.cells_of: f(v, item, 7, alike))
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    points = {0, (1 << 64) - 1, *(int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64))}
    for c in centers:
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(points):
        for y in points[:i]:
            if bin(x ^ y).count("1") <= 4:
                parent[find(x)] = find(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    got = defaultdict(set)
    for r in S.near_fingerprints(fps, 4).collect():
        got[r.root].add(r.node)
    want = defaultdict(set)
    for p in points:
        want[find(p)].add(signed(p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_groups_and_dedup(spark):
    base = [f"w{i}" for i in range(400)]
    near = base[:399] + ["other"]
    pairs = [(9, " ".join(base)), (4, " ".join(near)), (6, " ".join(base)), (6, " ".join(base)), (None, " ".join(base).upper()), (1, None), (2, ""), (3, "one"),
             (8, " ".join(f"v{i}" for i in range(300)))]
    docs = docs_of(spark, pairs)
    fps = [simple_fingerprint(t) for _, t in pairs]
    linked = [[j for j, b in enumerate(fps) if bin(a ^ b).count("1") <= 4] for a in fps]
    comp = list(range(len(pairs)))
    for _ in pairs:
        comp = [min(comp[j] for j in linked[i]) for i in range(len(pairs))]
    least = {c: min((pairs[j][0] for j in range(len(pairs)) if comp[j] == c and pairs[j][0] is not None)) for c in set(comp)}
    want = sorted((str(pairs[i][0]), f"{fps[i]:016x}", least[comp[i]]) for i in range(len(pairs)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_groups(docs).collect()) == want
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert S.near_groups(docs.limit(0)).count() == 0 and S.near_dedup(docs.limit(0)).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert S.near_dedup(nameless).count() == len(least)


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        want = plain(a, b)
        assert all(L.within(a, b, k) == (want <= k) for k in range(max(len(a), len(b)) + 2))


def test_edits_by_words_are_never_too_few():
    rng = random.Random(4)
    words = [w * n for w in ("a", "bc", "é") for n in (1, 2, 5)]
    for _ in range(600):
        a = [rng.choice(words) for _ in range(rng.randrange(1, 20))]
        b = [w for w in a if rng.random() < 0.9 for w in ([w, rng.choice(words)] if rng.random() < 0.1 else [w])] or a[:1]
        cost, texts = L.edits_by_words(a, b), (" ".join(a), " ".join(b))
        assert L.within(*texts, cost) and (cost == 0) == (a == b)
    assert L.edits_by_words("one two three four".split(), "one 2 three four".split()) == 3
    assert L.similar("x" * 10, "x" * 8, 0.8) and not L.similar("x" * 10, "x" * 7, 0.8) and not L.similar("ab cd ef", "gh ij kl", 0.8)


def test_pairs_that_meet_again_are_decided_once(spark, monkeypatch):
    """Nodes that meet at several anchors of one lead: links join what is similar, and no pair is compared twice."""
    rng = random.Random(6)
    base = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(3)]
    forms = [b.replace(b[7 * k:7 * k + 6], "x" * 6) for b in base for k in range(6)]
    rows = [(anchor, 5, True, bytes([k]), 0, f) for anchor in range(8) for k, f in enumerate(forms) if k != 2 * anchor]
    asked, plain = [], (L.few_changes, L.few_edits)
    monkeypatch.setattr(L, "few_changes", lambda a, b, least: asked.append((a, b)) or plain[0](a, b, least))
    monkeypatch.setattr(L, "few_edits", lambda a, b, least: asked.append((a, b, "edits")) or plain[1](a, b, least))
    known = L.Decided([])
    for anchor in range(8):
        known.forest(homes := [(r[3], r[4], r[5]) for r in rows if r[0] == anchor], homes, L.BITS, 0.8)
    assert len({known.root(bytes([k])) for k in range(18)}) == 3 and len(known.links) == 15
    edits = [frozenset(x[:2]) for x in asked if len(x) == 3]
    assert len(edits) == len(set(edits)) <= 3 * 36 and len(asked) < 8 * 18 * 18 / 4
    visits = spark.createDataFrame(rows, "anchor long, lead long, own boolean, node binary, fp long, form string")
    groups = {bytes(r.node): bytes(r.root) for r in components(L.verified_links(visits, L.BITS, 0.8)).collect()}
    assert groups == {bytes([k]): bytes([k // 6 * 6]) for k in range(18)}


def met(reader, a, b):
    """Whether two lines come to be compared by their edit distance."""
    (x, y), (k, m) = reader.read([a.split(), b.split()])
    common = set(k) & set(m)
    return any(not key & 1 for key in common) or bool(common) and bin((x ^ y) & (2**64 - 1)).count("1") <= L.BITS


def test_recall_of_edit_similarity():
    """Of all pairs of different lines with edit similarity 0.8, found by brute force, nine in ten at least are compared."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()
    forms = sorted({b" ".join(ws) for (t,) in texts for x in t.encode().split(b"\n") if (ws := L.words_of(x))}, key=lambda f: len(f.decode()))
    size = np.array([len(f.decode()) for f in forms])
    bags = np.stack([np.bincount(np.frombuffer(f, np.uint8), minlength=256) for f in forms]).astype(np.int32)
    reader, found, all_ = L.LineReader(), 0, 0
    for i, f in enumerate(forms):
        end = np.searchsorted(size, size[i] / 0.8 + 1e-9, side="right")
        gap = bags[i + 1:end] - bags[i]
        # An edit changes at most four bytes of UTF-8 on either side.
        near = np.maximum(gap.clip(0).sum(1), (-gap).clip(0).sum(1)) <= np.where(size[i + 1:end] == bags[i + 1:end].sum(1), 1, 4) * 0.2 * size[i + 1:end]
        for j in np.flatnonzero(near) + i + 1:
            if L.similar(f.decode(), forms[j].decode(), 0.8):
                all_ += 1
                found += met(reader, f, forms[j])
    assert all_ >= 5 and found >= 0.9 * all_, (found, all_)


@pytest.mark.parametrize("words", [3, 5, 8, 9, 12, 17, 35, 70, 300])
def test_recall_of_changed_lines(words):
    """Lines with a tenth of their words changed, moved in or left out (one at least, if similar)."""
    rng, reader = random.Random(words), L.LineReader()
    vocabulary = ["".join(rng.choices("abcdefghinorst", k=rng.randrange(2, 9))) for _ in range(3000)]
    found = all_ = 0
    while all_ < 200:
        a = rng.choices(vocabulary, k=words)
        b = list(a)
        for _ in range(max(1, words // 10)):
            k, kind = rng.randrange(len(b)), rng.randrange(3)
            b[k:k + 1] = [[rng.choice(vocabulary)], [], [b[k], rng.choice(vocabulary)]][kind]
        x, y = " ".join(a), " ".join(b)
        if x != y and L.similar(x, y, 0.8):
            all_ += 1
            found += met(reader, x.encode(), y.encode())
    assert found >= 0.9 * all_, (found, all_)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    line = lambda: " ".join(rng.sample(words, 60))
    shared = [line() for _ in range(4)]
    change = lambda s, k: " ".join(w if i != k else w + "x" for i, w in enumerate(s.split(" ")))
    pairs = [(k, "\n".join([line(), change(shared[k % 4], 3 * k), "***", "", "Short one!", shared[k % 4].upper()])) for k in range(12)]
    pairs += [(20, None), (21, ""), (None, shared[0] + "\nonly here"), (22, shared[1] + "\n" + shared[1]), (22, shared[1] + "\n" + shared[1]), (23, "z" * 100_000)]
    docs = docs_of(spark, pairs)
    keys = {(r.doc_id, r.body): r.doc for r in L.keyed(docs, "doc_id", "text").collect()}
    rows = [Row(doc=keys[i, t or ""], doc_id=i, k=k, form=b" ".join(L.words_of(x.encode())).decode())
            for i, t in sorted(set(pairs), key=str) for k, x in enumerate((t or "").split("\n")) if L.words_of(x.encode())]
    forms = sorted({r.form for r in rows})
    fps = L.LineReader().fingerprints([f.encode().split() for f in forms])
    root = list(range(len(forms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for j in range(i):
            if L.similar(forms[i], forms[j], 0.8):
                root[find(i)] = find(j)
    best = {}
    where = lambda r: (r.doc_id is None, r.doc_id or 0, r.k, r.doc)
    for r in rows:
        g = find(forms.index(r.form))
        best[g] = min(best.get(g, where(r)), where(r))
    want = {(r.doc, r.k) for r in rows if where(r) != best[find(forms.index(r.form))]}
    assert {tuple(r) for r in L.repeated_lines(docs).collect()} == want
    assert any(f is not None for f in fps) and len({find(i) for i in range(len(forms))}) < len(forms)
    out = L.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and out.count() == len(pairs)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[20].text is None and texts[21].text == "" and texts[20].n_lines == 0 and "***" in texts[5].text and texts[23].n_dropped == 0
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_line_fingerprint_counts_every_pair():
    rng = random.Random(8)
    reader = L.LineReader()
    lines = [[str(rng.randrange(50)).encode() for _ in range(n)] for n in (5, 4, 300, 256, 257, 3000, 6, 40)]

    def plain(ws):
        mask = (1 << 64) - 1
        out = []
        for a, b in zip(ws, ws[1:]):
            a, b = xxh64_intdigest(a, 42), xxh64_intdigest(b, 42)
            p = (a * 0x9E3779B97F4A7C15 & mask) ^ (b + 0x632BE59BD9B4E019 & mask)
            p = (p ^ p >> 31) * 0xD6E8FEB86659FD93 & mask
            out.append(p ^ p >> 32)
        fp = sum(1 << k for k in range(64) if 2 * sum(p >> k & 1 for p in out) > len(out))
        return fp - (1 << 64) if fp >> 63 else fp

    assert reader.fingerprints(lines) == [None if len(ws) < 5 else plain(ws) for ws in lines]
    assert L.words_of("Ab-C  É,\tx1".encode()) == [b"ab", b"c", "É".encode(), b"x1"]


def test_lines_are_read_as_arrays(monkeypatch):
    """Normal forms, word hashes, lots and places of characters against their plain definitions."""
    rng = random.Random(11)
    alphabet = [*map(chr, range(128)), "\n", "\n", " ", " ", "é", "中", "😀", *"abcXYZ019" * 8]
    texts = ["", "\n", " \n ", "x\n", "y" * 40 + " z"] + ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(200)]
    forms = [[b" ".join(L.words_of(x)) for x in t.encode().split(b"\n")] for t in texts]
    assert [L.normal(t.encode()).split(b"\n") for t in texts] == forms
    for lot in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(L, "LOT", lot)
        got = [[] for _ in texts]
        for joined, spans in L.lots_of(t.encode() for t in texts):
            lines = iter(joined.split(b"\n"))
            for d, first, n in spans:
                assert first == len(got[d])
                got[d] += [next(lines) for _ in range(n)]
            assert next(lines, None) is None
        assert got == forms
    words = [rng.randbytes(n).replace(b" ", b"x") for n in range(1, 70) for _ in range(3)]
    size = np.array([len(w) for w in words])
    hashes = L.word_hashes(np.frombuffer(b" ".join(words), np.uint8), np.cumsum(size + 1) - size - 1, size)
    assert hashes.tolist() == [xxh64_intdigest(w, 42) for w in words]
    for t in texts:
        assert L.places_of(t) == {c: sum(1 << k for k, x in enumerate(t) if x == c) for c in set(t)}


def test_documents_are_read_once_for_all_their_lines(spark):
    """The texts of the lines that meet others come from one pass over a document, not from one for each line."""
    body = "A  first, line\n***\nÉté 中\nlast!"
    docs = docs_of(spark, [(1, body), (1, body), (2, None), (3, "x y\nz")])
    keys = {r.doc_id: r.doc for r in L.keyed(docs, "doc_id", "text").collect()}
    wanted = spark.createDataFrame([(bytes([k]), keys[1], k) for k in (0, 2, 3)] + [(b"z", keys[3], 1)], "node binary, doc long, k int")
    out = L.forms_of(docs, "doc_id", "text", wanted)
    assert {bytes(r.node): r.form for r in out.collect()} == {b"\0": "a first line", b"\2": "Été 中", b"\3": "last", b"z": "z"}
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("homes", [3, 4096])
def test_alike_anchors_connect_all_close_pairs(spark, monkeypatch, homes):
    monkeypatch.setattr(S, "cells_of", lambda v, item, n=homes, alike=False, f=S.cells_of: f(v, item, homes, alike))
    monkeypatch.setattr(S, "SMALL", 30)
    rng = random.Random(homes)
    points = set()
    for _ in range(20):
        c = rng.getrandbits(63)
        points |= {c ^ sum(1 << b for b in set(rng.choices(range(63), k=rng.randrange(4)))) for _ in range(rng.randrange(1, 30))}
    points = sorted(points)
    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    blocks = F.explode(F.array(*[F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535)) + F.lit(k << 16) for k in range(4)]))
    visits = fps.select(blocks.alias("anchor"), F.lit(True).alias("own"), "fp")
    got = {r.node: r.root for r in components(S.close_links(visits, 3, alike=True)).collect()}
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(points):
        for y in points[:i]:
            if bin(x ^ y).count("1") <= 3:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    groups = defaultdict(list)
    for p in points:
        groups[find(p)].append(p)
    assert got == {p: root for root, members in groups.items() if len(members) > 1 for p in members}


def test_dedup_takes_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x  y"), ("c", "x  y"), ("d", "z")], "doc_id string, text string")
    assert {r.doc_id for r in E.exact_dedup(docs).collect()} == {"a", "d"}
    assert {r.doc_id for r in S.near_dedup(docs).collect()} == {"a", "d"}
    assert {r.doc_id for r in E.exact_groups(docs).where("kept").collect()} == {"a", "d"}
