"""Lexical search, the Merkle manifest and HyperMinHash near-dedup against brute force, with nulls, empty and long texts, ties,
repeats, empty tables, text ids and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteseries.llm import crowds as C
from siteseries.llm import hyper_minhash as H
from siteseries.llm import lexical_search as X
from siteseries.llm import merkle_manifest as M
from siteseries.llm.near_copies import ShingleReader
from tests.llm.test_dedup import docs_of
from tests.llm.test_near_copies import jaccard, plain_shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, item long, block int, node string, score int"


def rows_of(spark, rows, kind="long"):
    """Rows (doc_id, text, source) with further columns whose names the operators use inside."""
    made = [(i, t, None if k % 3 else "de", s, None if t is None else len(t), f"r{k}", k, k, "n", k) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS.replace("doc_id long", f"doc_id {kind}"))


# --- lexical search ---------------------------------------------------------------------------------------------------

def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k=10):
    """{place of the item: [(doc_id, score)]}."""
    terms = [plain_terms(t) for _, t, *_ in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for ws in terms for w in set(ws))
    out = {}
    for at, (_, text) in enumerate(items):
        wanted, scored = set(plain_terms(text)), []
        for row, ws in enumerate(terms):
            tf, m = Counter(ws), 10 + 90 * len(ws) * n_docs // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * tf[w] // (1000 * tf[w] + 8 * m))
                        for w in wanted if tf[w])
            if score > 0:
                scored.append((-score, docs[row][0] is None, docs[row][0] if docs[row][0] is not None else 0, row))
        out[at] = [(docs[s[3]][0], -s[0]) for s in sorted(scored)[:k]]
    return out


def search_cases(seed, ids=lambda k: k):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(60)] + ["Éa", "x٣y", "don't", "A1"]
    docs = [(ids(k), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))), "s") for k in range(150)]
    docs += [(ids(500), None, "s"), (ids(501), "", "s"), (ids(502), " .,;\n", "s"), (ids(503), "W1 w2\0w3-w4_w5", None), (None, "w1 w2", "s"), (None, "w1 w2", "s"),
             (ids(504), "the " * 30000 + "w7", "s"), (ids(505), docs[3][1], "s"), (ids(505), docs[3][1], "s"), (ids(3), docs[3][1], "s")]
    rng.shuffle(docs)
    items = [(k % 7, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for k in range(20)]
    return docs, items + [(50, None), (51, "nowhere else"), (None, "w1, W2"), (52, docs[5][1]), (52, docs[5][1])]


def check_search(spark, docs, items, kind="long"):
    table = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(items)], "item_id long, text string, term string, number int")
    got = X.search(rows_of(spark, docs, kind), table).collect()
    want = Counter()
    for at, found in plain_search(docs, items).items():
        want.update((items[at][0], rank, *f) for rank, f in enumerate(found, 1))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want


def test_search_equals_brute_force(spark):
    check_search(spark, *search_cases(1))


@pytest.mark.parametrize("owners", [(1.0,), (0.01, 0.02, 0.05, 0.3, 0.6, 1.0)])
def test_search_over_blocks_owners_and_passes(spark, monkeypatch, owners):
    """Small bundles, slices, blocks, stretches and dictionary parts change nothing."""
    for name, value in (("OWNERS", owners), ("BUNDLE", 4), ("SLICE", 16), ("LOT", 8), ("STRETCH", 50), ("VOCABULARY", 2000)):
        monkeypatch.setattr(X, name, value)
    check_search(spark, *search_cases(2))


def test_search_takes_text_ids_and_empty_tables(spark):
    docs, items = search_cases(3, ids="d{}".format)
    docs = [(i, t, s) for i, t, s in docs if i is not None]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = X.search(rows_of(spark, docs, "string"), table, k=3).collect()
    want = Counter()
    scores = plain_search([(k, t, s) for k, (_, t, s) in enumerate(sorted(docs, key=lambda d: d[0]))], items, 3)
    names = sorted(d[0] for d in docs)
    for at, found in scores.items():
        want.update((items[at][0], rank, names[k], score) for rank, (k, score) in enumerate(found, 1))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want
    some = rows_of(spark, docs, "string")
    assert X.search(some.limit(0), table).count() == 0 and X.search(some, table.limit(0)).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------------------------------

def test_addresses_are_a_layout(spark):
    """Every node has one place, the root the first; both ways to find it agree; lower subtrees are stretches."""
    for leaves, levels in [(1, 1), (1, 4), (2, 2), (16, 2), (17, 3), (255, 3), (256, 3), (300, 4), (4096, 4), (4095, 4), (70000, 6)]:
        found = M.addresses(leaves, levels)
        assert sorted(np.concatenate(found).tolist()) == list(range(M.stored(leaves, levels)))
        assert found[-1].tolist() == [0]
        for level in range(levels):
            for number in {0, len(found[level]) // 2, len(found[level]) - 1}:
                assert M.address(leaves, levels, level, number) == found[level][number]
    low = M.addresses(4096, 4)
    for tree in range(256):
        assert sorted([*low[0][16 * tree:16 * tree + 16], low[1][tree]]) == list(range(17 + 17 * tree, 34 + 17 * tree))


def plain_manifest(docs):
    """Rows as the query gives them, from nested lists."""
    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(i, t, s, lang, n):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)))

    def proof(nodes, at):
        """[(siblings before, siblings after)] of each level, and the root."""
        steps = []
        while len(nodes) > 1:
            lo = at // 16 * 16
            steps.append((nodes[lo:at], nodes[at + 1:lo + 16]))
            nodes, at = [h("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)], at // 16
        return steps, nodes[0]

    groups = defaultdict(list)
    for i, t, s, lang, n in docs:
        other = None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        own = leaf(i, t, s, lang, n)
        groups[s].append((i is not None, i if i is not None else 0, own, leaf(i, other, s, lang, n) if changed else own))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = {s: proof([r[2] for r in sorted(groups[s])], 0)[1] for s in names}
    out = []
    for k, s in enumerate(names):
        rows = sorted(groups[s])
        above, root = proof([subroots[x] for x in names], k)
        for at, (some, i, own, claimed) in enumerate(rows):
            steps = proof([r[2] for r in rows], at)[0] + above
            x = claimed
            for before, after in steps:
                x = h("".join([*before, x, *after]))
            out.append((i if some else None, own, subroots[s], root, h("".join("".join(b) + "".join(a) for b, a in steps)), x, x == root))
    return Counter(out)


def manifest_rows(rng):
    sources = [None, "", "a", "é", "z", "Ab"] + [f"s{k}" for k in range(40)]
    docs = [(rng.randrange(900), rng.choice([None, "", "Plain Text", "lower", "x" * 50_000 + "Y", "Ünïcode Ä"]), rng.choice(sources[:6] + sources), k) for k in range(300)]
    docs += [(k, f"Text {k}", "hot", k) for k in range(1000, 1500)]
    docs += [(7, "Same", "hot", 1), (7, "Same", "hot", 1), (None, "No id", "a", 1), (None, None, None, 1), (7, "Other", "hot", 1)]
    rng.shuffle(docs)
    return [(i, t, s, None if n % 2 else "en", n if n % 5 else None) for i, t, s, n in docs]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_nested_lists(spark, height):
    docs = manifest_rows(random.Random(height))
    table = spark.createDataFrame([(*d, "t", 1, "r") for d in docs],
                                  "doc_id long, text string, source string, lang string, n_chars long, tree string, rank int, root string")
    made = M.manifest(table, height=height, tampered=M.tampered("doc_id", "text"))
    got = M.proofs(made, "tampered").collect()
    assert Counter(map(tuple, got)) == plain_manifest(docs)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_one_row_text_ids_and_no_rows(spark):
    table = rows_of(spark, [("a", "Text", "s")], "string")
    row, = M.proofs(M.manifest(table)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    empty = M.manifest(table.limit(0))
    assert empty.root is None and M.proofs(empty).count() == 0
    both = M.proofs(M.manifest(rows_of(spark, [("b", "Text", "s"), (None, None, None), ("a", "", "")], "string"))).collect()
    assert {r.doc_id for r in both} == {"a", "b", None} and all(r.verified for r in both)


# --- HyperMinHash -----------------------------------------------------------------------------------------------------

def plain_components(pairs):
    sets = [plain_shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, j in {(i, j) for own in holders.values() for i in own for j in own if i < j}:
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), i if not sets[k] else least.get(find(k)), (i if not sets[k] else least.get(find(k))) == i) for k, (i, _) in enumerate(pairs))


def near_cases(seed):
    rng = random.Random(seed)
    pairs = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, " \n"), (905, ""), (None, "no id here at all of five words"),
             (None, None), (None, "one"), (906, "w " * 3000), (907, "v " * 20_000 + "end")]
    for k in range(50):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice((6, 11, 30, 90, 120, 700)))]
        for n in range(4):
            words = list(base)
            for at in rng.sample(range(len(words)), min(len(words), round(len(words) * rng.choice((0, 0.01, 0.015, 0.03))))):
                words[at] = f"x{rng.randrange(10**5)}"
            pairs.append((10 * k + n, " ".join(words[:len(words) - rng.randrange(2)])))
    pairs.append((3, pairs[-1][1]))
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("homes", [2, 2048])
def test_hyper_groups_equal_brute_force(spark, monkeypatch, homes):
    """Also with keys cut into parts of two sketches and of two sets, and two visitors at a time."""
    monkeypatch.setattr(H, "HOMES", homes)
    if homes == 2:
        monkeypatch.setattr(H, "LOT", 2)
        monkeypatch.setattr(C, "BYTES", 2 * C.LEAST)
    pairs = near_cases(homes)
    docs = docs_of(spark, pairs)
    got = H.hyper_groups(docs).collect()
    assert Counter(map(tuple, got)) == plain_components(pairs)
    kept = H.hyper_dedup(docs)
    assert kept.columns == docs.columns
    linked = {c for _, n, c, _ in plain_components(pairs) if n}
    without = sum(1 for _, t in pairs if not plain_shingles(t))
    assert kept.count() == len(linked) + without
    assert H.hyper_groups(docs.limit(0)).count() == 0 and H.hyper_dedup(docs.limit(0)).count() == 0


def test_hyper_groups_of_the_documents(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables absent")
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, H.op13_hyper_minhash(spark, folder).collect())) == plain_components(pairs)


def test_hyper_groups_take_text_ids(spark):
    docs = spark.createDataFrame([("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "")], "doc_id string, text string")
    assert {tuple(r) for r in H.hyper_groups(docs).collect()} == {("b", 2, "a", False), ("a", 2, "a", True), ("c", 0, "c", True)}


def pair_of(rng, union):
    both = -(-85 * union // 100)
    u = rng.integers(0, 1 << 64, union, dtype=np.uint64)
    cut = both + rng.integers(0, union - both + 1)
    return np.unique(np.r_[u[:both], u[both:cut]]), np.unique(np.r_[u[:both], u[cut:]])


@pytest.mark.parametrize("union", [7, 8, 13, 20, 40, 79, 80, 81, 90, 94, 100, 150, 400, 3000])
def test_pairs_at_the_threshold_meet(union):
    rng = np.random.default_rng(union)
    for _ in range(300):
        a, b = pair_of(rng, union)
        sa, sb = H.sketch(a), H.sketch(b)
        ka, kb = H.keys_of(a, sa, 85), H.keys_of(b, sb, 85)
        assert (len(ka[0]) and len(kb[0]) and (ka[0] == kb[0]).any()) or set(ka[1].tolist()) & set(kb[1].tolist())
        assert H.plausible(sa, len(a), sb[None], np.array([len(b)]), 85)[0]


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.6, 0.9):
        guesses = []
        for _ in range(200):
            u = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
            k = round(2000 * share)
            a, b = np.sort(u[:2000]), np.sort(np.r_[u[:k], u[2000:4000 - k]])
            guesses.append(H.estimates(H.sketch(a), H.sketch(b)[None], H.collision_chance(2000))[0][0])
        assert abs(np.mean(guesses) - share * 2000 / (4000 - 2000 * share)) < 0.01
    # Unrelated registers collide as often as expected.
    hits = tried = 0
    for _ in range(400):
        a, b = (H.sketch(np.sort(rng.integers(0, 1 << 64, 2000, dtype=np.uint64))) for _ in "ab")
        hits, tried = hits + int((a == b).sum()), tried + H.BUCKETS
    assert abs(hits - tried * H.collision_chance(2000)) < 5 * math.sqrt(tried * H.collision_chance(2000)) + 1


def test_sets_are_those_of_the_words():
    reader = ShingleReader(5)
    for text in ("", "a", "A b c d", "a b c d e", "x y " * 50, "É é z 1 2 3 4"):
        assert len(reader.shingles(text)) == len(plain_shingles(text))
    assert jaccard(plain_shingles("a b c d e f"), plain_shingles("A B C D E F")) == 1
