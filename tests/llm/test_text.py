"""Packing, scores, rules, URL filters, tokenizers and secret scans, on edge cases and against brute force."""

import base64
import gzip
import json
import math
import random
import re
import struct
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteseries.llm import packing as P
from siteseries.llm import piece_sampling as S
from siteseries.llm import quality_classifier as Q
from siteseries.llm import quality_rules as R
from siteseries.llm import secrets_scan as X
from siteseries.llm import token_counts as T
from siteseries.llm import url_filters as U
from siteseries.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, row string, words int, label int, score double, spans string, clean string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "r", 1, 1, 0.5, "s", "c") for i, t in pairs], SCHEMA)


TEXTS = ["", "a", "It's <|endoftext|>don't <|ENDOFTEXT|> 'S x's. ÉTÉ été. É't! a!!'s", " \t a b.\x0bc 　 d  \n\n e ", "x" * 5000 + "!!!", "漢字.カ éa. ▁ ▁x \U0010fffe",
         "word " * 9000, "12345 ½ ΣΑΣ İx\r\n tail ", "\x85\xa0\u2028q"]
CASES = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (101, "same text"), (101, "same text")]


# Packing

@pytest.fixture(scope="module")
def clip():
    return tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_word_encoder_equals_library(clip):
    with open(tokenizer_path("word_bpe_49k.json")) as f:
        encoder = P.WordEncoder(f.read())
    rng = random.Random(1)
    alphabet = [*"aAéÉß .,!'*&%<|>\n\t1½漢", "'s", "<|endoftext|>", "the", "Ḧ", "h̤", "Σ"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == clip.encode(text, add_special_tokens=False).ids, text


def test_packing_places_every_token_once(spark, clip):
    capacity = 64
    rows = P.pack_documents(docs_of(spark, CASES).repartition(3), tokenizer_path("word_bpe_49k.json"), capacity=capacity, keep_ids=True).collect()
    want = sorted((str(i), clip.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in CASES)
    docs, taken = defaultdict(list), defaultdict(set)
    for r in rows:
        docs[r.doc_id].append(r)
        ids = struct.unpack(f"<{len(r.ids) // 4}I", r.ids)
        assert len(ids) == r.length <= capacity and r.ids_crc32 == zlib.crc32(r.ids)
        spots = set(range(r.offset, r.offset + r.length))
        assert not spots & taken[r.sequence_id]
        taken[r.sequence_id] |= spots
    assert all(t == set(range(len(t))) and len(t) <= capacity for t in taken.values())
    got = []
    for i, parts in docs.items():
        copies = Counter(r.piece for r in parts)[0]
        if copies == 1:
            parts.sort(key=lambda r: r.piece)
            assert [r.start for r in parts] == [capacity * k for k in range(len(parts))]
            assert all(r.length == capacity for r in parts[:-1])
            got.append((str(i), [x for r in parts for x in struct.unpack(f"<{len(r.ids) // 4}I", r.ids)]))
        else:
            got += [(str(i), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in parts]
    assert sorted(got) == want
    total = sum(len(x) for _, x in want)
    assert len(taken) <= -(-total // capacity) + 2
    assert P.pack_documents(docs_of(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 1, 2048) if seed else np.array([2048] * 9 + [1025] * 7 + [1] * 3)
    histogram = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
    plan, placed = P.plan(histogram), Counter()
    for config, times in plan:
        assert sum(l * a for l, a in config) <= 2048 and times > 0
        for l, a in config:
            placed[l] += a * times
    assert placed == histogram
    used = sum(times for _, times in plan)
    assert used <= sum(times for _, times in P.best_fit(histogram, 2048))
    assert P.plan({}) == []


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    items = [rng.randrange(1, 60) for _ in range(300)]
    rooms = []
    for x in sorted(items, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= x]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(100 - x)
    got = P.best_fit(dict(Counter(items)), 100)
    assert sum(times for _, times in got) == len(rooms)
    assert Counter({x: 0}) + sum((Counter({l: a * times for l, a in config}) for config, times in got), Counter()) == Counter(items)


@pytest.mark.parametrize("sf, bound", [("sf0.001", 88), ("sf0.01", 442)])
def test_documents_are_packed_as_tightly_as_their_volume(spark, sf, bound):
    out = P.op2_pack_documents(spark, f"/root/testdata/{sf}")
    assert out.select("sequence_id").distinct().count() == bound


def test_what_the_encoder_remembers_is_bounded_while_it_encodes(clip):
    made = []
    held = P.Recent(lambda t: made.append(t) or t.encode(), 64_000)
    for k in range(3000):
        assert held[f"w{k}"] == f"w{k}".encode()
        assert held["hot"] == b"hot"
    assert len(held) + len(held.older) < 64_000 / 250 and made.count("hot") < 100
    assert held["x" * 10_000] == b"x" * 10_000 and "x" * 10_000 not in held
    with open(tokenizer_path("word_bpe_49k.json")) as f:
        encoder = P.WordEncoder(f.read())
    encoder.chunks, encoder.words = P.Recent(encoder.chunk, 4000), P.Recent(encoder.word, 4000)
    text = " ".join(f"Wörd{k % 70}, a{k % 50}!" for k in range(2000))
    assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == clip.encode(text, add_special_tokens=False).ids


def test_capitals_and_marks_of_plain_texts_do_not_take_the_full_way(clip):
    with open(tokenizer_path("word_bpe_49k.json")) as f:
        encoder = P.WordEncoder(f.read())
    taken, full = [], encoder.whole
    encoder.whole = lambda text: taken.append(text) or full(text)
    text = "Été, ÉTÉ!!! (l'Été) «Ñandú»\tAÑO 12½ µ ª x's ß÷Ø" * 3
    assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == clip.encode(text, add_special_tokens=False).ids
    assert not [t for t in taken if any(c.isalpha() for c in t.replace("'s", ""))]
    rng = random.Random(5)
    alphabet = [*map(chr, range(9, 14)), *map(chr, range(32, 0x250)), *["'ll", "'S", " ", "\n", "<|", "<|endoftext|>", "\u0301", "\x1c"] * 9]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == clip.encode(text, add_special_tokens=False).ids, text


def test_large_ids_beside_nulls_stay_exact(spark):
    from siteseries.llm.line_dedup import lines_of
    big = (1 << 62) + 1
    docs = docs_of(spark, [(big, "a b c d e f"), (None, "x")]).coalesce(1)
    ids = {big, None}
    assert {r.doc_id for r in P.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()} == ids
    assert {r.doc_id for r in S.encode(docs, tokenizer_path("piece_bpe_32k.model")).collect()} == ids
    assert {r.doc_id for r in lines_of(docs, "doc_id", "text").collect()} == ids


def test_knapsack_is_best():
    rng = random.Random(0)
    lengths = np.array([3, 5, 7])
    for _ in range(20):
        prices = np.array([rng.random() for _ in lengths])
        value, last = P.knapsack(prices, lengths, 20)
        brute = max(a * prices[0] + b * prices[1] + c * prices[2] for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
        assert value[20] == pytest.approx(brute)
        assert sum(prices[list(lengths).index(x)] for x in P.unfold(last, 20)) == pytest.approx(brute)


# Tokens and pieces

def test_token_counts_equal_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = T.count_tokens(docs_of(spark, CASES), path).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in CASES)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert T.count_tokens(docs_of(spark, []), path).count() == 0


@pytest.mark.parametrize("chunk,states,words", [(1 << 16, 400_000, 500_000), (7, 400_000, 500_000), (5, 50, 3)])
def test_transducer_on_random_texts(monkeypatch, chunk, states, words):
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "STATES", states)
    monkeypatch.setattr(T, "WORDS", words)
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    with open(path) as f:
        machine = T.Transducer(f.read())
    rng = random.Random(chunk)
    alphabet = [*" \n\t'srtvelmdxAé漢１½!?\x85.#<|>😀̈\x1c", "<|endoftext|>", "'re", "'ll", "  ", "the", " and"]
    for _ in range(2500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_pieces_decode_to_the_text(spark):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    runs = []
    for parts in (1, 3):
        made = S.encode(docs_of(spark, CASES).repartition(parts), path)
        from pyspark.sql import functions as F
        rows = made.select("doc_id", "text", "ids", S.decode(made, F.col("ids"), path).alias("back")).collect()
        assert all(r.back == r.text for r in rows) and len(rows) == len(CASES)
        runs.append(sorted((str(r.doc_id), bytes(r.ids)) for r in rows))
    assert runs[0] == runs[1]
    for i, ids in runs[0]:
        if i == "101":
            assert library.decode(np.frombuffer(ids, "<i4").tolist()) == "same text"
    assert len({ids for i, ids in runs[0] if i == "101"}) == 1
    checked = S.encode(docs_of(spark, CASES), path, verify=True).collect()
    assert all(r.lossless for r in checked) and sorted((str(r.doc_id), bytes(r.ids)) for r in checked) == runs[0]
    assert S.encode(docs_of(spark, []), path).count() == 0


def test_pieces_are_drawn_by_their_weight():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        sampler = S.Sampler(S.Pieces(f.read(), 0.7))
    pieces, word = sampler.pieces, "▁thing"
    of = {pieces.bytes[i].decode().replace(" ", "▁"): (i, pieces.weight[i]) for i in range(len(pieces.bytes)) if pieces.weight[i] > 0}

    def ways(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in of:
                for tail, w in ways(rest[k:]):
                    yield (of[rest[:k]][0], *tail), w * of[rest[:k]][1]

    want = dict(ways(word))
    total, n = sum(want.values()), 40_000
    drawn = Counter(tuple(x.tolist()) for x in sampler.sample(np.arange(n, dtype=np.uint64) * np.uint64(7919), ["thing"] * n))
    assert set(drawn) <= set(want)
    for way, w in want.items():
        p = w / total
        assert abs(drawn[way] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_long_words_do_not_underflow():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        sampler = S.Sampler(S.Pieces(f.read(), 1.0))
    text = "qzxj" * 3000
    (ids,) = sampler.sample(np.array([1], np.uint64), [text])
    assert S.plain(b"".join(sampler.pieces.bytes[i] for i in ids.tolist())) == text


def test_shares_of_long_words_are_those_of_a_direct_forward_pass():
    """At every place of a word of 500 characters, the shares of the pieces that may end there, beside logarithms of all masses."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        p = S.Pieces(f.read(), 1.0)
    weight_of = {p.bytes[i].decode(): p.weight[i] for i in range(len(p.bytes)) if p.weight[i] > 0}
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdluqzxj") for _ in range(n)) for n in (500, 400, 30)]
    sampler = S.Sampler(p)
    sampler.filter(words)
    for word, first in zip(words, sampler.first):
        logs = [0.0] + [-math.inf] * len(word)
        for place in range(1, len(word) + 1):
            arcs = {n: logs[place - n] + math.log(w) for n in range(1, min(place, p.longest) + 1) if (w := weight_of.get(word[place - n:place]))}
            logs[place] = max(arcs.values()) + math.log(sum(math.exp(x - max(arcs.values())) for x in arcs.values()))
            node = first + place
            lo, hi = np.searchsorted(np.floor(sampler.bound - 1e-12), [node, node + 1])
            got = dict(zip(sampler.back[lo:hi].tolist(), np.diff(sampler.bound[lo:hi] - node, prepend=0.0).tolist()))
            assert got.keys() == arcs.keys()
            assert all(abs(got[n] - math.exp(arcs[n] - logs[place])) < 1e-6 for n in arcs)


# Classifier and rules

def junk(rng, words):
    return " ".join(w + "***" for w in rng.sample(words, 80))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioutrns") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows = [(k, junk(rng, words) if k % 4 == 0 else ". ".join(rng.sample(words, 90))) for k in range(600)]
    docs = docs_of(spark, rows + [(900, None), (901, ""), (None, "x y"), (902, "w " * 50_000), (0, rows[0][1])])
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0, "x") for k in range(500)] + [(None, 1, 0, "x"), (5, None, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_classifier_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    rows = Q.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held if r.held_out) >= 0.97 * sum(r.held_out for r in held)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert Q.scores(docs.limit(0), labels).count() == 0 and Q.keep_good(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_discriminant_equals_dense_formula():
    rng = np.random.default_rng(0)
    x = {q: rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + q for q in (0, 1)}
    model = Q.discriminant({q: (len(v), v.sum(0), v.T @ v) for q, v in x.items()}, pooled=0, diagonal=0, floor=0)
    at = rng.normal(size=(20, 3))
    density = [-0.5 * np.einsum("ij,jk,ik->i", at - v.mean(0), np.linalg.inv(np.cov(v.T, bias=True)), at - v.mean(0)) - 0.5 * np.linalg.slogdet(np.cov(v.T, bias=True))[1] for v in x.values()]
    assert np.allclose(model.score(at), 1 / (1 + np.exp(density[0] - density[1])))


def base_truth(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i:i + 8])].append(i)
    covered = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = random.Random(2)
    texts = TEXTS + [None, " ".join(rng.choice("ab") for _ in range(60)), "a b c d e f g h " * 3, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "l\nl\n \nl|#\nm", "é*É\n\n"]
    rows = R.measured(docs_of(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {k: base_truth(t) for k, t in enumerate(texts)}


def test_rules_learn_junk_and_spare_the_rest(spark, labelled):
    docs, labels = labelled
    rows = R.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.kept == (r.doc_id % 4 != 0)
        assert not (r.kept and r.base_failed)
    assert R.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in R.judge(docs, labels.limit(0)).collect())


def test_ordered_list_is_a_conditional_expression(spark):
    rules = [[R.Condition("n_words", True, 10.0, 0, 1), R.Condition("bang_rate", False, 0.5, 1, 1)], [R.Condition("bang_rate", True, 2.0, 1, 2)]]
    df = spark.createDataFrame([(12, 0.1), (12, 0.9), (3, 0.1), (3, 2.0)], "n_words int, bang_rate double")
    assert [r[0] for r in df.select(R.decision(rules)).collect()] == [False, True, True, False]


# URL filters

URLS = ["https://Shop.EXAMPLE.org/es/1?x=/q", "http://example.org/en/17#a", "x://org/", "x://org", "https://a.com/fr/2", "https://a.com/de/2", "https://notcom/de/2", None, "no host/x",
        "http://h.net?q", "http://h.net#f", "://é.COM/fr/É", "http://myexample.org/es/9", "a://b://c/d", "http://x\n.com/de/\nz"]


def url_truth(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
    return host, path, max(fits, key=len, default=None)


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "t") for k, u in enumerate(URLS)] + [(1, URLS[1], "h", "t")], "page_id long, url string, host string, template string")
    rows = U.filter_urls(pages, None, U.RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = url_truth(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (U.RULES[rule] if rule else "allow")
    assert U.filter_urls(pages.limit(0), None, U.RULES).count() == 0


def test_templates_generalise_and_bad_branches_are_blocked(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for k in range(900):
        part = ("news", "tag", "spam")[k % 3]
        pages.append((k, f"http://h.net/{part}/{rng.randrange(10**6)}/view", f"k{k}"))
        if k % 2 == 0:
            labels.append((f"k{k}", int(part != "spam")))
    frame = spark.createDataFrame(pages, "page_id long, url string, key string")
    rows = U.filter_urls(frame, spark.createDataFrame(labels, "key string, label int"), {}).collect()
    assert {r.template for r in rows} == {"/news/*/view", "/tag/*/view", "/spam/*/view"} or {r.template for r in rows} == {"/news/*/*", "/tag/*/*", "/spam/*/*"}
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in rows)
    assert len({r.bad_share for r in rows if "/spam/" not in r.path}) >= 1


def judged(spark, pages):
    """The verdicts of (url, label) pages, all labelled, by url."""
    frame = spark.createDataFrame([(k, u, f"k{k}") for k, (u, _) in enumerate(pages)], "page_id long, url string, key string")
    labels = spark.createDataFrame([(f"k{k}", y) for k, (_, y) in enumerate(pages)], "key string, label int")
    return U.filter_urls(frame, labels, {}).collect()


def test_a_bad_section_with_a_small_share_of_its_host_is_blocked(spark):
    rows = judged(spark, [(f"http://h.net/s{k % 25}/{k}", int(k % 25 != 7)) for k in range(5000)])
    assert all((r.verdict == "block") == r.path.startswith("/s7/") for r in rows)


def test_bad_branches_are_blocked_at_any_depth(spark):
    rows = judged(spark, [(f"http://h.net/a/b/c/d/e/f/g/{('good', 'bad')[k % 2]}/{k}", int(k % 2 == 0)) for k in range(4000)])
    assert {r.template.rpartition("/")[0] for r in rows} == {"/a/b/c/d/e/f/g/good", "/a/b/c/d/e/f/g/bad"}
    assert all((r.verdict == "block") == ("/bad/" in r.path) for r in rows)


def test_sections_with_rising_shares_do_not_chain_into_one_branch(spark):
    rows = judged(spark, [(f"http://h.net/s{s}", int(k % 14 >= s)) for s in range(15) for k in range(70)])
    verdicts = {r.path: r.verdict for r in rows}
    assert all(verdicts[f"/s{s}"] == "allow" for s in range(5)) and all(verdicts[f"/s{s}"] == "block" for s in range(10, 15))


def test_a_bad_value_among_ids_is_told_apart_by_its_labels(spark):
    rows = judged(spark, [(f"http://h.net/{k}", 1) for k in range(3000)] + [(f"http://h.net/promo/{k}", 0) for k in range(30)])
    assert {r.template for r in rows} == {"/*", "/promo/*"}
    assert all((r.verdict == "block") == r.path.startswith("/promo/") for r in rows)


def test_long_and_repeated_urls(spark):
    long = "http://h.net/" + "seg/" * 20000
    rows = judged(spark, [(long, 1), (long, 1), ("http://h.net/" + "x" * 100000, 0)])
    assert len(rows) == 3 and {r.template for r in rows} == {"/**"}


def test_labels_join_by_whole_headings(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + " good\nmore"), (2, "x" * 50 + " bad\nmore"), (3, "  short\nrest"), (4, "y" * 80), (5, None), (6, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)], "doc_id long, quality int")
    got = {r.key: r.label for r in U.title_labels(docs, labels).collect()}
    assert got == {"x" * 50 + " good": 1, "x" * 50 + " bad": 0, "short": 0, "y" * 80: 1, "y" * 60: 1}


# Secrets

SECRET = "token=abcdefgh12345"


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_patterns():
    rng = random.Random(6)
    parts = ["token", "TOKEN=", "secret: ", "api_key", "apiKey='", "ſecret=", " ", "=", ":", '"', "abcdefgh", "AKIA", "Z9" * 7, "0f" * 17, "g", "é", "passwd", "\n", "-."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert X.scan(text) == base_spans(text), text


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s).decode(), lambda s: base64.urlsafe_b64encode(b"??>>" + s).decode().rstrip("="),
    lambda s: base64.b64encode(gzip.compress(s)).decode(), lambda s: base64.b64encode(zlib.compress(zlib.compress(s))).decode(),
    lambda s: "".join(f"%{b:02X}" for b in s), lambda s: "".join(f"\\u{b:04x}" for b in s), lambda s: "".join(f"\\x{b:02x}" for b in s),
    lambda s: "".join(f"&#{b};" for b in s), lambda s: urllib.parse.quote(urllib.parse.quote("".join(f"%{b:02X}" for b in s))),
    lambda s: base64.b64encode(base64.b64encode(zlib.compress(base64.b64encode(s)))).decode(),
    lambda s: urllib.parse.quote(base64.b64encode("".join(f"\\u{b:04x}" for b in s).encode()).decode(), safe=""),
])
def test_nested_layers_are_unwrapped(wrap):
    inner = wrap(SECRET.encode())
    text = f"é before {inner} after"
    found = X.secrets_of(text)
    assert any(k == 0 and a == 9 and b == 9 + len(inner) and layer > 0 for a, k, b, layer in found)
    assert X.redacted(text) == f"é before {X.MASK} after"


@pytest.mark.parametrize("layer", [
    f"n°\u00a01\u00a0: {SECRET}".encode(), b"\xef\xbb\xbf" + SECRET.encode(), f"\u200b\f\0{SECRET}".encode(), b"caf\xe9 \xff\xfe " + SECRET.encode() + b" \x80", b"x caf\xe9 " + SECRET.encode(),
    gzip.compress(b"first") + gzip.compress(SECRET.encode()), gzip.compress(b"first") + zlib.compress(b"x") + gzip.compress(gzip.compress(SECRET.encode())),
    gzip.compress(SECRET.encode())[:-6] + b"damaged", gzip.compress(b"first") + b"\0\0\0\0 " + SECRET.encode(),
])
def test_every_layer_is_scanned_whole(layer):
    run = base64.b64encode(layer).decode()
    assert X.redacted(f"before {run} after") == f"before {X.MASK} after"


def test_every_frame_is_scanned():
    zstandard = pytest.importorskip("zstandard")
    made = zstandard.ZstdCompressor().compress
    run = base64.b64encode(made(b"first") + made(b"x" * 3_000_000) + made(SECRET.encode())).decode()
    assert X.redacted(f"before {run} after") == f"before {X.MASK} after"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_base64_is_one_layer(end, width):
    rng = random.Random(width)
    noise = " ".join(f"{rng.getrandbits(60):x}" for _ in range(60))
    for plain in (b"." * (width // 4 * 3 - 10) + SECRET.encode(), gzip.compress(f"{noise} {SECRET} {noise}".encode())):
        run = base64.b64encode(plain).decode()
        text = end.join(run[k:k + width] for k in range(0, len(run), width))
        assert X.redacted(f"before: {text}. After") == f"before: {X.MASK}. After"


def test_layers_past_64_mb_are_read_to_their_end():
    run = base64.b64encode(zlib.compress(zlib.compress(b", " * 35_000_000 + SECRET.encode(), 1), 9)).decode()
    assert X.redacted(f"before {run} after") == f"before {X.MASK} after"


def test_windows_part_no_secret(monkeypatch):
    monkeypatch.setattr(X, "WINDOW", 50)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice([", ", "é ", "a" * 9, SECRET, " api_key = 'abcdefghij' ", base64.b64encode(SECRET.encode()).decode(), "%41"]) for _ in range(30))
        raw = text.encode()
        parts = list(X.windows(raw[k:k + 7] for k in range(0, len(raw), 7)))
        assert "".join(parts) == text and sum(len(X.scan(p)) for p in parts) == len(X.scan(text))


def test_long_windows_keep_the_groups_of_a_run(monkeypatch):
    monkeypatch.setattr(X, "WINDOW", 50), monkeypatch.setattr(X, "MAX_RUN", 2000), monkeypatch.setattr(X, "OVERLAP", 200)
    for n in range(3000, 3012):
        inner = base64.b64encode(b"." * n + SECRET.encode() + b"." * 500)
        run = base64.b64encode(b"x " + inner).decode()
        assert X.redacted(run) == X.MASK


def test_harmless_and_endless_texts():
    assert X.secrets_of("%41%zz \\uD800 &#99999999; " + "A" * 400 + " " + base64.b64encode(b"\x78\x9c" + b"0" * 60).decode()) == []
    deep = SECRET.encode()
    for _ in range(12):
        deep = base64.b64encode(deep)
    assert [x[3] for x in X.secrets_of(deep.decode())] == [12]
    assert X.redacted("plain text") == "plain text"


def test_secrets_of_documents(spark):
    pairs = [(1, None), (2, ""), (3, "x " + SECRET), (3, "x " + SECRET), (None, "AKIA" + "A1" * 8), (5, "z" * 300_000 + " " + "ab" * 16)]
    docs = docs_of(spark, pairs)
    rows = X.find_secrets(docs).collect()
    assert sorted((str(r.doc_id), [(s.kind, s.start, s.end, s.layer) for s in r.spans]) for r in rows) == sorted(
        (str(i), [(X.KINDS[k], a, b, 0) for a, k, b in base_spans(t or "")]) for i, t in pairs)
    clean = X.redact_secrets(docs, size="words")
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    got = {r.doc_id: r for r in clean.collect()}
    assert got[1].text is None and got[3].text == "x " + X.MASK and got[3].words == len(got[3].text) and got[2].words == 1
    assert X.redact_secrets(docs.limit(0)).count() == 0 and X.find_secrets(docs.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, labelled):
    docs, labels = labelled
    for df in (R.judge(docs, labels), U.filter_urls(docs.selectExpr("doc_id AS page_id", "text AS url"), None, U.RULES)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_tokenizer_files_are_read_as_parameters():
    assert json.load(open(tokenizer_path("byte_bpe_50k.json")))["model"]["type"] == "BPE"
