"""Deduplication, mixing, URL lists and the pipeline, against plain versions."""

import hashlib
import importlib.util
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.llm import collection_bwt, jaccard_join, mixing, substring_dedup, token_output, url_lists, weak_labels
from causeway.llm.registry import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DATA = "/root/testdata/sf0.001"


def words(rng, n, k=2):
    return " ".join("".join(rng.choices("abcdefghij", k=k)) for _ in range(n))


def corpus(rng):
    """Near copies, exact copies, shared passages, odd texts."""
    base = [words(rng, rng.randint(3, 120), 3) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                v[rng.randrange(len(v))] = "zzz"
            out.append(" ".join(v) if rng.random() < 0.8 else " ".join(v).upper())
    passage = words(rng, 30, 3)
    out += [f"{words(rng, 20, 3)} {passage} {words(rng, 60, 3)}" for _ in range(6)]
    return [*out, None, "", " \n", "one two", "one two", "One TWO", "two one", "a" * 300, "a" * 200]


def plain_sets(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return sets


def plain_components(ids, texts):
    sets, up = plain_sets(texts), list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i in range(len(ids)):
        least[find(i)] = min(least[find(i)], ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("chunk", [3000, 2])
def test_jaccard_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    texts = corpus(random.Random(chunk))
    ids = random.Random(7).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, cid string")
    assert sorted(tuple(r) for r in jaccard_join.link(docs).collect()) == sorted(plain_components(ids, texts))


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (4, None), (None, "only here")], "doc_id long, text string")
    got = jaccard_join.link(docs)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got.collect()) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (3, 3), (4, 4)]
    assert jaccard_join.link(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_first(docs.where("doc_id IS NOT NULL").union(spark.createDataFrame([(9, "A b c d e f")], docs.schema)))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, "a b c d e f"), (4, None)]


def test_keep_first_decides_by_text(spark):
    far = "p q r s t u v"
    rows = [(1, "a b c d e f"), (3, "a b c d e f"), (3, far), (3, far), (3, "P q r s t u v"), (3, "short"), (5, far), (None, "x y z x y z"), (None, "x y z x y z"), (7, "k l m n o p"), (7, "k l m n o p")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, lang string")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = [(-1, "x y z x y z")] * 2 + [(1, "a b c d e f"), (3, "P q r s t u v"), (3, "short"), (7, "k l m n o p")]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_signature_bound_never_drops_a_link():
    rng = np.random.default_rng(0)
    sets, pairs = [], []
    for n in (1, 5, 63, 64, 65, 300, 1500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for drop in (0, len(a) // 7, len(a) // 4):
            b = np.unique(np.append(a[drop:], rng.integers(0, 2**63, 2 * drop // 9).astype(np.uint64)))
            pairs.append((len(sets), len(sets) + 1))
            sets += [a, b]
    known = jaccard_join.Signatures(np.array([len(s) for s in sets]), [jaccard_join.signature(s) for s in sets])
    i, j = np.array(pairs).T
    for ok, (x, y) in zip(known.may_link(i, j), pairs):
        if jaccard_join.similar(jaccard_join.overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
            assert ok
    far = np.array([[len(sets) - 1, len(sets) - 13]])
    assert not known.may_link(*far.T)[0]


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(1)
    for _ in range(5):
        sets = []
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, rng.integers(5, 200)).astype(np.uint64))
            sets += [a, a[: max(1, int(len(a) * rng.uniform(0.6, 1)))]]
        label = jaccard_join.join_sets(sets, np.arange(len(sets)))
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if jaccard_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x == max(a, b) else x for x in up]
        assert label.tolist() == up


@pytest.mark.parametrize("memory", [1 << 24, 0])
def test_collection_bwt(memory, monkeypatch):
    monkeypatch.setattr(collection_bwt, "MEMORY_ROWS", memory)
    rng = random.Random(8)
    for _ in range(60):
        texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 10))]
        size = np.array([len(t) for t in texts])
        m = np.zeros((len(texts), max(1, size.max())), np.uint8)
        for i, t in enumerate(texts):
            if t:
                m[i, -len(t) :] = list(t)
        symbol, text, length, lcp = collection_bwt.build(m, size)
        suffixes = [texts[a][len(texts[a]) - b :] for a, b in zip(text, length)]
        want = sorted((t[k:], i) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert [(s, a) for s, a in zip(suffixes, text)] == want
        assert all(c == (texts[a][len(texts[a]) - b - 1] + 1 if b < len(texts[a]) else 0) for a, b, c in zip(text, length, symbol))
        for i in range(1, len(suffixes)):
            same = 0
            while suffixes[i][: same + 1] == suffixes[i - 1][: same + 1] and same < min(map(len, suffixes[i - 1 : i + 1])):
                same += 1
            assert lcp[i] == same


def plain_removal(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for i, t in rows:
        off = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                off[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, o in zip(t, off) if not o)
        spans = sum(1 for k in range(len(t)) if off[k] and not (k and off[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark):
    rng = random.Random(9)
    texts = [*corpus(rng), "é" * 60, "x" + "é" * 40, words(rng, 40, 1) * 3, "q" * 49, "q" * 50, "q" * 50, "q" * 120]
    ids = random.Random(10).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids))), "doc_id long, text string, block int")
    got = [tuple(r) for r in substring_dedup.remove(docs).collect()]
    assert sorted(got) == sorted(plain_removal([(i, (t or "").encode()) for i, t in zip(ids, texts)]))
    odd = spark.createDataFrame([(1, "r" * 60), (1, "r" * 60), (None, "r" * 60), (2, "r" * 55)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove(odd, cut_texts=True).collect()) == [(0, 0), (1, 0), (1, 0), (2, 55)]
    assert substring_dedup.remove(odd.limit(0)).count() == 0


def test_substrings_travel_compressed(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(120)]
    docs = spark.createDataFrame([(2 * i + k, f"{k} {t}") for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    dealt, by_number = [], substring_dedup.by_number
    monkeypatch.setattr(substring_dedup, "by_number", lambda rows, column: dealt.append(rows) or by_number(rows, column))
    got = substring_dedup.remove(docs)
    assert got.where("n_removed > 0").count() == len(texts)
    sent = next(d for d in dealt if {"head", "text"} <= set(d.columns))
    size = sum(F.octet_length(c) for c, kind in sent.dtypes if kind == "binary")
    assert sent.agg(F.sum(size)).first()[0] < 4 * sum(2 * len(t) + 4 for t in texts)


def test_substrings_of_copies_travel_once(spark, monkeypatch):
    """Of a table that is nothing but copies, what is sent stays below its texts' bytes."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("etaoinshrdlu ", k=4000)) for _ in range(40)]
    docs = spark.createDataFrame([(40 * k + i, t) for k in range(8) for i, t in enumerate(texts)], "doc_id long, text string")
    dealt, by_number = [], substring_dedup.by_number
    monkeypatch.setattr(substring_dedup, "by_number", lambda rows, column: dealt.append(rows) or by_number(rows, column))
    got = substring_dedup.remove(docs)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(i, 4000 * (i >= 40)) for i in range(320)]
    size = [sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in d.dtypes if kind == "binary") for d in dealt[1:]]
    assert sum(d.agg(F.sum(n)).first()[0] for d, n in zip(dealt[1:], size)) < 320 * 4000


def test_substrings_around_one_phrase(spark):
    """A phrase too short to go, in ever new surroundings, some of which repeat: split and unsplit alike."""
    rng = random.Random(12)
    phrase = "licensed under the terms of the corpus agreement"
    assert len(phrase) < 50
    texts = [words(rng, 12) + f" {phrase} " + words(rng, 12) for _ in range(300)]
    texts += [t[5:-5] for t in texts[:20]] + texts[40:50] * 3 + ["a" + phrase + "b", "za" + phrase + "b"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(plain_removal([(i, t.encode()) for i, t in enumerate(texts)]))
    for heavy, many in ((1, 1), (20, 2), (10**9, 16)):
        assert sorted(tuple(r) for r in substring_dedup.remove(docs, heavy=heavy, many=many).collect()) == want


def test_strings_of_segments():
    rng = np.random.default_rng(13)
    count = np.array([1, 31, 4, 7])
    size = count + substring_dedup.LENGTH - 1
    data = rng.integers(0, 256, int(size.sum())).astype(np.uint8)
    start = np.cumsum(size) - size
    who, place, string = substring_dedup._strings(substring_dedup._matrix(data, start, size), count)
    assert [(w, p) for w, p in zip(who, place)] == [(w, p) for w in range(4) for p in range(count[w])]
    assert all((data[start[w] + p : start[w] + p + 50] == s).all() for w, p, s in zip(who, place, string))
    same = np.concatenate([string, string])
    assert (substring_dedup._hash(same)[: len(string)] == substring_dedup._hash(string)).all()
    assert len(np.unique(substring_dedup._hash(string))) == len(string)


def test_mixing_agrees_with_sql(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(0, 40)) or None, rng.choice(["a", "b", "b", "b", "B", "é", None])) for i in range(300)]
    rows += [(301, "", "empty"), (302, "w " * 3000, "big"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.plan_mix(docs)
    table = docs.toArrow()
    db = duckdb.connect()
    db.register("documents", table)
    want = db.sql(mixing.oracle()).df()
    key = lambda r: str(r)
    assert sorted(clean_rows(got.toPandas()), key=key) == sorted(clean_rows(want), key=key)
    per = {r["source_size"]: r["target"] for r in got.collect()}
    assert all(t <= 3 * s + 1e-6 for s, t in per.items())
    assert mixing.emit_mix(docs).count() == got.agg(F.sum("copies")).first()[0] and mixing.emit_mix(docs).columns == docs.columns
    shared = mixing.plan_mix(docs, broadcast_bytes=0)
    assert sorted(clean_rows(shared.toPandas()), key=key) == sorted(clean_rows(want), key=key)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "mix_salt" in shared._jdf.queryExecution().toString()
    emitted = [sorted(map(str, mixing.emit_mix(docs, broadcast_bytes=b).collect())) for b in (0, mixing.BROADCAST_BYTES)]
    assert emitted[0] == emitted[1] and mixing.emit_mix(docs, broadcast_bytes=0).columns == docs.columns
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.plan_mix(docs.limit(0), broadcast_bytes=-1).count() == 0
    assert mixing.plan_mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def clean_rows(d):
    return [tuple(None if pd.isna(x) else round(float(x), 6) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)]


def test_url_lists(spark):
    entries = [("1", "spam.org", "block", "2024-02-01"), ("2", "spam.org", "drop", "2024-03-01"), ("3", "Good.Spam.org", "allow", "2024-02-10"), ("4", "x.com/ads", "block", "2024-01-01"), ("5", "x.com", "allow", "2024-01-01"), ("6", None, "block", "2024-01-01"), ("7", "tie.org", "allow", "2024-01-01"), ("8", "tie.org", "block", "2024-01-01")]
    entries = spark.createDataFrame(entries, "entry_id string, key string, action string, listed_on string")
    cases = [
        ("http://a.SPAM.org./p", "2024-01-31", False), ("http://a.spam.org/p", "2024-02-01", True), ("https://u:p@spam.org:80", "2024-02-29", True), ("https://spam.org", "2024-03-01", False), ("http://z.good.spam.org/", "2024-02-20", False),
        ("http://z.good.spam.org/", "2024-02-05", True), ("http://www.x.com/ads/1?q", "2024-05-01", True), ("http://www.x.com/adsx", "2024-05-01", False), ("http://tie.org", "2024-01-02", True), ("notspam.org", "2024-02-02", False), (None, "2024-02-02", False), ("http://spam.org", None, False), ("http://notspam.org", "2024-02-02", False),
    ]
    pages = spark.createDataFrame([(i, u, f, 1) for i, (u, f, _) in enumerate(cases)] + [(1, cases[1][0], cases[1][1], 1)], "page_id long, url string, fetched string, host int")
    got = url_lists.judge(pages, entries).collect()
    assert len(got) == len(cases) + 1 and {r["page_id"]: r["blocked"] for r in got} == {i: c[2] for i, c in enumerate(cases)}
    assert url_lists.judge(pages.limit(0), entries).count() == 0 and not url_lists.judge(pages, entries.limit(0)).where("blocked").count()


def test_url_segments_keep_their_case(spark):
    entries = spark.createDataFrame([("1", "X.com/Ads", "block", "2024-01-01"), ("2", "y.com/ads", "block", "2024-01-01")], "entry_id string, key string, action string, listed_on string")
    cases = [("http://x.com/Ads/1", True), ("http://x.com/ads/1", False), ("http://Y.com/ads", True), ("http://y.com/Ads", False)]
    pages = spark.createDataFrame([(i, u, "2024-02-01") for i, (u, _) in enumerate(cases)], "page_id long, url string, fetched string")
    assert {r["page_id"]: r["blocked"] for r in url_lists.judge(pages, entries).collect()} == {i: b for i, (_, b) in enumerate(cases)}


def test_url_lists_agree_with_sql_on_capitals(spark):
    rows = [(i, f"http://h{i % 9}.Org/{s}/x") for i, s in enumerate(["Ads", "ads", "ÄB", "News", "p"] * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_lists.judge(pages.withColumn("fetched", url_lists.capture_day(F.col("page_id"))), url_lists.derived_entries(pages))
    with duckdb.connect() as db:
        db.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
        want = db.execute(url_lists.oracle()).fetchall()
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert any("/Ads" in str(r[4]) for r in want) and text(got.collect()) == text(want)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_against_plain_python(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r["doc_id"] for r in weak_labels.classify(docs).where("kept").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    ids = sorted(rows)
    comps = {i: c for i, _, c in plain_components(ids, [rows[i]["text"] for i in ids])}
    left = [i for i in ids if comps[i] == i]
    strip = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    items = [grams(strip(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = [i for i in left if not any(len(g & grams(strip(rows[i]["text"] or ""))) >= 0.6 * len(g) for g in items if g)]
    mix = mixing.plan_mix(docs.where(F.col("doc_id").isin(left))).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((r["doc_id"], len(t.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids) + 1) for r in mix for _ in range(r["copies"]))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert len(corpus_pipeline.STAGES) == 5 and token_output.END == 1


def test_stages_carry_columns_of_any_name(spark):
    names = ["target", "source_size", "mix_of", "mix_copies", "mix_size", "MIX_TARGET", "mix_turn", "quality_score", "gone_id", "many_id", "stay_id", "stay_text", "filter_place", "filter_bits", "filter_bit", "a.b", "label", "cid", "rows", "component_id"]
    base = words(random.Random(1), 80, 5)
    rows = [(1, base), (2, base + " z"), (3, base), (3, "another text of some words"), (4, None), (None, "x"), (5, "one two")]
    docs = spark.createDataFrame([(i, t, "en", "s", *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for stage in (weak_labels.keep_good, jaccard_join.keep_first, mixing.emit_mix):
        got = stage(docs)
        assert got.columns == docs.columns
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in got.collect())
    kept = jaccard_join.keep_first(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, base), (3, "another text of some words"), (4, ""), (0, "x"), (5, "one two")])


def test_filter_passes_all_that_are_among_the_ids(spark, monkeypatch):
    from causeway.llm import rows as R

    table = spark.range(-3000, 3000).union(spark.createDataFrame([(None,)], "id long"))
    for bits in (1 << 25, 1 << 10):
        monkeypatch.setattr(R, "FILTER_BITS", bits)
        some, others = R.may_have(table, "id", spark.range(0, 6000, 37))
        passed = {r[0] for r in some.collect()}
        assert set(range(0, 3000, 37)) <= passed and len(passed) + others.count() == 6001
        assert bits < 1 << 20 or len(passed) < 90


def test_names_that_clash_keep_classes_apart(spark, monkeypatch):
    real = jaccard_join.fingerprint
    monkeypatch.setattr(jaccard_join, "fingerprint", lambda s: (5, real(s)[1]) if len(s) in (3, 4) else real(s))
    assert jaccard_join.named((5, 9), frozenset([5])) == 9 and jaccard_join.named((5, 9), frozenset()) == 5
