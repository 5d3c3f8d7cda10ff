"""Operators that judge or measure texts, against plain versions and on odd tables."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from causeway.llm import decontaminate, language_id, linear, quality_rules, toxicity, weak_labels
from causeway.llm.rows import held_out, is_held_out
from causeway.llm.textkernel import batches, shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
ODD = [None, "", " \t\n", "a", "a b c", "a b c d e f g h " * 3, "x " * 40, "Ünï  cöde\x0b\x0cw\x85 q", "one two\n\none two\n one two\none two\n", "# * $ % & | < > a", "é" * 5000 + " z"]
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, t in enumerate(texts)], SCHEMA)


def one(texts):
    return next(iter(batches(pa.array(texts, pa.string()), 1 << 40)))


def plain_counts(text):
    data = (text or "").encode()
    w = WORD.findall(data)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(data.count(c.encode()) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(covered))


def test_counts():
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choices("ab #|\n\t", k=rng.randint(0, 300))) for _ in range(200)]
    for limit in (1 << 40, 50):
        got = [quality_rules.measure(t) for t in batches(pa.array(texts, pa.string()), limit)]
        cols = [np.concatenate([g[c] for g in got]) for c in quality_rules.COUNTS[:5]]
        assert [tuple(int(c[i]) for c in cols) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_sliced_columns():
    whole = pa.array(["skip", "a b", None, "c"], pa.string())
    (t,) = batches(whole.slice(1))
    assert [t.text(i) for i in range(t.n)] == [b"a b", b"", b"c"]
    assert list(batches(pa.array([], pa.string()))) == []


def test_shingles_are_sets_of_five_lowered_words():
    a, b, c, d, e = shingle_sets(one(["A b c d e f", "a B c d e\tf", "a b", "b a", ""]))
    assert len(a) == 2 and (a == b).all() and len(c) == 1 and c[0] != d[0] and len(e) == 0


def test_binomial_tail():
    assert 0 < quality_rules.binomial_tail(450_000, 10**8, 0.005) < 1e-300 or quality_rules.binomial_tail(450_000, 10**8, 0.005) == 0
    for k, n, p in ((0, 10, 0.1), (9, 10, 0.9), (150, 200, 0.5), (3, 50, 0.1), (7, 200, 0.05), (10, 10, 0.3)):
        assert math.isclose(quality_rules.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_cutoffs_need_proof_and_use():
    n = 4000
    key = ("en", "symbols")
    assert quality_rules.choose({(*key, 0.1): (n, 0, 50), (*key, 0.2): (n, 0, 50)}) == {key: 0.2}  # the loosest of equals
    assert quality_rules.choose({(*key, 0.1): (n, 0, 0)}) == {}  # rejects nothing bad
    assert quality_rules.choose({(*key, 0.1): (40, 0, 30)}) == {}  # too few labels for a bound
    assert quality_rules.choose({(*key, 0.1): (n, 200, 5000)}) == {}  # rejects too many good ones


def test_rules_on_odd_tables(spark):
    docs = table(spark, [*ODD, "a b c d e f g h " * 3]).union(table(spark, ["x"]).withColumn("lang", F.lit(None)).withColumn("doc_id", F.lit(None)))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(docs, labels)
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and not any(r["kept"] and r["base_failed"] for r in rows)
    assert {r["doc_id"]: r["base_failed"] for r in rows}[0] is True
    assert quality_rules.apply_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_rules_against_a_plain_judge(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeFG", k=5))
    texts, quality = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 70))]
        bad = i % 9 == 0
        if bad:
            w = [x + "#$"[: rng.randint(0, 2)] for x in w] if i % 2 else w[:12] * 4
        texts.append(("\n" if i % 4 else " ").join(w))
        quality.append(0 if bad else 1)
    labels = [(i, q, 0) for i, q in enumerate(quality) if i % 5]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), risk=0.2, delta=0.2).collect()}

    def counts(t):
        w, lines = t.split(), [x for x in t.split("\n") if x.split()]
        seen = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {j for i, x in enumerate(seen) if seen.count(x) > 1 for j in range(i, i + 8)}
        return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice), "n_lines": len(lines), "n_capitals": sum(c.isupper() for c in t)}

    ratios = {"symbols": lambda c: c["n_symbols"] / max(c["n_words"], 1), "dup_lines": lambda c: c["n_dup_lines"] / max(c["n_lines"], 1), "repeats": lambda c: c["n_repeat_words"] / max(c["n_words"], 1), "capitals": lambda c: c["n_capitals"] / max(c["word_chars"], 1)}
    all_ = [counts(t) for t in texts]
    failed = [c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] for c in all_]
    sure = [(i, q) for i, q, _ in labels if not failed[i]]
    n, limit, tests = sum(q for _, q in sure), 0.2 / 4, []
    for rule, ratio in ratios.items():
        for c in quality_rules.GRID:
            k, bad = (sum(q == want and ratio(all_[i]) > c for i, q in sure) for want in (1, 0))
            p = 1.0 if k >= limit * n else sum(math.comb(n, x) * limit**x * (1 - limit) ** (n - x) for x in range(k + 1))
            tests.append((p, str(("en", rule, c)), rule, c, k, bad))
    best = {}
    for i, (p, _, rule, c, k, bad) in enumerate(sorted(tests)):
        if p > 0.2 / (len(tests) - i):
            break
        if bad > 5 * k and (bad - 5 * k, c) > best.get(rule, (0, 0)):
            best[rule] = (bad - 5 * k, c)
    assert best
    for i, c in enumerate(all_):
        r = got[i]
        assert {x: r[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {x: c[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert r["base_failed"] == failed[i] and r["kept"] == (not failed[i] and not any(ratios[x](c) > cut for x, (_, cut) in best.items()))


def test_learned_rule_rejects_junk_and_keeps_good(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    good, junk = [words(60) for _ in range(1500)], [words(60).replace(" ", " ### ") for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1560)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(table(spark, good + junk), labels, risk=0.05).collect()}
    assert all(got[i] for i in range(1500)) and not any(got[i] for i in range(1500, 1560))


def test_expectation_maximisation_finds_the_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.7, 0.99]
    v = np.stack([np.where(rng.random(20000) < 0.1, 2, np.where(truth, np.where(rng.random(20000) < 0.02, 0, 1), np.where(rng.random(20000) < a, 0, 1))) for a in accuracy], 1)
    patterns, counts = np.unique(v @ 3 ** np.arange(4), return_counts=True)
    post, share, rates = weak_labels.estimate(patterns, counts.astype(float), 4)
    assert abs(share - 0.8) < 0.02 and np.abs(rates[0] - accuracy).max() < 0.05
    assert ((post[np.searchsorted(patterns, v @ 3 ** np.arange(4))] > 0.5) == truth).mean() > 0.97


def plain_grams(text, lower=True):
    """The bucket of every 3-byte string of a text."""
    data = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in text.encode())
    return [(((data[i] * 257 + data[i + 1]) * 257 + data[i + 2]) % 2**32 * 2654435761 % 2**32) >> (32 - linear.BITS) for i in range(len(data) - 2)]


MANY = ["", "ab", "Fox runs! the DOG sleeps. a\nthen #### nothing?", "word " * 700, "été à la plage. " * 9, "x" * 2_200_000 + ". End here."]


def test_linear_scorer_against_plain_sums():
    rng = np.random.default_rng(5)
    model = weak_labels.Model({}, rng.normal(size=(linear.BUCKETS, 1)), rng.normal(size=1 << weak_labels.SHAPE_BITS), np.array([0.3]))
    for t in batches(pa.array(MANY)):
        got, shapes = model.score(t), weak_labels.shape_buckets(weak_labels.shape(t))
        for i in range(t.n):
            text = MANY[t.first + i]
            g = plain_grams(text, lower=False)
            z = 0.3 + linear.SCALE * (sum(model.grams[b, 0] for b in g) / len(g) if g else 0) + linear.SCALE * sum(model.shapes[b] for b in shapes[i]) / len(weak_labels.BINS)
            want = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            assert abs(got[i] - (want if text.split() else 0.0)) < 1e-3


def test_estimation_against_plain_steps():
    rng = np.random.default_rng(6)
    patterns, counts = np.unique(rng.integers(0, 3, (4000, 3)) @ 3 ** np.arange(3), return_counts=True)
    votes = [[int(p) // 3**j % 3 for j in range(3)] for p in patterns]
    total = int(counts.sum())
    post = [(1 + v.count(1)) / (1 + v.count(1) + 4 * (v.count(0) + 0.25)) for v in votes]
    for _ in range(25):
        rate = {}
        for c in (0, 1):
            for j in range(3):
                q = [(p if c else 1 - p) * n for p, n in zip(post, counts)]
                bad, said = sum(x for x, v in zip(q, votes) if v[j] == 0), sum(x for x, v in zip(q, votes) if v[j] < 2)
                extra = weak_labels.PRIOR_WEIGHT * total if c else 0
                rate[c, j] = (bad + 1 + weak_labels.PRIOR_WRONG * extra) / (said + 2 + extra)
        share = min(max(sum(p * n for p, n in zip(post, counts)) / total, 1e-4), 1 - 1e-4)
        like = lambda v, c: math.prod(rate[c, j] if x == 0 else 1 - rate[c, j] for j, x in enumerate(v) if x < 2)  # noqa: B023, E731
        post = [share * like(v, 1) / (share * like(v, 1) + (1 - share) * like(v, 0)) for v in votes]
    got, *_ = weak_labels.estimate(patterns, counts.astype(float), 3, rounds=25)
    assert np.abs(got - post).max() < 1e-6


def test_decoding_against_plain_losses():
    rng = np.random.default_rng(7)
    codes = language_id.codewords(4)
    model = language_id.Model(list("abcd"), codes, rng.random(codes.shape[1]), rng.normal(size=(linear.BUCKETS, codes.shape[1])), rng.normal(size=codes.shape[1]))
    for t in batches(pa.array(MANY)):
        lang, score, close = model.predict(t)
        for i in range(t.n):
            g = plain_grams(MANY[t.first + i])
            if not any(map(str.isalpha, MANY[t.first + i])):
                assert (lang[i], score[i]) == ("und", 0)
                continue
            margin = [model.bias[b] + linear.SCALE * (sum(model.weights[x, b] for x in g) / len(g) if g else 0) for b in range(codes.shape[1])]
            loss = [sum(w * np.logaddexp(0, -m * c) for w, m, c in zip(model.trust, margin, code)) for code in codes]
            p = np.exp(min(loss) - np.array(loss))
            p = sorted(zip(p / p.sum(), "abcd"))
            assert lang[i] == p[-1][1] and abs(score[i] - p[-1][0]) < 1e-3 and close[i] == (p[-1][0] - p[-2][0] < language_id.MARGIN)


def test_noisy_or_against_plain_products():
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS), -1.0)
    for t in batches(pa.array([*MANY, "One bad line\nno. ???", "a.b.c"])):
        got = model.score(t)
        for i in range(t.n):
            text, kept, sentences = t.text(i).decode(), 1.0, 0
            probabilities = []
            for s in re.split(r"[.!?\n\r]", text):
                words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", s.encode())
                if not words:
                    continue
                one = next(batches(pa.array([s])))
                bucket, *_ = toxicity.bag(one)
                assert len(bucket) == sum(1 + sum(len(w) > k for k in toxicity.STEMS) for w in words)
                z = model.bias + sum(model.weights[b] for b in bucket)
                probabilities.append(1 / (1 + math.exp(-max(z, -500))))
                kept *= 1 - min(probabilities[-1], 1 - 1e-12)
                sentences += 1
            assert abs(got["score"][i] - (1 - kept if sentences else 0)) < 1e-6 and got["n_sentences"][i] == sentences
            if sentences:
                assert got["n_offending"][i] == sum(p >= 0.5 for p in probabilities) and abs(got["worst_score"][i] - max(probabilities)) < 1e-9


def test_weak_labels_on_tables(spark):
    rng = random.Random(2)
    prose = lambda: ". ".join(" ".join("".join(rng.choices("abcdefghik", k=rng.randint(3, 7))) for _ in range(12)).capitalize() for _ in range(6)) + "."
    texts = [prose() for _ in range(200)] + ["Spam SPAM " * 80 for _ in range(20)] + [prose().replace(" ", " ### ") for _ in range(20)] + [None, ""]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in weak_labels.classify(docs.union(docs.limit(1))).collect()}
    assert all(got[i]["kept"] for i in range(200)) and not any(got[i]["kept"] for i in range(200, 242))
    kept = weak_labels.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 200
    assert weak_labels.classify(docs.limit(0)).count() == 0
    assert weak_labels.classify(docs.limit(5)).where("kept").count() == 5  # one side only: posteriors alone


def test_codewords():
    for k in (2, 3, 4, 5, 9, 30):
        c = language_id.codewords(k)
        distance = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
        assert distance >= c.shape[1] // 2 and len({tuple(r) for r in c}) == k


def test_languages(spark):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    make = lambda s: " ".join("".join(rng.choices(s, k=4)) for _ in range(30))
    rows = [(i, make(letters[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa"), (901, "123 !", "bb"), (None, make("abcde"), "aa"), (902, "", None), (903, "日本", None), (0, make("abcde"), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == rows[i][2] and by[i]["held_out"] == is_held_out(i) for i in range(90))
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] in letters and by[None]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_linear_scores_are_means_over_short_and_long_texts():
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(linear.BUCKETS, 2)), np.array([0.5, -1.0])
    t = one(["", "ab", "abc", "", "hello world", "xy", "Hello"])
    for i, row in enumerate(linear.score(t, w, b)):
        at, f = linear.histograms(one([t.text(i).decode()]))[0] if len(t.text(i)) else (np.zeros(0, int), np.zeros(0))
        assert np.allclose(row, b + linear.SCALE * (w[at] * f[:, None]).sum(0), atol=1e-4)


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["sun", "rain", "wind", "tree", "house", "road"]) for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        parts = [say() for _ in range(8)]
        if i % 4 == 0:
            parts[i % 8] += rng.choice([" vilest", " vilely", " crudest"])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "..."), (None, "vilest"), (5, rows[5][1])], "doc_id long, text string").withColumn("toxic", F.lit(9))
    known = spark.createDataFrame([*labels, (4, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, known).collect()
    assert len(got) == len(rows) + 5
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    hit = by[8]
    assert hit["worst"] == 0 and "vil" in rows[8][1][hit["worst_start"] : hit["worst_end"]] + rows[8][1] and hit["n_sentences"] == 8
    assert [by[i]["score"] for i in (1000, 1001, 1002)] == [0.0] * 3 and by[None]["predicted"] == 1
    assert {r["score"] for r in toxicity.detect(docs, known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.detect(docs.limit(0), known).count() == 0


def brute_scores(index, terms):
    out = np.zeros(index.n)
    for t in terms:
        span = slice(index.at[t], index.at[t + 1])
        out[index.item[span]] += index.impact[span]
    return out


def test_wand_is_exact():
    rng = random.Random(5)
    items = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(1, 30))) for _ in range(150)]
    index = decontaminate.Index(list(range(150)), items)
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 40))))
        score, least = brute_scores(index, terms), rng.choice([0.05, 0.2, 0.5, 0.9])
        got = sorted(index.wand(terms, least))
        assert [i for i, _ in got] == np.flatnonzero(score >= least - 1e-9).tolist()
        if (score >= least).any():
            assert index.candidates(np.zeros(len(terms), np.int64), terms, least).tolist() == [0]


def test_decontamination(spark):
    rng = random.Random(6)
    w = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    items = [f"{w(20)}? {w(8)}." for _ in range(30)] + ["short one", None, "", w(300)]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(items)], "item_id long, text string, score double")
    bench = bench.union(bench.limit(1))
    texts = [w(200) for _ in range(20)]
    texts[3] += " " + items[7].upper() + " " + w(100)
    texts[4] = w(90) + " " + items[8][: len(items[8]) // 2] + " " + w(30)  # half a question is no leak
    texts[5] = items[33] + " " + items[9]
    texts += [None, "", "short one", items[2].split("?")[0]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    long_text = "lorem ipsum " * 250_000 + items[11] + " dolor" * 100
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.search(spark.createDataFrame([(None, long_text)], "doc_id long, text string"), bench).collect()] == [(None, 11)]
    for shard in (20_000, 7):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, bench, shard=shard).collect()}
        assert got == {(3, 7), (5, 33), (5, 9), (22, 30)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(24)) - {3, 5, 22}
    assert decontaminate.search(docs, bench.limit(0)).count() == 0 and decontaminate.search(docs.limit(0), bench).count() == 0


def plain_hits(items, texts, threshold, overlap):
    """{(text, item): score} by plain BM25 over every passage, with plain sets of 5-grams."""
    import math

    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    bags = {i: words(t) for i, t in items.items()}
    df = {}
    for bag in bags.values():
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)

    def impact(w, bag):
        tf = bag.count(w)
        return math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))

    def parts(i):
        at, ends = [], [m.start() for m in re.finditer(r"[.!?\n]", items[i])]
        for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", items[i]):
            at.append(sum(e < m.start() for e in ends))
        k = at.index(at[-1]) if at[0] != at[-1] else len(at) - max(1, len(at) // 4)
        return bags[i][:k], bags[i][k:]

    grams = lambda x, k: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
    out = {}
    for d, text in enumerate(texts):
        have = words(text or "")
        for i, bag in bags.items():
            own, half = sum(impact(w, bag) for w in set(bag)), decontaminate.stride_of(len(bag))
            for lo in range(0, max(1, -(-len(have) // half) - 1) * half, half):
                passage = have[lo : lo + 2 * half]
                score = sum(impact(w, bag) for w in set(bag) & set(passage)) / own
                if score >= threshold:
                    shares = [len(grams(p, min(5, len(p))) & grams(passage, min(5, len(p)))) / len(grams(p, min(5, len(p)))) if p else 1.0 for p in parts(i)]
                    if min(shares) >= overlap:
                        out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_decontamination_against_plain_bm25(spark):
    rng = random.Random(8)
    w = lambda n: " ".join(rng.choices(["the", "of", "a", *(f"w{i}" for i in range(60))], k=n))
    items = {i: f"{w(rng.randint(3, 40))}. {w(rng.randint(1, 15))}" for i in range(60)} | {60: w(90), 61: "é ü? x"}
    texts = [w(rng.randint(0, 150)) for _ in range(25)]
    for i in range(0, 60, 2):  # whole, cut short, and with words exchanged
        x = items[i].split()
        texts.append(w(rng.randint(0, 60)) + " " + " ".join(x[: len(x) - i % 5] if i % 3 else [("zz" if rng.random() < 0.1 else y) for y in x]) + " " + w(rng.randint(0, 200)))
    texts += [items[60], items[61], None, ""]
    want = plain_hits(items, texts, 0.6, 0.5)
    assert 10 < len(want)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"shard": 3}, {"shard_words": 100}):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.search(docs, bench, **sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_held_out_agrees(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert all(r[1] == is_held_out(r[0]) for r in ids.select("doc_id", held_out(F.col("doc_id"))).collect())
