"""Ranked search, whitening and language identification against plain versions, with nulls, empties, ties and repeats."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import language, lexical, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def plain_search(docs, items, top=20):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := plain_terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        want, found = Counter(plain_terms(text)), []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(k * math.floor(1000 * math
                .log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, k in want.items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("first", "bits"), [(100, 16), (4, 12), (7, 3)])
def test_search_equals_scoring_all_documents(spark, first, bits):
    """Whatever the bounds' quality: few coordinates make them loose, few first candidates leave items open."""
    rnd = random.Random(4)
    words = [*(f"w{int(rnd.paretovariate(0.7))}" for _ in range(60)), "ÉTÉ", "été", "Straße", "İx", "ΣΑΣ", "x\x00y", "漢字", "A_b", "\U0001f600z"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 30, 300])))) for i in range(120)]
    docs += [(None, "w1 w2"), (None, None), (500, ""), (501, "..."), (502, None), (9, docs[9][1]), (503, docs[9][1]), (504, docs[9][1]),
        (None, docs[9][1]), (505, " ".join(f"z{i}" for i in range(30000)) + " w3")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 20)))) for i in range(25)] + [(3, "w1 W1 w2"), (3, "w1 W1 w2"),
        (None, "w2 w3"), (40, None), (41, ""), (42, "nowhere"), (43, docs[9][1])]
    d = spark.createDataFrame([(*x, "z", [1]) for x in docs], "doc_id long, text string, doc string, term array<int>")
    q = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(d, q, first=first, bits=bits).collect()), key=repr)
    assert got == plain_search(docs, items)


def test_bounds_are_above_the_scores(spark):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{rnd.randint(0, 40)}" for _ in range(50))) for i in range(30)], "doc_id long, text string")
    asked = lexical.items_of(spark.createDataFrame([(0, "w1 w2 w3 w4")], "item_id long, text string"))
    stats = lexical.statistics(docs, asked)
    profile = lexical._weighted(asked, stats, 30, 4)
    coords = profile.groupBy("b", "_item").agg(F.sum("weight").alias("weight"))
    bound = lexical.bounds(lexical.index(docs, 4).withColumn("doc", F.col("doc_id")), coords, "100L")
    score = {r.doc_id: r.score for r in lexical.rescored(docs, bound, profile, "100L").collect()}
    assert len(score) > 20 and all(r.bound >= score.get(r.doc_id, 0) for r in bound.collect())


def test_search_of_nothing(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d,
        q.limit(0)).count() == 0 and lexical.search(d.select("doc_id", F.lit("").alias("text")), q).count() == 0


VECTORS = "vec_id long, embedding array<float>, n int, h string"


def plain_whitening(rows, k=32):
    ok = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i,
        v in rows if v and len(v) == len(rows[0][1]) and all(c is not None and math.isfinite(c) and abs(c) < 2.0**46 for c in v)]
    x, n = np.array([v for _, v in ok]), len(ok)
    sums = [sum(v[j] for _, v in ok) for j in range(x.shape[1])]
    c = x - np.array(sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    keep = [j for j in range(min(k, len(e))) if e[j] > 1e-9 * e[0] > 0]
    z = c @ u[:, keep] / np.sqrt(e[keep])
    return [(i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), abs(float(z[r, j])), float(e[j] / e.sum())) for r,
        (i, v) in enumerate(ok) for j in keep]


def test_whitening_equals_the_whole_matrix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=40) * np.linspace(0.2, 3, 40)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(rows[5][0], rows[5][1]), (None, rows[6][1]), (300, None), (301, []),
        (302, [1.0] * 39), (303, [1.0] * 39 + [None]), (304, [1.0] * 39 + [math.nan]), (305, [1.0] * 39 + [-math.inf]), (306, [1e30] * 40)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "h") for r in rows], VECTORS)).collect()
    assert got and all(r.identity_error <= 1e-8 for r in got)
    order = lambda r: (repr(r[0]), r[1], r[3], r[4])
    mine, want = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got),
        key=order), sorted(plain_whitening(rows), key=order)
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in mine], [r[4:] for r in want], rtol=1e-7, atol=1e-9)


def test_whitening_without_spread(spark):
    def out(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, "h") for i, v in rows], VECTORS)).collect()

    assert out([]) == [] and out([(1, [1.0, 2.0])]) == [] and out([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and out([(1, None)]) == []
    flat = out([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])  # one direction only
    assert {r.component for r in flat} == {1} and abs(sum(r.whitened**2 for r in flat) / 9 - 1) < 1e-9
    far = out([(0, [-3e13, 1.0]), (1, [3e13, 0.0]), (2, [0.0, 7.0])])
    assert {(r.vec_id, r.deviation) for r in far} == {(0, None), (1, None), (2, 692224)}


def test_whitening_may_count_each_vector_once(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(60, [0.0, 1.0]), (61, [2.0, 3.0])]
    x = whitening.whole(spark.createDataFrame([(*r, 1, "h") for r in rows], VECTORS)).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    assert whitening.fit(x).n == 52 and whitening.fit(x, multiplicity=False).n == 3


def plain_counts(text):
    """Runs of 1 to 3 characters without a break inside, from the definition."""
    s = "".join(c if c.isalpha() else " " for c in f" {text or ''} ".lower())
    return sum((c.isalpha()) for c in s) + sum(s[i : i + 2] != "  " for i in range(len(s) - 1)) + sum(s[i + 1] != " " for i in range(len(s) - 2))


def test_every_run_of_a_text_counts(monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", "a", " ", "é", "ab", "12 a-b", "\U00020000漢 x",
        *("".join(rnd.choice("abcé ,1漢") for _ in range(rnd.randint(1, 90))) for _ in range(60))]
    for t in texts:
        whole = language.counts_of(t)
        assert whole.sum() == (plain_counts(t) if any(c.isalpha() for c in t or "") else 0)
        for size in (1, 2, 7, 64):
            monkeypatch.setattr(language, "SLICE", size)
            assert (language.counts_of(t) == whole).all()
        monkeypatch.undo()


def plain_bayes(rows):
    """Rows of (doc_id, text, lang) -> (doc_id, held_out, language), with dictionaries."""
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 0

    counts, docs = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        c = language.counts_of(t)
        if i is not None and not out(i) and lang is not None and c.any():
            docs[lang] += 1
            for b in c.nonzero()[0]:
                counts[lang][int(b)] += int(c[b])
    got = []
    for i, t, _ in rows:
        c, best = language.counts_of(t), ("und", 0.0)
        if c.any() and docs:
            log = {}
            for lang in sorted(docs):
                size = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
                log[lang] = math.log(docs[lang] / sum(docs.values())) + sum(int(c[b]) * math
                    .log((counts[lang][int(b)] + language.SMOOTHING) / size) for b in c.nonzero()[0])
            top = max(log.values())
            name = next(x for x in log if log[x] == top)
            best = (name, 1 / sum(math.exp(v - top) for v in log.values()))
        got.append((i, out(i), best[0], round(best[1], 6)))
    return sorted(got, key=repr)


def test_language_equals_plain_bayes(spark):
    rnd = random.Random(8)
    speak = {"en": "the of and tion ing er", "fr": "le de et eau é ment", "de": "der ung sch ü ein ß", "": "qq ww zz"}
    rows = [(i, " ".join(rnd.choice(speak[x].split()) for _ in range(rnd.choice([1, 3, 40]))),
        x) for i in range(80) for x in [rnd.choice(list(speak))]]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 ...", "fr"), (103, "the", None), (None, "le eau", "xx"), (None, "der", None),
        (104, rows[0][1], rows[0][2]), (rows[1][0], rows[1][1], rows[1][2]), (105, "ment eau " * 40000, "fr")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, bucket string")
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in language.identified(d).collect()), key=repr)
    assert got == plain_bayes(rows)
    assert language.identified(d.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identified(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_language_on_held_out_documents(spark):
    """Over 99 of 100 of the given documents that weren't learned from."""
    sf = "/root/testdata/sf0.01"
    got = language.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert right > 0.99 * got.count() > 150
