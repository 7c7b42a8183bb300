"""Training-data operators: brute force, round trips, and nulls, empties, ties, repeats and foreign columns."""

import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import ann, bpe, components, decontaminate, html_text, licenses, minhash, token_counts, toxicity, url_filters, warc

DOCS = "doc_id long, text string, key string, h int"
LONG = " ".join(f"word{i % 97} and{i % 31}" for i in range(4000))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib, rnd = Tokenizer.from_file(path), random.Random(3)
    letters = list(" \n\t\r\x0b\x1c\x85 　abcXYZ'stremvld019²_-.,!é漢́\U0001f600") + ["<|endoftext|>", "  ", " the"]
    texts = ["", None, LONG, "a" * 3000, *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(300))]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), path).collect()}
    apart = bpe.decode(bpe.encode(frame(spark, texts), path), path).collect()
    again = {r.doc_id for r in apart if (r.ids, r.decoded) == (got[r.doc_id].ids, got[r.doc_id].decoded)}
    for i, t in enumerate(texts):
        assert i in again and list(array("I", got[i].ids)) == lib.encode(t or "", add_special_tokens=False).ids and got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids) // 4


def test_bpe_pieces_need_no_pattern_and_equal_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib, rnd, model = Tokenizer.from_file(path), random.Random(7), bpe.load_model(path)
    alpha = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert bpe.regex.fullmatch(r"\p{L}+", alpha)  # what the short cut takes for letters are the pattern's
    parts = ["haus", "Été", "漢", "ſtreet", "'s", "'", "_", "...", ".\n", "\n", "\n\n", "\r\n", "9", "²", "\xa0", "\u0301", " ", "***", "'ll"]
    run = bpe.encoder(model)
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert list(array("I", run.encode(text))) == lib.encode(text, add_special_tokens=False).ids, text
    calls, split = [], run.split
    run.split = lambda x: calls.append(x) or split(x)
    run.encode("one haus, Haus.\nUnd zwei*** drei.\nvier!")
    assert calls == ["one"] and bpe.encoder(model) is run  # the memo stays for the process's next task


def test_bag_minhash_is_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(40):
        el, a = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(0, 6, 60).astype(float)
        b = np.where(rng.random(60) < 0.6, a, rng.integers(0, 9, 60)).astype(float)
        e, w = np.concatenate([el[a > 0], el[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
        s = minhash.bag_minhash(e, w, np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def test_near_duplicates(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(200)]
    near, far = base[:], base[:]
    near[100] = "changed"
    for k in range(0, 200, 8):
        far[k] = "other"
    texts = [" ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), None, "", "...", "too short", "too short", "one two three"]
    docs = frame(spark, texts).unionByName(frame(spark, texts[:1]))
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9}
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [0, 0, 3, 4, 7, 9]
    assert minhash.classes(docs.limit(0)).count() == 0


def plain_classes(texts):
    """The smallest index of each text's class, by the exact weighted Jaccard similarity of all pairs and union-find."""
    from collections import Counter

    bags = [Counter(minhash.shingles(minhash.words_of(t)).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if not either or both >= 0.8 * either:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_duplicates_equal_all_pairs(spark):
    """Null ids are among them."""
    rnd = random.Random(21)
    texts = []
    for f in range(12):
        base = [f"f{f}w{rnd.randint(0, 60)}" for _ in range(rnd.choice([8, 30, 90, 300]))]
        for _ in range(rnd.choice([1, 3, 8, 20])):
            t = base[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 4]) * len(t) // 90):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 999)}"
            texts.append(" ".join(t + t[:20] * rnd.choice([0, 0, 1])))
    rnd.shuffle(texts)
    rows = [(None if i % 9 == 4 else i, t, i) for i, t in enumerate([*texts, "", None, "one", "one", LONG])]
    root = plain_classes([t for _, t, _ in rows])
    ids = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[k][0], ids[root[k]]) for k in range(len(rows))), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    assert sorted(((r.doc_id, r.class_id) for r in minhash.classes(docs).collect()), key=repr) == want
    kept = [r.key for r in minhash.keep_one(docs).collect()]
    assert sorted(root[k] for k in kept) == sorted(set(root)) and len({r for r in root}) < len(rows) - 20


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components.components(e).collect()} == {i: 0 for i in range(1, 31)} | {100: 99}


def test_components_of_random_edges_against_union_find(spark):
    rng = random.Random(5)
    for nodes, n in ((40, 25), (30, 60)):
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
        root = list(range(nodes))
        for u, v in edges:
            a, b = root[u], root[v]
            root = [min(a, b) if r in (a, b) else r for r in root]
        got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted((r.node, r.root) for r in got) == [(i, r) for i, r in enumerate(root) if r != i]


def test_toxic_rows_go_with_or_without_an_id(spark):
    rows = [(i, "vile scum idiot talk " * 3 + f"w{i}" if i % 3 == 0 else f"some plain words w{i} and more w{i % 7}") for i in range(90)] + [(None, "vile scum idiot talk " * 3), (None, "plain words")]
    docs = spark.createDataFrame([(*r, 1, [2]) for r in rows], "doc_id long, text string, score int, row array<int>")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {r for r in rows if "vile" not in r[1]}
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0 and toxicity.without_toxic(docs, labels.limit(0)).count() == 92


def test_maximal_segments_against_brute_force():
    rnd = random.Random(0)
    for _ in range(300):
        n = rnd.randint(1, 20)
        sc = {i: rnd.random() * 3 for i in range(n) if rnd.random() < 0.3}
        full = [sc.get(i, -0.4) for i in range(n)]

        def best(lo, hi, full=full):
            found = max(((sum(full[i : j + 1]), -i, -j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            return [] if found[0] <= 0 else [*best(lo, -found[1]), (-found[1], -found[2]), *best(-found[2] + 1, hi)]

        assert [x[:2] for x in toxicity.maximal_segments(list(sc), list(sc.values()), 0.4)] == best(0, n)


def plain_toxicity(rows, labels):
    """doc_id -> score, without Spark: direct counts, all maximal segments by recursion, plain sums."""
    import math
    import zlib
    from collections import Counter

    split = lambda t: toxicity._find((t or "").lower())
    texts: dict = {}
    for i, t in rows:
        marks = [y for k, y in labels if k == i and y in (0, 1)]
        if i is not None and marks and zlib.crc32(str(i).encode()) % 3 != 1:
            texts[t] = max(texts.get(t, 0), *marks)
    n, docs = (Counter(), Counter()), Counter()
    for t, y in texts.items():
        tokens = [k for w in split(t) for k in toxicity.tokens_of(w)]
        n[y].update(tokens)
        docs.update(set(tokens) if y else ())
    total = [sum(c.values()) for c in n]
    prior = toxicity.PRIOR_SHARE * sum(total)
    lexicon = {}
    for k in set(n[0]) | set(n[1]):
        a = toxicity.PRIOR_LEAST + toxicity.PRIOR_SHARE * (n[0][k] + n[1][k])
        side = [math.log((n[y][k] + a) / max(total[y] + prior - n[y][k] - a, 1)) for y in (0, 1)]
        delta = side[1] - side[0]
        if delta >= toxicity.MIN_DELTA and delta / math.sqrt(1 / (n[1][k] + a) + 1 / (n[0][k] + a)) >= toxicity.MIN_Z and docs[k] >= toxicity.MIN_DOCS:
            lexicon[k] = delta
    freq = {k: (n[0][k] + 5 / len(lexicon)) / total[0] for k in lexicon}
    gap = max(toxicity.GAP, 2 * sum(freq[k] * lexicon[k] for k in lexicon))
    decay = toxicity._decay(np.array(list(lexicon.values())), np.array(list(freq.values())), gap)

    def segments(full, lo, hi):
        found = max(((sum(full[i : j + 1]), -i, -j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
        return [] if found[0] <= 1e-12 else [*segments(full, lo, -found[1]), found[0], *segments(full, -found[2] + 1, hi)]

    def scan(t):
        full = [max((lexicon[k] for k in toxicity.tokens_of(w) if k in lexicon), default=-gap) for w in split(t)]
        return len(full), segments(full, 0, len(full))

    clean = [scan(t) for t, y in texts.items() if y == 0]
    log_k = math.log((sum(len(s) for _, s in clean) + 1) / sum(k for k, _ in clean)) + decay * min(lexicon.values())
    evidence = lambda k, s: sum(max(0.0, decay * x - log_k - math.log(max(k, 1))) for x in s)
    bins: dict = {}
    for t, y in texts.items():
        x = evidence(*scan(t))
        bins.setdefault(round(math.log1p(x) / toxicity.BIN), []).append((x, y))
    each = [(np.mean([x for x, _ in g]), sum(y for _, y in g), sum(1 - y for _, y in g)) for _, g in sorted(bins.items())]
    a, b = toxicity._logistic(*(np.array(c, float) for c in zip(*each, strict=True)))
    return [(i, 1 / (1 + math.exp(-max(-30, min(30, a + b * evidence(*scan(t))))))) for i, t in rows]


def test_toxicity_equals_a_plain_version(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(3, 25))]
        if i % 4 == 0:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "scum", "idiot"]) + rnd.choice(["", "ic", "ish"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(None, "vile scum"), (700, None), (701, ""), (702, "vile " * 30 + "w1 " * 30), (3, rows[3][1]), (703, rows[0][1])]
    labels += [(None, 1), (703, 0), (7, 1), (9, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = toxicity.classified(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (i, x), (k, y) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(plain_toxicity(rows, labels), key=key), strict=True):
        assert i == k and abs(x - y) < 1e-6, (i, x, y)


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                words[rnd.randrange(60)] = rnd.choice(["vile", "scum", "idiot"]) + rnd.choice(["", "ic", "ish"])
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(i % 5 == 0), "z"))
    docs = spark.createDataFrame(rows + [(None, "vile scum", "x", 1), (900, None, "x", 1), (901, "", "x", 1)], DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, "z"), (3, None, "z")], "doc_id long, toxic int, text string")
    got = toxicity.classified(docs, marks).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert {r.score for r in toxicity.classified(docs, marks.limit(0)).collect()} == {0.0}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "if John has 7 apples and gives 3 apples to Mary then how many of the 7 apples remain", 0), (2, "tiny item", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    docs = frame(spark, ["Well, if Peter has 12 apples and gives 5 apples to Anna then how many of the 12 apples remain?", "if Peter has 12 apples and gives 5 apples to Anna then how many of the 15 apples remain", "a tiny item here", None, "", "nothing of the kind", LONG])
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.matches(docs, items).collect()}
    assert got == {(0, 1): True, (2, 2): False}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 3, 4, 5, 6]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_decontamination_of_items_full_of_placeholders(spark):
    items = spark.createDataFrame([(1, "What is 48 + 27 * 6?"), (2, "12 + 7 * 3 - 4 = 29"), (3, "42"), (4, "7 kg"), (5, "Anna, Bob, Carl, Dana, Emil, Fred"), (6, "page 7"), (7, "Anna gives Bob 7 apples")], "item_id long, text string")
    docs = frame(spark, [
        "they ask: What is 48 + 27 * 6? and so on", "What is 47 + 26 * 5?", "so 12 + 7 * 3 - 4 = 29 holds", "so 13 + 8 * 2 - 5 = 30 holds", "in 1999 it was 9 kg", "the answer is 42.", "it weighs 7 kg", "with Anna, Bob, Carl, Dana, Emil, Fred", "with Gina, Hugo, Ivan, Jane, Karl, Lena", "see page 12", "then Anna gives Bob 7 apples",
    ])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(0, 1), (2, 2), (5, 3), (6, 4), (7, 5), (10, 7)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 3, 4, 8, 9]


def plain_matches(docs, items):
    """(doc_id, item_id) -> contaminated, without Spark: templates by loops, every alignment tried."""
    import regex

    w, token = decontaminate.WINDOW, regex.compile(decontaminate.TOKEN)
    number = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*")

    def tokens(text):
        """(placeholder or lower-cased word, value or None) of each token."""
        text = text or ""
        units, out, last = set(decontaminate.UNITS.split("|")), [], None
        for m in token.finditer(text):
            word, gap = m[0], text[last.end() : m.start()] if last else ""
            if number.fullmatch(word):
                kind = "<num>"
            elif last and number.fullmatch(last[0]) and word.lower() in units and len(gap) <= 2 and not gap.strip():
                kind = "<unit>"
            else:
                kind = "<name>" if word[0].isupper() and any(c.islower() for c in word[1:]) else None
            out.append((kind or word.lower(), word.lower() if kind else None))
            last = m
        return out

    def contaminated(doc, item):
        size = min(w, len(item))
        n = len(item) - size + 1
        covered, quoted = set(), False
        for shift in range(-len(item), len(doc)):
            at, pairs = set(), set()
            for i in range(n):
                if not 0 <= i + shift <= len(doc) - size:
                    continue
                a, b = item[i : i + size], doc[i + shift : i + shift + size]
                slots = [x[1] for x in a if x[1] is not None]
                literal = [x[1] or x[0] for x in a] == [x[1] or x[0] for x in b]
                typed = [x[0] for x in a] == [x[0] for x in b] and len(slots) <= (size - 1) // 2
                if typed:
                    at.add(i)
                    pairs |= {(x[1], y[1]) for x, y in zip(a, b, strict=True) if x[1] is not None}
                if literal:
                    at.add(i)
                    pairs |= {(v, v) for v in slots}
            if not at or len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
                continue
            ordered = sorted(at)
            for p, q in zip(ordered, ordered[1:], strict=False):
                at |= set(range(p, q)) if q <= p + w else set()
            covered |= at
            quoted |= any(set(range(p, p + decontaminate.QUOTE - w + 1)) <= at for p in at)
        return len(covered) >= decontaminate.COVER * n or quoted

    return {(d, i) for d, text in docs for i, words in ((i, tokens(x)) for i, x in items) if words and contaminated(tokens(text), words)}


def test_decontamination_equals_a_plain_version(spark):
    rnd = random.Random(11)
    words = "the a of red blue train car runs buys gives adds then and to for with Anna Bob McDonald The. Then 7 12 3.5 1,000 5kg 9Km kg km hours USA =".split()
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, sentence(rnd.choice([1, 2, 3, 4, 5, 6, 9, 20]))) for i in range(40)]
    docs = []
    for i in range(160):
        base = rnd.choice(items)[1].split()
        if i % 2:
            base = [rnd.choice(["5", "9", "44"]) if x[0].isdigit() and rnd.random() < 0.5 else rnd.choice(["Dora", "Emil"]) if x[0].isupper() and rnd.random() < 0.5 else x for x in base]
        docs.append((i, " ".join([sentence(rnd.randint(0, 5)), *base[: rnd.randint(1, 25)], sentence(rnd.randint(0, 5))]).strip()))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 50


def test_decontamination_of_rows_without_or_with_repeated_ids(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(None, f"so {item} it ends", 0), (None, "something else entirely", 1), (1, f"so {item}", 2), (1, "another text of that id", 3), (1, "another text of that id", 4), (2, "", 5), (3, None, 6), (4, LONG, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own int")
    items = spark.createDataFrame([(9, item, 0), (9, "a second text under the same id of an item", 0), (None, "another text of that id", 0)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id is None, r.item_id, r.coverage) for r in decontaminate.matches(docs, items).collect()) == [(False, 9, 1.0), (True, 9, 1.0)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["_own"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7]
    assert decontaminate.clean(docs.limit(0), items).count() == 0


def test_decontamination_of_units_and_names_anywhere(spark):
    """Units stand right behind a number or after a space, and names may begin a sentence."""
    items = spark.createDataFrame([(1, "A crate weighs 5 kg and holds 12 kg of sand."), (2, "Tom has 7 apples. Tom eats 3 apples. How many remain?"), (3, "McDonald sells 8 cows to his brother at noon")], "item_id long, text string")
    docs = frame(spark, ["A crate weighs 7kg and holds 15kg of sand.", "Anna has 9 apples. Anna eats 4 apples. How many remain?", "so MacBeth sells 3 cows to his brother at noon", "Anna has 9 apples. Berta eats 4 apples. How few stay here?", "the 5 kgs of sand"])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_near_duplicates_with_very_large_ids(spark):
    top = 2**63 - 1
    rows = [(top, "one two three four five six seven"), (top - 1, "one two three four five six seven"), (2**62, "another text of some seven plain words"), (None, "one two three four five six seven"), (None, "nameless text of some seven plain words"), (5, "small id with some seven plain words")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, i int")
    got = sorted(((r.doc_id, r.class_id, r.rep_id) for r in minhash.classes(docs).collect()), key=repr)
    assert got == sorted([(top, top - 1, top - 1), (top - 1, top - 1, top - 1), (2**62, 2**62, 2**62), (None, top - 1, top - 1), (None, None, None), (5, 5, 5)], key=repr)
    assert sorted(r.i for r in minhash.keep_one(docs).collect()) == [1, 2, 4, 5]
    with pytest.raises(ValueError, match="no room"):
        minhash.classes(spark.createDataFrame([(top, "a"), (-top, "b")], "doc_id long, text string"))


def test_url_filters_cut_bursts(spark, monkeypatch):
    """A burst within a second is dealt into buckets like any other stretch."""
    monkeypatch.setattr(url_filters, "BUCKET", 500)
    rows = spark.range(6000).select(F.lit("a.org").alias("pattern"), F.timestamp_seconds(F.when(F.col("id") == 0, 0).otherwise(10**9 + F.col("id") % 2)).alias("at"), F.lit(1).alias("kind"), F.col("id").alias("row"))
    sizes = [r["count"] for r in url_filters._bucketed(rows, ["at", "kind", "row"]).groupBy("pattern", "bucket").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1500


def test_decontamination_counts_windows_that_matched_ones_span(spark):
    items = spark.createDataFrame([(1, "we add up 1 2 3 to get all of it")], "item_id long, text string")
    docs = frame(spark, ["we add up 4 5 6 to get all of it", "they say we add up 4 5 here"])
    got = [(r.doc_id, r.n_windows, r.coverage, r.reparameterised) for r in decontaminate.matches(docs, items).collect()]
    assert got == [(0, 7, 1.0, True)]


def test_decontamination_of_partial_quotes(spark):
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ab", "eb", "ib", "ob", "ub", "ac", "ec", "ic", "oc", "uc")] * 2
    words = [w + "xyzuvw"[k // 20 % 6] + "s" * (k // 100) for k, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = frame(spark, [" ".join(["so", *words[40:130], "end"]), " ".join(["so", *words[60:73], "end"]), " ".join(["so", *words[60:72], "end", *words[90:102]])])
    assert [r.doc_id for r in decontaminate.matches(docs, items).orderBy("doc_id").collect()] == [0, 1]


def test_licenses(spark, tmp_path):
    import duckdb

    text = "Copyright (c) 2020 J. Someone\n" + licenses._MIT.upper().replace(",", " ,")
    wrapped = "# a file\n" + licenses._MIT.replace(" the ", "\nthe ") + "\nprint(1)\n"
    texts = [text, "x\n  released under the mit licence!\ny", None, "", "Licensed under CC BY-NC 4.0.", "the MIT License is nice", "Copyright 2020 X. Released under the MIT License.",
             "Copyright 2020 Foo Inc. All rights reserved. Released under the MIT License.", wrapped, f"{licenses._APACHE}\nand\n{licenses._APACHE}", "!!!", licenses._MIT.replace("granted", "not granted"), "(c) me", LONG]
    docs = frame(spark, texts)
    got = {(r.doc_id, r.scope, r.license, r.n) for r in licenses.scan(docs, licenses.known(spark)).collect()}
    want = {(0, "text", "MIT", 1), (1, "line", "MIT", 1), (4, "text", "CC-BY-NC-4.0", 1), (4, "line", "CC-BY-NC-4.0", 1), (6, "text", "MIT", 1), (6, "line", "MIT", 1),
            (7, "text", "MIT", 1), (7, "line", "MIT", 1), (8, "passage", "MIT", 1), (9, "passage", "Apache-2.0", 2)}
    assert got == want
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert set(con.sql(licenses.ORACLES["op3_license_scan"]).fetchall()) == want
    own = licenses.registry(spark.createDataFrame([("own", "My own terms apply."), ("none", ""), ("null", None)], "license string, text string"))
    assert [r.license for r in licenses.scan(frame(spark, ["my own terms apply"]), own).where("scope = 'text'").collect()] == ["own"]
    assert licenses.scan(docs.limit(0), licenses.known(spark)).count() == 0 and licenses.scan(docs, own.limit(0)).count() == 0


def test_token_counts(spark):
    sizes = [0, 0, 3, 5, 5, 4097, 9000]
    limits = token_counts.by_limit(token_counts.histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens long")))
    for r in limits.collect():
        limit = r.context_limit
        assert (r.truncated_total, r.docs_longer, r.docs_that_fit) == (sum(min(s, limit) for s in sizes), sum(s > limit for s in sizes), sum(s <= limit for s in sizes))
    for limit in (1, 4, 5000, 20000):
        r = token_counts.answer(limits, limit).first()
        assert (r.truncated_total, r.docs_that_fit) == (sum(min(s, limit) for s in sizes), sum(s <= limit for s in sizes))
    assert token_counts.by_limit(token_counts.histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0
    assert sorted(r.n_tokens for r in token_counts.lengths(frame(spark, [None, "", "the the"]), bpe.default_vocabulary()).collect()) == [0, 0, 2]


def test_html_roles():
    page = "<body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two<aside>no</aside><form>no</form><p>three<div class='comment-list'>no</div><script>var x='</p>'</script>end</article><footer>no</footer>"
    assert html_text.blocks_of(page) == [("menu", 2), ("A & B", 0), ("one two", 0), ("no", 2), ("no", 2), ("three", 0), ("no", 2), ("end", 0), ("no", 2)]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("<p") == []


def test_repeated_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        tokens, page = rng.integers(0, 3, 60).astype(np.uint64), np.repeat(np.arange(6), 10)
        want = np.zeros(60, bool)
        for i in range(60 - 3):
            if len({page[j] for j in range(60 - 3) if (tokens[j : j + 4] == tokens[i : i + 4]).all()}) >= 3:
                want[i : i + 4] = True
        got = html_text.repeated(tokens, page, 4, 3)
        assert (got[:57] | want[:57] == got[:57]).all() and (got[:53] == want[:53]).all()


def test_html_boilerplate_of_a_host(spark):
    bar = "Subscribe now to our weekly letter and never miss a story again"
    rows = [(i, f"http://h.example/{i}", f"<body><p>{bar}</p><p>{' '.join(f'own{i}x{k}' for k in range(12))}</p></body>", "c") for i in range(5)]
    pages = spark.createDataFrame(rows + [(9, None, None, "c"), (10, "http://h.example/a", "", "c"), (11, "bad[url", "<article>kept</article>", "c")], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert len(got) == 8 and got[9] == got[10] == "" and got[11] == "kept" and all(got[i].startswith(f"own{i}x0") for i in range(5))


def test_html_maximal_repeats_against_brute_force():
    """Places in a substring of RUN tokens or more, of any length, that stands on three pages."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        tokens, page = rng.integers(0, 2, 80).astype(np.uint64), np.repeat(np.arange(8), 10)
        ends = np.arange(80) % 10  # substrings stay within a page
        want = np.zeros(80, bool)
        for i in range(80):
            for n in range(4, 11 - ends[i]):
                if len({page[j] for j in range(80) if ends[j] + n <= 10 and (tokens[j : j + n] == tokens[i : i + n]).all()}) >= 3:
                    want[i : i + n] = True
        assert (html_text.repeated(tokens, page, 4, 3, starts=ends <= 6) == want).all()


def test_html_arrays_decide_without_telling_markup(spark, monkeypatch):
    menu, foot = "Home News Sport Weather Travel Culture Contact", "All rights reserved by the owners of this site"
    own = lambda i, k: " ".join(f"own{i}x{k}y{j}" for j in range(12))
    rows = [(i, "http://h.example/x", f"<div><p>{menu}</p></div><div><p>{own(i, 0)}</p><p>{own(i, 1)}</p></div><div>{foot}</div>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == {i: f"{own(i, 0)}\n\n{own(i, 1)}" for i in range(6)}
    assert all((r.repeated, r.template, r.by_markup) == (2, 0, 0) for r in got.values())
    monkeypatch.setattr(html_text, "repeated_blocks", lambda tokens: tokens.select("uid", "block").limit(0))
    assert all(menu in r.text and foot in r.text for r in html_text.main_text(pages).collect())


def test_html_inside_articles(spark):
    bar, passage = "Read our other stories too", "a passage that a few of the articles share with one another"
    rows = [(i, "http://h.example/x", f"<article><h1>t{i}</h1>{f'<p>{passage}</p>' if i < 4 else ''}<section id='related-work'>w{i}</section><div class='related-posts'>r{i}</div><p>{bar}</p></article>") for i in range(12)]
    rows += [(50 + i, "http://g.example/x", "<article><p>the same article on all pages</p></article>") for i in range(12)]
    rows += [(90, "http://h.example/x", rows[0][2]), (90, "http://h.example/y", "<article>another row of that id</article>"), (None, "http://h.example/z", "<article>no id</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in html_text.main_text(pages.unionByName(pages.limit(1))).collect())
    one = lambda i: f"t{i}\n\n" + (f"{passage}\n\n" if i < 4 else "") + f"w{i}"
    want = [(i, one(i)) for i in range(12)] + [(0, one(0)), (90, one(0)), (90, "another row of that id"), (-1, "no id")] + [(50 + i, "the same article on all pages") for i in range(12)]
    assert got == sorted(want)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_boilerplate_does_not_depend_on_shards(spark, monkeypatch):
    bar, short = "Subscribe now to our weekly letter and never miss a story again", "Back to top"
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    rows = [(i, "http://h.example/x", f"<p>{own(i)}</p>" + (f"<p>{bar}</p><p>{short}</p>" if i % 13 == 0 else "") + (f"<p>twice {own('t')}</p>" if i in (1, 20) else "")) for i in range(39)]
    pages = spark.createDataFrame([*rows, (100, "http://h.example/x", rows[1][2]), (101, "http://g.example/x", f"<p>{bar}</p>")], "page_id long, url string, html string")
    want = {i: own(i) + (f"\n\ntwice {own('t')}" if i in (1, 20) else "") for i in range(39)} | {100: f"{own(1)}\n\ntwice {own('t')}", 101: bar}
    for shard in (1_000_000, 100):
        monkeypatch.setattr(html_text, "SHARD", shard)
        assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want


def test_url_filters(spark):
    entries = spark.createDataFrame([("a.example.com", 10, "block"), ("a.example.com", 90000, "pass"), ("example.com", 50000, "block"), (None, 1, "block"), ("a.example.com/x", 95000, "block"), ("a.example.com/x", 95000, "pass")], "pattern string, s long, action string").select("pattern", F.timestamp_seconds("s").alias("since"), "action")
    caps = spark.createDataFrame([(1, "http://a.example.com/y", 5), (2, "http://A.example.com/y", 10), (3, "http://a.example.com/y", 89999), (4, "http://a.example.com/y", 90000), (5, "http://b.example.com", 40000), (6, "http://a.example.com/x/z", 99000), (7, None, 5), (8, "http://a.example.com/", None)], "id long, url string, s long").select("id", "url", F.timestamp_seconds("s").alias("at"))
    got = {r.id: r.pattern for r in url_filters.filtered(caps, entries, "url", "at").collect()}
    assert got == {1: None, 2: "a.example.com", 3: "a.example.com", 4: "example.com", 5: None, 6: "a.example.com/x", 7: None, 8: None}


def test_url_filters_against_brute_force(spark, monkeypatch):
    """Many rows a pattern, with small buckets; repeated and null ids, clashing columns, empty tables."""
    monkeypatch.setattr(url_filters, "BUCKET", 20)
    rnd = random.Random(3)
    hosts = ["a.x.org", "b.x.org", "x.org", "c.y.net"]
    spans = [(rnd.choice([*hosts, "a.x.org/p"]), rnd.choice([rnd.randint(0, 10**6), 777]), rnd.choice(["block", "pass"])) for _ in range(150)]
    caps = [(rnd.choice([1, 2, None]), f"http://{rnd.choice(hosts[:2] if k % 3 else hosts)}/{rnd.choice('pq')}/x", rnd.choice([rnd.randint(0, 10**6), 777]), k) for k in range(400)]

    def verdict(url, at):
        host, seg = url.split("/")[2:4]
        on = []
        for p in {host, ".".join(host.split(".")[1:]) if host.count(".") > 1 else host, f"{host}/{seg}"}:
            past = [(s, a == "pass") for q, s, a in spans if q == p and s <= at]
            if past and not min((-s, x) for s, x in past)[1]:
                on.append((len(p), p, max(past)[0]))
        return max(on)[1:] if on else (None, None)

    entries = spark.createDataFrame(spans, "pattern string, s long, action string").select("pattern", F.timestamp_seconds("s").alias("since"), "action")
    df = spark.createDataFrame(caps, "id long, url string, s long, row int").select("id", "url", F.timestamp_seconds("s").alias("at"), "row", F.lit(1).alias("pattern"), F.lit(2).alias("top"))
    got = url_filters.filtered(df, entries, "url", "at")
    assert got.columns == [*df.columns, "blocked", "pattern_", "since"]
    assert {r.row: (r.pattern_, r.since and int(r.since.timestamp())) for r in got.collect()} == {k: verdict(u, s) for _, u, s, k in caps}
    assert url_filters.filtered(df.limit(0), entries, "url", "at").count() == 0
    assert url_filters.filtered(df, entries.limit(0), "url", "at").where("blocked").count() == 0


def test_warc_records_are_rebuilt(spark, tmp_path):
    big = "y" * 1500
    pages = spark.createDataFrame([(1, "http://a", big, 0), (2, "http://b", big, 60), (3, "http://c", "small é", None)], "page_id long, url string, html string, s long")
    pages = pages.select("page_id", "url", "html", F.timestamp_seconds("s").alias("at"), F.lit(1).alias("head"), F.lit(2).alias("address"))
    got = {r.record_id: bytes(r.record).decode() for r in warc.read(spark, f"{tmp_path}/w", warc.write(pages, f"{tmp_path}/w", at="at")).collect()}
    assert got[2].startswith("WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 1970-01-01T00:01:00Z\r\nWARC-Record-ID: <urn:record:2>\r\n") and got[2].endswith(f"Content-Length: 1500\r\n\r\n{big}\r\n\r\n")
    assert f"WARC-Profile: {warc.PROFILE}\r\nWARC-Refers-To: <urn:record:2>" in got[1] and got[1].endswith("Content-Length: 0\r\n\r\n\r\n\r\n")
    assert got[3].endswith("Content-Length: 8\r\n\r\nsmall é\r\n\r\n")
    none = f"{tmp_path}/none"
    assert warc.read(spark, none, warc.write(pages.limit(0), none)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né"
    rows = [(1, "http://a", big, 0), (2, "http://b\r\nX: y", big, 0), (3, None, "small", 0), (4, "http://d", "small", 0), (5, "http://e", None, 0), (6, "http://f", "", 0), (None, "http://g", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    boundary = warc.write(pages, f"{tmp_path}/w")
    got = {r.record_id: r for r in warc.read(spark, f"{tmp_path}/w", boundary).collect()}
    assert {k: bytes(v.payload).decode() for k, v in got.items()} == {r[0]: r[2] or "" for r in rows}
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:900] = x[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [None] * 16, 0), (5004, [1.0], 0), (None, [1.0] * 16, 0), (3, x[3].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    assert got.groupby("query_id").size().eq(20).all() and got.query_id.nunique() == 75
    hit = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(want) & set(part.vec_id))
        assert part.sort_values("rank").score.is_monotonic_decreasing
    assert hit / 1500 >= 0.9
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_registry_matches_the_entry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline_equals_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rnd = random.Random(17)
    items = [(1, "if John has 7 apples and gives 3 apples to Mary then how many of the 7 apples remain"), (2, "the quick brown fox jumps over the lazy dog near the river bank")]
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(6, 25))]
        if i % 5 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "scum", "idiot"]) + rnd.choice(["", "ic", "ish"])
        if i % 11 == 3:
            words += [items[0][1].replace("John", "Peter").replace("7", "12"), "end"] if i % 2 else [items[1][1]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    for i in range(20):
        t = rows[rnd.randrange(400)][1].split()
        rows.append((1000 + i, " ".join(t if i % 2 else [*t, "extra"])))
    rows += [(None, rows[1][1]), (None, "of its own, without an id"), (None, "of its own, without an id"), (None, items[1][1]), (None, "vile scum idiot talk " * 3), (2000, ""), (2001, None), (2002, LONG[:400]), (7, rows[7][1])]
    for name, df in {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _own string"),
        "labels": spark.createDataFrame(labels, "doc_id long, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }.items():
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")

    score = plain_toxicity(rows, labels)
    clean = [(i, t) for (i, t), (_, p) in zip(rows, score, strict=True) if p < toxicity.THRESHOLD]
    root = plain_classes([t for _, t in clean])
    least = {r: min((clean[k][0] for k in range(len(clean)) if root[k] == r and clean[k][0] is not None), default=None) for r in set(root)}
    kept, seen = [], set()
    for (i, t), r in zip(clean, root, strict=True):
        if i == least[r] and (i is not None or r not in seen):
            kept.append((i, t))
            seen.add(r)
    bad = {d for d, _ in plain_matches(list(enumerate(t for _, t in kept)), items)}
    left = [row for k, row in enumerate(kept) if k not in bad]
    assert len(rows) - 20 > len(clean) > len(kept) + 15 > len(left) + 20
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in left), key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, list(array("I", r.ids))) for r in got), key=repr) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in got)


def test_pipeline_stages_keep_columns_and_survive_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "benchmark decontamination", "bpe"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row int, _own string, bands int, h long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
