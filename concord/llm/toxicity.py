"""Toxicity (operator 4): maximum-scoring segments of token log-odds.

Tokens are words (lower-cased runs of letters, digits and underscores) and, since inflected forms share stems, their
beginnings of STEMS letters; a word scores as its best token.

Learning. Every token's counts in toxic and in clean labelled texts give its log-odds under a Dirichlet prior (half
a count plus a share of the corpus counts) and that value's standard error. Words that stand clear of it score their
log-odds; of the others nothing is known, and they score -gap. Labelled rows with equal texts count once. All labelled
rows outside the held-out third are used, up to LABELLED of them; beyond that a part of them by hash of the doc_id, which
bounds the model. (Scoring unclear and clean-side tokens by their own log-odds was measured and finds fewer: 108 to 121
of 144 held-out toxic rows at sf0.1 against 129.)

Scanning. One linear scan finds all maximal-scoring segments of the whole text. Segment scores of clean text have an
extreme-value law: with n words, E = K n exp(-lambda S) segments of score S or more are expected by chance. lambda
solves sum p exp(lambda s) = 1 over clean word frequencies, where gap is at least twice the mean score, so that clean
text drifts down; K is set by the segments in clean learning texts. A text's evidence is the sum of -ln E over its
significant segments (E < 1); a logistic curve over all learning rows turns evidence into the score.

Defined results: null and empty texts have no evidence and get the base score; rows with a null doc_id are scored
but never learned from, and held_out is false; several labels for a document count as toxic if one is; with no toxic
or no clean label, or no token that stands clear, every score is 0. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from concord.llm.common import salted_rows_bound, table, text_digest, without, written

GAP = 0.1
PRIOR_SHARE, PRIOR_LEAST = 0.01, 0.5
MIN_Z, MIN_DELTA, MIN_DOCS = 3.0, 4.0, 3
LABELLED = 2_000_000  # labelled rows to learn from, about
BROADCAST_ROWS = 1_000_000
STEMS = (3, 4, 5, 6)
THRESHOLD = 0.7
BIN = 0.02  # width of the curve's bins on the scale ln(1 + evidence)
MEMO = 100_000  # words whose score a task remembers
FLUSH = 100_000  # tokens a task counts before it hands its partial counts on

SEGMENTS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("score", DoubleType()), StructField("e_value", DoubleType())]))

_find = re.compile(r"\w+").findall


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def tokens_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Scores(dict):
    """word -> its score, 0 for words without one."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        got = max(self.lexicon.get(t, 0.0) for t in tokens_of(word))
        if len(self) < MEMO:
            self[word] = got
        return got


def maximal_segments(places: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first place, last place, score) of a word sequence in which the words at
    ``places`` have positive ``scores`` and every other one has -gap. Linear in the number of places."""
    stack: list[list] = []  # [first, last, sum before it, sum after it, index of the last one with a smaller sum before]
    total, last = 0.0, -1
    for i, s in zip(places, scores, strict=True):
        total -= gap * (i - last - 1)
        new = [i, i, total, total + s, -1]
        total, last = total + s, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def out():
        rows = list(counts.values())
        got = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], ["word", "n0", "n1", "d0", "d1"])
        counts.clear()
        return got

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = _find((text.as_py() or "").lower())
            here: dict[str, int] = {}
            for w, n in Counter(words).items():
                for token in tokens_of(w):
                    here[token] = here.get(token, 0) + n
            for token, n in here.items():
                row = counts.get(token)
                if row is None:
                    row = counts[token] = [0, 0, 0, 0]
                row[toxic] += n
                row[2 + toxic] += 1
            if len(counts) >= FLUSH:
                yield out()
    if counts:
        yield out()


def log_odds(counts: DataFrame) -> DataFrame:
    """word, n0, n1, d0, d1 -> also delta (log-odds of toxic against clean) and z (delta in standard errors)."""
    total = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")).withColumn("prior", PRIOR_SHARE * (F.col("t0") + F.col("t1")))
    c = counts.crossJoin(F.broadcast(total)).withColumn("a", PRIOR_LEAST + PRIOR_SHARE * (F.col("n0") + F.col("n1")))  # totals: one row

    def side(n, t):
        return F.log((F.col(n) + F.col("a")) / F.greatest(F.col(t) + F.col("prior") - F.col(n) - F.col("a"), F.lit(1.0)))

    delta = side("n1", "t1") - side("n0", "t0")
    return c.withColumn("delta", delta).withColumn("z", delta / F.sqrt(1 / (F.col("n1") + F.col("a")) + 1 / (F.col("n0") + F.col("a"))))


def _decay(scores: np.ndarray, freq: np.ndarray, gap: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, where -gap has the rest of the frequency."""
    rest, lo, hi = 1 - freq.sum(), 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if (freq * np.exp(np.minimum(mid * scores, 700))).sum() + rest * math.exp(-mid * gap) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def _scan(text: str | None, scores: Scores, gap: float) -> tuple[int, list[tuple[int, int, float]]]:
    words = _find((text or "").lower())
    each = list(map(scores.__getitem__, words))
    hits = [i for i, s in enumerate(each) if s]
    return len(words), maximal_segments(hits, [each[i] for i in hits], gap) if hits else []


def _evidence(n: int, segments, decay: float, log_k: float) -> float:
    floor = log_k + math.log(max(n, 1))
    return sum(max(0.0, decay * s - floor) for _, _, s in segments)


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression in one variable, lightly ridged, by damped Newton steps."""
    w = np.zeros(2)
    X = np.stack([np.ones_like(x), x], 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (pos - (pos + neg) * p) - 0.1 * w
        h = (X * ((pos + neg) * p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model: lexicon, gap, decay, log_k and the curve. ``docs`` has doc_id and text, ``labels`` doc_id and toxic."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if salted_rows_bound(marks, BROADCAST_ROWS):
        marks = F.broadcast(marks)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id")
    once = text.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = written(once.select("doc_id", "toxic").distinct(), "tox")
    n_labelled = once.count()
    if n_labelled > LABELLED:
        once = once.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(LABELLED / n_labelled * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.join(F.broadcast(once) if salted_rows_bound(once, BROADCAST_ROWS) else once, "doc_id")
    counts = train.select("text", "toxic").mapInArrow(_counted, "word string, n0 long, n1 long, d0 long, d1 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))
    counts = written(counts, "tox")
    size = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not size[0] or not size[1]:
        return None
    clear = (F.col("z") >= MIN_Z) & (F.col("delta") >= MIN_DELTA) & (F.col("d1") >= MIN_DOCS)
    best = log_odds(counts).where(clear).select("word", "delta", "n0", "t0").orderBy("word").collect()  # words of MIN_DOCS toxic rows or more: bounded by LABELLED
    if not best:
        return None
    lexicon = {r["word"]: r["delta"] for r in best}
    scores, freq = np.array([r["delta"] for r in best]), np.array([(r["n0"] + 5 / len(best)) / r["t0"] for r in best])
    gap = max(GAP, 2 * float((freq * scores).sum()))
    decay = _decay(scores, freq, gap)
    low, shared = float(scores.min()), docs.sparkSession.sparkContext.broadcast(lexicon)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            got = [_scan(t.as_py(), scores, gap) for t in batch.column("text")]
            columns = [pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in x] for _, x in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", "n", "s"])

    seen = written(train.select("text", "toxic").mapInArrow(scanned, "toxic int, n long, s array<double>"), "tox")
    clean = seen.where("toxic = 0").agg(F.sum("n"), F.sum(F.size("s"))).first()
    log_k = math.log(((clean[1] or 0) + 1) / max(1, clean[0] or 0)) + decay * low
    floor = F.lit(log_k) + F.log(F.greatest("n", F.lit(1)))
    x = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), decay * s - floor))
    bins = seen.withColumn("x", x).groupBy(F.round(F.log1p("x") / BIN).alias("bin"))
    bins = bins.agg(F.avg("x").alias("x"), F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).orderBy("bin").collect()  # ln(1 + x) / BIN: some hundreds of rows
    a, b = _logistic(np.array([r["x"] for r in bins]), np.array([float(r["pos"]) for r in bins]), np.array([float(r["neg"]) for r in bins]))
    return {"lexicon": lexicon, "gap": gap, "decay": decay, "log_k": log_k, "a": a, "b": b}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, segments (first word, last word, score, e_value) of every row; the significant ones only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, ["doc_id"])


def _scored(rows: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, score and segments: one pass over the texts, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = Scores(m["lexicon"] if m else {})
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text"):
                if m is None:
                    scores.append(0.0)
                    found.append([])
                    continue
                n, segments = _scan(text.as_py(), lexicon, m["gap"])
                z = m["a"] + m["b"] * _evidence(n, segments, m["decay"], m["log_k"])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                log_e = [(a, b, s, m["log_k"] + math.log(max(n, 1)) - m["decay"] * s) for a, b, s in segments]
                found.append([{"first": a, "last": b, "score": s, "e_value": math.exp(max(-700.0, e))} for a, b, s, e in log_e if e < 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(found, kind)], [*keep, *names])

    names = ["_score", "_segments"]
    out = StructType([*(rows.schema[c] for c in keep), StructField(names[0], DoubleType()), StructField(names[1], SEGMENTS)])
    got = rows.mapInArrow(run, out)
    return got.select(*(got[c] for c in keep), got["_score"].alias("score"), got["_segments"].alias("segments"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs, learn(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; rows without a doc_id are scored alike.

    A prediction depends on the text alone, so rows go by a digest of their text."""
    model = learn(docs, labels)
    rows = docs.select(text_digest(docs["text"]).alias("digest"), F.col("text").cast("string").alias("text"))
    toxic = _scored(rows, model, ["digest"]).where(F.col("score") >= THRESHOLD).select("digest")
    return without(docs, text_digest(docs["text"]), toxic)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


QUERIES = {"op4_toxicity": query}
ORACLES: dict[str, str] = {}
