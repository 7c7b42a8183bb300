"""Language identification (operator 13): multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; letters stay, everything else is a break. Runs of 1 to 3 characters that lie in one word, with one
break before or behind it, are hashed to 2^BITS buckets. Tasks count buckets by language with numpy over all learning
documents, and the counts are added by a grouped sum. The matrix of log probabilities (buckets x languages, at most
2^BITS x MAX_LANGS) is broadcast, and batches of documents are scored as sparse counts against it.

``score`` is the posterior probability of the predicted language. Texts are cut into slices of SLICE characters that
overlap, so every run of a long text counts and memory stays bounded; an Arrow batch is bounded in rows and bytes.

Defined results: a text that is null or has no letter is ``und`` with score 0, and isn't learned from; so is every text if
there is nothing to learn from. A null doc_id isn't held out, nor learned from. An empty lang is a language like any other;
of equally likely languages the first in order of their names wins. Repeated rows count and are returned like others.
More than MAX_LANGS languages among the learning rows are refused. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import table, written

BITS, MAX_LANGS, SMOOTHING, SLICE = 15, 256, 0.5, 1 << 20
BUCKETS, FLUSH = 1 << BITS, 64
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _buckets(chars: str, starts: int) -> list[np.ndarray]:
    """The buckets of the runs that begin at the first ``starts`` characters of ``chars``, by length of the run."""
    code = np.frombuffer(chars.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    c, out = np.where(letter, code, 32).astype(np.uint64), []
    for n in (1, 2, 3):
        m = min(starts, len(c) - n + 1)
        if m <= 0:
            break
        packed = c[:m]
        for k in range(1, n):
            packed = (packed << np.uint64(21)) | c[k : m + k]
        inside = letter[:m] if n == 1 else letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1]
        out.append(((packed[inside] * MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def counts_of(text: str | None) -> np.ndarray:
    """How often each bucket occurs in the whole text; all zero if it has no letter."""
    whole, total = f" {text or ''} ", np.zeros(BUCKETS, np.int64)
    for at in range(0, len(whole), SLICE):
        part = whole[at : at + SLICE + 2]
        for b in _buckets(part, SLICE if at + SLICE < len(whole) else len(part) * 2):
            total += np.bincount(b, minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # bucket x language


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n; bucket BUCKETS has the number of documents."""
    total: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            n = counts_of(text.as_py())
            if n.any():
                total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[lang] += np.r_[n, 1]
        if len(total) > FLUSH:
            yield from rows()
    yield from rows()


def learn(docs: DataFrame) -> Model | None:
    """From all rows of ``docs`` (text, lang) with a lang and a letter."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string")
        .alias("lang")).where("text is not null and lang is not null")
    counts = written(rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language")
    languages = [r["lang"] for r in counts.where(F.col("bucket") == BUCKETS).select("lang").orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(languages) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    if not languages:
        return None
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))  # BUCKETS + 1 entries a language
    seen = np.zeros((BUCKETS + 1, len(languages)))
    for lang, bucket, n in packed.toLocalIterator():
        seen[bucket, languages.index(lang)] = n
    p = seen[:-1] + SMOOTHING
    return Model(languages, np.log(seen[-1] / seen[-1].sum()), np.log(p / p.sum(0)))


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, lang_pred and score."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    if model is None:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [(n[at], at) for n in (counts_of(t.as_py()) for t in batch.column("_text")) for at in [n.nonzero()[0]]]
            some = np.array([len(at) > 0 for _, at in found], bool)
            names, scores = np.full(len(found), UNKNOWN, object), np.zeros(len(found))
            if some.any():
                n, at = np.concatenate([n for n, _ in found]), np.concatenate([at for _, at in found])
                first = np.cumsum([0, *(len(at) for _, at in found if len(at))][:-1])
                total = np.add.reduceat(n[:, None] * model.log_p[at], first, axis=0) + model.prior
                best = total.argmax(1)
                names[some] = np.array(model.languages, object)[best]
                scores[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)],
                [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(own.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(own.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


QUERIES = {"op13_language": query}
ORACLES: dict[str, str] = {}
