"""MinHash near-dedup (operator 2): weighted-Jaccard classes of documents by BagMinHash.

A document is the multiset of its five-word shingles (lower-cased words of letters, digits and underscores; with
fewer than five words, the words together are its one shingle). Its signature comes from Poisson processes over
discretised weights: every shingle has one process for each dyadic weight interval [0,1), [1,2), [2,4) ...; the
process gives points in ascending time, each for one random component of the signature and at a random weight, and
a point counts where that weight lies below the shingle's own. A component keeps its earliest time, so two
documents agree in it with probability equal to their weighted Jaccard similarity. Only points before a horizon
are made; a document with a component still empty gets a longer one.

Banding finds candidates; the overlap of the shingle multisets decides them. Copies with the same words are one
document from the first shuffle on. A bucket's centre is its smallest document. Every document is held against the smallest of its
buckets' centres, then against the centres whose class still differs from its own; then, in families that
buckets with several classes even so connect, all documents against each other, block by block. So no pair of a bucket
is left undecided unless its two documents are already in one class, and rows never grow with the pairs of a group.

Of the published scheme this keeps the Poisson processes over discretised weights, one for each dyadic level with
rejection; it doesn't split them recursively or end them early by a queue, since points are made for whole arrays at once.

Defined results: null texts count as empty; all texts without a word form one class; class_id is the class's
smallest doc_id; repeated rows give repeated rows, and rows that share a doc_id are one document; rows whose doc_id is
null are compared and classed like others, each text as a document of its own, but never lend a class its id unless no
other member has one (then class_id is null, as is rep_id where all rows with the same words have none).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import private, table, without, written
from concord.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 7  # a pair of similarity 0.8 shares a band with probability 0.9995
BLOCK = 150_000  # shingles that a task handles at once; a longer document is a block of its own
GROUP = 200  # documents held against one copy of a centre's shingles

_find = re.compile(r"\w+").findall


def _times(k: int, odd: int) -> np.uint64:
    return np.uint64(k * odd & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _find((text or "").lower())


def shingles(words: list[str]) -> np.ndarray:
    """64-bit hashes of the shingles, in order and with repeats."""
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(h) - WIDTH + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def _first_points(elem, weight, doc, n_docs: int, m: int, slack: float) -> np.ndarray:
    total = np.bincount(doc, weight, n_docs)
    horizon = (math.log(m) + slack) / np.maximum(total, 1e-300)
    best = np.full(n_docs * m, np.inf)
    lower, length, level = 0.0, 1.0, 0
    while True:
        at = np.flatnonzero(weight > lower)
        if not at.size:
            return best.reshape(n_docs, m)
        seed, d, w = mix(elem[at] + _times(level, 0xD1342543DE82EF95)), doc[at], weight[at]
        t, step = np.zeros(at.size), 0
        partial = bool(level) and bool((w < lower + length).any())
        while t.size:
            step += 1
            h = mix(seed + _times(step, 0x9E3779B97F4A7C15))
            t = t - np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / (m * length)
            live = t < horizon[d]
            t, h, seed, d, w = t[live], h[live], seed[live], d[live], w[live]
            h = mix(h ^ np.uint64(0xA0761D6478BD642F))
            part = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            if partial:
                y = lower + (h & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length
                ok = y < w
                np.minimum.at(best, d[ok] * m + part[ok], t[ok])
            else:
                np.minimum.at(best, d * m + part, t)
        lower, length, level = lower + length, length if not level else length * 2, level + 1


def bag_minhash(elem, weight, doc, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n_docs x m) of weighted sets given as parallel arrays; every document has an element."""
    sig, slack = _first_points(elem, weight, doc, n_docs, m, 6.0), 6.0
    while (open_ := np.flatnonzero(np.isinf(sig).any(1))).size:
        slack *= 2
        number = np.full(n_docs, -1)
        number[open_] = np.arange(open_.size)
        at = number[doc] >= 0
        sig[open_] = _first_points(elem[at], weight[at], number[doc[at]], open_.size, m, slack)
    return sig


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def _counted(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.unique(x, return_counts=True) for x in block]
    sizes = [len(p[0]) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64), np.repeat(np.arange(len(block)), sizes)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        begin, block, keys, size = 0, [], [], 0
        for k in range(len(ids)):
            words = words_of(texts[k].as_py())
            keys.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
            block.append(shingles(words))
            size += len(block[-1])
            if size >= BLOCK or k == len(ids) - 1:
                full = [i for i, x in enumerate(block) if len(x)]
                bands: list = [[] for _ in block]
                if full:
                    got = band_hashes(bag_minhash(*_counted([block[i] for i in full]), len(full)))
                    for i, row in zip(full, got, strict=True):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin : k + 1], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])
                begin, block, keys, size = k + 1, [], [], 0


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the words), bands: one pass over the texts, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signed, "doc_id long, key binary, bands array<long>")


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["center", "salt", "member", "doc_id", "grams"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    for batch in batches:
        out, size = [], 0
        for doc_id, text, places in zip(*(batch.column(c) for c in ("doc_id", "text", "places")), strict=True):
            doc_id = doc_id.as_py()
            x = np.sort(shingles(words_of(text.as_py())))
            if len(x):  # repeats become distinct: the k-th occurrence of a shingle is an element of its own
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                nth = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
                x = np.sort(mix(x + nth.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
            data = x.tobytes()
            for p in places.as_py():
                out.append((p["center"], p["salt"], doc_id != p["center"], doc_id, data))
                size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    center, grams = None, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for c, member, doc_id, data in zip(*(batch.column(n) for n in ("center", "member", "doc_id", "grams")), strict=True):
            x = np.frombuffer(data.as_py(), np.uint64)
            if not member.as_py():
                center, grams = c.as_py(), x
                continue
            assert center == c.as_py(), "a centre's row comes first"
            both = np.intersect1d(grams, x, assume_unique=True).size
            out.append((center, doc_id.as_py(), both / max(1, len(grams) + len(x) - both)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "sim"])


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, sim) with the exact weighted Jaccard similarity of their shingles.

    The texts are shuffled once, to meet their centres' names, and the shingles of those that are needed once more,
    in groups of some hundreds around a copy of the centre's shingles, however many documents a centre has.
    """
    groups = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("s"))
    spots = pairs.join(groups, "u").select(F.col("v").alias("doc_id"), F.struct(F.col("u").alias("center"), F.pmod(F.hash("v"), "s").alias("salt")).alias("place"))
    own = groups.select(F.col("u").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt")).select("doc_id", F.struct(F.col("doc_id").alias("center"), "salt").alias("place"))
    needed = spots.unionByName(own).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    rows = docs.select("doc_id", "text").join(needed, "doc_id").mapInArrow(_gram_rows, "center long, salt int, member boolean, doc_id long, grams binary")
    return rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "member").mapInArrow(_compared, "u long, v long, sim double")


def _joined(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, salt) -> for each such group links of similar documents that join its classes: a
    spanning forest, so no more links than documents, however many pairs are similar."""

    def links(ids: list[int], grams: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(g) for g in grams])
        code = np.unique(np.concatenate(grams), return_inverse=True)[1]
        at = np.r_[0, np.cumsum(sizes)[:-1]]
        mark, parent, out = np.zeros(int(code.max()) + 1), list(range(len(ids))), []

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in range(len(ids) - 1):
            own = code[at[i] : at[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[code[at[i + 1] :]], at[i + 1 :] - at[i + 1])
            mark[own] = 0
            for j in i + 1 + np.flatnonzero(both >= threshold * (sizes[i] + sizes[i + 1 :] - both)):
                if (a := top(i)) != (b := top(int(j))):
                    parent[b] = a
                    out.append((ids[i], ids[j]))
        return out

    group, ids, grams, out = None, [], [], []
    for batch in batches:
        for c, k, doc_id, data in zip(*(batch.column(n).to_pylist() for n in ("center", "salt", "doc_id", "grams")), strict=True):
            if (c, k) != group:
                out += links(ids, grams) if len(ids) > 1 else []
                group, ids, grams = (c, k), [], []
            if data:
                ids.append(doc_id)
                grams.append(np.frombuffer(data, np.uint64))
    out += links(ids, grams) if len(ids) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["u", "v"])


def _among(docs: DataFrame, inside: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) among all documents of each family: those that buckets which hold several classes connect.

    A family is dealt into blocks, and every two blocks meet in one task: that is a bounded number of rows a task, and
    rows in proportion to the family times its blocks, not to its pairs."""
    root = components(inside.select(F.col("doc_id").alias("u"), F.col("u").alias("v")))
    homes = root.select(F.col("node").alias("doc_id"), F.col("root").alias("family")).unionByName(root.select(F.col("root").alias("doc_id"), F.col("root").alias("family")).distinct())
    sizes = homes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("n"))
    dealt = homes.join(sizes, "family").withColumn("b", F.pmod(F.hash("doc_id"), "n"))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.col("family").alias("center"), (F.least("b", j) * F.col("n") + F.greatest("b", j)).alias("salt")))
    rows = docs.join(dealt.select("doc_id", places.alias("places")), "doc_id").mapInArrow(_gram_rows, "center long, salt int, member boolean, doc_id long, grams binary")
    return rows.repartition("center", "salt").sortWithinPartitions("center", "salt").mapInArrow(lambda it: _joined(it, threshold), "u long, v long")


def _placed(slots: DataFrame, found: DataFrame) -> DataFrame:
    """band, u, doc_id, label: the bucket places with each document's class so far."""
    return slots.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "u", "doc_id", F.coalesce("root", "doc_id").alias("label"))


#: Inside, doc_ids lie below this number, and ids of texts that come without one above it.
NAMELESS = 1 << 62


def id_shift(docs: DataFrame) -> int:
    """What is taken from doc_ids so that they lie below NAMELESS: 0, unless there are larger ones."""
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high")).first()
    shift = 0 if ends["high"] is None else max(0, ends["high"] - (NAMELESS - 1))
    if shift and ends["low"] - shift < -(1 << 63):
        raise ValueError(f"doc_ids from {ends['low']} to {ends['high']} leave no room for ids of texts without one")
    return shift


def own_id(text: Column, shift: int) -> Column:
    """The doc_id less ``shift``, or an id from the text, larger than all real ones."""
    named = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 61))
    return F.coalesce(F.col("doc_id").cast("long") - F.lit(shift).cast("long"), named)


def identified(docs: DataFrame, shift: int) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(own_id(text, shift).alias("doc_id"), text.alias("text"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, rep_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    rep_id is the smallest doc_id among rows with the same words, class_id the smallest of the whole class.
    """
    shift = id_shift(docs)
    got = _classes(identified(docs, shift), threshold)
    return got.select(*(F.when(F.col(c) < NAMELESS, F.col(c) + F.lit(shift).cast("long")).alias(c) for c in ("doc_id", "class_id", "rep_id")))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    marks = written(signed(docs), "bag")
    reps = written(marks.groupBy("key").agg(F.min("doc_id").alias("rep")), "bag")
    heads = marks.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    slots = heads.select("doc_id", F.explode("bands").alias("band"))
    mins = slots.groupBy("band").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("z")).where("u < z").select("band", "u")
    slots = written(slots.join(mins, "band").distinct(), "bag")  # only buckets with more than one document
    # only documents of such buckets are ever compared, so the texts are shuffled once, not for every comparison
    texts = written(docs.join(slots.select("doc_id").distinct(), "doc_id", "left_semi"), "bag")
    # first each document against the smallest centre of all its buckets, one pair a document
    spokes = slots.where("doc_id <> u").groupBy(F.col("doc_id").alias("v")).agg(F.min("u").alias("u"))
    stars = written(compare(texts, spokes), "bag")
    links = stars.where(F.col("sim") >= threshold).select("u", "v")
    found = components(links)

    # then against the other centres, where classes still differ
    placed = _placed(slots, found)
    centers = placed.where("doc_id = u").select("band", F.col("label").alias("center_label"))
    open_ = placed.join(centers, "band").where("doc_id <> u and label <> center_label").select("u", F.col("doc_id").alias("v")).distinct().join(spokes, ["u", "v"], "left_anti")
    open_ = written(open_, "bag")
    if not open_.isEmpty():
        more = written(compare(texts, open_), "bag")
        links = links.unionByName(more.where(F.col("sim") >= threshold).select("u", "v"))
        found = components(links)

    # then members against each other, in buckets that still hold several classes
    placed = _placed(slots, found)
    mixed = placed.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band")
    inside = written(placed.join(mixed, "band", "left_semi").select("u", "doc_id").distinct(), "bag")
    if not inside.isEmpty():
        extra = written(_among(texts, inside, threshold), "bag")
        if not extra.isEmpty():
            found = components(links.unionByName(extra))
    # classes first meet the representatives, one row each; copies join them by their words in one plain join
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("class_id"))
    return marks.select("doc_id", "key").join(written(named, "bag"), "key").select("doc_id", "class_id", F.col("rep").alias("rep_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest doc_id. Rows that repeat one doc_id are
    one document and stay or go together; of rows without a doc_id one of each text can stay, and only where no document
    of its class has an id."""
    shift = id_shift(docs)
    gone = _classes(identified(docs, shift), threshold).where("doc_id <> class_id").select("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = without(docs, own_id(text, shift), gone)
    nameless = kept.where("doc_id is null").withColumn(private(docs), text).dropDuplicates([private(docs)]).drop(private(docs))
    return kept.where("doc_id is not null").unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_neardup": query}
ORACLES: dict[str, str] = {}
