"""Profiling: read-only evidence about tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.cohort import same
from concord.operators.identity import bounded
from concord.shared import kept


def distinct_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0, subset=[str(v) for v in values])


def disagreement(df: DataFrame, a: str, b: str, norm: dict[str, str]) -> DataFrame:
    """Rows where two descriptions differ after both are normalized; null differs from a value, not from null."""
    table = F.create_map(*(F.lit(x) for kv in norm.items() for x in kv))

    def n(c: str) -> Column:
        return F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))

    return df.where(~n(a).eqNullSafe(n(b)))


TILE, BLOCK = 1024, 4096  # a tile of samples has room for so many values of so many features, about
MOST, PART = 4096, 512  # samples in a tile at most, and those that are multiplied at once


def _tiles(meas: DataFrame, sample: str, feature: str, value: str, floor: float, own: list[str], tile: int, block: int,
        groups: DataFrame | None = None) -> DataFrame:
    """A row for each sample and tile that its tile meets, sorted: own, _x, _y (the two tiles), _t (its own), _s, _f and _v
    (features and values as arrays), _g (its groups)."""
    m = meas.where((F.col(value) > floor) & F.col(sample).isNotNull() & F.col(feature).isNotNull())
    m = m.select(*own, F.col(sample).alias("_s"), F.xxhash64(feature).alias("_f"), F.col(value).cast("double").alias("_v"))
    m = m.groupBy(*own, "_s").agg(F.collect_list(F.struct("_f", "_v")).alias("_l")).select(*own, "_s", "_l._f", "_l._v")
    if groups is not None:
        of = groups.where(F.col(sample).isNotNull() & F.col("group").isNotNull()).groupBy(F.col(sample).alias("_s"))
        m = m.join(of.agg(F.collect_set("group").alias("_g")), "_s").select(*own, "_s", "_f", "_v", "_g")
    m = kept(m, "expressed")  # counted and dealt
    features = m.select(*own, F.explode("_f").alias("_f")).groupBy(*own).agg(F.count_distinct("_f").alias("_nf"))
    room = F.greatest(F.least(F.floor(F.lit(tile * block) / F.col("_nf")), F.lit(MOST)), F.lit(1))
    if own:
        sizes = m.groupBy(*own).agg(F.count(F.lit(1)).alias("_ns")).alias("n").join(features.alias("f"), same("n", "f", own)).select("n.*", "_nf")
    else:
        sizes = m.agg(F.count(F.lit(1)).alias("_ns")).crossJoin(features)  # one row
    sizes = kept(sizes.select(*own, F.ceil(F.col("_ns") / room).cast("int").alias("_n")), "tiles")
    met = sizes.agg(F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2).alias("n")).first()["n"] or 0
    z = sizes.withColumnsRenamed({c: f"_own{k}" for k, c in enumerate(own)})
    on = [F.col(c).eqNullSafe(F.col(f"_own{k}")) for k, c in enumerate(own)]
    at = m.join(bounded(z), reduce(Column.__and__, on)) if own else m.crossJoin(F.broadcast(z))
    at = at.withColumn("_t", F.pmod(F.xxhash64("_s"), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    keys = [*own, "_x", "_y"]
    at = at.select(*own, F.least("_t", "_other").alias("_x"), F.greatest("_t", "_other").alias("_y"), "_t", *(c for c in m.columns if c not in own))
    n = max(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(met), 4000))
    return at.repartition(n, *keys).sortWithinPartitions(*keys)


def _met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of two tiles together, from batches in the order of ``keys``."""
    rows, now = [], None
    for batch in batches:
        at, start = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)), 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[start]:
                if rows and at[start] != now:
                    yield pa.Table.from_batches(rows)
                    rows = []
                now = at[start]
                rows.append(batch.slice(start, i - start))
                start = i
    if rows:
        yield pa.Table.from_batches(rows)


def _sides(got: pa.Table) -> tuple[dict, dict, bool]:
    """Two tiles as matrices over the same features: rows (in the table), v (less the sample's mean), has; those that have
    every feature come first (``whole`` of them), with z, their values at mean 0 and length 1, and ``even``, without spread."""
    lists = got.column("_f").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    columns, col = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    v, has = np.zeros((len(lengths), len(columns))), np.zeros((len(lengths), len(columns)))
    v[row, col], has[row, col] = got.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False), 1.0
    v -= has * (v.sum(1) / has.sum(1))[:, None]
    t, x, y = got.column("_t").to_numpy(), got.column("_x")[0].as_py(), got.column("_y")[0].as_py()

    def side(k: int) -> dict:
        rows = np.flatnonzero(t == k)
        full = has[rows].all(1)
        rows = np.concatenate([rows[full], rows[~full]])
        a, whole = v[rows], int(full.sum())
        w = a[:whole]
        even = w.max(1, initial=-np.inf) == w.min(1, initial=np.inf)
        w = w - w.mean(1, keepdims=True)
        length = np.sqrt((w**2).sum(1))
        z = w / np.where(even | (length == 0), 1.0, length)[:, None]
        return {"rows": rows, "v": a, "has": has[rows], "whole": whole, "z": z, "even": even | (length == 0)}

    a = side(x)
    return a, a if x == y else side(y), x == y


def _correlated(a: dict, b: dict, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """r (NaN without spread) and number of common features of some samples of two tiles."""
    if i.stop <= a["whole"] and j.stop <= b["whole"]:
        r = a["z"][i] @ b["z"][j].T
        r[a["even"][i]] = np.nan
        r[:, b["even"][j]] = np.nan
        return r, np.full(r.shape, float(a["v"].shape[1]))
    va, ha, vb, hb = a["v"][i], a["has"][i], b["v"][j], b["has"][j]
    n, sx, sy, sxx, syy = ha @ hb.T, va @ hb.T, ha @ vb.T, (va**2) @ hb.T, ha @ (vb**2).T
    p, q = n * sxx - sx**2, n * syy - sy**2
    spread = (p > 1e-13 * n * sxx) & (q > 1e-13 * n * syy)  # less is what rounding leaves of equal values
    return np.where(spread, (n * (va @ vb.T) - sx * sy) / np.sqrt(np.where(spread, p * q, 1.0)), np.nan), n


def _parts(a: dict) -> list[slice]:
    """Some samples each; those with every feature are not mixed with others."""
    w, n = a["whole"], len(a["rows"])
    return [slice(k, min(k + PART, w)) for k in range(0, w, PART)] + [slice(k, min(k + PART, n)) for k in range(w, n, PART)]


def sample_correlation(meas: DataFrame, sample: str, feature: str, value: str, floor: float, within: list[str] = (), tile: int = TILE,
        block: int = BLOCK) -> DataFrame:
    """Pearson correlation r of each pair of samples of one group over the n_features that both express above ``floor``;
    null where one of them has no spread there.

    A sample's values are one row. The samples of a group (``within``) are cut into tiles by hash, the larger the fewer
    features there are, and two tiles meet in one task with all their features, which multiplies them as matrices, with
    masks for what one of them lacks, and returns pairs. So the values times the tiles of their group are sent, and pairs
    are never sent. The pairs themselves are quadratic in the samples of a group by nature; group_correlation doesn't
    make them. Values are taken less their sample's mean, so sums don't lose digits."""
    own = list(within)
    at = _tiles(meas, sample, feature, value, floor, own, tile, block)
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"a {kinds['_s']}, b {kinds['_s']}, r double, n_features long"])
    keys = [*own, "_x", "_y"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _met(batches, keys):
            a, b, one = _sides(got)
            ids = got.column("_s").combine_chunks()
            rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            for i in _parts(a):
                for j in _parts(b):
                    if one and j.start < i.start:
                        continue
                    r, n = _correlated(a, b, i, j)
                    pick = n > 0
                    if one and i == j:
                        pick &= np.triu(np.ones_like(pick), 1)
                    k, m = pick.nonzero()
                    p, q = a["rows"][i][k], b["rows"][j][m]
                    swap = rank[p] > rank[q]  # pairs come with the smaller id first
                    r = r[k, m]
                    out = [ids.take(pa.array(np.where(swap, q, p))), ids.take(pa.array(np.where(swap, p, q))),
                        pa.array(r, pa.float64(), mask=~np.isfinite(r)), pa.array(n[k, m].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(got.column(c)[0], len(k)) for c in own), *out], [*own, "a", "b", "r", "n_features"])

    return at.mapInArrow(pairs, schema)


def group_correlation(meas: DataFrame, groups: DataFrame, sample: str, feature: str, value: str, floor: float, within: list[str] = (),
        least: int = 1, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """What correlation_of_groups says of the pairs of sample_correlation with ``least`` common features: ``within``,
    group_a, group_b, mean_r, n_pairs, without making pairs.

    groups: group and sample, of which a sample may have several. Two tiles return sums for each pair of their groups.
    Where samples have all features, r is the product of their standardized values, so the sum over the pairs of two
    groups is the product of the groups' sums; the others are multiplied pair by pair."""
    own = list(within)
    at = _tiles(meas, sample, feature, value, floor, own, tile, block, groups.select("group", sample))
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    kind = kinds["_g"][len("array<") : -1]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"_ga {kind}, _gb {kind}, _r double, _n double"])
    keys = [*own, "_x", "_y"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _met(batches, keys):
            a, b, one = _sides(got)
            lists = got.column("_g").combine_chunks()
            flat = lists.flatten()
            names = flat.unique()
            member = np.zeros((len(got), len(names)))
            lengths = np.diff(lists.offsets.to_numpy())
            member[np.repeat(np.arange(len(got)), lengths), pc.index_in(flat, value_set=names).to_numpy()] = 1.0
            ga, gb = member[a["rows"]], member[b["rows"]]
            total, count, wa, wb = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2), a["whole"], b["whole"]
            if a["v"].shape[1] >= least:
                ma, mb = ga[:wa] * ~a["even"][:, None], gb[:wb] * ~b["even"][:, None]
                total += (ma.T @ a["z"]) @ (mb.T @ b["z"]).T
                count += np.outer(ma.sum(0), mb.sum(0))
                if one:  # each pair once, none with itself
                    twice = ma.T @ ma
                    total, count = (total - ma.T @ (ma * (a["z"] ** 2).sum(1, keepdims=True))) / 2, (count - twice) / 2
            for i in _parts(a):
                for j in _parts(b):
                    if one and j.start < i.start or i.stop <= wa and j.stop <= wb:
                        continue
                    r, n = _correlated(a, b, i, j)
                    pick = (n >= max(least, 1)) & np.isfinite(r)
                    if one and i == j:
                        pick &= np.triu(np.ones_like(pick), 1)
                    total += ga[i].T @ np.where(pick, r, 0.0) @ gb[j]
                    count += ga[i].T @ pick.astype(float) @ gb[j]
            k, m = count.nonzero()
            # of two different groups both orders are told, and added below
            out = [names.take(pa.array(k)), names.take(pa.array(m)), pa.array(total[k, m]), pa.array(count[k, m])]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(got.column(c)[0], len(k)) for c in own), *out], [*own, "_ga", "_gb", "_r", "_n"])

    g = at.mapInArrow(sums, schema).groupBy(*own, F.least("_ga", "_gb").alias("group_a"), F.greatest("_ga", "_gb").alias("group_b"))
    g = g.agg(F.sum("_r").alias("_r"), F.sum("_n").alias("_n"))
    return g.select(*own, "group_a", "group_b", (F.col("_r") / F.col("_n")).alias("mean_r"), F.round("_n").cast("long").alias("n_pairs"))


def correlation_of_groups(pairs: DataFrame, groups: DataFrame, sample: str, within: list[str] = ()) -> DataFrame:
    """Mean correlation between groups of samples and inside them: ``within``, group_a, group_b (in order), mean_r, n_pairs.

    pairs: what sample_correlation returned. groups: group and sample, of which a sample may have several."""
    a = groups.select(F.col(sample).alias("a"), F.col("group").alias("_ga")).distinct()
    b = groups.select(F.col(sample).alias("b"), F.col("group").alias("_gb")).distinct()
    met = pairs.where("r is not null").join(bounded(a), "a").join(bounded(b), "b")
    return met.groupBy(*within, F.least("_ga", "_gb").alias("group_a"),
        F.greatest("_ga", "_gb").alias("group_b")).agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n_pairs"))


def label_crosscheck(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return a.join(b, key).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def duplicate_names(df: DataFrame, col: str) -> DataFrame:
    """Blank names, names that occur more than once, and their rows: one row."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    blank = F.col(col).isNull() | (F.trim(col) == "")
    return g.agg(F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank"),
        F.count_if(~blank & (F.col("n") > 1)).alias("repeated_names"),
            F.coalesce(F.sum(F.when(~blank & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_rows"))


def library_depth(values: DataFrame, sample: str, value: str, labels: DataFrame) -> DataFrame:
    return values.groupBy(sample).agg(F.sum(value).alias("depth"), F.count(F.lit(1)).alias("n")).join(labels, sample)


def presence_matrix(df: DataFrame, name: str, study: str, names: list[str], studies: list[str]) -> DataFrame:
    """For given names: in which studies they occur."""
    g = df.where(F.col(name).isin(names)).groupBy(name)
    return g.agg(*(F.coalesce(F.bool_or(F.col(study) == s), F.lit(False)).alias(s) for s in studies))


def names_in_all(df: DataFrame, name: str, study: str, studies: list[str]) -> DataFrame:
    """Names as written that every study has; one scan, one aggregation."""
    g = df.where(F.col(study).isin(studies)).groupBy(name).agg(F.count_distinct(study).alias("_n"))
    return g.where((F.col("_n") == len(set(studies))) & F.col(name).isNotNull()).select(name)
