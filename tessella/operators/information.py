"""Mutual information of continuous features with a target, by distances to nearest neighbours (Kraskov and others, 2004).

Differences in a feature and in the target are divided by their deviations. For every row the distance r to its k-th nearest neighbour in (feature,
target), by the larger of both differences, is found; then the rows nearer than r in the feature alone and in the target
alone are counted, and importance is digamma(n) + digamma(k) - mean(digamma(n_x + 1) + digamma(n_y + 1)), at least 0.

Equal rows are one point with a number. Points are cut into strips along the feature (and along the target where many have
one feature value), some 8 sqrt(n) points each, so that there are sqrt(n) / 8 strips, whose boxes are all that the driver
holds. A strip's points find their neighbours there; those that may have nearer ones in other strips are sent to just the
strips whose boxes are nearer than what they have. The counts are running sums of points over values, read at the exact
two numbers that bound what is nearer than r.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.blocks import running

STRIP, LEAST = 8, 512
POINT = "feature string, x double, y double, m long"


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): first, first + 1, ... of each, `size` of them."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[which]


def distance(dx: np.ndarray, dy: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Differences are scaled, not values, so that equal differences stay equal."""
    return np.maximum(np.abs(dx) * scale[0], np.abs(dy) * scale[1])


def nearest(x: np.ndarray, y: np.ndarray, k: int, scale: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """The k least distances of each of some points to the others, ascending, infinite where there are fewer; y ascends."""
    n, out = len(x), np.full((len(x), k), np.inf)
    left, h = np.arange(n), 2 * k
    while len(left):
        for part in np.array_split(left, max(1, len(left) * h // 1_000_000)):
            at = part[:, None] + np.r_[-h:0, 1 : h + 1][None]
            there = (at >= 0) & (at < n)
            at = at.clip(0, n - 1)
            d = np.where(there, distance(x[at] - x[part, None], y[at] - y[part, None], scale), np.inf)
            out[part] = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
        below, above = left - h - 1, left + h + 1
        gap = scale[1] * np.minimum(np.where(below >= 0, y[left] - y[below.clip(0)], np.inf), np.where(above < n, y[above.clip(max=n - 1)] - y[left], np.inf))
        left, h = left[out[left, k - 1] > gap], 2 * h
    return out


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


class Strips:
    """Strips of one feature: by values of x, then inside each by values of y; boxes in order."""

    def __init__(self, edges: list[float], scale: tuple[float, float]):
        self.scale, self.x = scale, np.unique(np.array(edges, float))
        self.y: list[np.ndarray] = [np.zeros(0)] * (len(self.x) + 1)
        self.base = np.arange(len(self.x) + 2)
        self.box: np.ndarray | None = None

    def split(self, of: dict[int, list[float]]) -> None:
        self.y = [np.unique(np.array(of.get(i) or [], float)) for i in range(len(self.x) + 1)]
        self.base = np.r_[0, np.cumsum([len(e) + 1 for e in self.y])]

    def slab(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.x, x, "right")

    def strip(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slab = self.slab(x)
        out = self.base[slab]
        for i in np.unique(slab):
            if len(self.y[i]):
                here = slab == i
                out[here] += np.searchsorted(self.y[i], y[here], "right")
        return out

    def asked(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, strip): the other strips whose boxes are nearer than r."""
        x0, x1, y0, y1 = self.box.T
        far = r / self.scale[0] * (1 + 1e-12)
        first = np.searchsorted(np.maximum.accumulate(x1), x - far, "left")
        last = np.searchsorted(np.minimum.accumulate(x0[::-1])[::-1], x + far, "right")
        which, strip = ranges(first, np.maximum(last - first, 0))
        outside = lambda v, a, b: np.maximum(np.maximum(a[strip] - v[which], v[which] - b[strip]), 0)
        off = distance(outside(x, x0, x1), outside(y, y0, y1), self.scale)
        near = (off < r[which]) & (strip != own)
        return which[near], strip[near]


def _placed(strips: dict[str, Strips], name: str, place):
    """mapInArrow: adds a column of what place(strips of the feature, x, y) says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("feature", "x", "y"))
            out = np.zeros(len(f), np.int64)
            for name_ in np.unique(f):
                here = f == name_
                out[here] = place(strips[name_], x[here], y[here])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return run


def _expanded(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) in order of y, a point standing as often as it has equals, k + 1 times at most, which is all that matters."""
    x, y, m = (table[c].to_numpy() for c in ("x", "y", "m"))
    row = np.repeat(np.arange(len(x)), np.minimum(m, k + 1))
    row = row[np.argsort(y[row], kind="stable")]
    return row, x[row], y[row]


def _inside(strips: dict[str, Strips], k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        of, own = strips[key[0].as_py()], key[1].as_py()
        row, x, y = _expanded(table, k)
        d = np.empty((len(table), k))
        d[row] = nearest(x, y, k, of.scale)
        px, py = table["x"].to_numpy(), table["y"].to_numpy()
        which, strip = of.asked(px, py, d[:, k - 1], own)
        asks = _lists(strip[np.argsort(which, kind="stable")].astype(np.int64), np.bincount(which, minlength=len(table)))
        return table.select(["feature", "x", "y", "m"]).append_column("d", _lists(d.ravel(), np.full(len(d), k))).append_column("asks", asks)

    return run


def _beyond(strips: dict[str, Strips], k: int):
    def run(key: tuple, points: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(asks) or not len(points):
            return pa.table({"feature": pa.array([], pa.string()), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "m": pa.array([], pa.int64()), "d": pa.array([], pa.list_(pa.float64()))})
        scale = strips[key[0].as_py()].scale
        _, x, y = _expanded(points, k)
        qx, qy, r = (asks[c].to_numpy() for c in ("x", "y", "r"))
        far = r / scale[1] * (1 + 1e-12)
        first, last = np.searchsorted(y, qy - far, "left"), np.searchsorted(y, qy + far, "right")
        which, at = ranges(first, last - first)
        d = distance(x[at] - qx[which], y[at] - qy[which], scale)
        near = d < r[which]
        which, d = which[near], d[near]
        order = np.lexsort((d, which))
        which, d = which[order], d[order]
        rank = np.arange(len(d)) - np.searchsorted(which, which)
        which, d = which[rank < k], d[rank < k]
        return asks.select(["feature", "x", "y", "m"]).append_column("d", _lists(d, np.bincount(which, minlength=len(asks))))

    return run


def _ordered_bits(v: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order, and back."""
    i = v.view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _from_bits(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)


def bounds(v: np.ndarray, r: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): values w with low < w <= high, and no others, are nearer to v than r; only v itself for r = 0.

    Differences are those of floating numbers, so the bounds are found by halving between numbers.
    """
    nearer = lambda d: np.where(r > 0, d * scale < r, d <= 0)

    def last(from_: np.ndarray, to: np.ndarray, inside) -> np.ndarray:
        """The last number from from_ (inside) towards to (outside) that is inside."""
        a, b = _ordered_bits(from_), _ordered_bits(to)
        for _ in range(64):
            mid = (a >> 1) + (b >> 1) + (a & b & 1)
            yes = inside(_from_bits(mid))
            a, b = np.where(yes, mid, a), np.where(yes, b, mid)
            if (np.abs(a - b) <= 1).all():
                break
        return _from_bits(a)

    far = r / scale * 2 + np.abs(v) * 1e-15 + 1e-300
    low = last(v, v - far, lambda w: nearer(v - w))
    high = last(v, v + far, lambda w: nearer(w - v))
    return np.nextafter(low, -np.inf), high


def _bounded(scales: dict[str, tuple[float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "r"))
            f = batch.column("feature").to_numpy(zero_copy_only=False)
            out = np.empty((4, len(f)))
            for name in np.unique(f):
                here = f == name
                for i, v in enumerate((x, y)):
                    out[2 * i : 2 * i + 2, here] = bounds(v[here], r[here], scales[name][i])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "x0", "x1", "y0", "y1"])

    return run


def digamma(n: Column) -> Column:
    """For n of 1 or more, to 1e-14: by the series ten places further on."""
    z = n.cast("double") + 10
    w = 1 / (z * z)
    series = F.ln(z) - 1 / (2 * z) - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240)))
    for i in range(10):
        series = series - 1 / (n.cast("double") + i)
    return series


def _value_buckets(values: DataFrame, n: int) -> tuple[dict, int]:
    """Edges of value buckets by (feature, dim), of some STRIP * sqrt(n) values each."""
    parts = max(1, int(n**0.5 / STRIP))
    levels = F.array(*(F.lit(i / parts) for i in range(1, parts)), F.lit(1.0))
    rows = values.groupBy("feature", "dim").agg(F.percentile_approx("v", levels, 10_000).alias("e")).collect()
    return {(r.feature, r.dim): np.unique(np.array(r.e[:-1], float)) for r in rows}, parts


def _bucketed(edges: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, dim, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("feature", "dim", "v"))
            out = np.zeros(len(f), np.int64)
            for key in set(zip(f, dim, strict=True)):
                here = (f == key[0]) & (dim == key[1])
                out[here] = np.searchsorted(edges[key], v[here], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "_slab"])

    return run


def neighbour_distances(points: DataFrame, n: int, k: int, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """feature, x, y, m, r: the distance of each point to its k-th nearest neighbour, its own equals included; n points a feature or so."""
    size = max(LEAST, int(STRIP * n**0.5))
    parts = max(1, n // size)
    levels = F.array(*(F.lit(i / parts) for i in range(1, parts)), F.lit(1.0))
    strips = {r.feature: Strips(r.e[:-1], scales[r.feature]) for r in points.groupBy("feature").agg(F.percentile_approx("x", levels, 10_000).alias("e")).collect()}
    slabs = points.mapInArrow(_placed(strips, "slab", lambda s, x, y: s.slab(x)), f"{POINT}, slab long")
    # Slabs that hold more than two strips' points, for many have one x, are cut along y.
    wide = slabs.groupBy("feature", "slab").agg(F.count("*").alias("n"), F.percentile_approx("y", F.array(*(F.lit(i / parts) for i in range(1, parts)), F.lit(1.0)), 10_000).alias("e")).where(F.col("n") > 2 * size)
    cuts: dict[str, dict[int, list[float]]] = {f: {} for f in strips}
    for r in wide.collect():
        need = -(-r.n // size)
        cuts[r.feature][r.slab] = [r.e[min(int(i * parts / need), parts - 1)] for i in range(1, need)]
    for f, s in strips.items():
        s.split(cuts[f])
    placed = points.mapInArrow(_placed(strips, "strip", lambda s, x, y: s.strip(x, y)), f"{POINT}, strip long")
    for s in strips.values():
        s.box = np.full((int(s.base[-1]), 4), np.nan)
    for r in placed.groupBy("feature", "strip").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect():
        strips[r.feature].box[r.strip] = r.x0, r.x1, r.y0, r.y1
    for s in strips.values():  # a strip without points is as far as can be, in its place
        for i in np.flatnonzero(np.isnan(s.box[:, 0])):
            s.box[i] = (s.box[i - 1, 1],) * 2 + (np.inf, -np.inf) if i else (-np.inf, -np.inf, np.inf, -np.inf)
    found = placed.groupBy("feature", "strip").applyInArrow(_inside(strips, k), f"{POINT}, d array<double>, asks array<long>")
    asks = found.select("feature", F.explode("asks").alias("strip"), "x", "y", "m", F.element_at("d", k).alias("r"))
    more = placed.groupBy("feature", "strip").cogroup(asks.groupBy("feature", "strip")).applyInArrow(_beyond(strips, k), f"{POINT}, d array<double>")
    both = found.drop("asks").unionByName(more).groupBy("feature", "x", "y", "m")
    return both.agg(F.element_at(F.array_sort(F.flatten(F.collect_list("d"))), k).alias("r"))


def knn_information(df: DataFrame, target: str, columns: Sequence[str], k: int = 3) -> DataFrame:
    """feature, importance of every column, over rows that are complete in all of them and the target.

    Rows with NaN are not complete. Without complete rows there is no result; with k or fewer importance is 0. Columns
    without spread are not scaled.
    """
    names = [target, *columns]
    bare = df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(names))).dropna()
    one = bare.agg(F.count("*").alias("n"), *(F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(len(names)))).first()
    n = one.n
    scale = lambda i: 1 / (one[f"s{i}"] or 1.0)
    scales = {c: (scale(i + 1), scale(0)) for i, c in enumerate(columns)}
    value = lambda i: F.col(f"c{i}") + F.lit(0.0)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), value(i + 1).alias("x"), value(0).alias("y")) for i, c in enumerate(columns))))
    points = bare.select(each.alias("p")).select("p.*").groupBy("feature", "x", "y").agg(F.count("*").alias("m"))
    if n <= k:
        return points.select("feature").distinct().withColumn("importance", F.lit(0.0))
    near = neighbour_distances(points, n, k, scales).mapInArrow(_bounded(scales), f"{POINT}, r double, x0 double, x1 double, y0 double, y1 double")
    end = lambda dim, v, sign: F.struct(F.lit(dim).alias("dim"), F.col(v).alias("v"), F.lit(sign).alias("sign"))
    ends = near.select("feature", "x", "y", "m", F.explode(F.array(end("x", "x0", -1), end("x", "x1", 1), end("y", "y0", -1), end("y", "y1", 1))).alias("e")).select("feature", "x", "y", "m", "e.*")
    counts = lambda dim: points.groupBy("feature", F.lit(dim).alias("dim"), F.col(dim).alias("v")).agg(F.sum("m").alias("w"))
    places = counts("x").unionByName(counts("y")).unionByName(ends.select("feature", "dim", "v", F.lit(0).cast("long").alias("w")).distinct())
    places = places.groupBy("feature", "dim", "v").agg(F.sum("w").alias("w"))
    edges, _ = _value_buckets(places, n)
    placed = places.mapInArrow(_bucketed(edges), "feature string, dim string, v double, w long, _slab long")
    upto = running(placed, {"upto": F.col("w")}, ("feature", "dim"), "v", F.col("_slab")).select("feature", "dim", "v", "upto")
    counted = ends.join(upto, ["feature", "dim", "v"]).groupBy("feature", "x", "y", "m")
    within = lambda dim: F.sum(F.when(F.col("dim") == dim, F.col("sign") * F.col("upto")))
    per = counted.agg(within("x").alias("nx"), within("y").alias("ny"))
    mean = F.sum(F.col("m") * (digamma(F.col("nx")) + digamma(F.col("ny")))) / F.sum("m")
    return per.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.lit(n)) + digamma(F.lit(k)) - mean).alias("importance"))
