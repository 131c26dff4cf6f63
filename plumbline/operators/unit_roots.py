"""Augmented unit-root and cointegration tests: lag orders chosen by an information criterion, p-values from response surfaces.

A series is streamed once. Its rows carry the last changes as arrays; tasks add up cross-products of batches, so that the
normal equations of every lag order of a series are one small matrix, whatever the series' length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import bound, normal_cdf, polynomial
from .cross_section import correlations
from .folds import frac_diff
from .relations import log_price

#: Values that a series needs, and dates that a pair needs.
LEAST, LEAST_DATES = 8, 30
#: Response surfaces of the p-values of unit-root statistics, by trend term (n: none, c: constant, ct: with a
#: linear trend) and number of series: below which statistic p is 0, from which the upper curve holds, above which p is 1,
#: and both curves' coefficients from the constant up. p is the normal distribution of the curve's value.
SURFACES = {
    ("n", 1): (-19.04, -1.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    ("c", 1): (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    ("c", 2): (-18.86, -2.62, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
    ("ct", 1): (-16.18, -2.89, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}


def p_value(statistic: Column, trend: str = "c", of: int = 1) -> Column:
    """The p-value of a unit-root statistic; missing stays missing."""
    return bound(statistic, lambda t: _p_value(t, trend, of))


def _p_value(statistic: Column, trend: str, of: int) -> Column:
    least, turn, most, low, high = SURFACES[trend, of]
    curve = F.when(statistic <= turn, polynomial(statistic, low[::-1])).otherwise(polynomial(statistic, high[::-1]))
    p = F.when(statistic < least, 0.0).when(statistic > most, 1.0) if math.isfinite(most) else F.when(statistic < least, 0.0)
    return F.when(statistic.isNotNull(), p.otherwise(normal_cdf(curve)))


def lag_limit(n: Column, terms: int) -> Column:
    """The most lags that a series of n values is tried with, terms of a trend besides."""
    return F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100.0, 0.25)), F.floor(n / 2) - terms - 1)).cast("int")


def _fit(gram: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Coefficients, residual sum of squares and the first coefficient's variance over the residual one, of a regression
    of the first of the variables on the others; None if those are collinear."""
    yy, xy, xx = gram[0, 0], gram[1:, 0], gram[1:, 1:]
    scale = np.sqrt(np.diag(xx))
    if not (scale > 0).all():
        return None
    try:
        inverse = np.linalg.inv(xx / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(inverse).all() or np.abs(inverse).max() > 1e13:
        return None
    b = inverse @ (xy / scale)
    return b / scale, float(yy - b @ (xy / scale)), float(inverse[0, 0] / scale[0] ** 2)


def choose(gram: np.ndarray, heads: list[np.ndarray], limit: int, terms: int, rows: int) -> tuple[int, int, float | None]:
    """lag, rows used and t statistic of the level, from the cross-products of [change, level, changes 1 to limit before,
    trend terms] over the rows that have all of them, and those variables of the earlier rows (heads).

    The lag with the least Akaike criterion over the rows that all orders share (ties to the smaller one; orders that
    leave no row to spare are passed over) is fitted again with the rows that it leaves."""
    best: tuple[float, int] | None = None
    pick = lambda p: [0, 1, *range(2, 2 + p), *range(2 + limit, 2 + limit + terms)]
    for p in range(limit + 1):
        at = pick(p)
        fit = _fit(gram[np.ix_(at, at)]) if rows > len(at) - 1 else None
        if fit is not None and fit[1] > 0:
            aic = rows * (math.log(2 * math.pi) + math.log(fit[1] / rows) + 1) + 2 * (len(at) - 1)
            if best is None or aic < best[0]:
                best = (aic, p)
    if best is None:
        return 0, rows, None
    p = best[1]
    at = pick(p)
    used = [z for t, z in heads if t > p]
    whole = gram[np.ix_(at, at)] + sum((np.outer(z[at], z[at]) for z in used), np.zeros((len(at), len(at))))
    n = rows + len(used)
    fit = _fit(whole)
    spare = n - (len(at) - 1)
    if fit is None or spare <= 0 or fit[1] <= 0:
        return p, n, None
    return p, n, float(fit[0][0] / math.sqrt(fit[1] / spare * fit[2]))


def augmented_dickey_fuller(df: DataFrame, x: str, by: list[str], order: str, trend: str = "c", of: int = 1, surface: str | None = None) -> DataFrame:
    """by, values, lag, n, statistic, p of every series by with LEAST values or more; missing values are left out.

    The statistic is the t of the level in a regression of the change on it, on lag changes before and on trend (n, c or
    ct); lag is chosen by choose() up to lag_limit(). p is that of surface (trend if not given) and of series: residuals of
    a cointegrating regression are tested with trend n, of 2 and surface c. A constant series has no statistic.
    """
    terms = {"n": 0, "c": 1, "ct": 2}[trend]
    held = df.select(*by, order, F.col(x).cast("double").alias("_x")).where("_x is not null")
    sizes = held.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_x").alias("_mean")).where(F.col("_n") >= LEAST)
    sizes = sizes.withColumn("_limit", lag_limit(F.col("_n"), terms))
    most = sizes.agg(F.max("_limit")).first()[0] or 0  # one number
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag("_x").over(w)
    steps = held.select(*by, order, before.alias("_level"), (F.col("_x") - before).alias("_d"), (F.row_number().over(w) - 1).alias("_t"))
    steps = steps.withColumn("_z", F.collect_list("_d").over(w.rowsBetween(-most, 0))).where("_t > 0")
    rows = steps.join(sizes, by).select(*by, "_t", (F.col("_level") - F.when(F.lit(terms > 0), F.col("_mean")).otherwise(0.0)).alias("_level"), "_z", "_limit", "_n")
    keys = len(by)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema if f.name in by}

    def vector(t: int, level: float, changes: list[float], limit: int, n: int) -> np.ndarray:
        z = np.zeros(2 + limit + terms)
        last = changes[::-1][: limit + 1]
        z[0], z[1], z[2 : 1 + len(last)] = last[0], level, last[1:]
        if terms:
            z[2 + limit] = 1.0
        if terms > 1:
            z[3 + limit] = t / n
        return z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = list(zip(*(c.to_pylist() for c in b.columns[:keys]), strict=True))
            t, level, changes, limit, n = (c.to_pylist() for c in b.columns[keys:])
            out: list[tuple] = []
            lo = 0
            while lo < len(named):
                hi = lo + 1
                while hi < len(named) and named[hi] == named[lo]:
                    hi += 1
                top = limit[lo]
                zs = [vector(t[i], level[i], changes[i], top, n[i]) for i in range(lo, hi)]
                whole = [z for i, z in zip(range(lo, hi), zs, strict=True) if t[i] > top]
                out += [(*named[lo], t[i], z.tolist(), 0) for i, z in zip(range(lo, hi), zs, strict=True) if t[i] <= top]
                if whole:
                    m = np.array(whole)
                    out.append((*named[lo], 0, (m.T @ m).ravel().tolist(), len(whole)))
                lo = hi
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = [*by, "_t", "_v", "_rows"]
    schema = pa.schema([*((c, pa.int64() if kinds[c] == "bigint" else pa.int32() if kinds[c] == "int" else pa.float64() if kinds[c] == "double" else pa.string()) for c in by), ("_t", pa.int32()), ("_v", pa.list_(pa.float64())), ("_rows", pa.int64())])
    parts = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", _t int, _v array<double>, _rows long")
    # few numbers a series: the cross-products of its batches are summed place by place, its first rows are kept
    sums = parts.where("_t = 0").select(*by, "_rows", F.posexplode("_v").alias("_i", "_s")).groupBy(*by, "_i").agg(F.sum("_s").alias("_s"), F.sum("_rows").alias("_rows"))
    grams = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda v: v["_s"]).alias("_gram"), F.first("_rows").alias("_rows"))
    heads = parts.where("_t > 0").groupBy(*by).agg(F.collect_list(F.struct("_t", "_v")).alias("_heads"))
    ready = sizes.join(grams, by).join(heads, by, "left")

    @F.arrow_udf("struct<lag: int, n: long, statistic: double>")
    def tested(gram: pa.Array, first: pa.Array, limit: pa.Array, count: pa.Array) -> pa.Array:
        out = []
        for g, h, top, m in zip(gram.to_pylist(), first.to_pylist(), limit.to_pylist(), count.to_pylist(), strict=True):
            width = 2 + top + terms
            early = sorted(((r["_t"], np.array(r["_v"])) for r in h or []), key=lambda r: r[0])
            lag, n, t = choose(np.array(g).reshape(width, width), early, top, terms, m)
            out.append({"lag": lag, "n": n, "statistic": t})
        return pa.array(out, pa.struct([("lag", pa.int32()), ("n", pa.int64()), ("statistic", pa.float64())]))

    found = ready.select(*by, F.col("_n").alias("values"), tested("_gram", "_heads", "_limit", "_rows").alias("_r")).select(*by, "values", "_r.*")
    return found.withColumn("p", p_value(F.col("statistic"), surface or trend, of))


def least_order(df: DataFrame, x: str, orders: list[float], threshold: float = 1e-5, significance: float = 0.05, by: str = "symbol", order: str = "ts") -> DataFrame:
    """by, d, p, lag: the smallest of the orders at which the fractionally differenced x has a p below significance, with its
    test; orders that leave fewer than LEAST values are passed over. Missing if none is. All series and orders are tested
    at once."""
    tried = None
    for d in orders:
        one = df.select(by, order, frac_diff(x, d, threshold).alias("_f"), F.lit(float(d)).alias("d"))
        tried = one if tried is None else tried.unionByName(one)
    found = augmented_dickey_fuller(tried, "_f", [by, "d"], order)
    passed = found.where(F.col("p") < significance).groupBy(by).agg(F.min(F.struct("d", "p", "lag")).alias("_m"))
    return df.select(by).distinct().join(passed, by, "left").select(by, F.col("_m.d").alias("d"), F.col("_m.p").alias("p"), F.col("_m.lag").alias("lag"))


def cointegrated_pairs(prices: DataFrame, k: int, most_p: float = 0.05, least_correlation: float = 0.7) -> DataFrame:
    """a, b, corr, slope, cut, deviation, lag, statistic, p of the k pairs of names (a before b) with the smallest p, most_p at
    most; ties by name. prices: date, symbol, close.

    Only names with a positive price on every date, and LEAST_DATES of those, take part. Pairs whose log prices correlate
    by less than least_correlation in size are left out before their dates are joined. The residuals of a on b with a
    constant are tested for a unit root; p is that of two series."""
    p = prices.select("date", "symbol", log_price("close").alias("x"))
    days = p.agg(F.count_distinct("date").alias("_days"))  # one row
    full = p.groupBy("symbol").agg(F.count("x").alias("_n")).join(F.broadcast(days)).where((F.col("_n") == F.col("_days")) & (F.col("_n") >= LEAST_DATES))
    p = p.join(full.select("symbol"), "symbol", "left_semi")
    near = correlations(p.withColumnRenamed("x", "ret")).where(F.abs("corr") >= least_correlation).select("a", "b", "corr")
    left, right = p.select(F.col("symbol").alias("a"), "date", "x"), p.select(F.col("symbol").alias("b"), "date", F.col("x").alias("y"))
    pairs = near.select("a", "b").join(left, "a").join(right, ["b", "date"])
    fit = pairs.groupBy("a", "b").agg(F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("cut"))
    rest = pairs.join(fit, ["a", "b"]).select("a", "b", "date", (F.col("x") - F.col("slope") * F.col("y") - F.col("cut")).alias("e"))
    found = augmented_dickey_fuller(rest, "e", ["a", "b"], "date", "n", 2, "c").where(F.col("p") <= most_p)
    deviation = rest.groupBy("a", "b").agg(F.stddev_samp("e").alias("deviation")).where("deviation > 0")
    out = found.join(fit, ["a", "b"]).join(near, ["a", "b"]).join(deviation, ["a", "b"])
    return out.orderBy("p", "statistic", "a", "b").limit(k).select("a", "b", "corr", "slope", "cut", "deviation", "lag", "statistic", "p")
