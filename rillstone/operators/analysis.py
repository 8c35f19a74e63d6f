"""Lagged relations between two daily series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs_at_lags(dense: DataFrame, date: str, cause: str, effect: str, lags: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """(lag, x, y): effect on a day and cause so many days before, of a gap-filled series (a row a day). Each lag is a window column over
    the same order, so one shuffle serves any number of lags, and the pairs are laid out only after it."""
    w = Window.partitionBy(*groups).orderBy(date)
    ago = [F.struct(F.lit(int(k)).alias("lag"), (F.lag(cause, k) if k >= 0 else F.lead(cause, -k)).over(w).alias("x")) for k in lags]
    rows = dense.select(*groups, date, F.col(effect).alias("y"), F.array(*ago).alias("ago"))
    pairs = rows.filter("y is not null").select(*groups, F.explode("ago").alias("a"), "y").select(*groups, "a.lag", "a.x", "y")
    return pairs.filter("x is not null")


def lag_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("lag").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def lag_regression(pairs: DataFrame) -> DataFrame:
    """Slope, intercept and r2 of effect on cause, for each lag: one aggregation."""
    return pairs.groupBy("lag").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n")
    )


def fit_linear(df: DataFrame, predictors: Sequence[str], target: str):
    """An ordinary least squares model of target on all predictors; rows with a null are left out. None if no more rows are
    left than there are coefficients."""
    rows = df.select(*predictors, F.col(target).alias("label")).dropna()
    if rows.limit(len(predictors) + 2).count() < len(predictors) + 2:
        return None
    data = VectorAssembler(inputCols=list(predictors), outputCol="features").transform(rows)
    return LinearRegression(solver="normal", regParam=0.0).fit(data)


def lag_model(df: DataFrame, predictors: Sequence[str], target: str) -> DataFrame:
    """A row per term: its coefficient, beside r2 and the number of rows; no row if there are too few to fit."""
    schema = "term string, coefficient double, r2 double, n long"
    m = fit_linear(df, predictors, target)
    if m is None:
        return df.sparkSession.createDataFrame([], schema)
    terms = [("intercept", float(m.intercept)), *zip(predictors, map(float, m.coefficients), strict=True)]
    rows = [(name, value, float(m.summary.r2), int(m.summary.numInstances)) for name, value in terms]
    return df.sparkSession.createDataFrame(rows, schema)


def causality(df: DataFrame, own: Sequence[str], other: Sequence[str], target: str) -> DataFrame:
    """Do the other series' lags improve the prediction from the own lags? F of the nested regressions, with its degrees of
    freedom; f and the sums are null if there are too few rows for the full model."""
    schema = "f double, df1 int, df2 int, ssr_own double, ssr_full double, n long"
    rows = df.select(target, *own, *other).dropna()
    small, full = fit_linear(rows, own, target), fit_linear(rows, [*own, *other], target)
    q = len(other)
    if full is None:
        n = rows.count()
        return df.sparkSession.createDataFrame([(None, q, n - len(own) - q - 1, None, None, n)], schema)
    n = int(full.summary.numInstances)
    rest = n - len(own) - q - 1
    ssr = [float(m.summary.meanSquaredError) * n for m in (small, full)]
    f = (ssr[0] - ssr[1]) / q / (ssr[1] / rest) if ssr[1] > 0 else None
    return df.sparkSession.createDataFrame([(f, q, rest, ssr[0], ssr[1], n)], schema)


#: Rows that a model needs beyond its coefficients, and how near to singular its equations may be.
SPARE, SINGULAR = 1, 1e-12


def walk_forward(df: DataFrame, groups: Sequence[str], date: str, predictors: Sequence[str], target: str, cuts: Sequence[str], spare: int = SPARE) -> DataFrame:
    """Forecasts of target by a linear model per group, each fitted on what lies before: a row per row of df from the first cut on whose target and
    predictors are there, with groups, date, fold (from 1), target, forecast and n_train.

    ``cuts`` are ascending days; the model of a fold is fitted on all rows before its cut and forecasts those from it to the next. Least squares
    by normal equations: the sums of products of a group's rows between two cuts come from one aggregation, those of all rows before a cut from adding
    them up, and the equations of every (group, fold) are solved where their row lies. Sums are of differences from a group's own
    first values, so that large levels don't drown small changes. forecast is null where the rows are too few or a predictor depends on others."""
    p = len(predictors)
    names = [*predictors, target]
    rows = df.select(*groups, F.col(date).alias("date"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna(subset=["date", *[f"x{i}" for i in range(p + 1)]])
    fold = sum((F.when(F.col("date") >= F.lit(c).cast("date"), 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("fold", fold)
    keyed = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    own = [f"g{i}" for i in range(len(groups))]
    rows = rows.select(*keyed, "date", "fold", *[f"x{i}" for i in range(p + 1)])
    xs = F.struct(*[f"x{i}" for i in range(p + 1)])
    base = rows.groupBy(*own).agg(F.min(F.struct("date", xs.alias("at"))).alias("first")).select(*[F.col(c).alias(f"b{c}") for c in own], F.col("first.at").alias("base"))
    same = lambda right, on: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{right}{c}")) for c in on], F.lit(True))
    met = rows.join(base, same("b", own)).select(*own, "date", "fold", *[f"x{i}" for i in range(p + 1)], *[(F.col(f"x{i}") - F.col(f"base.x{i}")).alias(f"d{i}") for i in range(p + 1)], "base")
    d = [F.lit(1.0), *[F.col(f"d{i}") for i in range(p + 1)]]
    pairs = [(i, j) for i in range(p + 2) for j in range(i, p + 2)]
    sums = met.filter(F.col("fold") < len(cuts)).groupBy(*own, "fold", "base").agg(*[F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i, j in pairs])
    later = sums.select(*own, "base", F.explode(F.sequence(F.col("fold") + 1, F.lit(len(cuts)))).alias("fold"), *[f"s{i}_{j}" for i, j in pairs])
    totals = later.groupBy(*own, "fold", "base").agg(F.array(*[F.sum(f"s{i}_{j}") for i, j in pairs]).alias("sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: k for k, x in enumerate(pairs)}
        for b in batches:
            s = np.array(b.column("sums").to_pylist(), float).reshape(-1, len(pairs))
            full = np.stack([np.stack([s[:, at[min(i, j), max(i, j)]] for j in range(p + 2)], -1) for i in range(p + 2)], -2)
            left, right, n = full[:, : p + 1, : p + 1], full[:, : p + 1, p + 1], s[:, 0]
            size = np.sqrt(np.maximum(np.einsum("kii->ki", left), 1e-300))
            even = left / (size[:, :, None] * size[:, None, :])  # columns of one length, so that units don't matter
            good = (n >= p + 1 + spare) & np.isfinite(even).all((1, 2))
            good[good] = np.linalg.svd(even[good], compute_uv=False)[:, -1] > SINGULAR
            beta = np.full((len(s), p + 1), np.nan)
            beta[good] = np.linalg.solve(even[good], (right / size)[good][:, :, None])[:, :, 0] / size[good]
            told = pa.array([None if not ok else list(x) for ok, x in zip(good, beta.tolist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], b.column("fold"), pa.array(n.astype(np.int64)), told], names=[*own, "fold", "n_train", "beta"])

    kinds = ", ".join([*[f"{c} {totals.schema[c].dataType.simpleString()}" for c in own], "fold int", "n_train long", "beta array<double>"])
    models = totals.select(*own, F.col("fold").cast("int").alias("fold"), "sums").mapInArrow(solve, kinds)
    models = models.select(*[F.col(c).alias(f"m{c}") for c in [*own, "fold"]], "n_train", "beta")
    tested = met.filter("fold > 0").join(models, same("m", [*own, "fold"]), "left")
    forecast = F.col(f"base.x{p}") + F.col("beta")[0] + sum((F.col("beta")[i + 1] * F.col(f"d{i}") for i in range(p)), F.lit(0.0))
    return tested.select(*[F.col(c).alias(g) for c, g in zip(own, groups, strict=True)], "date", "fold", F.col(f"x{p}").alias("target"), forecast.alias("forecast"), F.coalesce("n_train", F.lit(0)).alias("n_train"))


def forecast_errors(forecasts: DataFrame, groups: Sequence[str], previous: str = "previous") -> DataFrame:
    """n, MAE and RMSE of the forecasts and of persistence (the value of the day before, column ``previous``), over the rows that have both, and skill: the share of
    persistence's squared error that the forecasts save. A single aggregation."""
    both = forecasts.filter(F.col("forecast").isNotNull() & F.col(previous).isNotNull())
    error = {"": F.col("forecast") - F.col("target"), "_persistence": F.col(previous) - F.col("target")}
    told = both.groupBy(*groups).agg(
        F.count("*").alias("n"), *[F.avg(F.abs(e)).alias(f"mae{k}") for k, e in error.items()], *[F.sqrt(F.avg(e * e)).alias(f"rmse{k}") for k, e in error.items()]
    )
    return told.withColumn("skill", 1 - F.try_divide(F.col("rmse") * F.col("rmse"), F.col("rmse_persistence") * F.col("rmse_persistence")))
