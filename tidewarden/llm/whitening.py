"""Whitening of embeddings: principal components of the exactly centred distinct vectors, each scaled to variance one.

Components are whole numbers, so sums are exact and n * x - S is the exact n-fold of the centred component; one division makes
it a double before anything is multiplied. MLlib's RowMatrix adds up the Gram matrix over the cluster; only the sums and that
matrix (width x width) come to the driver, for a local eigendecomposition. The components are sent to the tasks that whiten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle

#: Scaled entries beyond it count as it, so that whole numbers fit a long.
LARGEST = 2.0**44
#: What every entry is moved by.
SHIFT = 1_000_000


@dataclass
class Whitening:
    """What was fitted: ``n`` distinct vectors, their sums by dimension, the components (width x k, unit length), eigenvalues
    by falling size, their share of the whole variance, and the largest entry of the whitened vectors' covariance less one."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def whole_vectors(embeddings: DataFrame, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, x array<long>), x = floor(scale * entry) + 1,000,000. Null vectors and those that hold a null or a
    non-finite entry are left out; null and repeated ids are kept."""
    c = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    most = F.lit(LARGEST / scale)
    x = F.transform(c, lambda e: F.floor(F.greatest(-most, F.least(most, e)) * scale) + SHIFT)
    return embeddings.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def _gram(rows: DataFrame, array: Column) -> np.ndarray:
    """The Gram matrix of a column of arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(array).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(vectors: DataFrame, k: int = 16) -> Whitening | None:
    """Fitted on each distinct ``x`` of ``vectors`` once; None if there is none. Shorter vectors are as if entries of zero
    followed. Of dimensions without variance as many components are kept as k asks for, with eigenvalue 0."""
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    padded = vectors.select(F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    once = settle(padded.distinct(), "distinct")
    each = once.select(F.posexplode("x").alias("place", "e")).groupBy("place").agg(F.sum(F.col("e").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = {r.place: (int(r.s), r.n) for r in each.collect()}  # a row for each dimension
    n, sums = found[0][1], [found[i][0] for i in range(width)]
    covariance = _gram(once, _centred(F.col("x"), n, sums)) / n
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-e, kind="stable")[:k]
    trace = float(np.trace(covariance))
    values = np.where(e[order] > max(trace, 0) * width * 2.0**-50, e[order], 0.0)  # beneath it is rounding
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # the same sign in every run
    model = Whitening(n, np.array(sums, dtype=object), v, values, values / trace if trace > 0 else np.zeros(len(order)))
    model.identity_error = _identity_error(once, model)
    return model


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """(n * x - S) / n of each dimension: the numerator is exact."""
    return F.zip_with(x, _longs(sums), lambda e, s: (e * F.lit(n).cast("long") - s).cast("double") / n)


def _projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """Adds ``whitened`` (array<double>, null for a component without variance) to rows that have ``centred``."""
    live = model.eigenvalues > 0
    scaled = model.components[:, live] / np.sqrt(model.eigenvalues[live])
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.drop('centred').dtypes)}, whitened array<double>"

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.full((len(frame), len(live)), np.nan)
            if len(frame):
                out[:, live] = np.array(frame["centred"].tolist()) @ scaled
            values = [[None if np.isnan(x) else float(x) for x in row] for row in out] if not live.all() else list(out)
            yield frame.drop(columns="centred").assign(whitened=values)

    return rows.mapInPandas(whiten, schema.removeprefix(", "))


def _identity_error(once: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance less one, measured on the vectors; None without variance."""
    live = [int(i) for i in np.flatnonzero(model.eigenvalues > 0)]
    if not live:
        return None
    centred = once.select(F.lit(0).alias("_"), _centred(F.col("x"), model.n, list(model.sums)).alias("centred"))
    w = settle(_projected(centred, model).select(F.array(*(F.col("whitened")[i] for i in live)).alias("w")), "whitened")
    means = {r.place: r.m for r in w.select(F.posexplode("w").alias("place", "e")).groupBy("place").agg(F.avg("e").alias("m")).collect()}
    mean = F.array(*(F.lit(float(means[i])) for i in range(len(live))))
    covariance = _gram(w, F.zip_with("w", mean, lambda e, m: e - m)) / model.n
    return float(np.abs(covariance - np.eye(len(live))).max())


def whiten(vectors: DataFrame, k: int = 16) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each row (vec_id, x) and each of
    the first k components, numbered from 1.

    ``deviation``: the sum of (n * x - S)**2 over the dimensions, exact; null if a long can't hold it. A component without
    variance has ``whitened`` null and ``explained`` 0. Ids may be null or repeat, each row is whitened; an empty table
    and vectors of no entries give no rows; other columns are left out."""
    model = fit(vectors, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, width = F.lit(model.n).cast("long"), len(model.sums)
    x = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    apart = F.zip_with(x, _longs(list(model.sums)), lambda e, s: F.try_subtract(F.try_multiply(e, n), s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda t, d: F.try_add(t, F.try_multiply(d, d)))
    rows = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), deviation.cast("string").alias("deviation"), _centred(x, model.n, list(model.sums)).alias("centred"))
    each = _projected(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*(F.lit(float(s)) for s in model.explained))
    return each.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("place") + 1).alias("component"), n.alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
