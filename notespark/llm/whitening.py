"""Whitening of embeddings on their leading components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .feast import leading
from .vectors import finite

COMPONENTS = 16
#: Fixed-point form of an entry: steps of 1 / STEPS, moved up by OFFSET.
STEPS, OFFSET = 64, 1_000_000


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.tolist()).astype(np.int64)


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's number of rows and its sum per dimension."""
    rows, sums = 0, None
    for batch in batches:
        if len(batch):
            rows += len(batch)
            sums = (0 if sums is None else sums) + _stack(batch["x"]).sum(axis=0)
    if rows:
        yield pd.DataFrame({"pos": np.arange(len(sums)), "s": sums, "rows": rows})


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where they fit, else as Python's."""
    most = int(np.abs(x).max(initial=0))
    if n * most + int(np.abs(sums).max(initial=0)) < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _products(n: int, sums: np.ndarray, project: np.ndarray | None):
    """A task's sums of products of the centred rows, or of their projections: (i, j, p), and the sums at i = -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products = total = None
        for batch in batches:
            if len(batch):
                c = _numerators(_stack(batch["x"]), n, sums).astype(np.float64) / n
                c = c if project is None else c @ project
                products = (0 if products is None else products) + c.T @ c
                total = (0 if total is None else total) + c.sum(axis=0)
        if products is not None:
            d = len(total)
            i, j = np.indices((d, d))
            yield pd.DataFrame({"i": [*i.ravel(), *[-1] * d], "j": [*j.ravel(), *range(d)], "p": [*products.ravel(), *total]})

    return run


def _covariance(distinct: DataFrame, n: int, sums: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance over ``distinct(x)``. As many numbers reach the driver as dimensions have pairs."""
    d = len(sums) if project is None else project.shape[1]
    parts = distinct.select("x").mapInPandas(_products(n, sums, project), "i int, j int, p double")
    cells = np.zeros((d + 1, d))
    for i, j, p in parts.groupBy("i", "j").agg(F.sum("p")).collect():
        cells[i, j] = p
    mean = cells[d] / n  # zero but for rounding: the rows are centred
    return cells[:d] / n - np.outer(mean, mean)


def _whiten(n: int, sums: np.ndarray, project: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                numbers = _numerators(_stack(batch["x"]), n, sums)
                most = int(np.abs(numbers).max(initial=0))
                exact = numbers if most * most * numbers.shape[1] < 2**62 else numbers.astype(object)
                yield pd.DataFrame({"id": batch["id"], "deviation": [str(s) for s in (exact * exact).sum(axis=1)],
                                    "whitened": list(numbers.astype(np.float64) / n @ project)})

    return run


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    An entry c counts as x = floor(64 * c) + 1000000. Means and covariance are those of the
    distinct x vectors, ``n`` in number: ``deviation`` (decimal) is the exact sum of squares of
    n * x less the sums, ``whitened`` the centred x on the unit eigenvector of the component over
    the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, and
    ``identity_error`` the largest entry by which the covariance of all whitened distinct vectors
    differs from the identity. Components are numbered from 1 by falling eigenvalue.

    Left out are rows whose vector is null or empty, holds a null or non-finite entry or one
    beyond a 64-bit number, or is not of the most frequent dimension (ties: the greater). Rows
    without an id and repeated rows are rows like others. Components whose eigenvalue is zero do
    not exist, so one distinct vector, or no rows, give no rows. Further columns are not read.

    Vectors meet once, to become distinct; everything else is sums per task. What reaches the
    driver, and is solved there, has the size of the covariance, whatever the number of rows.
    """
    read = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("v")).filter(finite("v"))
    read = read.filter(F.forall("v", lambda c: F.abs(c.cast("double")) < F.lit(2.0**56)))
    rows = read.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * STEPS) + OFFSET).alias("x"))
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "id {}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double".format(
        vectors.schema[id_col].dataType.simpleString())
    if dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == dims["d"])
    distinct = staged(rows.select("x").distinct(), "distinct")
    totals = distinct.mapInPandas(_totals, "pos int, s bigint, rows bigint").groupBy("pos").agg(F.sum("s"), F.sum("rows")).collect()
    n, sums = totals[0][2], np.array([s for _, s, _ in sorted(totals)], dtype=np.int64)
    covariance = _covariance(distinct, n, sums)
    values, axes = leading(covariance, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    project = axes / np.sqrt(values)
    error = float(np.abs(_covariance(distinct, n, sums, project) - np.eye(len(values))).max())
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    done = rows.mapInPandas(_whiten(n, sums, project), f"id {vectors.schema[id_col].dataType.simpleString()}, deviation string, whitened array<double>")
    return done.select("id", "deviation", F.posexplode("whitened").alias("p", "whitened")).select(
        "id", (F.col("p") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", F.get(explained, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
