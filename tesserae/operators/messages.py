"""Directed message passing on edge tables: what an edge hears are the edges into its source, but not its own way back.

The sum over the edges into a node is one aggregate for all edges that leave it; the edges that come straight back are taken off
it again, from an aggregate by both ends. So a step is two sums and two joins whatever the degrees are, and no node's
edges are gathered; the dense layers between the sums are matrix products on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import discard, written


class Layer(NamedTuple):
    """A dense layer: ``weight`` has a row for each input."""

    weight: np.ndarray
    bias: np.ndarray
    relu: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weight + self.bias
        return np.maximum(out, 0.0) if self.relu else out


def _sums(df: DataFrame, by: list[str], column: str, width: int) -> DataFrame:
    """Element-wise sums of an array column."""
    return df.groupBy(*by).agg(*(F.sum(F.element_at(column, i + 1)).alias(f"_s{i}") for i in range(width))).select(*by, F.array(*(f"_s{i}" for i in range(width))).alias("_sum"))


def dense(df: DataFrame, columns: list[str], layers: list[Layer], out: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``out``: the layers applied to array columns put end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in columns], axis=1)
            for layer in layers:
                x = layer(x)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), rows], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *(c for c in columns if c not in keep)).mapInArrow(run, f"{kinds}, `{out}` array<double>")


def _zeros(width: int):
    return F.array(*(F.lit(0.0) for _ in range(width)))


def heard(edges: DataFrame, state: str, width: int) -> DataFrame:
    """``edges`` (src, dst and more) with ``_heard``: the sum of ``state`` over edges into src, without those from dst."""
    into = _sums(edges, ["dst"], state, width).select(F.col("dst").alias("_at"), F.col("_sum").alias("_into"))
    back = _sums(edges, ["src", "dst"], state, width).select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("_sum").alias("_back"))
    met = edges.join(into, F.col("src") == F.col("_at"), "left").join(back, (F.col("dst") == F.col("_from")) & (F.col("src") == F.col("_to")), "left")
    total, own = F.coalesce("_into", _zeros(width)), F.coalesce("_back", _zeros(width))
    return met.withColumn("_heard", F.zip_with(total, own, lambda x, y: x - y)).drop("_at", "_into", "_from", "_to", "_back")


def passed(edges: DataFrame, features: str, first: list[Layer], message: list[Layer], steps: int) -> DataFrame:
    """``edges`` (src, dst, an array of features) with ``state`` after ``steps`` steps: at each, a message made of an edge's state
    and what it hears is added to the state. Edges with a null end or null features are left out; parallel edges count each."""
    some = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col(features).isNotNull())
    some = some.withColumn(features, F.col(features).cast("array<double>"))
    width = first[-1].weight.shape[1]
    now = written(dense(some, [features], first, "state", [c for c in some.columns if c != "state"]), "edges")
    keep = now.columns
    for _ in range(steps):
        told = dense(heard(now, "state", width), ["state", "_heard"], message, "_told", keep)
        after = written(told.withColumn("state", F.zip_with("state", "_told", lambda x, y: x + y)).drop("_told"), "edges")
        discard(now)
        now = after
    return now


def read_out(nodes: DataFrame, key: str, features: str, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """(key, state): layers over a node's features and the sum of the states of edges into it; 0 where there are none."""
    width = layers[0].weight.shape[0] - nodes.select(F.size(features)).first()[0] if not nodes.isEmpty() else 1
    sums = _sums(edges, ["dst"], "state", width).select(F.col("dst").alias("_at"), "_sum")
    met = nodes.select(F.col(key).alias("_k"), F.col(features).cast("array<double>").alias("_f")).join(sums, F.col("_k") == F.col("_at"), "left")
    return dense(met.select("_k", "_f", F.coalesce("_sum", _zeros(width)).alias("_sum")), ["_f", "_sum"], layers, "state", ["_k"]).withColumnRenamed("_k", key)


def pooled(states: DataFrame, by: str, width: int, how: str = "mean") -> DataFrame:
    """(by, state): mean, sum or greatest of the node states of each graph."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return states.groupBy(by).agg(*(f(F.element_at("state", i + 1)).alias(f"_s{i}") for i in range(width))).select(by, F.array(*(f"_s{i}" for i in range(width))).alias("state"))
