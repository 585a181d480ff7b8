"""K-means on vectors, and what is chosen or split by cluster: centres are few and known to every task, rows stay put.

Rows without vector are left out; ties go to the least cluster and key; fewer rows than clusters give a cluster a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import DISTANCES
from tesserae.operators.split import draw


def _assigned(rows: DataFrame, vector: str, centres: np.ndarray, metric: str) -> DataFrame:
    """``rows`` with _at: (distance, cluster) of the nearest centre. The centres are a table of one row."""
    known = rows.sparkSession.createDataFrame([(centres.tolist(),)], "_known array<array<double>>")
    near = F.array_min(F.transform("_known", lambda c, i: F.named_struct(F.lit("distance"), DISTANCES[metric](F.col(vector), c), F.lit("cluster"), i)))
    return rows.join(F.broadcast(known), how="inner").withColumn("_at", near).drop("_known")


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(key, vector, cluster, distance) and the centres: Lloyd's rounds from k rows drawn by a hash of their key.

    A round is one aggregate of k times the vector's length sums; it ends early when no centre moves.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(key, vector)
    first = rows.orderBy(draw(F.col(key), seed), key).limit(k).select(vector).collect()
    centres = np.array([list(r[0]) for r in first], np.float64)
    for _ in range(rounds if len(centres) else 0):
        # assigned below the explode, once a row
        near = _assigned(rows, vector, centres, "euclidean").select(F.col("_at.cluster").alias("cluster"), F.posexplode(vector).alias("i", "x"))
        found = near.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
        moved = centres.copy()
        for r in found:
            moved[r["cluster"], r["i"]] = r["m"]
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    if not len(centres):
        return rows.select(key, vector, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), centres
    return _assigned(rows, vector, centres, "euclidean").select(key, vector, "_at.cluster", "_at.distance"), centres


def pick(df: DataFrame, key: str, vector: str, k: int, mode: str = "medoid", score: str | None = None, rounds: int = 10, seed: int = 0) -> DataFrame:
    """A row of each cluster: (key, cluster, distance): the one nearest the centre, a random one, or the best by a score."""
    found, _ = kmeans(df, key, vector, k, rounds, seed)
    if mode == "best":
        found = found.join(df.select(key, F.col(score).alias("_score")), key)
        order = F.struct(-F.col("_score"), F.col(key))
    else:
        order = F.struct(F.col("distance") if mode == "medoid" else draw(F.col(key), seed + 1), F.col(key))
    return found.groupBy("cluster").agg(F.min_by(F.struct(key, "distance"), order).alias("x")).select(F.col(f"x.{key}").alias(key), "cluster", "x.distance")


def split(df: DataFrame, key: str, vector: str, k: int = 10, test: float = 0.2, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """(key, cluster, split): whole clusters go to test, then to validation, in hash order until each has its share."""
    found, _ = kmeans(df, key, vector, k, seed=seed)
    sizes = sorted(found.groupBy("cluster").count().collect(), key=lambda r: np.random.default_rng([seed, r["cluster"]]).random())
    total, named, seen = sum(r["count"] for r in sizes), {}, {"test": 0, "valid": 0}
    for r in sizes:
        for name, share in (("test", test), ("valid", valid)):
            if seen[name] + r["count"] <= share * total:
                named[r["cluster"]], seen[name] = name, seen[name] + r["count"]
                break
        else:
            named[r["cluster"]] = "train"
    part = F.element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), F.col("cluster")) if named else F.lit("train")
    return found.select(key, "cluster", part.alias("split"))
