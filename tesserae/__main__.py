"""Command lines over tables: python -m tesserae curate|train|predict|benchmark|learn|suggest --help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import settings, sources
from tesserae.operators import bioisosteres, curate, metrics, models, split, surrogate


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae", description="Structure-activity analytics on Spark.")
    top.add_argument("--config", help="JSON or YAML file of settings; command-line values win")
    does = top.add_subparsers(dest="what", required=True)

    def add(name: str, text: str, *names: str) -> argparse.ArgumentParser:
        one = does.add_parser(name, help=text)
        for n in names:
            one.add_argument(f"--{n}", required=True)
        return one

    add("curate", "keep the first row of each structure and split the rest", "input", "output", "key").add_argument("--test-size", type=float, default=0.15)
    train = add("train", "fit and cross-validate a line", "input", "model", "target", "key", "features")
    train.add_argument("--n-features", type=int)
    add("predict", "score a table with a fitted line", "input", "model", "output")
    add("benchmark", "regression metrics of a table of predictions", "input", "target", "prediction")
    learn = add("learn", "an active-learning campaign against known values", "observed", "pool", "output", "key", "vector", "value")
    learn.add_argument("--rounds", type=int)
    learn.add_argument("--batch-size", type=int)
    add("suggest", "replacements for the fragments of molecules", "input", "output", "key", "fragments")
    return top


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else sources.read_delimited(spark, path)


def run(spark: SparkSession, given: list[str]) -> int:
    """Runs one command; a summary goes to standard output as one JSON line."""
    a = _parser().parse_args(given)
    config = settings.load_config(a.config) if a.config else {}
    if a.what == "curate":
        rows = _read(spark, a.input)
        out = split.random_split(curate.keep_first(rows, [a.key], [a.key]), a.key, train=1 - 2 * a.test_size, valid=a.test_size)
        out.write.mode("errorifexists").parquet(a.output)
        said = {r["split"]: r["count"] for r in spark.read.parquet(a.output).groupBy("split").count().collect()}
    elif a.what == "train":
        c = settings.ModelConfig.from_dict(config)
        rows, names = _read(spark, a.input), a.features.split(",")
        chosen = models.selected(rows, names, a.target, a.n_features or c.n_features)
        scores = models.cross_validated(rows, chosen, a.target, a.key, c.cv_folds, c.ridge, c.seed)
        models.fit(rows, chosen, a.target, c.ridge).save(spark, a.model)
        said = {"features": chosen} | {k: v for k, v in scores.agg(*(F.avg(m).alias(m) for m in ("r2", "mae", "rmse"))).first().asDict().items()}
    elif a.what == "predict":
        models.Linear.load(spark, a.model).predict(_read(spark, a.input)).write.mode("errorifexists").parquet(a.output)
        said = {"rows": spark.read.parquet(a.output).count()}
    elif a.what == "benchmark":
        said = metrics.regression(_read(spark, a.input), a.target, a.prediction).first().asDict()
    elif a.what == "learn":
        c = settings.ActiveLearningConfig.from_dict(config)
        pool = _read(spark, a.pool)
        optimizer = surrogate.BayesianOptimizer(a.key, a.vector, a.value, c.acquisition, c.kernel, c.minimize, c.seed).fit(_read(spark, a.observed))
        picked = surrogate.rounds(optimizer, pool, pool, a.batch_size or c.batch_size, a.rounds or c.n_rounds)
        picked.write.mode("errorifexists").parquet(a.output)
        said = {"picks": picked.count(), "best": optimizer.best()}
    else:
        out = bioisosteres.suggest(_read(spark, a.input), a.key, a.fragments, bioisosteres.rules(spark))
        out.write.mode("errorifexists").parquet(a.output)
        said = {"suggestions": spark.read.parquet(a.output).count()}
    print(json.dumps(said, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("tesserae").getOrCreate(), sys.argv[1:]))
