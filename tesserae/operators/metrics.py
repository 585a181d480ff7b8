"""Evaluation metrics as aggregates: regression, classification, ranking, many tasks; null pairs are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ratio
from tesserae.operators.ordered import average_ranks, running

#: Fixed value: metrics of which more is better.
HIGHER_IS_BETTER = ("r2", "accuracy", "f1", "roc_auc", "spearman", "kendall")


def _pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())


def regression_aggregates(y: Column, p: Column, delta: float = 1.0) -> dict[str, Column]:
    """rmse, mae, r2, mape and huber as aggregate expressions, so that any groupBy can use them."""
    e = y - p
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * F.abs(e) - 0.5 * delta * delta)
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": 1 - ratio(F.sum(e * e), F.regr_syy(y, F.lit(1.0))),
        "mape": 100 * F.avg(F.abs(e / (y + 1e-10))),
        "huber": F.avg(huber),
    }


def regression(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, rmse, mae, r2, mape and huber, in all or by group."""
    made = regression_aggregates(F.col(y), F.col(p))
    return _pairs(df, y, p).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in made.items()))


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks."""
    ranked = average_ranks(average_ranks(_pairs(df, y, p).select(y, p), y, "_ry"), p, "_rp")
    return ranked.agg(F.corr("_ry", "_rp").alias("spearman"))


def kendall_classes(df: DataFrame, y: str, p: str) -> DataFrame:
    """Kendall's tau-b of two columns with few distinct values: from the table of their joint counts.

    Pairs are formed between distinct (y, p) values, so the work grows with the square of those and not of rows;
    ``concordance.kendall`` is for any columns.
    """
    cells = _pairs(df, y, p).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    other = cells.select(F.col("y").alias("y2"), F.col("p").alias("p2"), F.col("n").alias("n2"))
    sign = F.signum(F.col("y") - F.col("y2")) * F.signum(F.col("p") - F.col("p2"))
    tied = lambda c: df_ties(cells, c)
    score = cells.join(other, F.col("y") > F.col("y2")).agg(F.coalesce(F.sum(sign * F.col("n") * F.col("n2")), F.lit(0.0)).alias("s"))
    n = cells.agg(F.sum("n").alias("n"))
    out = score.join(F.broadcast(n), how="inner").join(F.broadcast(tied("y")), how="inner").join(F.broadcast(tied("p")), how="inner")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    return out.select(ratio(F.col("s"), F.sqrt((n0 - F.col("t_y")) * (n0 - F.col("t_p")))).alias("kendall"))


def df_ties(cells: DataFrame, column: str) -> DataFrame:
    """Pairs tied in a column."""
    n = F.col("_n")
    return cells.groupBy(column).agg(F.sum("n").alias("_n")).agg(F.sum(n * (n - 1) / 2).alias(f"t_{column}"))


def classification_aggregates(y: Column, p: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1 and Matthews' coefficient of 0/1 columns as aggregate expressions."""
    tp, fp = F.count_if((y == 1) & (p == 1)).cast("double"), F.count_if((y == 0) & (p == 1)).cast("double")
    fn, tn = F.count_if((y == 1) & (p == 0)).cast("double"), F.count_if((y == 0) & (p == 0)).cast("double")
    none = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": F.coalesce(ratio(tp, tp + fp), none),
        "recall": F.coalesce(ratio(tp, tp + fn), none),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), none),
        "mcc": F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), none),
    }


def classification(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    made = classification_aggregates(F.col(y), F.col(p))
    return _pairs(df, y, p).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in made.items()))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    counted = _pairs(df, y, score).select(F.col(score).alias("score"), (F.col(y) == 1).cast("long").alias("pos"), (F.col(y) != 1).cast("long").alias("neg"))
    return running(counted, "score", ["pos", "neg"], descending=True)


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Mann-Whitney area with half credit for ties; 0.5 if a class is absent."""
    # a positive beats the negatives that score below it, which come after it in falling order
    rows = _by_score(df, y, score).agg(F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return rows.select(F.coalesce(ratio(F.col("_u").cast("double"), F.col("_p").cast("double") * F.col("_n")), F.lit(0.5)).alias("roc_auc"))


def pr_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under precision over recall by trapezoids between distinct scores, from the first score on."""
    rows = _by_score(df, y, score)
    hits, seen = F.col("before_pos") + F.col("pos"), F.col("before_pos") + F.col("before_neg") + F.col("pos") + F.col("neg")
    before = F.col("before_pos") + F.col("before_neg")
    now, last = hits / seen, F.when(before > 0, F.col("before_pos") / before)
    area = F.sum(F.coalesce(F.col("pos") * (now + last) / 2, F.lit(0.0)))
    return rows.agg(area.alias("_a"), F.sum("pos").alias("_p")).select(F.coalesce(ratio(F.col("_a"), F.col("_p").cast("double")), F.lit(0.0)).alias("pr_auc"))


def _head(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def top_k(df: DataFrame, y: str, score: str, key: str, k: int) -> DataFrame:
    """Hits among the k best, hit rate, base rate, enrichment and expected hits; ties go to the least key."""
    base = _pairs(df, y, score).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(y).cast("double")).alias("base_rate"))
    head = _head(_pairs(df, y, score), score, key, k).agg(F.sum(F.col(y).cast("long")).alias("n_hits"), F.avg(F.col(y).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("k"))
    return head.join(F.broadcast(base), how="inner").select("k", "n_hits", "hit_rate", "base_rate", ratio(F.col("hit_rate"), F.col("base_rate")).alias("enrichment"), (F.col("base_rate") * F.col("k")).alias("expected_hits"))


def enrichment_factor(df: DataFrame, y: str, score: str, key: str, fraction: float) -> DataFrame:
    """Hit rate of the best share of rows over the base rate."""
    n = _pairs(df, y, score).count()
    return top_k(df, y, score, key, max(1, int(n * fraction))).select("k", "hit_rate", "base_rate", F.col("enrichment").alias("enrichment_factor"))


def bedroc(df: DataFrame, y: str, score: str, alpha: float = 20.0) -> DataFrame:
    """Early recognition: exponentially weighted ranks of the positives, scaled between the worst and best order.

    Positives and negatives of equal score share the mean rank of their tie.
    """
    rows = _by_score(df, y, score)
    rank = F.col("before_pos") + F.col("before_neg") + (F.col("pos") + F.col("neg") + 1) / 2
    sums = rows.agg(F.sum("pos").alias("p"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    weighted = rows.withColumn("_r", rank).join(F.broadcast(sums), how="inner").agg(F.sum(F.col("pos") * F.exp(-alpha * F.col("_r") / F.col("n"))).alias("s"), F.max("p").alias("p"), F.max("n").alias("n"))
    step = F.exp(-alpha / F.col("n"))
    best = step * (1 - F.exp(-alpha * F.col("p") / F.col("n"))) / (1 - step)
    worst = best * F.exp(-alpha * (F.col("n") - F.col("p")) / F.col("n"))
    return weighted.select(F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), F.lit(0.0)).otherwise((F.col("s") - worst) / (best - worst)).alias("bedroc"))


def gaussian_nll(y: Column, mean: Column, std: Column) -> Column:
    """Mean negative log-likelihood, deviations at least 1e-6."""
    s = F.greatest(std, F.lit(1e-6))
    return F.avg(0.5 * F.log(2 * F.pi() * s * s) + (y - mean) * (y - mean) / (2 * s * s))


def multitask(df: DataFrame, task: str, y: str, p: str) -> DataFrame:
    """Regression metrics of each task and, as task '(all)', their means weighted by rows."""
    each = regression(df, y, p, [task])
    names = ["rmse", "mae", "r2"]
    weighted = [ratio(F.sum(F.col(m) * F.col("n")), F.sum(F.when(F.col(m).isNotNull(), F.col("n")))).alias(m) for m in names]
    return each.select(F.col(task).cast("string").alias("task"), "n", *names).unionByName(each.agg(F.sum("n").alias("n"), *weighted).select(F.lit("(all)").alias("task"), "n", *names))
