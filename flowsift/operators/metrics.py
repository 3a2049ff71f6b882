"""Model evaluation as aggregations; nothing larger than a threshold table is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.operators.position import BUCKET_ROWS, key_range, prefix_sums
from flowsift.session import written


def _safe(over: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(over, under), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _safe(2 * p * r, p + r)


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(tn, fp, fn, tp) in one pass, zeros included."""
    cell = lambda a, p: F.count_if((F.col(y) == a) & (F.col(pred) == p))
    return df.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _cells() -> tuple[Column, Column, Column, Column]:
    return F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")


def metrics_of(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = _cells()
    p, r = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return cm.select(
        _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return metrics_of(confusion_matrix(df, y, pred))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows Safe, Unsafe, accuracy, macro avg, weighted avg from one confusion matrix."""
    tn, fp, fn, tp = _cells()

    def scores(hit: Column, false_hit: Column, miss: Column) -> dict[str, Column]:
        return {
            "precision": _safe(hit, hit + false_hit),
            "recall": _safe(hit, hit + miss),
            "f1": _safe(2 * hit, 2 * hit + false_hit + miss),
            "support": hit + miss,
        }

    safe, unsafe = scores(tn, fn, fp), scores(tp, fp, fn)
    total = safe["support"] + unsafe["support"]
    accuracy = _safe(tp + tn, total)
    names = ("precision", "recall", "f1")
    macro = {n: (safe[n] + unsafe[n]) / 2 for n in names}
    weighted = {
        n: _safe(safe[n] * safe["support"] + unsafe[n] * unsafe["support"], total) for n in names
    }
    rows = [
        ("Safe", safe, safe["support"]),
        ("Unsafe", unsafe, unsafe["support"]),
        ("accuracy", {n: accuracy for n in names}, total),
        ("macro avg", macro, total),
        ("weighted avg", weighted, total),
    ]
    structs = [
        F.struct(F.lit(name).alias("class"), *[vals[n].alias(n) for n in names], support.alias("support"))
        for name, vals, support in rows
    ]
    return confusion_matrix(df, y, pred).select(F.inline(F.array(*structs)))


def thresholds(start: float = 0.1, step: float = 0.05, n: int = 17) -> list[float]:
    """start, start + step, ... with the step as floating point leaves it after the first one."""
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


def threshold_sweep(
    sc: DataFrame, start: float = 0.1, step: float = 0.05, n: int = 17, y: str = "y", score: str = "score"
) -> DataFrame:
    """(t, precision, recall, f1) for predictions score >= t.

    Rows shrink to at most (n + 1) x 2 counts before the thresholds are met. Every
    threshold has a row, of zeros without input.
    """
    ts = thresholds(start, step, n)
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts), F.lit(0))
    counts = sc.groupBy(passed.alias("passed"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    none = sc.sparkSession.range(1).select(F.lit(0).alias("passed"), F.lit(0).alias("y"), F.lit(0).cast("long").alias("n"))
    counts = counts.unionByName(none)
    at = F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("i", "t")
    positive, caught = F.col("y") == 1, F.col("passed") > F.col("i")
    cells = (
        counts.select("*", at)
        .groupBy("t")
        .agg(
            F.coalesce(F.sum(F.when(positive & caught, F.col("n"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(~positive & caught, F.col("n"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(positive & ~caught, F.col("n"))), F.lit(0)).alias("fn"),
        )
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        "t",
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def ranking_metrics(
    sc: DataFrame, y: str = "y", score: str = "score", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(roc_auc, average_precision): ties count half, precision is summed step-wise.

    Equal scores collapse before anything is ordered; running counts over distinct
    scores are split into key buckets. With one class only both values are 0.
    """
    by_score = sc.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q")
    )
    by_score = written(by_score, "scores")  # read several times below; scoring must run once
    falling = -F.col("s")
    span = key_range(by_score, falling)
    ranked = prefix_sums(
        by_score, falling, {"p_above": F.col("p"), "q_above": F.col("q")}, span, bucket_rows
    )
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    tp, seen = F.col("p_above") + p, F.col("p_above") + F.col("q_above") + p + q
    sums = ranked.agg(
        F.sum(p * tp / seen).alias("ap"),
        F.sum(q * (F.col("p_above") + p / 2)).alias("pairs"),
        F.sum(p).alias("pp"),
        F.sum(q).alias("qq"),
    )
    both = (F.col("pp") > 0) & (F.col("qq") > 0)
    return sums.select(
        F.when(both, F.col("pairs") / (F.col("pp") * F.col("qq"))).otherwise(0.0).alias("roc_auc"),
        F.when(both, F.col("ap") / F.col("pp")).otherwise(0.0).alias("average_precision"),
    )


def anomaly_rate(df: DataFrame, flag: str = "flag") -> DataFrame:
    return df.agg(
        F.count_if(F.col(flag) == 1).alias("flagged"),
        _safe(F.count_if(F.col(flag) == 1), F.count("*")).alias("rate"),
    )
