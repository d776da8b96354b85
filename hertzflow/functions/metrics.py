"""Metrics as aggregate columns, for use in any ``agg`` or ``groupBy``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import order_rows
from ..storage import group_side


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pinball(y, q, alpha: float) -> Column:
    e = _c(y) - _c(q)
    return F.avg(F.greatest(alpha * e, (alpha - 1) * e))


def interval_coverage(y, lo, hi) -> Column:
    return F.avg(_c(y).between(_c(lo), _c(hi)).cast("double"))


def interval_width(lo, hi) -> Column:
    return F.avg(_c(hi) - _c(lo))


def coverage_below(y, q) -> Column:
    """Share of observations strictly below the prediction."""
    return F.avg((_c(y) < _c(q)).cast("double"))


def mae(y, q) -> Column:
    return F.avg(F.abs(_c(y) - _c(q)))


def rmse(y, q) -> Column:
    e = _c(y) - _c(q)
    return F.sqrt(F.avg(e * e))


def crossing_rate(lo, hi) -> Column:
    return F.avg((_c(lo) > _c(hi)).cast("double"))


def confusion(actual, predicted) -> dict[str, Column]:
    a, p = _c(actual).cast("boolean"), _c(predicted).cast("boolean")
    return {
        "tp": F.count_if(a & p),
        "fp": F.count_if(~a & p),
        "fn": F.count_if(a & ~p),
        "tn": F.count_if(~a & ~p),
    }


def _ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_rates(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    tp, fp, fn, tn = (_c(x).cast("double") for x in (tp, fp, fn, tn))
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": _ratio(tn, tn + fp),
        "fpr": _ratio(fp, fp + tn),
        "fnr": _ratio(fn, fn + tp),
    }


def class_weight(label) -> Column:
    """Negatives per positive; 1 without positives."""
    positive, negative = F.count_if(_c(label) == 1), F.count_if(_c(label) == 0)
    return F.coalesce(negative / F.nullif(positive, F.lit(0)), F.lit(1.0))


def alert_precision(alert, breached) -> dict[str, Column]:
    """Alerts raised, and those whose row really was in breach."""
    return {
        "alerts": F.count_if(_c(alert)),
        "correct_alerts": F.count_if(_c(alert) & _c(breached)),
    }


def day_summary(value: str, threshold: float) -> dict[str, Column]:
    return {
        "min_value": F.min(value),
        "max_value": F.max(value),
        "mean_value": F.avg(value),
        "breach_rows": F.count_if(F.col(value) < threshold),
    }


def interval_metrics(y: str, lo: str, hi: str, alphas: tuple[float, float]) -> dict[str, Column]:
    """The full evaluation of a quantile band as one set of aggregates."""
    return {
        "rows": F.count("*"),
        "pinball_lower": pinball(y, lo, alphas[0]),
        "pinball_upper": pinball(y, hi, alphas[1]),
        "mae_lower": mae(y, lo),
        "mae_upper": mae(y, hi),
        "rmse_lower": rmse(y, lo),
        "rmse_upper": rmse(y, hi),
        "below_lower": coverage_below(y, lo),
        "below_upper": coverage_below(y, hi),
        "picp": interval_coverage(y, lo, hi),
        "mpiw": interval_width(lo, hi),
        "crossing": crossing_rate(lo, hi),
    }


def aggregate(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Apply metrics per group; groups below ``min_rows`` give no row."""
    out = df.groupBy(*by).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in metrics.items()])
    return out.where(F.col("_n") >= min_rows).drop("_n")


def _score_steps(df: DataFrame, label: str, score: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct scores with the positives and negatives at and above each, and the totals.

    Equal scores are merged before anything is ordered, so ties cannot pile up.
    """
    steps = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("_hits"), F.count_if(F.col(label) == 0).alias("_misses")
    )
    ordered = order_rows(steps.withColumn("_rank_key", -F.col(score)), list(by), ["_rank_key"])
    totals = ordered.df.groupBy(*by).agg(F.sum("_hits").alias("_p"), F.sum("_misses").alias("_n"))
    return ordered.running({"_tp": ("sum", F.col("_hits")), "_fp": ("sum", F.col("_misses"))}), totals


def auc_roc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; null for a single class."""
    steps, _ = _score_steps(df, label, score, by)
    # Pairs in which the negative scores higher or equal, from the running counts.
    hits, misses, above = (F.col(c).cast("double") for c in ("_hits", "_misses", "_fp"))
    lost = F.sum(hits * (above - misses) + hits * misses / 2)
    pairs = F.nullif(F.sum(hits) * F.sum(misses), F.lit(0.0))
    return steps.groupBy(*by).agg((1 - lost / pairs).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, highest first."""
    steps, totals = _score_steps(df, label, score, by)
    joined = steps.join(group_side(totals, "score-totals"), list(by)) if by else _with_totals(steps, totals)
    return joined.select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("_fp") / F.nullif("_n", F.lit(0))).alias("fpr"),
        (F.col("_tp") / F.nullif("_p", F.lit(0))).alias("tpr"),
    )


def _with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the single row of a global aggregate to every row."""
    row = totals.first()
    return df.withColumns({c: F.lit(row[c]) for c in totals.columns})


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin includes the maximum."""
    v = F.col(value)
    known = df.where(v.isNotNull()).select(*by, value)
    span = known.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    rows = known.join(group_side(span, "spans"), list(by)) if by else _with_totals(known, span)
    width = (F.col("_high") - F.col("_low")) / bins
    bin_no = F.least(F.lit(bins - 1), F.coalesce(F.floor((v - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(0)))
    out = rows.groupBy(*by, "_low", "_high", bin_no.cast("int").alias("bin")).agg(F.count("*").alias("rows"))
    lower = F.col("_low") + F.col("bin") * (F.col("_high") - F.col("_low")) / bins
    return out.select(*by, "bin", lower.alias("bin_start"), "rows")


def reliability(df: DataFrame, y: str, predictions: Mapping[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Observed share below the prediction for each nominal level, in one pass."""
    levels = sorted(predictions)
    wide = df.groupBy(*by).agg(*[coverage_below(y, predictions[a]).alias(f"_o{i}") for i, a in enumerate(levels)])
    rows = [F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_o{i}").alias("observed")) for i, a in enumerate(levels)]
    return wide.select(*by, F.inline(F.array(*rows)))


def period_comparison(df: DataFrame, period: str, first, second, metrics: Mapping[str, Column]) -> DataFrame:
    """Metrics of two periods side by side with the change in percent, from one pass."""
    per = df.where(F.col(period).isin(first, second)).groupBy(period).agg(*[c.alias(n) for n, c in metrics.items()])
    def of(value, name):
        return F.max(F.when(F.col(period) == value, F.col(name).cast("double")))
    wide = per.agg(*[of(v, n).alias(f"_{i}_{n}") for n in metrics for i, v in enumerate((first, second))])
    rows = []
    for n in metrics:
        a, b = F.col(f"_0_{n}"), F.col(f"_1_{n}")
        rows.append(
            F.struct(
                F.lit(n).alias("metric"),
                a.alias("first"),
                b.alias("second"),
                ((b - a) / F.nullif(a, F.lit(0.0)) * 100).alias("change_pct"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def normalise_by_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """|x| / max |x| per column; 0 where the maximum is 0."""
    peak = df.groupBy(*by).agg(*[F.max(F.abs(c)).alias(f"_max_{c}") for c in columns])
    rows = df.join(group_side(peak, "peaks"), list(by)) if by else _with_totals(df, peak)
    return rows.withColumns(
        {f"{c}_norm": F.coalesce(F.abs(c) / F.nullif(f"_max_{c}", F.lit(0.0)), F.lit(0.0)) for c in columns}
    ).drop(*[f"_max_{c}" for c in columns])


def min_max_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1] with the range of the training rows only."""
    span = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        lo, hi = span[f"lo_{c}"], span[f"hi_{c}"]
        width = (hi - lo) if lo is not None and hi != lo else 1.0
        out[f"{c}_scaled"] = (F.col(c) - F.lit(lo)) / F.lit(width)
    return df.withColumns(out)
