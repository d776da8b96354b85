"""The whole batch job: raw files to features, models, scores and reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import day_summary, aggregate
from ..models.calibrate import IsotonicMap, fit_isotonic
from ..models.classify import SequenceMonitor, classify, fit_instability_classifier, fit_sequence_monitor
from ..models.quantile import QuantileBoost, conformal_bounds, fit_quantile_boost
from ..operators.asof import asof_join
from ..operators.layout import POS, OrderedRows
from ..operators.resample import asof_interpolated
from ..settings import DEFAULTS, MODEL_FEATURES
from ..sources import readers, sinks, validate
from ..storage import stage
from .evaluate import evaluate, score
from .features import build_features, decide

# What a published version depends on besides its inputs; raise it when the logic changes.
LOGIC = "1"
WEATHER = ["temperature", "precipitation", "rain", "snowfall", "wind_speed", "wind_gusts", "solar_radiation"]


@dataclass(frozen=True)
class Periods:
    """Half-open ranges: training up to ``calibration``, calibration up to ``test``, test up to ``end``.

    The calibration rows are kept out of the training rows.
    """

    calibration: str
    test: str
    end: str

    def train_rows(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("timestamp") < F.to_timestamp(F.lit(self.calibration)))

    def calibration_rows(self, df: DataFrame) -> DataFrame:
        return _within(df, self.calibration, self.test)

    def test_rows(self, df: DataFrame) -> DataFrame:
        return _within(df, self.test, self.end)


def _within(df: DataFrame, start: str, end: str) -> DataFrame:
    at = F.col("timestamp")
    return df.where((at >= F.to_timestamp(F.lit(start))) & (at < F.to_timestamp(F.lit(end))))


def sources(
    spark: SparkSession, paths: Mapping[str, str], start: str, end: str, *, fmt: str = "parquet"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The three raw series of whole days, and one report on their types and ranges.

    Weather goes one sample beyond the last day, which its last hour leans on.
    """
    raw = {
        "frequency": readers.read_frequency(spark, paths["frequency"], start, end, fmt),
        "weather": readers.read_weather(spark, paths["weather"], start, end, fmt, beyond_hours=1),
        "inertia": readers.read_daily(spark, paths["inertia"], start, end, fmt),
    }
    expected = {
        "frequency": {"timestamp": "timestamp", "grid_frequency": "double"},
        "weather": {"timestamp": "timestamp"} | dict.fromkeys(WEATHER, "double"),
        "inertia": {"timestamp": "timestamp", "inertia_cost": "bigint"},
    }
    checks = {"frequency": validate.FREQUENCY_CHECKS, "weather": validate.WEATHER_CHECKS, "inertia": validate.COST_CHECKS}
    checked, reports = {}, []
    for name, df in raw.items():
        checked[name], schema, ranges = validate.validate(df, expected[name], checks[name])
        reports.append(schema.join(ranges, "column_name", "left").withColumn("source", F.lit(name)))
    return checked, readers.union_parts(reports)


def build(
    spark: SparkSession, paths: Mapping[str, str], start: str, end: str, *, fmt: str = "parquet", settings=DEFAULTS
) -> OrderedRows:
    """Read, check, merge and derive features for one grid."""
    return merge(sources(spark, paths, start, end, fmt=fmt)[0], settings=settings)


def merge(raw: Mapping[str, DataFrame], *, settings=DEFAULTS) -> OrderedRows:
    """Features for one grid from its sources.

    Weather is placed on the line between its samples at each fast row, daily
    values are carried on, and rows still incomplete are dropped.
    """
    fast, weather, daily = raw["frequency"], raw["weather"], raw["inertia"]
    merged = asof_interpolated(fast, weather, "timestamp", WEATHER)
    merged = asof_join(merged, daily, "timestamp").dropna().withColumn("series", F.lit("grid"))
    return build_features(merged, ["series"], ["timestamp"], settings=settings)


def fit_bounds(
    table: DataFrame, periods: Periods, *, rounds: int = 20, depth: int = 5, learning_rate: float = 0.1
) -> tuple[QuantileBoost, QuantileBoost]:
    shape = dict(rounds=rounds, depth=depth, learning_rate=learning_rate)
    train = periods.train_rows(table)
    lower, upper = (fit_quantile_boost(train, MODEL_FEATURES, "target_freq_next", a, **shape) for a in DEFAULTS.alphas)
    return lower, upper


def predictor(bounds: tuple[QuantileBoost, QuantileBoost]):
    return lambda df: bounds[1].transform(bounds[0].transform(df, "lower"), "upper")


@dataclass(frozen=True)
class Pipeline:
    """Everything that turns features into decisions: what ``run`` fits and ``load`` finds again."""

    bounds: tuple[QuantileBoost, QuantileBoost]
    monitor: GBTClassificationModel
    sequence: SequenceMonitor
    shifts: tuple[float, float] | None = None
    calibrators: tuple[IsotonicMap, ...] | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in zip(("lower", "upper"), self.bounds):
            model.save(spark, f"{path}/{name}")
        self.monitor.write().overwrite().save(f"{path}/monitor")
        self.sequence.save(spark, f"{path}/sequence")
        for i, model in enumerate(self.calibrators or ()):
            model.save(spark, f"{path}/isotonic/{i}")
        # Written last: a folder with it holds a complete pipeline.
        row = (list(self.shifts) if self.shifts else None, len(self.calibrators or ()))
        spark.createDataFrame([row], _PIPELINE).write.mode("overwrite").json(f"{path}/pipeline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        """The pipeline saved in ``path``, or the one published there last."""
        path = sinks.newest(spark, path) or path
        row = spark.read.schema(_PIPELINE).json(f"{path}/pipeline").first()
        bounds = tuple(QuantileBoost.load(spark, f"{path}/{name}") for name in ("lower", "upper"))
        maps = tuple(IsotonicMap.load(spark, f"{path}/isotonic/{i}") for i in range(row.calibrators))
        monitor = GBTClassificationModel.load(f"{path}/monitor")
        sequence = SequenceMonitor.load(spark, f"{path}/sequence")
        return cls(bounds, monitor, sequence, tuple(row.shifts) if row.shifts else None, maps or None)

    def decisions(self, table: DataFrame) -> DataFrame:
        scored = score(table, predictor(self.bounds), shifts=self.shifts, calibrators=self.calibrators)
        return decide(classify(self.monitor, scored, MODEL_FEATURES)).withColumn("day", F.to_date("timestamp"))


_PIPELINE = "shifts array<double>, calibrators int"


def reports(decisions: DataFrame, target: str = "target_freq_next") -> dict[str, DataFrame]:
    return {
        "metrics": evaluate(decisions, target),
        "metrics_by_day": evaluate(decisions, target, by=["day"], min_rows=10),
        "days": aggregate(decisions, day_summary("grid_frequency", DEFAULTS.unstable_low), ["day"]),
    }


def score_saved(
    spark: SparkSession,
    models: str,
    paths: Mapping[str, str],
    start: str,
    end: str,
    period: tuple[str, str] | None = None,
    *,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Decisions, reports and sequence scores of another date range by a pipeline saved by ``run``."""
    pipeline = Pipeline.load(spark, models)
    built = build(spark, paths, start, end, fmt=fmt)
    table = stage(built.df, "features")
    chosen = _within(table, *period) if period else table
    decisions = stage(pipeline.decisions(chosen), "decisions")
    sequence = pipeline.sequence.transform(built.with_df(table), "sequence_probability")
    sequence = (_within(sequence, *period) if period else sequence).select("series", "timestamp", "sequence_probability")
    return {"features": table, "decisions": decisions, "sequence": sequence, **reports(decisions)}


def run(
    spark: SparkSession,
    paths: Mapping[str, str],
    out: str,
    start: str,
    end: str,
    periods: Periods,
    *,
    recalibrate: str = "shift",
    fmt: str = "parquet",
    rounds: int = 20,
    depth: int = 5,
    learning_rate: float = 0.1,
    reuse: bool = True,
) -> dict[str, DataFrame]:
    """Run the job and return its tables; features, models and results are published under ``out``.

    Each of the three is a version named by all that decides it (paths, range, periods, settings
    and ``LOGIC``). One that is there is read instead of computed, so a second run computes
    nothing, and other periods on the same range reuse the features. ``reuse=False`` makes new
    ones, for raw files that changed under their paths. A run that fails leaves the versions
    before it as they were.
    """
    made = {"paths": dict(paths), "start": start, "end": end, "fmt": fmt, "logic": LOGIC}
    fitted = {**made, "periods": asdict(periods), "recalibrate": recalibrate, "rounds": rounds, "depth": depth, "rate": learning_rate}
    data = sinks.published(
        spark, f"{out}/features", sinks.content_key(**made), lambda path: _write_features(spark, paths, path, start, end, fmt), reuse=reuse
    )
    table = spark.read.parquet(f"{data}/table")
    total = (table.agg(F.max(POS)).first()[0] or 0) + 1
    built = OrderedRows(table.drop("day"), ("series",), ("timestamp",), total)

    def fit(path: str) -> None:
        shape = {"rounds": rounds, "depth": depth, "learning_rate": learning_rate}
        fit_pipeline(spark, built, periods, recalibrate, **shape).save(spark, path)

    models = sinks.published(spark, f"{out}/models", sinks.content_key(**fitted), fit, reuse=reuse)
    pipeline = Pipeline.load(spark, models)

    def write(path: str) -> None:
        decisions = pipeline.decisions(periods.test_rows(built.df)).drop(POS)
        sinks.write_partitioned(decisions.repartitionByRange("day", "series", "timestamp"), f"{path}/decisions", ["day"])
        warnings = pipeline.sequence.transform(built, "sequence_probability").select("series", "timestamp", "sequence_probability")
        periods.test_rows(warnings).write.mode("overwrite").parquet(f"{path}/sequence")
        sinks.write_csv_slice(built.df.drop(POS), f"{out}/test_slice", "timestamp", periods.test, periods.end)

    results = sinks.published(spark, f"{out}/results", sinks.content_key(**fitted), write, reuse=reuse)
    decisions = spark.read.parquet(f"{results}/decisions")
    importances = zip(*(m.importances() for m in pipeline.bounds))
    return {
        "features": table.drop(POS),
        "validation": spark.read.parquet(f"{data}/validation"),
        "decisions": decisions,
        "sequence": spark.read.parquet(f"{results}/sequence"),
        **reports(decisions),
        "importance": spark.createDataFrame([(f, a, b) for (f, a), (_, b) in importances], "feature string, lower_pct double, upper_pct double"),
    }


def _write_features(spark: SparkSession, paths: Mapping[str, str], path: str, start: str, end: str, fmt: str) -> None:
    raw, validation = sources(spark, paths, start, end, fmt=fmt)
    validation.write.mode("overwrite").parquet(f"{path}/validation")
    days = merge(raw).df.withColumn("day", F.to_date("timestamp"))
    # In time order, so that files hold few days each and period filters skip the others.
    sinks.write_partitioned(days.repartitionByRange("day", "series", "timestamp").sortWithinPartitions("series", "timestamp"), f"{path}/table", ["day"])


def fit_pipeline(
    spark: SparkSession, built: OrderedRows, periods: Periods, recalibrate: str = "shift", *, rounds: int = 20, depth: int = 5, learning_rate: float = 0.1
) -> Pipeline:
    """Bounds, their recalibration and both monitors, fitted on the training and calibration rows."""
    table, target = built.df, "target_freq_next"
    bounds = fit_bounds(table, periods, rounds=rounds, depth=depth, learning_rate=learning_rate)
    held = stage(predictor(bounds)(periods.calibration_rows(table)), "calibration")
    shifts = maps = None
    if recalibrate == "isotonic":
        maps = tuple(fit_isotonic(held, q, target) for q in ("lower", "upper"))
    elif recalibrate == "shift":
        shifts = conformal_bounds(held, target, ("lower", "upper"), DEFAULTS.alphas)
    monitor = fit_instability_classifier(
        periods.train_rows(table), MODEL_FEATURES, "target_is_unstable", rounds=rounds, depth=depth
    )
    in_train = F.col("timestamp") < F.to_timestamp(F.lit(periods.calibration))
    sequence = fit_sequence_monitor(built, in_train, MODEL_FEATURES, "target_is_unstable")
    return Pipeline(bounds, monitor, sequence, shifts, maps)
