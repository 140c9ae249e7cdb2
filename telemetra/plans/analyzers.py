"""Named analyses over records: one registry, one result shape.

An analysis is declared by its channels, settings and minimum length; its
``run`` adds a series and a per-log summary.  Logs that lack a channel or are
too short are reported in ``findings`` and left out, so one of them does not
stop the job for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, channel_columns
from telemetra.functions import engine
from telemetra.functions.formula import find_channel
from telemetra.operators import recurrence, series, stats
from telemetra.operators.layout import CHUNK_ROWS, log_sizes
from telemetra.session import constant_table, settle

VALUE = "value"


@dataclass(frozen=True)
class Outcome:
    """``values`` (log, idx, t, value), ``summary`` (a row per log), ``findings``
    (log, code, amount); ``algorithm`` is the analyzer's id, ``parameters`` its
    settings as used, channel names resolved."""

    name: str
    unit: str
    values: DataFrame
    summary: DataFrame
    findings: DataFrame
    algorithm: str = ""
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Job:
    """What ``run`` gets: the usable records and the settings."""

    records: DataFrame
    settings: Mapping[str, Any]
    rows: int

    def __getitem__(self, name: str) -> Any:
        return self.settings[name]


@dataclass(frozen=True)
class Analyzer:
    """``run(job)`` returns (series frame, summary frame, [(code, when, amount)])."""

    id: str
    name: str
    category: str
    defaults: Mapping[str, Any]
    channels: tuple[str, ...]  # names of the settings that hold channel names
    run: Callable[[Job], tuple[DataFrame, DataFrame, list[tuple[str, Column, Column]]]]
    title: Callable[[Mapping[str, Any]], str]
    unit: str | Callable[[Mapping[str, Any]], str] = ""
    min_records: Callable[[Mapping[str, Any]], int] = field(default=lambda s: 2)
    check: Callable[[Mapping[str, Any]], str | None] = field(default=lambda s: None)

    def settings(self, **given: Any) -> dict[str, Any]:
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return {**self.defaults, **given}

    def unit_of(self, settings: Mapping[str, Any]) -> str:
        return self.unit if isinstance(self.unit, str) else self.unit(settings)

    def required(self, settings: Mapping[str, Any]) -> list[str]:
        return [settings[c] for c in self.channels]


def _none(df: DataFrame) -> DataFrame:
    return df.select(LOG).distinct()


def _r(*pairs: tuple[str, Column, Column]) -> list[tuple[str, Column, Column]]:
    return list(pairs)


def _moving_average(job):
    out = series.moving_average(job.records, job["channel"], job["window_size"], VALUE, rows=job.rows)
    return out, _none(job.records), _r()


def _ema(job):
    got = recurrence.exponential_moving_average(
        job.records, job["channel"], job["alpha"], VALUE, rows=job.rows, keep=(T,)
    )
    return got, _none(job.records), _r()


def _median(job):
    out = series.median_filter(job.records, job["channel"], job["window_size"], VALUE, rows=job.rows)
    window = job["window_size"] + 1 - job["window_size"] % 2
    widened = F.lit(window != job["window_size"])
    return out, _none(job.records).withColumn("window", F.lit(window)), _r(
        ("window_widened", widened, F.lit(float(window)))
    )


def _butterworth(high):
    def run(job):
        got = recurrence.butterworth_filtfilt(
            job.records, job["channel"], job["cutoff_normalized"], job["order"], high, VALUE,
            rows=job.rows, keep=(T,),
        )
        step = F.max(F.when(F.col(IDX) == 1, F.col(T))) - F.max(F.when(F.col(IDX) == 0, F.col(T)))
        hertz = F.lit(float(job["cutoff_normalized"])) / F.greatest(step, F.lit(0.001))
        summary = job.records.filter(F.col(IDX) < 2).groupBy(LOG).agg(hertz.alias("cutoff_hz"))
        return got, summary, _r(
            ("high_order", F.lit(not high and job["order"] > 4), F.lit(float(job["order"])))
        )

    return run


def _describe(job):
    s = stats.describe(job.records, job["channel"], rows=job.rows)
    out = series.z_score(job.records, job["channel"], VALUE)
    return out, s, _r(("high_variability", F.col("cv") > 50.0, F.col("cv")))


def _correlation(job):
    x, y = job["channel_x"], job["channel_y"]
    fit = stats.correlation_labels(stats.linear_fit(job.records, x, y))
    return stats.residuals(job.records, x, y, VALUE), fit, _r(
        ("correlation", F.lit(True), F.col("r"))
    )


def _rate(job):
    derive = series.time_derivative if job["time_based"] else series.sample_derivative
    out = derive(job.records, job["channel"], VALUE, rows=job.rows)
    peak = F.greatest(F.abs("max"), F.abs("min"))
    s = stats.describe(out, VALUE, median=False).withColumn("max_abs_rate", peak)
    return out, s, _r(
        ("extreme_rate", F.col("max_abs_rate") > F.col("stdev") * 5.0, F.col("max_abs_rate"))
    )


def _drift(job):
    got = recurrence.drift_flags(
        job.records, job["channel"], job["k"], job["h"], job["baseline_pct"], VALUE, rows=job.rows,
        keep=(T,),
    )
    base = stats.baseline(job.records, job["channel"], job["baseline_pct"])
    counts = got.groupBy(LOG).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(VALUE) > 0.5).cast("long")).alias("high"),
        F.sum((F.col(VALUE) < -0.5).cast("long")).alias("low"),
    )
    s = counts.join(base, LOG)
    least = F.floor(F.col("n") / 20)
    return got, s, _r(
        ("positive_drift", F.col("high") > least, 100.0 * F.col("high") / F.col("n")),
        ("negative_drift", F.col("low") > least, 100.0 * F.col("low") / F.col("n")),
    )


def _zones(job):
    value = F.col(job["channel"])
    kind = engine.mixture_units(job.records, job["channel"])
    rich, lean = engine.zone_limits(
        F.col("mixture"), job["target"], job["rich_threshold"], job["lean_threshold"]
    )
    out = job.records.join(kind, LOG).withColumn(VALUE, engine.zone(value, rich, lean))

    def share(hit):
        return 100.0 * F.avg(hit.cast("double"))

    zone = F.col(VALUE)
    s = out.groupBy(LOG, "mixture").agg(
        share(zone < -0.5).alias("rich_pct"), share(F.abs(zone) < 0.5).alias("stoich_pct"),
        share(zone > 0.5).alias("lean_pct"),
    )
    s = s.withColumns(
        {"target": engine.target_of(F.col("mixture"), job["target"]), "rich_limit": rich,
         "lean_limit": lean}
    )
    return out, s, _r(
        ("excessive_rich", F.col("rich_pct") > 30.0, F.col("rich_pct")),
        ("excessive_lean", F.col("lean_pct") > 30.0, F.col("lean_pct")),
    )


def _deviation(job):
    kind = engine.mixture_units(job.records, job["channel"])
    target = engine.target_of(F.col("mixture"), job["target"])
    out = job.records.join(kind, LOG).withColumn(
        VALUE, engine.deviation_percent(F.col(job["channel"]), target)
    )
    s = stats.describe(out, VALUE, (LOG, "mixture"), median=False)
    return out, s, _r(
        ("lean_bias", F.col("mean") > 5.0, F.col("mean")),
        ("rich_bias", F.col("mean") < -5.0, F.col("mean")),
        ("unsteady_mixture", F.col("stdev") > 10.0, F.col("stdev")),
    )


def _efficiency(job):
    rpm, pressure, intake = (F.col(job[c]) for c in ("rpm_channel", "map_channel", "iat_channel"))
    value = engine.volumetric_efficiency(rpm, pressure, intake, job["is_iat_kelvin"])
    out = job.records.withColumn(VALUE, value)
    s = stats.describe(out, VALUE, median=False)
    return out, s, _r(
        ("very_high_efficiency", F.col("max") > 150.0, F.col("max")),
        ("very_low_efficiency", (F.col("min") < 20.0) & (F.col("min") > 0.0), F.col("min")),
    )


def _duty(job):
    value = engine.injector_duty(F.col(job["pulse_width_channel"]), F.col(job["rpm_channel"]))
    out = job.records.withColumn(VALUE, value)
    v = F.col(VALUE)
    s = out.groupBy(LOG).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"),
        F.sum((v > 80.0).cast("long")).alias("above_80"),
        F.sum((v > 95.0).cast("long")).alias("above_95"),
        F.sum((v >= 100.0).cast("long")).alias("at_100"),
    )
    full, high = F.col("at_100") > 0, F.col("above_95") > 0

    def pct(c):
        return 100.0 * F.col(c) / F.col("n")

    return out, s, _r(
        ("duty_at_limit", full, pct("at_100")),
        ("duty_above_95", ~full & high, pct("above_95")),
        ("duty_above_80", ~full & ~high & (F.col("above_80") > F.floor(F.col("n") / 10)), pct("above_80")),
    )


def _lambda(job):
    out = job.records.withColumn(
        VALUE, engine.lambda_of(F.col(job["afr_channel"]), job["stoich_afr"])
    )
    s = stats.describe(out, VALUE, median=False)
    return out, s, _r(
        ("very_rich", F.col("min") < 0.7, F.col("min")),
        ("very_lean", F.col("max") > 1.3, F.col("max")),
    )


def _filter_check(s):
    if not 0.0 < s["cutoff_normalized"] < 0.5:
        return "Cutoff must be between 0 and 0.5"
    return None if 1 <= s["order"] <= 8 else "Order must be between 1 and 8"


def _builtin() -> list[Analyzer]:
    one = ("channel",)
    cut = {"channel": "RPM", "cutoff_normalized": 0.1, "order": 2}
    return [
        Analyzer(
            "moving_average", "Moving Average", "Filters", {"channel": "RPM", "window_size": 5}, one,
            _moving_average, lambda s: f"{s['channel']} (MA{s['window_size']})",
            min_records=lambda s: s["window_size"],
        ),
        Analyzer(
            "exponential_moving_average", "Exponential Moving Average", "Filters",
            {"channel": "RPM", "alpha": 0.2}, one, _ema,
            lambda s: f"{s['channel']} (EMA α={s['alpha']:.2f})",
            check=lambda s: None if 0.0 < s["alpha"] <= 1.0 else "Alpha must be between 0 and 1",
        ),
        Analyzer(
            "median_filter", "Median Filter", "Filters", {"channel": "RPM", "window_size": 5}, one,
            _median,
            lambda s: f"{s['channel']} (Median{s['window_size'] + 1 - s['window_size'] % 2})",
            min_records=lambda s: s["window_size"],
        ),
        Analyzer(
            "butterworth_lowpass", "Butterworth Lowpass", "Filters", cut, one, _butterworth(False),
            lambda s: f"{s['channel']} (Butter{s['order']})", min_records=lambda s: 10,
            check=_filter_check,
        ),
        Analyzer(
            "butterworth_highpass", "Butterworth Highpass", "Filters",
            {**cut, "cutoff_normalized": 0.05}, one,
            _butterworth(True), lambda s: f"{s['channel']} (HP{s['order']})",
            min_records=lambda s: 10, check=_filter_check,
        ),
        Analyzer(
            "descriptive_stats", "Descriptive Statistics", "Statistics", {"channel": "RPM"}, one,
            _describe, lambda s: f"{s['channel']} Z-Score", "σ",
        ),
        Analyzer(
            "correlation", "Channel Correlation", "Statistics",
            {"channel_x": "RPM", "channel_y": "MAP"}, ("channel_x", "channel_y"), _correlation,
            lambda s: f"{s['channel_x']} vs {s['channel_y']} Residuals",
            min_records=lambda s: 3,
        ),
        Analyzer(
            "rate_of_change", "Rate of Change", "Statistics",
            {"channel": "RPM", "time_based": True}, one, _rate, lambda s: f"d({s['channel']})/dt",
            lambda s: "/s" if s["time_based"] else "/sample",
        ),
        Analyzer(
            "fuel_trim_drift", "Fuel Trim Drift Detection", "AFR",
            {"channel": "LTFT", "k": 2.5, "h": 20.0, "baseline_pct": 10.0}, one, _drift,
            lambda s: f"{s['channel']} Drift", "drift", min_records=lambda s: 100,
        ),
        Analyzer(
            "rich_lean_zone", "Rich/Lean Zone Detection", "AFR",
            {"channel": "AFR", "target": 0.0, "rich_threshold": 0.0, "lean_threshold": 0.0}, one,
            _zones, lambda s: f"{s['channel']} Zone", "zone", min_records=lambda s: 10,
        ),
        Analyzer(
            "afr_deviation", "AFR/Lambda Deviation %", "AFR", {"channel": "AFR", "target": 0.0}, one,
            _deviation, lambda s: f"{s['channel']} Deviation", "%",
        ),
        Analyzer(
            "volumetric_efficiency", "Volumetric Efficiency", "Derived",
            {"rpm_channel": "RPM", "map_channel": "MAP", "iat_channel": "IAT",
             "displacement_l": 2.0, "is_iat_kelvin": False},
            ("rpm_channel", "map_channel", "iat_channel"), _efficiency,
            lambda s: "Volumetric Efficiency", "%",
            check=lambda s: None if s["displacement_l"] > 0 else "Displacement must be positive",
        ),
        Analyzer(
            "injector_duty_cycle", "Injector Duty Cycle", "Derived",
            {"pulse_width_channel": "IPW", "rpm_channel": "RPM"},
            ("pulse_width_channel", "rpm_channel"), _duty, lambda s: "Injector Duty Cycle", "%",
        ),
        Analyzer(
            "lambda_calculator", "Lambda Calculator", "Derived",
            {"afr_channel": "AFR", "stoich_afr": 14.7}, ("afr_channel",), _lambda,
            lambda s: "Lambda", "λ",
            check=lambda s: None if s["stoich_afr"] > 0 else "Stoichiometric AFR must be positive",
        ),
    ]


class Registry:
    """The built-in analyses plus whatever is registered."""

    def __init__(self) -> None:
        self._known: dict[str, Analyzer] = {a.id: a for a in _builtin()}

    def register(self, analyzer: Analyzer) -> None:
        self._known[analyzer.id] = analyzer

    def all(self) -> list[Analyzer]:
        return list(self._known.values())

    def find(self, analyzer_id: str) -> Analyzer | None:
        return self._known.get(analyzer_id)

    def by_category(self) -> dict[str, list[Analyzer]]:
        out: dict[str, list[Analyzer]] = {}
        for a in self._known.values():
            out.setdefault(a.category, []).append(a)
        return out

    def available(self, channels: DataFrame, keys: Sequence[str] = (LOG,)) -> DataFrame:
        """Which analyses have all their default channels in which log.

        ``channels`` (log_id, name) is the channel dictionary, so the names
        gathered per log are few.
        """
        spark = channels.sparkSession
        needs = constant_table(
            spark,
            [(a.id, sorted({n.lower() for n in a.required(a.defaults)})) for a in self.all()],
            analyzer=pa.string(),
            _needs=pa.list_(pa.string()),
        )
        wanted = needs.select("analyzer", F.explode("_needs").alias("_name"), F.size("_needs").alias("_n"))
        have = channels.select(*keys, F.lower("name").alias("_name")).distinct()
        return (
            have.join(F.broadcast(wanted), "_name")
            .groupBy(*keys, "analyzer", "_n")
            .agg(F.count(F.lit(1)).alias("_found"))
            .filter(F.col("_found") == F.col("_n"))
            .select(*keys, "analyzer")
        )

    def run(
        self, analyzer_id: str, records: DataFrame, rows: int = CHUNK_ROWS, **given: Any
    ) -> Outcome:
        """Run one analysis over all logs of a records frame.

        A bad setting raises ValueError.  A channel no log has, a channel a log
        lacks and a log that is too short become findings.
        """
        analyzer = self._known[analyzer_id]
        settings = analyzer.settings(**given)
        problem = analyzer.check(settings)
        if problem:
            raise ValueError(problem)
        names = channel_columns(records)
        resolved = dict(settings)
        absent = []
        for c in analyzer.channels:
            found = find_channel(settings[c], names)
            if found is None:
                absent.append(settings[c])
            else:
                resolved[c] = found
        logs = records.select(LOG).distinct()
        if absent:
            findings = logs.select(
                LOG,
                F.explode(F.array(*[F.lit(f"missing_channel:{n}") for n in absent])).alias("code"),
                F.lit(0.0).alias("amount"),
            )
            empty = records.filter(F.lit(False)).select(LOG, IDX, T, F.lit(0.0).alias(VALUE))
            return Outcome(analyzer.title(settings), analyzer.unit_of(settings), empty, logs.limit(0),
                           findings, analyzer.id, settings)

        columns = [resolved[c] for c in analyzer.channels]
        present = [F.count(c).alias(f"_has_{i}") for i, c in enumerate(columns)]
        facts = settle(records.groupBy(LOG).agg(F.count(F.lit(1)).alias("_size"), *present))
        least = analyzer.min_records(settings)
        early = facts.select(
            LOG,
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.when(
                                F.col(f"_has_{i}") == 0, F.lit(f"missing_channel:{settings[c]}")
                            ).alias("code"),
                            F.lit(0.0).alias("amount"),
                        )
                        for i, c in enumerate(analyzer.channels)
                    ],
                    F.struct(
                        F.when(F.col("_size") < least, F.lit(f"too_few_records:{least}")).alias("code"),
                        F.col("_size").cast("double").alias("amount"),
                    ),
                )
            ).alias("_f"),
        ).select(LOG, "_f.code", "_f.amount").filter(F.col("code").isNotNull())

        good = F.col("_size") >= least
        for i in range(len(columns)):
            good = good & (F.col(f"_has_{i}") > 0)
        usable = facts.filter(good).select(LOG)
        work = records.join(usable, LOG, "left_semi")
        if "n" not in records.columns:
            work = work.join(log_sizes(records), LOG)
        values, summary, warnings = analyzer.run(Job(work, resolved, rows))
        findings = early
        for code, when, amount in warnings:
            findings = findings.unionByName(
                summary.filter(when).select(
                    LOG, F.lit(code).alias("code"), amount.cast("double").alias("amount")
                )
            )
        return Outcome(
            analyzer.title(settings), analyzer.unit_of(settings),
            values.select(LOG, IDX, T, VALUE), summary, findings, analyzer.id, dict(resolved),
        )
