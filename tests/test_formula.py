"""Formula front end, units, engine arithmetic, analyses."""

import math

import pytest
from pyspark.sql import functions as F

from telemetra.functions import engine, formula, units
from telemetra.plans.analyzers import Registry


def values(rec, text, log_id="a", **options):
    got = formula.evaluate(rec, text, "out", **options)
    return [r.out for r in got.filter(got.log_id == log_id).orderBy("idx").collect()]


def test_shift_pins(logs):
    rpm = logs({"a": {"RPM": [1000, 2000, 3000]}})
    assert values(rpm, "RPM - RPM[-1]") == [0, 1000, 1000]
    assert values(rpm, "RPM[+1] - RPM") == [1000, 1000, 0]
    assert values(rpm, "RPM[-1] + RPM[+1]") == [3000, 4000, 5000]
    x = logs({"a": {"X": [100, 200, 300, 400, 500]}})
    assert values(x, "X - X@-0.1s") == [0, 100, 100, 100, 100]
    assert values(x, "X@-0.1s + X@+0.1s") == [300, 400, 600, 800, 900]
    three = logs({"a": {"X": [1, 2, 3]}})
    assert values(three, "X[-100]") == [1, 1, 1]
    assert values(three, "X[+100]") == [3, 3, 3]
    one = logs({"a": {"X": [42]}})
    assert values(one, "X * 2") == [84]
    assert values(one, "X - X[-1]") == [0]


def test_floating_point_rules(logs):
    x = logs({"a": {"X": [0, 1]}})
    assert values(x, "1/X") == [0, 1]
    assert values(x, "5 + 1/(1/X)") == [5, 6]
    assert values(x, "ln(X) + 1") == [0, 1]
    assert values(x, "sqrt(0 - X)") == [0, 0]
    assert values(x, "exp(ln(X))") == [0, 1]
    assert values(x, "max(1/X, 3)") == [0, 3]
    assert values(x, "min(1/X, 3)") == [3, 1]
    assert values(x, "X % 0") == [0, 0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("-2 ^ 2", -4), ("2 ^ 3 ^ 2", 512), ("2 ^ -1", 0.5), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9),
        ("7 % 4", 3), ("-7 % 4", -3), ("round(-2.5)", -3), ("round(2.5)", 3), ("trunc(-2.7)", -2),
        ("fract(2.75)", 0.75), ("signum(0)", 1), ("signum(-3)", -1), ("floor(-0.5)", -1),
        ("ceil(0.2)", 1), ("max(1, 2, 3)", 3), ("min(4)", 4), ("log10(1000)", 3), ("log2(8)", 3),
        ("atan2(0, 1)", 0), ("tau / pi", 2), ("e", math.e), ("phi", (1 + 5**0.5) / 2),
        ("abs(-3) + +2", 5),
    ],
)
def test_arithmetic(logs, text, want):
    assert math.isclose(values(logs({"a": {"X": [1]}}), text + " + 0 * X")[0], want, abs_tol=1e-12)


def test_quoted_and_case(logs):
    rec = logs({"a": {"Engine Speed": [1, 2], "tps": [3, 4]}})
    assert values(rec, '"engine speed" + TPS') == [4, 6]
    assert values(rec, '"Engine Speed"[-1] * 2') == [2, 2]
    assert values(rec, "tps - _mean_tps") == [-0.5, 0.5]
    assert values(rec, '"Engine Speed" / _max_Engine_Speed') == [0.5, 1.0]


def test_missing_cells_count_as_zero(logs):
    assert values(logs({"a": {"X": [None, 2]}}), "X + 1") == [1, 3]


@pytest.mark.parametrize(
    "text,message",
    [
        ("  ", "blank"), ("A + B", "no channel named A, B"), ("X +", "Parse error"),
        ("X ** 2", "Parse error"), ("foo(X)", "no channel named foo"), ("sin(X, X)", "Parse error"),
        ("1e3 + X", "no channel named e3"), ("X + _mean_Nope", "no channel for the statistic"),
        ("X > 1", "Parse error"), ("X if X else 1", "no channel named"), ("X.real", "no channel named"),
    ],
)
def test_validation(text, message):
    with pytest.raises(formula.FormulaError, match=message):
        formula.check(text, ["X"])


def test_statistics_are_population_and_constant_gives_zero(logs):
    rec = logs({"a": {"RPM": [1, 3]}, "b": {"RPM": [5, 5]}})
    out = formula.apply_template(rec, "RPM Z-Score", "z")
    got = {(r.log_id, r.idx): r.z for r in out.collect()}
    assert got == {("a", 0): -1.0, ("a", 1): 1.0, ("b", 0): 0.0, ("b", 1): 0.0}


def test_templates_listed():
    assert len(formula.TEMPLATES) == 10
    for t in formula.TEMPLATES:
        formula.check(t.formula, ["RPM", "TPS", "MAP", "AFR"])


def test_binding_reports_missing(spark):
    channels = spark.createDataFrame(
        [("a", 0, "RPM"), ("a", 1, "rpm"), ("b", 0, "Other")], "log_id string, channel_idx int, name string"
    )
    got = {(r.log_id, r.reference): r.channel_idx for r in formula.bind(channels, "Rpm + 1").collect()}
    assert got == {("a", "Rpm"): 0, ("b", "Rpm"): None}


def test_unit_pins(spark):
    rows = [("K", "°C", 273.15, 0.0), ("K", "°F", 373.15, 212.0), ("kPa", "PSI", 100.0, 14.5038),
            ("kPa", "bar", 100.0, 1.0), ("km/h", "mph", 100.0, 62.1371), ("km", "mi", 100.0, 62.1371),
            ("L/100km", "mpg", 10.0, 23.5215), ("L/100km", "km/L", 10.0, 10.0), ("L/100km", "mpg", 0.0, 0.0),
            ("L", "gal", 10.0, 2.64172), ("cc/min", "lb/hr", 453.592, 45.0), ("m/s²", "g", 9.80665, 1.0),
            ("RPM", "RPM", 5.0, 5.0)]
    for source, target, value, want in rows:
        got = spark.range(1).select(units.convert_column(F.lit(value), source, target)).first()[0]
        assert math.isclose(got, want, abs_tol=1e-9), (source, target)
    df = spark.createDataFrame([(300.0, "K"), (5.0, "Hz"), (7.0, "")], "value double, unit string")
    got = units.legend(units.convert(df).withColumn("name", F.lit("n"))).collect()
    assert {r.legend for r in got} == {"n: 26.85 °C", "n: 5.00 Hz", "n: 7.00"}
    with pytest.raises(ValueError):
        units.conversion_table(spark, {"speed": "knots"})


@pytest.mark.parametrize(
    "seconds,want",
    [(0.5, "0.500s"), (65.25, "1:05.250"), (3725.5, "1:02:05.500"), (-65.25, "-1:05.250"), (59.0, "59.000s")],
)
def test_format_time(spark, seconds, want):
    assert spark.range(1).select(units.format_time(F.lit(seconds))).first()[0] == want


def test_engine_pins(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    duty = engine.injector_duty
    assert value(duty(F.lit(10.0), F.lit(6000.0))) == 50
    assert value(duty(F.lit(10.0), F.lit(7200.0))) == 60
    assert value(duty(F.lit(15.0), F.lit(8000.0))) == 100
    assert value(duty(F.lit(90.0), F.lit(8000.0))) == 100
    assert value(duty(F.lit(10.0), F.lit(0.0))) == 0
    ve = engine.volumetric_efficiency
    assert abs(value(ve(F.lit(3000.0), F.lit(101.325), F.lit(25.0))) - 100) < 1
    assert value(ve(F.lit(3000.0), F.lit(101.325), F.lit(298.0), True)) == 100
    assert value(ve(F.lit(0.0), F.lit(101.325), F.lit(25.0))) == 0
    assert value(ve(F.lit(3000.0), F.lit(101.325), F.lit(-300.0))) == 0
    assert value(ve(F.lit(3000.0), F.lit(-5.0), F.lit(25.0))) == 0
    assert value(engine.deviation_percent(F.lit(15.435), F.lit(14.7))) == pytest.approx(5.0)


def test_mixture_detection_and_zones(logs):
    rec = logs({"a": {"x": [14.5, 14.7, 14.9, 15.0, 14.2, 14.8]}, "b": {"x": [0.95, 1.0, 1.02, 0.98, 1.05, 0.97]}})
    assert {r.log_id: r.mixture for r in engine.mixture_units(rec, "x").collect()} == {"a": "afr", "b": "lambda"}
    # One custom width alone does not count.
    rich, lean = engine.zone_limits(F.lit("afr"), 0.0, 2.0, 0.0)
    assert rec.limit(1).select(rich, lean).first()[:] == (14.2, 15.2)


def test_registry_shape(logs):
    r = Registry()
    assert len(r.all()) == 14
    assert {k: len(v) for k, v in r.by_category().items()} == {"Filters": 5, "Statistics": 3, "AFR": 3, "Derived": 3}
    assert r.find("lambda_calculator").name == "Lambda Calculator" and r.find("nope") is None
    rec = logs({"a": {"RPM": range(20)}})
    with pytest.raises(ValueError):
        r.run("butterworth_lowpass", rec, order=9)
    with pytest.raises(ValueError):
        r.run("exponential_moving_average", rec, alpha=0.0)
    with pytest.raises(ValueError):
        r.run("moving_average", rec, bogus=1)


@pytest.mark.parametrize("name", [a.id for a in Registry().all()])
def test_every_analysis_runs_and_reports(logs, name):
    n = 120
    base = {
        "RPM": [1000 + 7 * i for i in range(n)], "MAP": [50 + i % 40 for i in range(n)],
        "LTFT": [0.0] * 60 + [15.0] * 60, "AFR": [14.7 + (i % 5) / 10 for i in range(n)],
        "IAT": [25.0] * n, "IPW": [5 + i / 10 for i in range(n)],
    }
    short = {k: v[:1] for k, v in base.items()}
    gone = {k: [None] * n for k in base}
    got = Registry().run(name, logs({"a": base, "short": short, "gone": gone}))
    counts = {r.log_id: r["count"] for r in got.values.groupBy("log_id").count().collect()}
    assert counts == {"a": n}
    codes = {(r.log_id, r.code.split(":")[0]) for r in got.findings.collect()}
    assert ("short", "too_few_records") in codes and ("gone", "missing_channel") in codes
    assert got.values.filter(F.col("value").isNull()).count() == 0
    if name == "fuel_trim_drift":
        assert ("a", "positive_drift") in codes


def test_template_names_with_dots(logs):
    assert values(logs({"a": {"a.b": [1, 2]}}), '"a.b" * 2') == [2, 4]


def test_fixed_text_rounds_the_binary_value(spark):
    values = [1.005, 0.125, 0.375, 2.675, -0.125, 1234567.891, 0.0]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.text for r in table.select(units.fixed_text(F.col("v"), 2).alias("text")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_findings_per_log(spark):
    rows = [("a", "X"), ("a", "Engine Speed"), ("a", "2nd"), ("b", "Y")]
    channels = spark.createDataFrame(rows, "log_id string, name string")
    texts = {
        "good": "x + 1", "mean": "X - _mean_Engine_Speed - _max_v_2nd", "blank": " ",
        "lost": "X * y + z", "power": "X ** 2", "odd": "X + _min_Nope + _max_Nope", "number": "1 + 1",
    }
    got = {(r.log_id, r.formula): (r.code, r.detail) for r in formula.findings(channels, texts).collect()}
    assert got == {
        ("a", "blank"): ("empty", ""), ("b", "blank"): ("empty", ""),
        ("a", "lost"): ("unknown_channels", "y, z"), ("b", "lost"): ("unknown_channels", "X, z"),
        ("a", "power"): ("parse_error", "Parse error: unknown operator **"),
        ("a", "odd"): ("unknown_statistic", "_min_Nope"),
        **{("b", f): ("unknown_channels", "X") for f in ("mean", "power", "odd")},
        ("b", "good"): ("unknown_channels", "x"),
    }
    assert formula.findings(channels, {}).count() == 0
    assert formula.findings(channels.limit(0), texts).count() == 0
