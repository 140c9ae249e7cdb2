"""User formulas over channels, translated to Spark columns.

A formula names channels bare (``RPM``) or quoted (``"Engine Speed"``), each
with an optional record shift ``[-1]`` or time shift ``@-0.1s``, and may use
per-log statistics such as ``_mean_RPM``.  Arithmetic follows floating-point
rules throughout (a division by zero is an infinity inside the expression); a
final result that is not finite becomes 0.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, channel_columns, finite_or_zero, is_finite, not_nan
from telemetra.operators.layout import CHUNK_ROWS
from telemetra.operators.nearest import time_shift
from telemetra.operators.series import index_shift
from telemetra.session import settle

# The reference syntax, the reserved words, the statistic prefixes.
SHIFT = r"(?:\[([+-]?\d+)\]|@([+-]?\d+\.?\d*)s)?"
REFERENCE = re.compile(r'"([^"]+)"' + SHIFT + r"|([a-zA-Z_][a-zA-Z0-9_]*)" + SHIFT)
RESERVED = (
    "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "asinh",
    "acosh", "atanh", "sqrt", "abs", "exp", "ln", "log", "log2", "log10", "floor", "ceil",
    "round", "trunc", "fract", "signum", "max", "min", "pi", "e", "tau", "phi",
)
STATISTICS = ("mean", "stdev", "min", "max", "range")


class FormulaError(ValueError):
    """The formula is empty, names unknown channels, or does not parse."""


@dataclass(frozen=True)
class Reference:
    """One channel use: a shift of 0 records or seconds is the record itself."""

    name: str
    records: int = 0
    seconds: float | None = None


@dataclass(frozen=True)
class Formula:
    text: str
    tree: ast.expr
    references: dict[str, Reference]  # placeholder -> reference
    statistics: dict[str, str]  # placeholder -> statistic variable

    def channel_names(self) -> list[str]:
        return _names(self.references)


def _names(references: dict[str, Reference]) -> list[str]:
    return list(dict.fromkeys(r.name for r in references.values()))


def _inf() -> Column:
    return F.lit(float("inf"))


def _nan() -> Column:
    return F.lit(float("nan"))


def _divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), a * _inf())


def _remainder(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_mod(a, b), _nan())


def _logarithm(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(fn(x), F.when(x == 0, -_inf()).otherwise(_nan()))


def _whole(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Beyond 2^52 a double has no fraction left to drop."""
    return lambda x: F.when(F.abs(x) < float(1 << 52), fn(x).cast("double")).otherwise(x)


def _trunc(x: Column) -> Column:
    return F.when(x < 0, _whole(F.ceil)(x)).otherwise(_whole(F.floor)(x))


def _signum(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def _extreme(pick, empty: float) -> Callable[..., Column]:
    def fold(*xs: Column) -> Column:
        clean = [not_nan(x) for x in xs]
        return F.coalesce(pick(*clean) if len(clean) > 1 else clean[0], F.lit(empty))

    return fold


CONSTANTS = {"pi": math.pi, "e": math.e, "tau": 2 * math.pi, "phi": (1 + math.sqrt(5)) / 2}
UNARY: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh,
    "atanh": F.atanh, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp,
    "ln": _logarithm(F.ln), "log": _logarithm(F.log10), "log2": _logarithm(F.log2),
    "log10": _logarithm(F.log10), "floor": _whole(F.floor), "ceil": _whole(F.ceil),
    "round": lambda x: F.round(x), "trunc": _trunc, "fract": lambda x: x - _trunc(x),
    "signum": _signum,
}
VARIADIC = {
    "max": _extreme(F.greatest, float("-inf")),
    "min": _extreme(F.least, float("inf")),
}
OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: _divide,
    ast.Mod: _remainder,
    ast.Pow: F.pow,
}


def variable_name(channel: str) -> str:
    """Channel name as used after a statistic prefix (``_mean_Engine_Speed``)."""
    name = "".join(c if c.isalnum() else "_" for c in channel)
    return f"v_{name}" if not name or name[0].isnumeric() else name


def _statistic_of(word: str) -> tuple[str, str] | None:
    for s in STATISTICS:
        if word.startswith(f"_{s}_"):
            return s, word[len(s) + 2 :]
    return None


def _scan(text: str) -> tuple[str, dict[str, Reference], dict[str, str]]:
    """The text with its references replaced by placeholders, and both tables."""
    if not text.strip():
        raise FormulaError("the formula is blank")
    references: dict[str, Reference] = {}
    statistics: dict[str, str] = {}

    def keep(table: dict, letter: str, value) -> str:
        for name, known in table.items():
            if known == value:
                return name
        name = f"__{letter}{len(table)}"
        table[name] = value
        return name

    def place(m: re.Match) -> str:
        quoted, qk, qs, bare, bk, bs = m.groups()
        if bare is not None:
            if bare.lower() in RESERVED:
                return m.group(0)
            if _statistic_of(m.group(0)):
                return keep(statistics, "s", m.group(0))
        k, s = (qk, qs) if quoted is not None else (bk, bs)
        ref = Reference(
            quoted if quoted is not None else bare,
            int(k) if k is not None else 0,
            float(s) if s is not None else None,
        )
        return keep(references, "r", ref)

    return REFERENCE.sub(place, text), references, statistics


def parse(text: str) -> Formula:
    """Split off the channel references and hand the rest to Python's own parser.

    ``^`` binds tighter than a leading minus and groups to the right.
    """
    body, references, statistics = _scan(text)
    if "**" in body:
        raise FormulaError("Parse error: unknown operator **")
    try:
        tree = ast.parse(body.replace("^", "**").strip(), mode="eval").body
    except SyntaxError as err:
        raise FormulaError(f"Parse error: {err.msg}") from None
    formula = Formula(text, tree, references, statistics)
    _check(tree, formula)
    return formula


def _check(node: ast.expr, formula: Formula) -> None:
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        _check(node.left, formula)
        _check(node.right, formula)
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        _check(node.operand, formula)
    elif isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return
    elif isinstance(node, ast.Name):
        known = (formula.references, formula.statistics, CONSTANTS)
        if not any(node.id in k for k in known):
            raise FormulaError(f"Parse error: unknown name {node.id}")
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        name, count = node.func.id, len(node.args)
        if name in UNARY:
            good = count == 1
        elif name == "atan2":
            good = count == 2
        elif name in VARIADIC:
            good = count >= 1
        else:
            raise FormulaError(f"Parse error: unknown function {name}")
        if not good:
            raise FormulaError(f"Parse error: wrong number of arguments for {name}")
        for a in node.args:
            _check(a, formula)
    else:
        raise FormulaError("Parse error: unsupported syntax")


def _column(node: ast.expr, values: dict[str, Column]) -> Column:
    if isinstance(node, ast.BinOp):
        return OPERATORS[type(node.op)](_column(node.left, values), _column(node.right, values))
    if isinstance(node, ast.UnaryOp):
        inner = _column(node.operand, values)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        return values[node.id] if node.id in values else F.lit(CONSTANTS[node.id])
    args = [_column(a, values) for a in node.args]
    if node.func.id == "atan2":
        return F.atan2(*args)
    if node.func.id in VARIADIC:
        return VARIADIC[node.func.id](*args)
    return UNARY[node.func.id](*args)


def find_channel(name: str, available: Sequence[str]) -> str | None:
    """First channel of that name, whatever the case."""
    for c in available:
        if c.lower() == name.lower():
            return c
    return None


def check(text: str, available: Sequence[str]) -> Formula:
    """Parse and verify all channels and statistics; raises FormulaError."""
    missing = [n for n in _names(_scan(text)[1]) if find_channel(n, available) is None]
    if missing:
        raise FormulaError(f"no channel named {', '.join(missing)}")
    formula = parse(text)
    known = {variable_name(c) for c in available}
    for word in formula.statistics.values():
        if _statistic_of(word)[1] not in known:
            raise FormulaError(f"no channel for the statistic {word}")
    return formula


def findings(
    channels: DataFrame, formulas: Mapping[str, str], keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """What keeps a log from evaluating a formula: keys, formula, code, detail.

    ``formulas`` maps names to texts, ``channels`` lists log and name.  A pair has
    at most one row, for the first that holds: ``empty``, ``unknown_channels`` (all of
    them, as written), ``parse_error``, ``unknown_statistic`` (the first).
    """
    keys = list(keys)
    asked = []
    for label, text in formulas.items():
        references, statistics, fault = {}, {}, None
        try:
            _, references, statistics = _scan(text)
            parse(text)
        except FormulaError as err:
            fault = str(err)
        wanted = [("channel", n, n.lower()) for n in _names(references)]
        wanted += [("statistic", w, _statistic_of(w)[1]) for w in statistics.values()]
        blank = not text.strip()
        for place, (kind, shown, key) in enumerate(wanted or [("none", None, None)]):
            cells = {"formula": label, "blank": blank, "fault": fault, "place": place,
                     "kind": kind, "shown": shown, "key": key}
            asked.append(F.struct(*[F.lit(v).alias(c) for c, v in cells.items()]))
    if not asked:
        none = F.lit(None).cast("string")
        return channels.select(*keys, *[none.alias(c) for c in ("formula", "code", "detail")]).limit(0)
    pairs = channels.select(*keys).distinct().select(*keys, F.explode(F.array(*asked)).alias("a"))
    word = F.regexp_replace("name", r"[^\p{L}\p{N}]", "_")
    word = F.when(word.rlike(r"^(\p{N}|$)"), F.concat(F.lit("v_"), word)).otherwise(word)
    known = channels.select(*keys, F.lit("channel").alias("kind"), F.lower("name").alias("key")).unionByName(
        channels.select(*keys, F.lit("statistic").alias("kind"), word.alias("key"))
    ).distinct()
    met = pairs.select(*keys, "a.*").join(known.withColumn("known", F.lit(True)), [*keys, "kind", "key"], "left")

    def missing(kind: str) -> Column:
        lacks = F.col("known").isNull() & (F.col("kind") == kind)
        found = F.collect_list(F.when(lacks, F.struct("place", "shown")))  # of one formula
        return F.transform(F.array_sort(found), lambda m: m["shown"])

    each = met.groupBy(*keys, "formula", "blank", "fault").agg(
        missing("channel").alias("lost"), missing("statistic").alias("odd")
    )
    ways = [
        (F.col("blank"), "empty", F.lit("")),
        (F.size("lost") > 0, "unknown_channels", F.array_join("lost", ", ")),
        (F.col("fault").isNotNull(), "parse_error", F.col("fault")),
        (F.size("odd") > 0, "unknown_statistic", F.get("odd", F.lit(0))),
    ]
    code = F.coalesce(*[F.when(when, F.lit(name)) for when, name, _ in ways])
    detail = F.coalesce(*[F.when(when, text) for when, _, text in ways])
    return each.select(*keys, "formula", code.alias("code"), detail.alias("detail")).filter("code IS NOT NULL")


def _cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def evaluate(
    records: DataFrame,
    text: str,
    out: str = "formula",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Add the formula's value per record.

    Record shifts become halo windows, time shifts nearest-record lookups (one
    per distinct shift), statistics one aggregate over the named channels only.
    """
    available = list(channels or channel_columns(records))
    formula = check(text, available)
    # Names Spark would read as paths get plain stand-ins while shifts run.
    keep = records.columns
    plain_name = {
        c: c if re.fullmatch(r"\w+", c) else f"__c{i}" for i, c in enumerate(keep)
    }
    records = records.select(*[_cell(c).alias(n) for c, n in plain_name.items()])
    work = records

    plain: dict[str, Column] = {}
    by_index: dict[str, tuple[str, int]] = {}
    by_time: dict[float, dict[str, str]] = {}
    for mark, ref in formula.references.items():
        channel = plain_name[find_channel(ref.name, available)]
        if ref.seconds is not None:
            by_time.setdefault(ref.seconds, {})[mark] = channel
        elif ref.records:
            by_index[mark] = (channel, ref.records)
        else:
            plain[mark] = F.coalesce(F.col(channel).cast("double"), F.lit(0.0))
    if by_index:
        work = index_shift(work, by_index, keys, rows)
    for seconds, wanted in by_time.items():
        work = time_shift(records, wanted, seconds, keys, rows, onto=work)
    if formula.statistics:
        work = work.join(_statistics(records, formula, available, plain_name, keys), list(keys))
    shifted = [*by_index, *(m for wanted in by_time.values() for m in wanted)]
    values = {
        **plain,
        **{m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in shifted},
        **{m: F.col(m) for m in formula.statistics},
    }
    result = finite_or_zero(_column(formula.tree, values))
    done = work.withColumn("__out", result)
    return done.select(
        *[F.col(n).alias(c) for c, n in plain_name.items() if c != out], F.col("__out").alias(out)
    )


def _statistics(
    records: DataFrame,
    formula: Formula,
    available: Sequence[str],
    plain_name: dict[str, str],
    keys: Sequence[str],
) -> DataFrame:
    by_name = {variable_name(c): plain_name[c] for c in reversed(available)}
    aggs = []
    for mark, word in formula.statistics.items():
        kind, name = _statistic_of(word)
        v = F.col(by_name[name]).cast("double")
        v = F.when(is_finite(v), v)
        value = {
            "mean": F.avg(v),
            "stdev": F.stddev_pop(v),
            "min": F.min(v),
            "max": F.max(v),
            "range": F.max(v) - F.min(v),
        }[kind]
        aggs.append(F.coalesce(value, F.lit(0.0)).alias(mark))
    return settle(records.groupBy(*keys).agg(*aggs))


def preview(
    records: DataFrame, text: str, count: int = 100, out: str = "formula", **options
) -> DataFrame:
    """The formula's first ``count`` values of every log."""
    return evaluate(records, text, out, **options).filter(F.col(IDX) < count)


def bind(channels: DataFrame, text: str, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Which channel of which log each reference means.

    ``channels`` lists log, channel_idx, name.  Gives log, reference,
    channel_idx; a reference a log cannot resolve has a NULL channel_idx, so
    one lacking log does not stop the others.
    """
    names = parse(text).channel_names()
    asked = channels.select(*keys).distinct().withColumn(
        "reference", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    found = (
        channels.withColumn("_key", F.lower("name"))
        .groupBy(*keys, "_key")
        .agg(F.min("channel_idx").alias("channel_idx"))
    )
    return (
        asked.withColumn("_key", F.lower("reference"))
        .join(found, [*keys, "_key"], "left")
        .drop("_key")
    )


@dataclass(frozen=True)
class Template:
    name: str
    formula: str
    unit: str
    category: str


# The built-in formulas.
TEMPLATES = tuple(
    Template(*row)
    for row in (
        ("RPM Delta", "RPM - RPM[-1]", "RPM/sample", "Rate"),
        ("TPS Rate", "(TPS - TPS@-0.1s) * 10", "%/s", "Rate"),
        ("Boost Rate", "(MAP - MAP@-0.1s) * 10", "kPa/s", "Rate"),
        ("AFR Deviation", "(AFR - 14.7) / 14.7 * 100", "%", "Engine"),
        ("Lambda", "AFR / 14.7", "λ", "Engine"),
        ("Load Estimate", "MAP / 101.325 * 100", "%", "Engine"),
        ("RPM Smoothed", "(RPM + RPM[-1] + RPM[-2]) / 3", "RPM", "Smoothing"),
        ("RPM Z-Score", "(RPM - _mean_RPM) / _stdev_RPM", "σ", "Anomaly"),
        ("AFR Z-Score", "(AFR - _mean_AFR) / _stdev_AFR", "σ", "Anomaly"),
        ("MAP Z-Score", "(MAP - _mean_MAP) / _stdev_MAP", "σ", "Anomaly"),
    )
)


def template(name: str) -> Template:
    for t in TEMPLATES:
        if t.name == name:
            return t
    raise KeyError(name)


def apply_template(records: DataFrame, name: str, out: str | None = None, **options) -> DataFrame:
    """Add a built-in formula as a channel named after it."""
    t = template(name)
    return evaluate(records, t.formula, out or t.name, **options)
