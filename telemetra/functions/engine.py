"""Air-fuel and engine arithmetic as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.frame import LOG
from telemetra.operators.stats import exact_median
from telemetra.session import settle

# Stoichiometric points, default zone widths, reference conditions.
STOICH_AFR = 14.7
STOICH_LAMBDA = 1.0
AFR_ZONE = 0.5
LAMBDA_ZONE = 0.03
LAMBDA_BELOW_MEDIAN = 3.0
REFERENCE_PRESSURE_KPA = 101.325
REFERENCE_TEMPERATURE_K = 298.0


def mixture_units(df: DataFrame, value: str, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Per log: ``mixture`` 'lambda' if the median is under 3, else 'afr'."""
    kind = F.when(F.col("median") < LAMBDA_BELOW_MEDIAN, "lambda").otherwise("afr")
    return settle(exact_median(df, value, keys).select(*keys, kind.alias("mixture")))


def stoichiometric(mixture: Column) -> Column:
    return F.when(mixture == "lambda", F.lit(STOICH_LAMBDA)).otherwise(F.lit(STOICH_AFR))


def to_afr(value: Column, mixture: Column) -> Column:
    return F.when(mixture == "lambda", value * STOICH_AFR).otherwise(value)


def lambda_of(afr: Column, stoich: float = STOICH_AFR) -> Column:
    if stoich <= 0:
        raise ValueError("the stoichiometric ratio must be positive")
    return afr / F.lit(float(stoich))


def target_of(mixture: Column, target: float = 0.0) -> Column:
    """The given target, or the stoichiometric point of the detected unit."""
    return F.lit(float(target)) if target > 0 else stoichiometric(mixture)


def zone_limits(
    mixture: Column, target: float = 0.0, rich: float = 0.0, lean: float = 0.0
) -> tuple[Column, Column]:
    """(rich limit, lean limit); custom widths count only if both are given."""
    aim = target_of(mixture, target)
    if rich > 0 and lean > 0:
        return aim - F.lit(float(rich)), aim + F.lit(float(lean))
    width = F.when(mixture == "lambda", F.lit(LAMBDA_ZONE)).otherwise(F.lit(AFR_ZONE))
    return aim - width, aim + width


def zone(value: Column, rich_limit: Column, lean_limit: Column) -> Column:
    return (
        F.when(value < rich_limit, F.lit(-1.0)).when(value > lean_limit, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def deviation_percent(value: Column, target: Column) -> Column:
    return (value - target) / target * F.lit(100.0)


def volumetric_efficiency(
    rpm: Column, pressure: Column, intake: Column, kelvin: bool = False
) -> Column:
    """Percent of a standard-condition charge; 0 for a stopped engine."""
    warm = intake if kelvin else intake + F.lit(273.15)
    share = (pressure / F.lit(REFERENCE_PRESSURE_KPA)) * F.try_divide(
        F.lit(REFERENCE_TEMPERATURE_K), warm
    )
    return F.when((rpm <= 0) | (warm <= 0), F.lit(0.0)).otherwise(
        F.greatest(share * F.lit(100.0), F.lit(0.0))
    )


def injector_duty(pulse_ms: Column, rpm: Column) -> Column:
    """Percent of the four-stroke cycle, held within 0..100."""
    duty = pulse_ms * rpm / F.lit(1200.0)
    return F.when(rpm <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.least(duty, F.lit(100.0)), F.lit(0.0))
    )
