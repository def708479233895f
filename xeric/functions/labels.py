"""Labels, classes and small scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ONSET = -0.5
SEVENS = ((2.0, "W3"), (1.5, "W2"), (1.0, "W1"))
WARM_MONTHS = (4, 5, 6, 7, 8, 9, 10)


def chain(branches: list[tuple[Column, object]], otherwise: object) -> Column:
    first, *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(*first)).otherwise(otherwise)


def season(date: Column) -> Column:
    """DJF, MAM, JJA or SON; December goes with its own calendar year."""
    m = F.month(date)
    return chain([(m.isin(12, 1, 2), "DJF"), (m <= 5, "MAM"), (m <= 8, "JJA")], "SON")


def water_year(date: Column, first_month: int = 10) -> Column:
    """A water year is named after the calendar year in which it begins."""
    return F.year(date) - (F.month(date) < first_month).cast("int")


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def severity_class(minimum: Column) -> Column:
    return chain([(minimum <= -2.0, "D3"), (minimum <= -1.5, "D2")], "D1")


def seven_classes(z: Column) -> Column:
    """W3, W2, W1, N, D1, D2, D3 by 2, 1.5, 1, -1, -1.5, -2; null stays null."""
    wet = [(z >= cut, name) for cut, name in SEVENS]
    dry = [(z <= -cut, name.replace("W", "D")) for cut, name in SEVENS]
    return F.when(z.isNull(), None).otherwise(chain(wet + dry, "N"))


def supply_class(z: Column) -> Column:
    """Surface supply classes, closed on the right, cut at -4, -3, -2, -1, 0 and 2."""
    cuts = [(-4, "exceptional"), (-3, "extreme"), (-2, "severe"), (-1, "moderate"), (0, "mild"), (2, "normal")]
    return F.when(z.isNull(), None).otherwise(chain([(z <= c, n) for c, n in cuts], "wet"))


def groundwater_class(z: Column) -> Column:
    return F.when(z.isNull(), None).otherwise(chain([(z > 0, "none"), (z >= -1, "mild"), (z >= -1.5, "moderate"), (z >= -2, "severe")], "extreme"))


def duration_class(months: Column, scale: int = 3) -> Column:
    """D3-6, D7-12, D13+; shorter events are below the threshold, or D1-2 at scale 1."""
    return chain([(months >= 13, "D13+"), (months >= 7, "D7-12"), (months >= 3, "D3-6")], "D1-2" if scale == 1 else "sub")


def oscillation_phase(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(chain([(x < -0.5, "Cool"), (x < 0.5, "Neutral")], "Warm"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def day_number_date(code: Column) -> Column:
    """YYYYDDD to a date."""
    return F.date_add(F.make_date((code / 1000).cast("int"), F.lit(1), F.lit(1)), (code % 1000).cast("int") - 1)


#: Coefficients of Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal_quantile_sql(p: str) -> str:
    """The standard normal quantile as SQL that Spark and other engines evaluate alike (relative error 1.2e-9)."""
    r, q = f"(({p}) - 0.5)", f"sqrt(-2.0 * ln({p}))"
    u = f"sqrt(-2.0 * ln(1.0 - ({p})))"
    middle = f"{_horner(ACKLAM_A, f'({r} * {r})')} * {r} / {_horner(ACKLAM_B, f'({r} * {r})')}"
    low = f"{_horner(ACKLAM_C, q)} / {_horner(ACKLAM_D, q)}"
    high = f"-({_horner(ACKLAM_C, u)} / {_horner(ACKLAM_D, u)})"
    return f"CASE WHEN ({p}) IS NULL THEN NULL WHEN ({p}) < 0.02425 THEN {low} WHEN ({p}) <= 0.97575 THEN {middle} ELSE {high} END"


def normal_quantile(column: str) -> Column:
    text = normal_quantile_sql(column)
    import re

    return F.expr(re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)", r"\1D", text))
