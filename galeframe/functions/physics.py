"""Scalar physics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.config import KELVIN, R_DRY, RHO_STD
from galeframe.functions.nullsafe import clip, col


def air_density(pressure_hpa: str | Column, temperature_c: str | Column, gas_constant: float = R_DRY) -> Column:
    """Dry-air density in kg/m3."""
    return col(pressure_hpa) * 100.0 / (F.lit(gas_constant) * (col(temperature_c) + KELVIN))


def density_corrected_wind(ws: str | Column, rho: str | Column) -> Column:
    return col(ws) * F.pow(col(rho) / RHO_STD, F.lit(1.0 / 3.0))


def power_density(ws: str | Column, rho: str | Column) -> Column:
    return col(rho) * 0.5 * F.pow(col(ws), F.lit(3.0))


def rotor_equivalent_wind(ws80: str | Column, ws120: str | Column, ws180: str | Column) -> Column:
    cubes = (F.pow(col(ws80), F.lit(3.0)) + F.pow(col(ws120), F.lit(3.0)) + F.pow(col(ws180), F.lit(3.0))) / 3.0
    return F.pow(clip(cubes, 0.0), F.lit(1.0 / 3.0))


def shear_exponent(ws_low: str | Column, ws_high: str | Column, h_low: float = 10.0, h_high: float = 120.0) -> Column:
    ratio = clip(clip(ws_high, 0.1) / clip(ws_low, 0.1), 0.1, 10.0)
    return clip(F.ln(ratio) / math.log(h_high / h_low), -0.3, 0.7)


def power_law(ws: str | Column, h_from: float, h_to: float, alpha: float) -> Column:
    """Wind moved from one height to another with a constant shear exponent."""
    return col(ws) * (h_to / h_from) ** alpha


def cube(x: str | Column) -> Column:
    return F.pow(col(x), F.lit(3.0))


def square(x: str | Column) -> Column:
    return col(x) * col(x)
