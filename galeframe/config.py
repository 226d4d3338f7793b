"""Column names and farm constants shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

SITE = "site_id"
TS = "ts"
TARGET = "power_mw"
REPAIR = "n_repair"

# Farm size, reference air and the physical bounds of the feeds.
CAPACITY_MW = 90.09
TOTAL_TURBINES = 26
TURBINE_RATED_MW = 3.465
HUB_HEIGHT_M = 80.0
ROTOR_HUB_M = 85.0
RHO_STD = 1.225
R_DRY = 287.05
R_DRY_PRECISE = 287.058
KELVIN = 273.15

# Weather column names, low level first.
LEVELS = ("10m", "80m", "120m", "180m")
WS_COLS = tuple(f"wind_speed_{h}" for h in LEVELS)
WD_COLS = tuple(f"wind_direction_{h}" for h in LEVELS)
GUST = "wind_gusts_10m"
PRESSURE = "pressure_msl"
PRECIP_COLS = ("rain", "showers", "snowfall")
CLOUD = "cloud_cover_low"


@dataclass(frozen=True)
class FarmConfig:
    """Farm-level parameters; the defaults describe the reference farm."""

    capacity_mw: float = CAPACITY_MW
    total_turbines: int = TOTAL_TURBINES
    turbine_rated_mw: float = TURBINE_RATED_MW
    hub_height_m: float = HUB_HEIGHT_M
    rotor_hub_m: float = ROTOR_HUB_M


DEFAULT = FarmConfig()
