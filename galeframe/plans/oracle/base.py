"""Building blocks for the checking SQL."""

from __future__ import annotations

from galeframe.functions.curve import DENSITY_KNOTS, power_rows
from galeframe.sources.derived import FEED_STEPS, FEEDS, HOURLY_COLUMNS, USERS_PER_SITE

_PTS = "CAST(ts AS VARCHAR) AS ts"
KEYS = f"site_id, {_PTS}"

HOURLY = f"""
hourly_g AS (
  SELECT CAST(floor(user_id/{USERS_PER_SITE}.0e0) AS BIGINT) AS site_id, date_trunc('hour', ts) AS ts, max(event_id) AS m
  FROM events GROUP BY 1, 2),
hourly_u AS (SELECT site_id, ts, m, ((m*37)%2500+0.5e0)/2503.0e0 AS u, (m*53)%360 AS d, m%4 AS n_repair FROM hourly_g),
hourly_w AS (SELECT site_id, ts, m, 25.0e0*u*sqrt(u) AS ws120, d, n_repair FROM hourly_u),
hourly AS (SELECT {HOURLY_COLUMNS} FROM hourly_w)"""


def feed_cte(name: str) -> str:
    minutes, cols = FEEDS[name]
    a, b = FEED_STEPS[name]
    return f"""
{name}_g AS (
  SELECT CAST(floor(user_id/{USERS_PER_SITE}.0e0) AS BIGINT) AS site_id,
         date_trunc('hour', ts + INTERVAL {minutes} MINUTE) AS ts, max(event_id) AS m
  FROM events GROUP BY 1, 2),
{name}_w AS (SELECT site_id, ts, m, 25.0e0*u*sqrt(u) AS v, d FROM (
  SELECT site_id, ts, m, ((m*{a})%2500+0.5e0)/2503.0e0 AS u, (m*{b})%360 AS d FROM {name}_g)),
{name} AS (SELECT site_id, ts, {cols} FROM {name}_w)"""


OOF = f"""{HOURLY},
oof AS (SELECT CAST(least(5, 3+floor((day(ts)-1)/10.0e0)) AS BIGINT) AS fold, site_id, ts, power_mw AS target_mw,
  26-n_repair AS active_turbines, wind_speed_120m AS ws_120,
  greatest(0.0e0, least(90.09e0, power_mw+((m%21)-10)*1.2e0*sqrt(((m*29)%2503+0.5e0)/2503.0e0))) AS pred_cf_mw,
  greatest(0.0e0, least(90.09e0, power_mw+((m%17)-8)*1.3e0*sqrt(((m*43)%2503+0.5e0)/2503.0e0))) AS pred_mw_mw FROM hourly)"""

OOF_ORDERS = """
oof_orders AS (SELECT CAST(floor(o_custkey/200.0e0) AS BIGINT) AS site_id, o_orderkey AS row_id, o_orderdate AS ts,
  CAST(year(o_orderdate) AS BIGINT) AS fold, CAST(month(o_orderdate) AS BIGINT) AS month,
  90.09e0*sqrt(o_totalprice/600000.0e0) AS y_pred,
  90.09e0*sqrt(o_totalprice/600000.0e0)*(0.85e0+0.02e0*month(o_orderdate))
    +((o_orderkey%23)-11)*0.37e0+0.1e0*month(o_orderdate) AS y_true,
  25.0e0*sqrt((o_orderkey%1000+0.5e0)/1000.0e0) AS ws_120 FROM orders)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes) + "\n"


def r(expr: str) -> str:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    return f"round(CAST(({expr}) AS DOUBLE), 6)+0.0e0"


def cols(doubles: dict[str, str] | None = None, ints: dict[str, str] | None = None, keys: str = KEYS) -> str:
    parts = [keys] if keys else []
    parts += [f"{r(e)} AS {n}" for n, e in (doubles or {}).items()]
    parts += [f"CAST(({e}) AS BIGINT) AS {n}" for n, e in (ints or {}).items()]
    return ", ".join(parts)


def clip(x: str, lo: str | None = None, hi: str | None = None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {out} END)"


def rho(p: str = "pressure_msl", t: str = "temperature_80m", gas: str = "287.05e0") -> str:
    return f"(({p})*100.0e0/({gas}*(({t})+273.15e0)))"


def cube(x: str) -> str:
    return f"pow({x}, 3.0e0)"


_GRID = "[" + ",".join(f"{v:.1f}e0" for row in power_rows() for v in row) + "]"
_RHO = "[" + ",".join(f"{v}e0" for v in DENSITY_KNOTS) + "]"


def curve_macro(ws: str, density: str) -> str:
    """Bilinear power-table lookup: weighted sum over the table's corners."""
    w = f"least(25.0e0, greatest(3.0e0, ({ws})))"
    wi = f"least(21, CAST(floor({w}) AS INT)-3)"
    d = f"least(1.27e0, greatest(1.06e0, ({density})))"
    di = f"least(8, len(list_filter({_RHO}, lambda k: k <= {d})))"
    wf = f"({w}-({wi}+3))"
    df = f"(({d}-{_RHO}[{di}])/({_RHO}[{di}+1]-{_RHO}[{di}]))"

    def cell(a: int, b: int) -> str:
        return f"{_GRID}[({wi}+{a})*9+{di}+{b}]"

    value = (
        f"({cell(0, 0)}*(1-{df})+{cell(0, 1)}*{df})*(1-{wf})"
        f"+({cell(1, 0)}*(1-{df})+{cell(1, 1)}*{df})*{wf}"
    )
    return (
        f"(CASE WHEN ({ws}) IS NULL OR ({density}) IS NULL THEN NULL"
        f" WHEN ({ws}) < 3 OR ({ws}) > 27 THEN 0.0e0 ELSE {value} END)"
    )


def curve_ctes(source: str, name: str, pairs: dict[str, tuple[str, str]]) -> str:
    """A CTE adding one power column (kW per turbine) per (wind, density) pair."""
    steps = ", ".join(f"{curve_macro(ws, d)} AS {c}" for c, (ws, d) in pairs.items())
    return f"{name} AS (SELECT *, {steps} FROM {source})"


BASE = f"""{HOURLY},
base0 AS (SELECT *, 26-n_repair AS active_turbines, (26-n_repair)/26.0e0 AS active_turbines_ratio,
  {rho()} AS air_density FROM hourly),
base AS (SELECT *, wind_speed_120m*pow(air_density/1.225e0, 1.0e0/3.0e0) AS v_eff FROM base0)"""
