"""Queries over the fitted lookups and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.operators import lookups, weather
from galeframe.plans.frames import added, base, with_feed
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, clip, cols, curve_ctes, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.sources.derived import hourly, oof

TRAIN = "2024-01-24 23:00:00"


def _train():
    return F.col(TS) <= F.lit(TRAIN).cast("timestamp_ntz")


def iso_ctes(name: str, points: str, keys: str = "site_id") -> str:
    """Isotonic fit by the max-min formula over prefix sums of the distinct x of ``points`` (keys, x, y)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_d AS (SELECT {keys}, x, count(*) AS w, sum(y) AS s FROM {points} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {keys}, x),
{name}_p AS (SELECT *, row_number() OVER k AS i, sum(w) OVER k AS cw, sum(s) OVER k AS cs FROM {name}_d WINDOW k AS (PARTITION BY {keys} ORDER BY x)),
{name}_m AS (SELECT {ka}, a.i AS a, b.i AS b, (b.cs-a.cs+a.s)/(b.cw-a.cw+a.w) AS mean FROM {name}_p a JOIN {name}_p b ON {on} AND a.i <= b.i),
{name}_s AS (SELECT *, min(mean) OVER (PARTITION BY {keys}, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM {name}_m),
{name}_f AS (SELECT {keys}, b AS i, max(low) AS fit FROM {name}_s GROUP BY {keys}, b),
{name} AS (SELECT {keys}, x AS kx, greatest(0.0e0, least(90.09e0, fit)) AS ky, cw, lead(x) OVER k AS nx, lead(greatest(0.0e0, least(90.09e0, fit))) OVER k AS ny,
  min(x) OVER (PARTITION BY {keys}) AS x_first FROM {name}_p JOIN {name}_f USING ({keys}, i) WINDOW k AS (PARTITION BY {keys} ORDER BY x))"""


def iso_at(alias: str, x: str) -> str:
    """Value at x from the ASOF-joined knot ``alias`` (its x clamped to the first knot before joining)."""
    return f"CASE WHEN {alias}.nx IS NULL OR {x} <= {alias}.kx THEN {alias}.ky ELSE {alias}.ky+({x}-{alias}.kx)*({alias}.ny-{alias}.ky)/({alias}.nx-{alias}.kx) END"


def iso_lookup(rows: str, name: str, x: str, out: str, keys: str = "site_id") -> str:
    first = f"(SELECT {keys}, min(kx) AS x0 FROM {name} GROUP BY {keys})"
    on = " AND ".join(f"r.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT r.* EXCLUDE (x0, qx), {iso_at('k', 'r.' + x)} AS {out} FROM (
      SELECT q.*, f.x0, greatest(q.{x}, f.x0) AS qx FROM {rows} q LEFT JOIN {first} f USING ({keys})) r
      ASOF LEFT JOIN {name} k ON {on} AND r.qx >= k.kx)"""


_CURVE = f"""t AS (SELECT site_id, power_mw AS y, least(49, CAST(floor(wind_speed_80m/0.5e0) AS INT)) AS b, CAST(floor(wind_direction_80m*1000/45.0e0) AS INT)%8 AS s
   FROM hourly WHERE ts <= TIMESTAMP '{TRAIN}'),
 cells AS (SELECT site_id, b, s, median(y) AS v FROM t GROUP BY 1, 2, 3 HAVING count(*) > 3), bins AS (SELECT site_id, b, median(y) AS v FROM t GROUP BY 1, 2 HAVING count(*) > 5),
 p AS (SELECT site_id, ts, least(49, CAST(floor(wind_speed_80m/0.5e0) AS INT)) AS b, least(7, CAST(floor(wind_direction_80m*1000/45.0e0) AS INT)) AS s FROM hourly)"""


@query("A01_power_curve", with_(HOURLY, _CURVE) + "SELECT " + cols({"power_mw": "v"}, {"ws_bin": "b", "sector": "s"}, keys="site_id") + " FROM cells")
def power_curve(spark, sf):
    fit = lookups.fit_power_curve(hourly(spark, sf), fit_filter=_train())
    return fit["cells"].withColumnRenamed("cell_mw", "power_mw")


@query("J17_lookup_join", with_(HOURLY, _CURVE) + "SELECT " + cols({"p_curve_binned": "least(90.09e0, coalesce(c.v, g.v, 0))"})
       + " FROM p LEFT JOIN cells c USING (site_id, b, s) LEFT JOIN bins g ON p.site_id = g.site_id AND p.b = g.b")
def lookup_join(spark, sf):
    h = hourly(spark, sf)
    return added(h, lookups.apply_power_curve(h, lookups.fit_power_curve(h, fit_filter=_train())))


_TH = with_(BASE, feed_cte("reanalysis"), "j AS (SELECT b.*, e.wind_speed_100m AS e100, e.wind_direction_100m AS ed FROM base b LEFT JOIN reanalysis e USING (site_id, ts))",
    curve_ctes("j", "k", {"k80": ("wind_speed_80m", "air_density"), "k120": ("wind_speed_120m", "air_density"), "ke": ("e100", "air_density")}),
    "th AS (SELECT *, " + ", ".join(f"{clip(f'{k}*active_turbines/1000.0e0', '0.0e0', '90.09e0')} AS {n}" for k, n in (("k80", "m80"), ("k120", "m120"), ("ke", "me"))) + " FROM k)",
    f"""r AS (SELECT site_id, power_mw/m80 AS q, CAST(floor(wind_direction_80m*1000/22.5e0) AS INT)%16 AS s, len(list_filter([4,5,6,7,8,9,10,11,12,14], lambda e: e <= wind_speed_80m)) AS b
      FROM th WHERE power_mw > 0.5 AND m80 > 1 AND ts <= TIMESTAMP '{TRAIN}'),
    rr AS (SELECT * FROM r WHERE q > 0.3 AND q < 1.3),
    wc AS (SELECT site_id, s, b, median(q) AS f FROM rr GROUP BY 1, 2, 3 HAVING count(*) >= 10), ws AS (SELECT site_id, s, median(q) AS f FROM rr GROUP BY 1, 2 HAVING count(*) >= 50),
    wg AS (SELECT site_id, median(q) AS f FROM rr GROUP BY 1)""")


def _theory(spark, sf):
    return weather.curve_power_columns(with_feed(spark, sf, base(spark, sf), "era5"))


@query("A02_wake_factor", _TH + "SELECT " + cols({"factor": "f"}, {"wake_sector": "s", "wake_bin": "b"}, keys="site_id, level") + """ FROM (
  SELECT 'cell' AS level, site_id, s, b, f FROM wc UNION ALL SELECT 'sector', site_id, s, -1, f FROM ws UNION ALL SELECT 'site', site_id, -1, -1, f FROM wg)""")
def wake_factor(spark, sf):
    fit = lookups.fit_wake(_theory(spark, sf), theory="ds_80m_farm_mw", fit_filter=_train())
    none = F.lit(-1).alias
    parts = [fit["cells"].select(SITE, F.lit("cell").alias("level"), "wake_sector", "wake_bin", F.col("cell_factor").alias("factor")),
             fit["sectors"].select(SITE, F.lit("sector").alias("level"), "wake_sector", none("wake_bin"), F.col("sector_factor").alias("factor")),
             fit["sites"].select(SITE, F.lit("site").alias("level"), none("wake_sector"), none("wake_bin"), F.col("site_factor").alias("factor"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _wf(w: str, d: str, n: str) -> str:
    return f"""{n} AS (SELECT t.site_id, t.ts, least(1.3e0, greatest(0.3e0, coalesce(a.f, b.f, g.f, 1))) AS f FROM (SELECT *, CAST(floor({d}/22.5e0) AS INT)%16 AS s,
      CASE WHEN {w} IS NOT NULL THEN len(list_filter([4,5,6,7,8,9,10,11,12,14], lambda e: e <= {w})) END AS b FROM th) t
      LEFT JOIN wc a ON a.site_id = t.site_id AND a.s = t.s AND a.b = t.b LEFT JOIN ws b ON b.site_id = t.site_id AND b.s = t.s LEFT JOIN wg g ON g.site_id = t.site_id)"""


@query("A03_wake_columns", _TH + ", " + _wf("wind_speed_80m", "wind_direction_80m*1000", "f1") + ", " + _wf("e100", "ed", "f2") + " SELECT " + cols({
    "wake_factor": "f1.f", "ds_wake_corrected": "m80*f1.f", "ds_wake_corrected_ratio": "m80*f1.f/90.09e0", "ds_consensus_wake_corrected": "list_avg([m80, m120, me])*f1.f",
    "era5_wake_factor": "f2.f", "ds_era5_wake_corrected": "me*f2.f"}) + " FROM th JOIN f1 USING (site_id, ts) JOIN f2 USING (site_id, ts)")
def wake(spark, sf):
    t = _theory(spark, sf)
    return added(t, lookups.wake_columns(t, lookups.fit_wake(t, theory="ds_80m_farm_mw", fit_filter=_train())))


_PT = f"pt AS (SELECT site_id, v_eff AS x, power_mw AS y FROM base WHERE power_mw >= 0 AND ts <= TIMESTAMP '{TRAIN}')"
_REWS = "cbrt((pow(wind_speed_80m,3)+pow(wind_speed_120m,3)+pow(wind_speed_180m,3))/3.0e0)"


@query("A04_site_isotonic", with_(BASE, _PT, iso_ctes("iso", "pt")) + "SELECT " + cols({"p_curve_global": "p"}) + " FROM " + iso_lookup("base", "iso", "v_eff", "p"))
def site_isotonic(spark, sf):
    b = base(spark, sf)
    return added(b, lookups.apply_site_curve(b, lookups.fit_site_curve(b, fit_filter=_train()), wind="v_eff", out="p_curve_global"))


_SEC = with_(BASE, f"bs AS (SELECT *, CAST(floor(wind_direction_120m*1000/45.0e0) AS INT)%8 AS sec, {_REWS} AS rews FROM base)", _PT, iso_ctes("iso", "pt"),
    f"ps0 AS (SELECT site_id, sec, v_eff AS x, power_mw AS y FROM bs WHERE power_mw >= 0 AND ts <= TIMESTAMP '{TRAIN}')",
    "ps AS (SELECT * FROM ps0 QUALIFY count(*) OVER (PARTITION BY site_id, sec) > 50)", iso_ctes("isos", "ps", "site_id, sec"))
_SECROWS = iso_lookup(iso_lookup("bs", "isos", "v_eff", "p1", "site_id, sec"), "iso", "v_eff", "p2")


@query("A05_sector_isotonic", _SEC + "SELECT " + cols({"p_curve_sector": "coalesce(p1, p2)"}) + f" FROM {_SECROWS}")
def sector_isotonic(spark, sf):
    b = base(spark, sf)
    site = lookups.fit_site_curve(b, fit_filter=_train())
    sector = lookups.fit_sector_curve(b, fit_filter=_train())
    return added(b, lookups.apply_sector_curve(b, sector, site, wind="v_eff", out="p_curve_sector"))


@query("A06_curve_columns", _SEC + "SELECT " + cols({
    "p_curve_sector": "coalesce(p1, p2)", "p_curve_global": "p2", "p_curve_rews": "CASE WHEN rews IS NOT NULL THEN p3 END", "p_curve_x_active": "coalesce(p1, p2)*active_turbines_ratio",
    "p_curve_global_x_active": "p2*active_turbines_ratio", "p_curve_ratio": "coalesce(p1, p2)/90.09e0", "p_curve_sector_minus_global": "coalesce(p1, p2)-p2"})
    + " FROM " + iso_lookup(_SECROWS, "iso", "rews", "p3"))
def curve_columns(spark, sf):
    b = weather.rotor_columns(base(spark, sf)).drop("rews_cube")
    return added(b, lookups.curve_columns(b, lookups.fit_curves(b, fit_filter=_train())))


@query("A07_impute_upper_level", with_(HOURLY, """a AS (SELECT site_id, avg(ln(wind_speed_180m/wind_speed_120m))/ln(1.5e0) AS al FROM hourly
   WHERE wind_speed_180m > 0.1 AND wind_speed_120m > 0.1 GROUP BY 1)""") + "SELECT " + cols({
    "wind_speed_180m": "coalesce(wind_speed_180m, wind_speed_120m*pow(1.5e0, coalesce(al, 0.143e0)))", "wind_direction_180m": "coalesce(wind_direction_180m, wind_direction_120m)"},
    {"ws_180m_is_imputed": "CASE WHEN wind_speed_180m IS NULL THEN 1 ELSE 0 END"}) + " FROM hourly LEFT JOIN a USING (site_id)")
def impute_upper_level(spark, sf):
    return lookups.impute_upper_level(hourly(spark, sf)).select(SITE, TS, "wind_speed_180m", "wind_direction_180m", "ws_180m_is_imputed")


_A8 = with_(HOURLY, "hi AS (SELECT *, power_mw > 90.09e0 AS bad FROM hourly)",
    f"pa AS (SELECT site_id, wind_speed_120m AS x, power_mw AS y FROM hi WHERE NOT bad AND ts <= TIMESTAMP '{TRAIN}')", iso_ctes("iso", "pa"),
    "ex AS " + iso_lookup("hi", "iso", "wind_speed_120m", "pe"), f"""un AS (SELECT *, CASE WHEN NOT bad AND ts <= TIMESTAMP '{TRAIN}' THEN power_mw-pe END AS x FROM ex)""")
_MH = "OVER (PARTITION BY site_id, month(ts), hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("A08_expected_power", _A8 + "SELECT " + cols({"avail_p_expected_mw": "pe", "avail_underprod_mw": "x", "avail_underprod_rate_mh": f"coalesce(avg(x) {_MH}, 0)",
    "avail_underprod_rate_30d": "coalesce(avg(x) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING), 0)"},
    {"avail_underprod_count_mh": f"count(x) {_MH}"}) + " FROM un")
def expected_power(spark, sf):
    h = hourly(spark, sf).withColumns({"_is_impossible": F.col(TARGET) > 90.09})
    return added(h, lookups.walk_forward_availability(h, train_end=TRAIN, freeze_after=TRAIN))


@query("A09_conditional_power", with_(HOURLY, """b AS (SELECT site_id, power_mw AS y, CAST(ceil(wind_speed_120m/0.5e0) AS INT)-1 AS k FROM hourly
   WHERE month(ts) IN (1, 4, 5) AND hour(ts) BETWEEN 0 AND 8 AND wind_speed_120m > 0 AND wind_speed_120m <= 8.5)""") + "SELECT " + cols({
    "mean": "avg(y)", "median": "median(y)", "std": "CASE WHEN count(*) > 1 THEN stddev_samp(y) END", "p25": "quantile_cont(y, 0.25)", "p75": "quantile_cont(y, 0.75)"}, {"ws_bin": "k", "n": "count(*)"}, keys="site_id")
    + " FROM b GROUP BY site_id, k")
def conditional_power(spark, sf):
    return lookups.conditional_power(hourly(spark, sf), months=(1, 4, 5), hours=(0, 8))


_WB = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 25, 100)
_WBI = "len(list_filter([2,4,6,8,10,12,14,16,18,25], lambda e: e <= ws_120))"


@query("A10_envelope", with_(OOF, f"o AS (SELECT *, {_WBI} AS b FROM oof)", "e AS (SELECT site_id, b, quantile_cont(target_mw, 0.05) AS lo, quantile_cont(target_mw, 0.95) AS hi FROM o WHERE fold < 5 GROUP BY 1, 2)")
       + "SELECT " + cols({"pred_capped": "least(90.09e0, greatest(coalesce(lo, 0), least(coalesce(hi, 90.09e0), pred_cf_mw)))"}) + " FROM o LEFT JOIN e USING (site_id, b)")
def envelope(spark, sf):
    o = oof(spark, sf)
    env = lookups.fit_envelope(o, wind="ws_120", target="target_mw", edges=_WB, fit_filter=F.col("fold") < 5)
    return lookups.apply_envelope(o, env, wind="ws_120", pred="pred_cf_mw", edges=_WB).select(SITE, TS, "pred_capped")


_RC = "len(list_filter([0,4,6,8,10,12,14], lambda e: e < wind_speed_80m))-1"


@query("A11_wake_loss", with_(BASE, curve_ctes("base", "k", {"k80": ("wind_speed_80m", "air_density")}), f"""l AS (SELECT *, least(90.09e0, k80*active_turbines/1000.0e0) AS th,
   CAST(floor(wind_direction_80m*1000/22.5e0) AS INT)%16 AS s, CASE WHEN wind_speed_80m > 25 THEN NULL ELSE {_RC} END AS b FROM k)""", "m AS (SELECT *, th-power_mw AS d FROM l WHERE abs(th-power_mw) < 30 AND power_mw > 0.5 AND th > 0.5)") + "SELECT " + cols({
    **{f"loss_bin{b}": f"avg(d) FILTER (b = {b})" for b in range(7)}, "mean_loss": "avg(d)", "std_loss": "CASE WHEN count(*) > 1 THEN stddev_samp(d) END", "loss_share": "avg(d/th) FILTER (wind_speed_80m >= 6)"},
    {"sector": "s", "n": "count(*)", **{f"n_bin{b}": f"count(*) FILTER (b = {b})" for b in range(7)}}, keys="site_id") + " FROM m GROUP BY site_id, s")
def wake_loss(spark, sf):
    return lookups.wake_loss_table(weather.curve_power_columns(base(spark, sf)))


_CMP = ("wind_speed_80m", "wind_speed_120m", "wind_gusts_10m", "temperature_80m", "pressure_msl")


@query("A12_compare_periods", with_(HOURLY, "l AS (" + " UNION ALL ".join(f"SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'early' ELSE 'late' END AS period, '{n}' AS column_name, {n} AS v FROM hourly" for n in _CMP) + ")")
       + "SELECT " + cols({"mean": "avg(v)", "std": "stddev_samp(v)", "median": "median(v)"}, {"n": "count(v)"}, keys="period, column_name") + " FROM l GROUP BY period, column_name")
def compare_periods(spark, sf):
    early = F.when(F.col(TS) < F.lit("2024-01-16").cast("timestamp_ntz"), "early").otherwise("late")
    return lookups.compare_periods(hourly(spark, sf), early, _CMP)


_AG = (("wind_speed_80m", "era5_wind_speed_100m"), ("wind_speed_80m", "gfs_ws100m"), ("era5_wind_speed_100m", "gfs_ws100m"), ("power_mw", "icon_ws100m"))
_AGN = {"wind_speed_80m": "h.wind_speed_80m", "era5_wind_speed_100m": "e.wind_speed_100m", "gfs_ws100m": "g.wind_speed_100m", "icon_ws100m": "i.wind_speed_100m", "power_mw": "h.power_mw"}


@query("A13_source_agreement", with_(HOURLY, feed_cte("reanalysis"), feed_cte("gfs"), feed_cte("icon"), "l AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, {_AGN[a]} AS a, {_AGN[b]} AS b FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts) LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN icon i USING (site_id, ts)" for a, b in _AG) + ")")
    + "SELECT " + cols({"correlation": "corr(a, b)", "mean_diff": "avg(a-b)", "mean_abs_diff": "avg(abs(a-b))", "max_abs_diff": "max(abs(a-b))"}, {"n": "count(a-b)"}, keys="first, second") + " FROM l GROUP BY first, second")
def agreement(spark, sf):
    return lookups.source_agreement(with_feed(spark, sf, hourly(spark, sf), "era5", "gfs", "icon"), _AG)


_PROF = ("wind_direction_10m", "wind_direction_80m", "wind_direction_120m", "wind_direction_180m", "wind_speed_10m", "wind_speed_180m", "wind_gusts_10m")


@query("A14_value_profile", with_(HOURLY, "l AS (" + " UNION ALL ".join(f"SELECT year(ts) AS y, '{n}' AS column_name, {n} AS v FROM hourly" for n in _PROF) + ")")
       + "SELECT " + cols({"min_value": "min(v)", "max_value": "max(v)", "mean_value": "avg(v)"}, {"year": "y", "n_present": "count(v)", "n_missing": "count(*)-count(v)"}, keys="column_name") + " FROM l GROUP BY y, column_name")
def profile(spark, sf):
    return lookups.value_profile(hourly(spark, sf), _PROF)


@query("A15_rate_tables", with_(HOURLY, """f AS (SELECT *, CASE WHEN power_mw < 30 THEN 1 ELSE 0 END AS f FROM hourly),
   l AS (SELECT 'hour' AS grouping, hour(ts) AS v, f FROM f UNION ALL SELECT 'year', year(ts), f FROM f UNION ALL SELECT 'n_repair', n_repair, f FROM f)""")
   + "SELECT " + cols({"flagged_pct": "avg(f)*100"}, {"value": "v", "n": "count(*)"}, keys="l.grouping AS grouping") + " FROM l GROUP BY l.grouping, v")
def rates(spark, sf):
    h = hourly(spark, sf).withColumns({"low": (F.col(TARGET) < 30).cast("int")})
    return lookups.rate_table(h, "low", {"hour": F.hour(TS), "year": F.year(TS), "n_repair": F.col("n_repair")})


@query("A16_gust_table", with_(HOURLY, "g AS (SELECT *, len(list_filter([0,5,10,15,18,20,22,25], lambda e: e < wind_gusts_10m))-1 AS b FROM hourly WHERE wind_gusts_10m > 0 AND wind_gusts_10m <= 30)")
       + "SELECT " + cols({"mean_power": "avg(power_mw)", "median_power": "median(power_mw)", "mean_ws80": "avg(wind_speed_80m)", "low_power_rate": "avg(CASE WHEN power_mw < 2 THEN 1 ELSE 0 END)"},
       {"gust_bin": "b", "n": "count(*)"}, keys="") + " FROM g GROUP BY b")
def gust_table(spark, sf):
    return lookups.gust_table(hourly(spark, sf))
