"""A seeded generator of half-hourly site years: drivers, fluxes with outages, and quality flags.

Sun and season are column expressions. Weather, soil heat and soil water remember the step before, so each site runs
through its series once, in its own task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OUT = (
    "site_id string, ts timestamp_ntz, shortwave double, vapour_pressure_deficit double, air_temperature double, net_radiation double, wind_speed double, "
    "wind_direction double, ground_heat_flux double, soil_temperature double, relative_humidity double, soil_water double, "
    "NEE double, H double, LE double, NEE_QC int, H_QC int, LE_QC int, NEE_truth double, H_truth double, LE_truth double"
)


def _smooth(x: np.ndarray, steps: float) -> np.ndarray:
    """Exponential smoothing with a memory of so many steps."""
    keep, out, now = np.exp(-1 / steps), np.empty(len(x)), x[0] if len(x) else 0.0
    for i, v in enumerate(x):
        now = keep * now + (1 - keep) * v
        out[i] = now
    return out


def _weather(rng: np.random.Generator, n: int, steps: float) -> np.ndarray:
    """Zero mean, unit variance, with a memory of so many steps."""
    keep = np.exp(-1 / steps)
    noise, out, now = rng.standard_normal(n + 1), np.empty(n), 0.0
    now = noise[n]
    for i in range(n):
        now = keep * now + np.sqrt(1 - keep * keep) * noise[i]
        out[i] = now
    return out


def _outages(rng: np.random.Generator, n: int, fraction: float, length: int) -> np.ndarray:
    """Bursts that cover about the fraction of rows, never more than overlaps allow."""
    mask = np.zeros(n, bool)
    count = int(round(fraction * n / length)) if fraction > 0 else 0
    for start, span in zip(rng.integers(0, max(n, 1), count), 1 + rng.poisson(length - 1, count)):
        mask[start : start + span] = True
    return mask


def _tetens(t: np.ndarray) -> np.ndarray:
    return 6.1078 * np.exp(17.27 * t / (t + 237.3))


def synthetic_sites(
    spark: SparkSession, sites: int = 1, start: str = "2018-01-01", days: int = 365, step_minutes: int = 30, latitude: float = 45.0, seed: int = 42, noise: float = 1.0,
    gap_fraction: float = 0.05, pre_filled_fraction: float = 0.1, closure: float = 1.0,
) -> DataFrame:
    """site_id, ts, ten drivers (complete), NEE, H, LE (null in outages), their flags (0 measured, 1 filled before, 3 missing) and noise-free truth.

    Without noise H + LE is closure times net radiation less ground heat. Sites differ by their seed.
    """
    n = days * 24 * 60 // step_minutes
    grid = spark.range(sites).select(F.format_string("site-%03d", "id").alias("site_id"), F.col("id").alias("no"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    grid = grid.select("site_id", "no", F.explode(F.sequence(F.col("day") * (n // days), (F.col("day") + 1) * (n // days) - 1)).alias("k"))
    ts = F.timestamp_add("MINUTE", F.col("k") * step_minutes, F.lit(start).cast("timestamp_ntz"))
    grid = grid.withColumn("ts", ts)
    declination = F.radians(F.lit(23.45)) * F.sin(2 * np.pi * (F.dayofyear("ts") + 284) / 365.25)
    hour = F.radians(15.0 * (F.hour("ts") + F.minute("ts") / 60.0 - 12.0))
    phi = float(np.radians(latitude))
    sun = F.lit(np.sin(phi)) * F.sin(declination) + F.lit(np.cos(phi)) * F.cos(declination) * F.cos(hour)
    grid = grid.withColumn("potential", 1361.0 * 0.75 * F.greatest(sun, F.lit(0.0)))
    per_day = n // days

    def year(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        rng = np.random.default_rng([seed, int(pdf["no"].iloc[0])])
        m, potential = len(pdf), pdf["potential"].to_numpy()
        daily = lambda x, f: np.repeat(f(x.reshape(-1, per_day), axis=1), per_day)
        clear = np.clip(0.85 + 0.25 * _weather(rng, m, per_day), 0.1, 1.0)
        sw = potential * clear
        season = daily(potential, np.mean)
        span = np.ptp(season)
        season = (season - season.min()) / span if span > 1e-9 else np.full(m, 0.5)
        warm = _smooth(season, 30 * per_day)
        ta = 2 + 20 * warm + 5 * (_smooth(potential, per_day / 8) - daily(potential, np.mean)) / 300 + 3 * _weather(rng, m, 3 * per_day)
        dew = np.minimum(daily(ta, np.min) - 1 + _weather(rng, m, 2 * per_day), ta - 0.2)
        rh = np.clip(100 * _tetens(dew) / _tetens(ta), 5, 100)
        vpd = _tetens(ta) * (1 - rh / 100)
        ts_soil = _smooth(ta, per_day)
        ws = np.clip(2.5 + 1.2 * _weather(rng, m, per_day / 2) + potential / 800, 0.05, None)
        wd = (225 + 60 * _weather(rng, m, per_day)) % 360
        netrad = 0.8 * sw - (40 + 50 * clear)
        ground = _smooth(np.where(netrad > 0, 0.1, 0.4) * netrad, per_day / 16)
        energy = netrad - ground
        green = np.clip((warm - 0.2) / 0.5, 0, 1)
        rain = np.where(rng.random(m) < 0.02 * (1.3 - clear), rng.exponential(2.0, m), 0.0)
        slope = 4098 * _tetens(ta) / (ta + 237.3) ** 2
        wish = 1.26 * slope / (slope + 0.66) * np.clip(energy, 0, None) * (0.25 + 0.75 * green)
        water, swc, le = 100.0, np.empty(m), np.empty(m)
        for i in range(m):  # a bucket that fills, drains and dries
            stress = min(1.0, max(0.0, (water - 20) / 80))
            le[i] = wish[i] * stress
            water = min(200.0, max(5.0, water + rain[i] - le[i] * 60 * step_minutes / 2.45e6))
            swc[i] = water / 5
        h = closure * energy - le
        gpp_most = 25 * green * np.clip(swc / 20, 0, 1) * np.exp(-0.05 * np.clip(vpd - 8, 0, None)) + 1e-9
        light = 0.05 * 2.1 * sw
        nee = 2.0 * 2 ** ((ts_soil - 15) / 10) * (0.5 + 0.5 * green) - gpp_most * light / (gpp_most + light)
        out = pd.DataFrame({
            "site_id": pdf["site_id"].to_numpy(), "ts": pdf["ts"].to_numpy(), "shortwave": sw, "vapour_pressure_deficit": vpd, "air_temperature": ta, "net_radiation": netrad, "wind_speed": ws,
            "wind_direction": wd, "ground_heat_flux": ground, "soil_temperature": ts_soil, "relative_humidity": rh, "soil_water": swc,
        })
        shared = _outages(rng, m, gap_fraction / 2, 12)
        for name, truth, size in (("NEE", nee, 0.5), ("H", h, 8.0), ("LE", le, 6.0)):
            gone = shared | _outages(rng, m, gap_fraction / 2, 8)
            before = _outages(rng, m, pre_filled_fraction, 10) & ~gone
            out[name] = np.where(gone, np.nan, truth + noise * size * rng.standard_normal(m) * (0.3 + potential / 1000))
            out[f"{name}_QC"] = np.where(gone, 3, np.where(before, 1, 0)).astype(np.int32)
            out[f"{name}_truth"] = truth
        return out[[c.split()[0] for c in _OUT.split(", ")]]

    made = grid.select("site_id", "no", "k", "ts", "potential").groupBy("site_id").applyInPandas(year, _OUT)
    return made.withColumns({t: F.nanvl(t, F.lit(None).cast("double")) for t in ("NEE", "H", "LE")})
