"""Settings of a run, checked when they are made, and read from JSON or YAML."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from ..errors import ConfigError
from ..functions import spellings
from ..operators import features as feature_ops
from ..operators import legacy
from ..operators.features import STRATEGIES
from ..operators.gaps import GapScenario
from ..operators.timeaxis import iso_duration, to_duration

DRIVERS = ("shortwave", "vapour_pressure_deficit", "air_temperature", "net_radiation", "wind_speed", "wind_direction", "ground_heat_flux", "soil_temperature", "relative_humidity", "soil_water")
MODES = {"RFR3": DRIVERS[:3], "RFR10": DRIVERS}

# The parameter grids, under the names that users of forests know.
GRIDS: dict[str, dict[str, tuple]] = {
    "package_default": {"max_features": (1.0, "sqrt"), "min_samples_leaf": (1, 5), "n_estimators": (100, 300)},
    "legacy": {
        "bootstrap": (True,), "max_depth": (80, 90, 100, 110), "max_features": (2, 3), "min_samples_leaf": (3, 4, 5),
        "min_samples_split": (8, 10, 12), "n_estimators": (100, 200, 300, 1000),
    },
    "legacy_fixed": {"max_depth": (20,), "min_samples_leaf": (3,), "min_samples_split": (12,), "n_estimators": (100,)},
}


@dataclass(frozen=True)
class FeatureConfig:
    use_limiter: bool = True
    mode: str = "paper_safe"
    radiation_thresholds: tuple[float, float] = (10.0, 100.0)
    boundary_convention: str = "medium_inclusive"
    min_daily_observations: int = 1
    daily_strategy: str = "missing"
    fallback_window_days: int = 7
    daily_std_ddof: int = 1

    def __post_init__(self):
        if self.mode not in ("paper_safe", "legacy"):
            raise ConfigError(f"unknown feature mode {self.mode!r}")
        if self.daily_strategy not in STRATEGIES:
            raise ConfigError(f"unknown daily statistic strategy {self.daily_strategy!r}")
        if self.boundary_convention not in ("medium_inclusive", "medium_exclusive"):
            raise ConfigError(f"unknown boundary convention {self.boundary_convention!r}")
        if not self.radiation_thresholds[0] < self.radiation_thresholds[1]:
            raise ConfigError("radiation_thresholds must rise")
        if self.min_daily_observations < 1 or self.fallback_window_days < 1 or self.daily_std_ddof < 0:
            raise ConfigError("daily statistic settings must be positive")

    def daily(self) -> dict[str, Any]:
        return {"strategy": self.daily_strategy, "minimum": self.min_daily_observations, "window_days": self.fallback_window_days, "ddof": self.daily_std_ddof}


@dataclass(frozen=True)
class ValidationConfig:
    daytime_threshold: float = 20.0
    subsets: tuple[str, ...] = ("all", "daytime", "nighttime")
    r2_definition: str = "residual"
    by_gap_class: bool = True
    bias_spread: bool = True
    energy_balance: bool = False

    def __post_init__(self):
        if self.r2_definition not in ("residual", "squared_correlation"):
            raise ConfigError(f"unknown R2 definition {self.r2_definition!r}")


@dataclass(frozen=True)
class RunConfig:
    mode: str = "RFR3"
    columns: Mapping[str, str] = field(default_factory=dict)  # canonical driver -> column
    frequency: str | None = None
    hemisphere: str | None = None
    latitude: float | None = None
    seed: int = 42
    grid: Mapping[str, tuple] = field(default_factory=lambda: dict(GRIDS["package_default"]))
    cv: str = "kfold"
    cv_folds: int = 5
    cv_shuffle: bool = False
    observed_qc: tuple[int, ...] = (0,)
    partitions: int = 8
    features: FeatureConfig = field(default_factory=FeatureConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    gaps: GapScenario = field(default_factory=GapScenario)

    def __post_init__(self):
        object.__setattr__(self, "mode", spellings.coerce(self.mode, tuple(MODES), "mode"))
        if self.hemisphere is not None:
            object.__setattr__(self, "hemisphere", spellings.coerce(self.hemisphere, ("north", "south"), "hemisphere", spellings.HEMISPHERE_SPELLINGS))
        if unknown := [c for c in self.columns if c not in DRIVERS]:
            raise ConfigError(f"unknown drivers {', '.join(unknown)}")
        if len(set(self.columns.values())) < len(self.columns):
            raise ConfigError("two drivers stand on one column")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise ConfigError("seed must be a whole number")
        if self.latitude is not None and not -90 <= self.latitude <= 90:
            raise ConfigError(f"latitude {self.latitude} is out of range")
        if self.cv not in ("kfold", "time_series_split"):
            raise ConfigError(f"unknown cross-validation {self.cv!r}")
        if self.cv_folds < 2:
            raise ConfigError("cross-validation needs two folds")

    @property
    def drivers(self) -> tuple[str, ...]:
        return MODES[self.mode]

    @property
    def side(self) -> str:
        """Hemisphere; an explicit one wins over the latitude. There is no default: seasons would be silently wrong."""
        if self.hemisphere is not None:
            return self.hemisphere
        if self.latitude is None:
            raise ConfigError("set hemisphere or latitude: seasons depend on them")
        return "south" if self.latitude < 0 else "north"

    @property
    def method(self) -> str:
        """Label of the arm: with the limiter RFR, without ORF, and the number of drivers."""
        return ("RFR" if self.features.use_limiter else "ORF") + str(len(self.drivers)) + ("-legacy" if self.features.mode == "legacy" else "")

    def as_benchmark_arm(self) -> RunConfig:
        """The same run without the limiter."""
        return dataclasses.replace(self, features=dataclasses.replace(self.features, use_limiter=False))

    def feature_description(self, target: str) -> dict[str, Any]:
        """The features of a run, in order, with every choice and code that made them."""
        f, old = self.features, self.features.mode == "legacy"
        out = {"mode": f.mode, "limiter": f.use_limiter, "drivers": list(self.drivers), "target": target}
        if old:
            return out | {
                "names": legacy.legacy_feature_names(target), "hemisphere": self.side, "statistics": list(legacy.LEGACY_STATISTICS), "daily_std_ddof": 1, "sees_withheld_truth": True,
                "radiation_codes": legacy.RADIATION_CODES, "season_codes": legacy.SEASON_CODES,
            }
        out["names"] = feature_ops.feature_names(list(self.drivers), target, f.use_limiter)
        if f.use_limiter:
            codes = lambda order: {name: code for code, name in enumerate(order)}
            out |= {
                "hemisphere": self.side, "hemisphere_from": "setting" if self.hemisphere else "latitude", "radiation_thresholds": list(f.radiation_thresholds),
                "boundary_convention": f.boundary_convention, "radiation_codes": codes(feature_ops.RADIATION), "season_codes": codes(feature_ops.SEASONS), **f.daily(),
            }
        return out

    def to_dict(self) -> dict[str, Any]:
        return _plain(dataclasses.asdict(self))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()


def _plain(x: Any) -> Any:
    if isinstance(x, Mapping):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return iso_duration(x) if isinstance(x, timedelta) else x


def _build(cls, data: Mapping[str, Any], where: str):
    known = {f.name for f in dataclasses.fields(cls)}
    if unknown := sorted(set(data) - known):
        raise ConfigError(f"unknown settings in {where}: {', '.join(unknown)}")
    return cls(**data)


def from_dict(data: Mapping[str, Any]) -> RunConfig:
    """A configuration from plain values; unknown keys are refused. grid may be the name of a preset."""
    data = dict(data)
    if isinstance(data.get("grid"), str):
        if data["grid"] not in GRIDS:
            raise ConfigError(f"unknown parameter preset {data['grid']!r}")
        data["grid"] = dict(GRIDS[data["grid"]])
    for key, cls in (("features", FeatureConfig), ("validation", ValidationConfig)):
        if key in data:
            part = {k: tuple(v) if isinstance(v, list) else v for k, v in data[key].items()}
            data[key] = _build(cls, part, key)
    if "gaps" in data:
        part = dict(data["gaps"])
        if "durations" in part:
            part["durations"] = {k: to_duration(v) for k, v in part["durations"].items()}
        data["gaps"] = _build(GapScenario, part, "gaps")
    if "observed_qc" in data:
        data["observed_qc"] = tuple(data["observed_qc"])
    return _build(RunConfig, data, "the configuration")


def load(path: str, **overrides: Any) -> RunConfig:
    """A configuration from a .json, .yaml or .yml file."""
    with open(path) as f:
        if path.endswith(".json"):
            data = json.load(f)
        elif path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(f)
        else:
            raise ConfigError(f"{path} is neither JSON nor YAML")
    return from_dict({**(data or {}), **overrides})


def arm_differences(a: RunConfig, b: RunConfig) -> dict[str, tuple]:
    """Settings, flattened, in which two runs differ."""

    def flat(d: Mapping, prefix: str = "") -> dict:
        out = {}
        for k, v in d.items():
            out |= flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {prefix + k: v}
        return out

    x, y = flat(a.to_dict()), flat(b.to_dict())
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}


def require_pair(a: RunConfig, b: RunConfig) -> None:
    """Refuse two arms that differ in more than the limiter."""
    if more := [k for k in arm_differences(a, b) if k != "features.use_limiter"]:
        raise ConfigError(f"the arms differ in {', '.join(more)} as well")
