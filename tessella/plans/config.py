"""Configuration: nested values by dotted path, validation, overrides from the environment; logging."""

from __future__ import annotations

import copy
import json
import logging
import os
from pathlib import Path
from typing import Any

SECTIONS = ("data", "preprocessing", "features", "models", "evaluation")
# The defaults that results depend on.
DEFAULTS: dict[str, Any] = {
    "data": {"raw_path": "data/raw", "processed_path": "data/processed", "external_path": "data/external", "assets": {"stocks": [], "etfs": [], "crypto": [], "bonds": []}},
    "preprocessing": {"adjust_splits": True, "adjust_dividends": True, "use_log_returns": True, "missing_data_strategy": "forward_fill", "volatility_window": 21, "sharpe_window": 21, "sortino_window": 21},
    "features": {
        "technical": {"macd": {"fast_period": 12, "slow_period": 26, "signal_period": 9}, "rsi": {"period": 14}, "bollinger_bands": {"period": 20, "std_dev": 2}},
        "rolling": {"windows": [5, 10, 21, 63], "metrics": ["mean", "std", "min", "max", "skew", "kurtosis"]},
    },
    "models": {"monte_carlo": {"confidence_levels": [0.05, 0.1, 0.9, 0.95]}, "baseline": {"optimization_method": "max_sharpe", "rebalance_frequency": "monthly", "transaction_costs": 0.001}},
    "evaluation": {"metrics": {"risk_free_rate": 0.02, "confidence_level": 0.95}},
}
#: Environment variable -> path and type.
ENVIRONMENT = {"RAW_DATA_PATH": ("data.raw_path", str), "PROCESSED_DATA_PATH": ("data.processed_path", str), "DATA_API_KEY": ("data.api_key", str), "RISK_FREE_RATE": ("evaluation.metrics.risk_free_rate", float)}


class Config:
    """Nested dictionaries behind dotted paths."""

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = copy.deepcopy(DEFAULTS if values is None else values)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file, or a YAML file where a YAML reader is installed."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("no YAML reader is installed; use JSON") from e
            return cls(yaml.safe_load(text) or {})
        return cls(json.loads(text))

    def save(self, path: str) -> None:
        """As YAML by a name that ends so, where a YAML writer is installed; else as JSON."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("no YAML writer is installed; use JSON") from e
            Path(path).write_text(yaml.safe_dump(self.values, sort_keys=False))
            return
        Path(path).write_text(json.dumps(self.values, indent=2))

    def get(self, path: str, default: Any = None) -> Any:
        here: Any = self.values
        for part in path.split("."):
            if not isinstance(here, dict) or part not in here:
                return default
            here = here[part]
        return here

    def set(self, path: str, value: Any) -> None:
        *above, last = path.split(".")
        here = self.values
        for part in above:
            here = here.setdefault(part, {})
        here[last] = value

    def __getitem__(self, path: str) -> Any:
        missing = object()
        if (value := self.get(path, missing)) is missing:
            raise KeyError(path)
        return value

    def __contains__(self, path: str) -> bool:
        missing = object()
        return self.get(path, missing) is not missing

    def problems(self) -> list[str]:
        """What is missing; empty if the configuration can be used."""
        out = [f"section {s}" for s in SECTIONS if s not in self]
        out += [f"data.{k}" for k in ("raw_path", "processed_path") if f"data.{k}" not in self]
        out += ["data.assets"] if not self.get("data.assets") else []
        return out + (["models.baseline"] if "models.baseline" not in self else [])

    def override(self, environment: dict[str, str] | None = None) -> Config:
        """Values of ENVIRONMENT win; one of the wrong type is reported and left out."""
        for name, (path, kind) in ENVIRONMENT.items():
            if (value := (os.environ if environment is None else environment).get(name)) is not None:
                try:
                    self.set(path, kind(value))
                except ValueError:
                    logging.getLogger(__name__).warning("%s is no %s", name, kind.__name__)
        return self

    def tickers(self) -> list[str]:
        return [t for k, ts in self.get("data.assets", {}).items() if k != "bonds" for t in ts]

    def make_folders(self) -> None:
        for k in ("raw_path", "processed_path", "external_path"):
            if path := self.get(f"data.{k}"):
                Path(path).mkdir(parents=True, exist_ok=True)


def logger(name: str, level: str = "INFO", file: str | None = None) -> logging.Logger:
    """A logger to the console, and to a file if named; asked twice, the same."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if file:
            Path(file).parent.mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(file))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
            log.addHandler(h)
    return log
