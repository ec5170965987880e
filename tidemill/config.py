"""Parameters of the engine, checked on the driver when they are made."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

MAX_ATTEMPTS = 5
EXPECTED_KEYS = 100_000
FALSE_POSITIVE_RATE = 0.01


class ConfigError(ValueError):
    """A parameter is out of its range."""


def _positive(name: str, value: float) -> None:
    if not (math.isfinite(value) and value > 0):
        raise ConfigError(f"{name} has to be finite and above 0; it is {value}")


@dataclass(frozen=True)
class Scheduling:
    """Lane weights in declaration order (which breaks ties) and the age from which a lane goes first."""

    weights: Mapping[str, float]
    max_starvation_ms: float

    def __post_init__(self):
        if not self.weights:
            raise ConfigError("there has to be a lane")
        for lane, weight in self.weights.items():
            _positive(f"the weight of lane {lane!r}", weight)
        _positive("max_starvation_ms", self.max_starvation_ms)

    @property
    def total(self) -> float:
        return sum(self.weights.values())


@dataclass(frozen=True)
class Visibility:
    """How long a claim lives and how often it may be extended (0: never)."""

    timeout_ms: float
    max_extensions: int

    def __post_init__(self):
        if self.timeout_ms <= 0:
            raise ConfigError(f"timeout_ms has to be above 0; it is {self.timeout_ms}")
        if self.max_extensions < 0:
            raise ConfigError(f"max_extensions can't be below 0; it is {self.max_extensions}")

    @property
    def max_hold_ms(self) -> float:
        """The longest that one claim can last."""
        return self.timeout_ms * (1 + self.max_extensions)


@dataclass(frozen=True)
class Dedupe:
    """The window of a key, and the sizing of the diagnostic bloom filter."""

    window_ms: float
    enabled: bool = True
    expected_keys: int = EXPECTED_KEYS
    false_positive_rate: float = FALSE_POSITIVE_RATE

    def __post_init__(self):
        if self.window_ms <= 0:
            raise ConfigError(f"window_ms has to be above 0; it is {self.window_ms}")


@dataclass(frozen=True)
class QueueConfig:
    """A whole queue. `compat` reproduces three known losses of data: a retry or dead letter without payload and dedupe
    key, a replay that therefore forgets no key, and a replay to an unknown lane that drops the dead letter."""

    scheduling: Scheduling
    visibility: Visibility
    dedupe: Dedupe | None = None
    max_attempts: int = MAX_ATTEMPTS
    compat: bool = False

    @property
    def lanes(self) -> list[str]:
        """Lane names in order. In compat mode names that look like array indices come first, ascending."""
        names = list(self.scheduling.weights)
        if not self.compat:
            return names
        index = lambda x: x.isascii() and x.isdigit() and str(int(x)) == x and int(x) < 2**32 - 1
        return sorted(filter(index, names), key=int) + [x for x in names if not index(x)]
