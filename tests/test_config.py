import math

import pytest

from tidemill.config import ConfigError, Dedupe, QueueConfig, Scheduling, Visibility


@pytest.mark.parametrize("weights", [{}, {"a": 0}, {"a": -1}, {"a": math.nan}, {"a": math.inf}])
def test_weights_are_checked(weights):
    with pytest.raises(ConfigError):
        Scheduling(weights, 10)


@pytest.mark.parametrize("bound", [0, -1, math.nan, math.inf])
def test_starvation_bound_is_checked(bound):
    with pytest.raises(ConfigError):
        Scheduling({"a": 1}, bound)


def test_visibility_is_checked():
    for bad in (0, -5):
        with pytest.raises(ConfigError):
            Visibility(bad, 1)
    with pytest.raises(ConfigError):
        Visibility(10, -1)
    assert Visibility(100, 2).max_hold_ms == 300
    assert Visibility(30_000, 10).max_hold_ms == 330_000


def test_dedupe_window_is_checked_even_when_disabled():
    with pytest.raises(ConfigError):
        Dedupe(0, enabled=False)


def test_lane_order():
    s = Scheduling({"b": 1, "10": 1, "2": 1, "a": 1}, 1)
    v = Visibility(1, 0)
    assert QueueConfig(s, v).lanes == ["b", "10", "2", "a"]
    assert QueueConfig(s, v, compat=True).lanes == ["2", "10", "b", "a"]
