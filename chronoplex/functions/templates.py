"""Pattern templates: short lists of values whose shape a search looks for."""

from __future__ import annotations

import math

#: Fixed value: width of the bell of ``spike`` and ``drop`` on the unit interval.
BELL_WIDTH = 0.1


def _bell(x: float, centre: float) -> float:
    return math.exp(-((x - centre) ** 2) / (2 * BELL_WIDTH**2))


#: Closed forms on x in [0, 1]. ``plateau`` equals ``step_down``; that is a fixed value too.
_FORMS = {
    "spike": lambda x, p, k: _bell(x, p),
    "drop": lambda x, p, k: -_bell(x, p),
    "increasing": lambda x, p, k: x,
    "decreasing": lambda x, p, k: 1 - x,
    "peak": lambda x, p, k: 1 - 4 * (x - 0.5) ** 2,
    "valley": lambda x, p, k: 4 * (x - 0.5) ** 2,
    "step_up": lambda x, p, k: 0.0 if x < p else 1.0,
    "step_down": lambda x, p, k: 1.0 if x < p else 0.0,
    "plateau": lambda x, p, k: 1.0 if x < p else 0.0,
    "oscillation": lambda x, p, k: math.sin(2 * math.pi * k * x),
}
TEMPLATE_NAMES = tuple(_FORMS)


def template(name: str, length: int | None = None, amplitude: float = 1.0, position: float = 0.5,
             periods: int = 2) -> list[float]:
    if name not in _FORMS:
        raise ValueError(f"unknown template {name!r}")
    length = length or (20 if name == "oscillation" else 10)
    grid = [i / (length - 1) for i in range(length)] if length > 1 else [0.0]
    return [amplitude * _FORMS[name](x, position, periods) for x in grid]


def z_normalised(values: list[float]) -> list[float]:
    """Zero mean and unit population deviation; a constant list is only centred."""
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return [(v - mean) / (std or 1.0) for v in values]
