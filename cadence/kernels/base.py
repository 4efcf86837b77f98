from __future__ import annotations

import math
from typing import Any


#: Values, numbers for the most part, of the rows that a task gives back at once.
BATCH_VALUES = 1 << 17


class Kernel:
    inputs: tuple[str, ...] = ()
    output: str = ""

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def finish(self, state: Any) -> list[tuple]:
        return []


def is_number(v: Any) -> bool:
    return v is not None and math.isfinite(v)


def round_up(x: float) -> int:
    """To the nearest whole number, halves up."""
    return math.floor(x + 0.5)


def weight(v: Any) -> int:
    """About how many values a row has: lists count as long as their first entry times their length."""
    if isinstance(v, tuple):
        return sum(weight(x) for x in v)
    return len(v) * weight(v[0]) if isinstance(v, list) and v else 1
