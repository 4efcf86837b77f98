"""Editing of a video's labels."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from cadence.kernels.base import Kernel


@dataclass
class Edited:
    marks: list[int] = field(default_factory=list)
    added: list[int] = field(default_factory=list)
    hold: list[int | None] = field(default_factory=lambda: [None, None])
    ambiguous: bool = False
    notes: str = ""


class EditLog(Kernel):
    """The labels that an edit log ends with. Marks are kept in order of time beside the order in which they came, so an
    event costs a search among the marks that stand, not a copy of them."""

    inputs = ("kind", "at_ms", "flag", "text")
    output = "marks array<bigint>, hold_start_ms bigint, hold_end_ms bigint, is_ambiguous boolean, notes string"

    def __init__(self, gap: int):
        self.gap = gap

    def start(self) -> Edited:
        return Edited()

    def _free(self, marks: list[int], at: int) -> bool:
        place = bisect_left(marks, at)
        return all(abs(m - at) >= self.gap for m in marks[max(place - 1, 0) : place + 1])

    def step(self, state: Edited, row: tuple) -> tuple[Edited, list[tuple]]:
        kind, at, flag, text = row
        if kind == "add" and at is not None and self._free(state.marks, at):
            insort(state.marks, at)
            state.added.append(at)
        elif kind == "undo" and state.added:
            del state.marks[bisect_left(state.marks, state.added.pop())]
        elif kind in ("hold_start", "hold_end"):
            state.hold[kind == "hold_end"] = at
        elif kind == "clear_hold":
            state.hold[state.hold[1] is not None] = None
        elif kind == "ambiguous":
            state.ambiguous, state.notes = bool(flag), text or ""
        return state, []

    def finish(self, state: Edited) -> list[tuple]:
        return [(state.marks, *state.hold, state.ambiguous, state.notes)]
