"""Kernel states as typed parts, so that a state store holds columns instead of pickled objects.

A part is one value (a struct) or a list of structs with a schema of its own. Parts are written one by one, so what a row
does not change is not written again, and fields can be added to a part without losing stored states.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import types as T

from cadence.kernels import counters, states, windows, workout
from cadence.kernels.base import Kernel

POSE = "array<struct<x:double,y:double,z:double,visibility:double>>"


@dataclass(frozen=True)
class Part:
    """`get(state)` gives the tuple to store (a list of tuples if `listed`), or None for nothing; `put(state, stored)` gives
    the state with it."""

    name: str
    ddl: str
    get: Callable[[Any], Any]
    put: Callable[[Any, Any], Any]
    listed: bool = False


def plain(v: Any) -> Any:
    """Python lists, tuples and numbers of arrays, rows and dictionaries; maps are left to `Part.get`."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, tuple):
        return tuple(plain(x) for x in v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def fitted(v: Any, kind: T.DataType) -> Any:
    """A value as its type stores it: whole numbers in double columns become doubles, rows and dictionaries tuples. Missing
    entries of arrays, which Avro state has no place for, become NaN or a struct without values; kernels read them alike."""
    if isinstance(kind, T.StructType):
        if v is None:
            return None
        given = [v.get(f.name) for f in kind] if isinstance(v, dict) else list(v)
        return tuple(fitted(x, f.dataType) for x, f in zip(given, kind, strict=True))
    if v is None:
        return None
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        empty = tuple(None for _ in inner) if isinstance(inner, T.StructType) else math.nan if isinstance(inner, (T.DoubleType, T.FloatType)) else None
        return [empty if x is None else fitted(x, inner) for x in (v.tolist() if isinstance(v, np.ndarray) else v)]
    if isinstance(kind, T.MapType):
        return {fitted(k, kind.keyType): fitted(x, kind.valueType) for k, x in v.items()}
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, (T.IntegralType,)):
        return int(v)
    return v.item() if isinstance(v, np.generic) else v


def _fields(ddl: str) -> list[str]:
    """Names of the top-level fields."""
    out, depth, name, naming = [], 0, "", True
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(name.strip("` "))
            name, naming = "", True
        elif naming and c == " " and name.strip():
            naming = False
        elif naming:
            name += c
    return out


def _set(state: Any, names: list[str], values: Any, back: dict[str, Callable]) -> Any:
    # A field that a stored row lacks or has no value for keeps what a new state has.
    given = {n: back.get(n, lambda v: v)(values[k]) for k, n in enumerate(names) if k < len(values)}
    if isinstance(state, dict):
        state.update(given)
        return state
    if getattr(state, "__dataclass_params__", None) is not None and state.__dataclass_params__.frozen:
        return replace(state, **given)
    for n, v in given.items():
        setattr(state, n, v)
    return state


def entries(name: str, ddl: str, **back: Callable) -> Part:
    """A part of the state's own entries or attributes, as named by the schema; `back` turns stored values into its own."""
    names = _fields(ddl)
    read = lambda s: tuple(plain(s[n] if isinstance(s, dict) else getattr(s, n)) for n in names)
    return Part(name, ddl, read, lambda s, v: _set(s, names, v, back))


def inside(entry: str, parts: list[Part]) -> list[Part]:
    """Parts of a state that is an entry of another one."""

    def put(p: Part):
        def one(s, v):
            s[entry] = p.put(s[entry], v)
            return s

        return one

    return [Part(f"{entry}_{p.name}", p.ddl, lambda s, p=p: p.get(s[entry]), put(p), p.listed) for p in parts]


def optional(name: str, ddl: str, entry: str, make: Callable[[Any], Any] = tuple, take: Callable[[Any], Any] = lambda v: v) -> Part:
    """An entry that can be None, stored only when it is not."""

    def put(s, v):
        s[entry] = make(v)
        return s

    return Part(name, ddl, lambda s: None if s[entry] is None else plain(take(s[entry])), put)


def _array(v):
    return None if v is None else np.array(v, float)


def _put(entry: str, make: Callable[[Any], Any]):
    def put(s, v):
        s[entry] = make(v)
        return s

    return put


_ZONES = entries("zones", "home int, home_range double, home_count int, zone int, away double, period_s double, last_ms double, count int")
_HOLD = [entries("hold", "since double, good double, current double, best double")]
_SPEECH = [entries("speech", "last double, waiting string, on boolean")]
_FILTER = [entries("filter", "x array<array<double>>, speed array<array<double>>, t array<array<double>>", **{n: lambda v: np.array(v, float).reshape(-1, 3) for n in ("x", "speed", "t")})]
_WINDOWS = [
    entries("clock", "first double, tick double, ticks int, next int, offset int"),
    optional("before", f"ms double, pose {POSE}", "before"),
    Part("rows", "v array<double>", lambda s: [(r,) for r in s["rows"].tolist()], _put("rows", lambda v: np.array([r[0] for r in v], float).reshape(-1, windows.WIDTH)), True),
    Part("waiting", "kept array<double>, width double, height double", lambda s: [(k, w, h) for k, w, h in s["waiting"]], _put("waiting", lambda v: [(list(r[0]), r[1], r[2]) for r in v]), True),
]
_COUNTER = [
    entries("pace", "next double, motion array<double>, smooth array<double>, axis array<double>, channel int, moving boolean", motion=_array, smooth=_array, axis=_array),
    *inside("zones", [_ZONES]),
    Part("window", "v array<double>", lambda s: [(plain(r),) for r in s["window"]], _put("window", lambda v: [np.array(r[0], float) for r in v]), True),
]


def _session(s: states.Session) -> tuple:
    return s.phase, s.manual, s.candidate, s.streak, s.set_id, s.active_ms


def _put_session(s: states.Session, v) -> states.Session:
    return replace(s, phase=v[0], manual=v[1], candidate=v[2], streak=v[3], set_id=v[4], active_ms=v[5])


def _put_set(s: states.Session, v) -> states.Session:
    return replace(s, set=states.OpenSet(*v))


_SESSION = [
    Part("session", "phase string, manual string, candidate string, streak int, set_id int, active_ms double", _session, _put_session),
    Part("open_set", "label string, start_ms double, reps int, warned int, warned_now boolean, hold_ms double, confidence double", lambda s: None if s.set is None else tuple(vars(s.set).values()), _put_set),
]


def _whole(name: str, ddl: str, take: Callable[[Any], Any], make: Callable[[Any], Any]) -> list[Part]:
    """A state that is one value, None before the first."""
    return [Part(name, ddl, lambda s: None if s is None else (take(s),), lambda s, v: make(v[0]))]


CODECS: dict[type, list[Part]] = {
    windows.WindowStream: _WINDOWS,
    windows.FeatureStream: _WINDOWS,
    states.SessionKernel: _SESSION,
    states.HoldTimer: _HOLD,
    states.RateLimiter: _SPEECH,
    states.Debounce: _whole("debounce", "since map<string,double>", lambda s: {k: float(v) for k, v in s.items()}, dict),
    states.ValueFilter: [entries("filter", "x double, speed double, t double")],
    states.ScoreSmoother: _whole("scores", "scores array<double>", plain, list),
    states.Ema: _whole("ema", "v double", float, float),
    counters.SignalCounter: [entries("smooth", "smooth double"), *inside("zones", [_ZONES]), Part("buffer", "v double", lambda s: [(float(v),) for v in s["buffer"]], _put("buffer", lambda v: [r[0] for r in v]), True)],
    counters.PoseCounter: _COUNTER,
    counters.ThresholdCounter: [entries("phase", "phase string, count int, lowest double, feedback string")],
    workout.Workout: [
        *inside("session", _SESSION),
        *inside("speech", _SPEECH),
        *inside("filter", _FILTER),
        *inside("stream", _WINDOWS),
        entries("chain", "set_id int, scores array<double>"),
        # What belongs to a set; a new set replaces these parts.
        *inside("counter", _COUNTER),
        *inside("hold", _HOLD),
        Part("judged", "since map<string,double>, cycle map<string,double>, visible array<string>, failed struct<text:string,until_ms:double>", lambda s: ({k: float(v) for k, v in s["debounce"].items()}, {k: float(v) for k, v in s["cycle"].items()}, list(s["visible"]), plain(s["failed"])), lambda s, v: {**s, "debounce": dict(v[0]), "cycle": dict(v[1]), "visible": list(v[2]), "failed": None if v[3] is None else tuple(v[3])}),
    ],
}


def codec(kernel: Kernel) -> list[Part]:
    """The parts of a kernel's state: its own `parts`, or those declared here for its class; otherwise one pickled value."""
    if getattr(kernel, "parts", None):
        return kernel.parts
    for kind in type(kernel).__mro__:
        if kind in CODECS:
            return CODECS[kind]
    return [Part("state", "pickled binary", lambda s: (pickle.dumps(s),), lambda s, v: pickle.loads(v[0]))]
