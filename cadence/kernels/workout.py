"""The whole live chain as one kernel: count, window, judge form, hold, session and speech, frame by frame."""

from __future__ import annotations

from dataclasses import replace

from cadence.kernels.base import Kernel
from cadence.kernels.counters import PoseCounter
from cadence.kernels.forms import BY_LABEL, HOLDS, evaluate, judge_cycle
from cadence.kernels.states import Debounce, HoldTimer, PoseFilter, RateLimiter, ScoreSmoother, Session
from cadence.kernels.windows import WindowStream

#: How long the warning of a failed repetition stays, in ms.
REP_WARNING_MS = 2500


class Workout(Kernel):
    """Rows of frames (`kind` NULL), controls (start, stop, choose with `label`, speech with `enabled`, forget) and model
    scores (scores), in order of time. Emits rows of kind rep, warning, say, window and set.

    Scores come back as rows: a model runs between two passes, on the windows of the first. A rule set applies from the
    frame after its label is known, and everything that belongs to a set starts anew with the next set.
    """

    inputs = ("ts_ms", "kind", "label", "enabled", "scores", "poor_pose", "pose", "width", "height")
    output = "ts_ms double, kind string, label string, number int, text string, duration_ms double, missing_ratio double, rows array<array<double>>"

    def __init__(self, labels: list[str] | None = None) -> None:
        self.counter, self.stream, self.hold, self.debounce, self.speech = PoseCounter(), WindowStream(), HoldTimer(), Debounce(), RateLimiter()
        self.smoother = ScoreSmoother(labels) if labels else None

    def _fresh(self):
        return {"counter": self.counter.start(), "debounce": self.debounce.start(), "cycle": {}, "hold": self.hold.start(), "visible": [], "failed": None}

    def start(self):
        return {"session": Session(), "set_id": 0, "scores": None, "filter": PoseFilter(), "stream": self.stream.start(), "speech": self.speech.start(), **self._fresh()}

    def _row(self, t, kind, label=None, number=None, text=None, duration=None, missing=None, rows=None):
        return float(t), kind, label, number, text, duration, missing, rows

    def _control(self, s, t, kind, label, enabled, scores, poor) -> None:
        session = s["session"]
        if kind == "start":
            s["session"] = session.begin(t)
        elif kind == "stop":
            s["session"] = session.stop(t)
            self.hold.close(s["hold"])
        elif kind == "choose":
            s["session"] = session.choose(label, t)
        elif kind == "speech":
            self.speech.enable(s["speech"], bool(enabled))
        elif kind == "scores" and self.smoother is not None:
            s["scores"], seen = self.smoother.judge(s["scores"], list(scores), bool(poor))
            s["session"] = session.predict(seen[0], seen[1], seen[3])

    def _closed(self, s, t) -> list[tuple]:
        done, s["session"] = s["session"].closed, replace(s["session"], closed=())
        return [self._row(t, "set", r[0], int(r[2]), f"{r[2] - r[3]}/{r[2]}", float(r[7])) for r in done]

    def step(self, s, row):
        t, kind, label, enabled, scores, poor, pose, width, height = row
        if kind is not None:
            self._control(s, t, kind, label, enabled, scores, poor)
            return s, self._closed(s, t)
        if s["session"].set_id != s["set_id"]:
            s.update(self._fresh(), set_id=s["session"].set_id, scores=None)
        out = []
        smooth = s["filter"].feed(pose, t)
        before = s["counter"]["zones"].count
        s["counter"], _ = self.counter.step(s["counter"], (t, pose, width, height))
        count = s["counter"]["zones"].count
        s["stream"], windows = self.stream.step(s["stream"], (t, pose, width, height))
        session = s["session"]
        label = (session.set.label if session.set else None) or session.manual
        rules = BY_LABEL.get(label)
        form = evaluate(smooth, rules, width, height)
        s["debounce"], visible = self.debounce.advance(s["debounce"], t, form.broken)
        s["cycle"], failed = judge_cycle(s["cycle"], form, rules, count > before)
        message = {r.id: r.message for r in rules.rules} if rules else {}
        if failed:
            s["failed"] = (failed[0].message, t + REP_WARNING_MS)
        elif s["failed"] is not None and s["failed"][1] <= t:
            s["failed"] = None
        if label in HOLDS:
            self.hold.advance(s["hold"], t, form.in_position)
        s["session"] = session.frame(t, s["counter"]["moving"], count, s["hold"]["best"], s["hold"]["since"] is not None, bool(visible))
        fresh = [i for i in visible if i not in s["visible"]]
        s["visible"] = visible
        if count > before:
            out.append(self._row(t, "rep", label, count))
            self.speech.say(s["speech"], str(count))
        for i in fresh:
            out.append(self._row(t, "warning", label, None, message[i]))
        if fresh:
            self.speech.say(s["speech"], message[fresh[0]])
        for r in failed:
            out.append(self._row(t, "warning", label, count, r.message))
        if failed:
            self.speech.say(s["speech"], failed[0].message)
        said = self.speech.release(s["speech"], t)
        if said is not None:
            out.append(self._row(t, "say", label, None, said))
        out += [self._row(t, "window", label, start, None, None, missing, rows) for start, missing, _, rows in windows]
        return s, out + self._closed(s, t)

    def finish(self, s):
        return [self._row(s["stream"]["tick"] or 0.0, "window", None, start, None, None, missing, rows) for start, missing, _, rows in self.stream.finish(s["stream"])]
