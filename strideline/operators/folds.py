"""Ordered state machines over the samples of a session.

A machine's ``step`` maps (state, sample) to a new state and an output row.  In batch
a session's rows are sorted and stepped through in one Arrow group; streams keep
the same state between micro-batches, so both give the same rows.  (A fold over a
sorted array column would stay in the JVM, but copies its output at every sample.)
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


class Machine:
    """State machine; subclasses give ``schema`` of what a sample adds, its ``inputs``, a start state and a step."""

    inputs: tuple[str, ...] = ("x",)
    schema = ""

    def start(self) -> dict:
        """State before the first sample."""
        raise NotImplementedError

    def step(self, state: dict, t: float, *values) -> tuple:
        """Changes the state and returns the output columns of one sample; ``values`` are its inputs."""
        raise NotImplementedError

    def process(self, state: dict, t: list, *inputs: list) -> list[list]:
        """``step`` over a block of samples; the output columns as lists."""
        rows = [self.step(state, *values) for values in zip(t, *inputs, strict=True)]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _outputs(self)]

    def fields(self) -> list[str]:
        """Columns that a table of samples must have."""
        return ["session", "seq", "t", "x", *[c for c in self.inputs if c not in ("x", "t", "seq")]]


class Recurrence(Machine):
    """A number that each sample moves: ``first`` of a sample's inputs gives it, ``then`` (value, inputs) moves it on.

    A value that is not finite is given anew by the next sample.  Time and state are linear in a session.
    """

    def __init__(self, name: str, first: Callable[..., float], then: Callable[..., float], inputs: tuple[str, ...] = ("x",)):
        self.first, self.then, self.inputs, self.schema = first, then, inputs, f"{name} double"

    def start(self) -> dict:
        return {"y": None}

    def step(self, s: dict, t: float, *values) -> tuple:
        y = s["y"]
        s["y"] = self.first(*values) if y is None or not math.isfinite(y) else self.then(y, *values)
        return (s["y"],)


def smoothing(cutoff: float, dt: float) -> float:
    """Weight of a new value in an exponential mean with a cut-off frequency, at samples ``dt`` apart."""
    tau = 1 / (2 * math.pi * cutoff)
    return dt / (tau + dt)


def ema(samples: DataFrame, alpha: float) -> DataFrame:
    """Exponential mean that its first value seeds, and the first after one that is not finite."""
    return run_machine(samples, Recurrence("ema", lambda x: x, lambda y, x: x * alpha + y * (1 - alpha)))


def rate_limited(samples: DataFrame, most: float) -> DataFrame:
    """Value that follows x by ``most`` a step."""
    return run_machine(samples, Recurrence("limited", lambda x: x, lambda y, x: y + max(min(x - y, most), -most)))


class BeltTrigger(Machine):
    """Schmitt trigger on a signal about its own slow mean, in units of its own slow amplitude."""

    schema = "event string, baseline double, amplitude double"

    def __init__(self, tau: float = 24.0, refractory: float = 6.0, least_amplitude: float = 5.0, rise: float = 0.3, fall: float = 0.5):
        self.tau, self.refractory, self.least_amplitude, self.rise, self.fall = tau, refractory, least_amplitude, rise, fall

    def start(self) -> dict:
        return {"b": None, "a": 0.0, "t": 0.0, "swinging": False, "last": None}

    def step(self, s: dict, t: float, x: float) -> tuple:
        if x is None or not math.isfinite(x):
            return None, s["b"], s["a"]
        if s["b"] is None:
            s.update(b=x, a=0.0, t=t)
            return None, x, 0.0
        alpha = 1 - math.exp(-max(t - s["t"], 0.0) / max(self.tau, 1e-3))
        s["b"] += alpha * (x - s["b"])
        e = x - s["b"]
        s["a"] += alpha * (abs(e) - s["a"])
        s["t"], event = t, None
        if s["a"] >= self.least_amplitude:
            if not s["swinging"]:
                if e >= self.rise * s["a"]:
                    s["swinging"], event = True, "toe_off"
            elif e <= -self.fall * s["a"] and (s["last"] is None or t - s["last"] >= self.refractory):
                s.update(swinging=False, last=t)
                event = "heel_strike"
        return event, s["b"], s["a"]


class LevelTrigger(Machine):
    """Two thresholds: armed at or above ``high``, fires at or below ``low``.

    With ``defer`` a strike inside the refractory time comes later; without it it is lost.
    With ``belt_gate`` the input ``belt`` must be at that length or beyond as well: above it,
    or below it if it is negative.
    """

    schema = "event string"

    def __init__(self, high: float, low: float, refractory: float, defer: bool = True, belt_gate: float | None = None):
        self.high, self.low, self.refractory, self.defer, self.belt_gate = high, low, refractory, defer, belt_gate
        if belt_gate is not None:
            self.inputs = ("x", "belt")

    def start(self) -> dict:
        return {"armed": False, "last": None}

    def step(self, s: dict, t: float, x: float, belt: float | None = None) -> tuple:
        if not s["armed"]:
            if x >= self.high:
                s["armed"] = True
                return ("toe_off",)
            return (None,)
        if x > self.low:
            return (None,)
        ready = s["last"] is None or t - s["last"] >= self.refractory
        if self.belt_gate is not None:
            ready = ready and (belt <= self.belt_gate if self.belt_gate < 0 else belt >= self.belt_gate)
        if ready or not self.defer:
            s["armed"] = False
        if not ready:
            return (None,)
        s["last"] = t
        return ("heel_strike",)


class PersistentGain(Machine):
    """Gain that follows a score: a rise needs a streak of scores above 0, a fall one of zeros, and no step is larger than ``most_step``."""

    schema = "gain double, deficits int, recoveries int"

    def __init__(self, persist: int = 3, most_step: float = 0.1, most_gain: float = 0.8):
        self.persist, self.most_step, self.most_gain = persist, most_step, most_gain

    def start(self) -> dict:
        return {"gain": 0.0, "deficits": 0, "recoveries": 0}

    def step(self, s: dict, t: float, x: float) -> tuple:
        target = min(max(x, 0.0), 1.0) * self.most_gain
        s["deficits"], s["recoveries"] = (s["deficits"] + 1, 0) if target > 0 else (0, s["recoveries"] + 1)
        if (s["deficits"] if target > s["gain"] else s["recoveries"]) >= self.persist:
            s["gain"] = min(max(s["gain"] + min(max(target - s["gain"], -self.most_step), self.most_step), 0.0), self.most_gain)
        return s["gain"], s["deficits"], s["recoveries"]


class GateRearm(Machine):
    """A gate that a strike below ``threshold`` uses up, until the signal has risen above ``reset``."""

    inputs = ("x", "strike")
    schema = "passed int, armed int"

    def __init__(self, threshold: float, reset: float):
        self.threshold, self.reset = threshold, reset

    def start(self) -> dict:
        return {"armed": True}

    def step(self, s: dict, t: float, x: float, strike: bool) -> tuple:
        s["armed"] = s["armed"] or x > self.reset
        passed = s["armed"] and strike and x <= self.threshold
        s["armed"] = s["armed"] and not passed
        return int(passed), int(s["armed"])


class SideTorque(Machine):
    """Strikes of one foot that may start a pulse: the last that did lies ``ratio`` of the foot's own cycle back.

    ``strike``, ``side`` and ``cycle`` are a step detector's; a cycle that is not known yet is ``nominal``.
    Strikes of the other foot and of none neither start a pulse nor put one off.
    """

    inputs = ("strike", "side", "cycle")
    schema = "fired int, last double"

    def __init__(self, side: str, nominal: float, ratio: float = 0.65):
        self.side, self.nominal, self.ratio = side, nominal, ratio

    def start(self) -> dict:
        return {"last": None}

    def step(self, s: dict, t: float, strike: bool, side: str, cycle: float) -> tuple:
        known = cycle is not None and math.isfinite(cycle) and cycle > 0
        wait = self.ratio * (cycle if known else self.nominal)
        fired = bool(strike) and side == self.side and (s["last"] is None or t - s["last"] >= wait)
        if fired:
            s["last"] = t
        return int(fired), s["last"]


class Transitions(Machine):
    """A session's state under its samples' ``kind``: (state, kind) leads to a state, anything else leaves it as it is."""

    inputs = ("kind",)
    schema = "state string"

    def __init__(self, first: str, edges: dict[tuple[str, str], str]):
        self.first, self.edges = first, edges

    def start(self) -> dict:
        return {"state": self.first}

    def step(self, s: dict, t: float, kind: str) -> tuple:
        s["state"] = self.edges.get((s["state"], kind), s["state"])
        return (s["state"],)


#: The states of a session and where each may lead; a safe stop can be reached from everywhere.
SESSION_STATES = {
    "INIT": {"CALIBRATION", "SAFE_STOP"}, "CALIBRATION": {"BASELINE_COLLECTION", "SAFE_STOP"}, "BASELINE_COLLECTION": {"MODEL_BUILDING", "SAFE_STOP"}, "MODEL_BUILDING": {"READY", "SAFE_STOP"},
    "READY": {"WALKING", "OOD", "SAFE_STOP"}, "WALKING": {"READY", "OOD", "SAFE_STOP"}, "OOD": {"WALKING", "READY", "SAFE_STOP"}, "SAFE_STOP": {"INIT"},
}


class SessionStates(Machine):
    """A session's state under wishes: an allowed one moves it, another is refused, one with a ``!`` before it is forced.

    The history is the rows whose note is ``moved`` or ``forced``.
    """

    inputs = ("wish",)
    schema = "state string, note string"

    def start(self) -> dict:
        return {"state": "INIT"}

    def step(self, s: dict, t: float, wish: str) -> tuple:
        forced, wish = wish.startswith("!"), wish.lstrip("!")
        if wish not in SESSION_STATES:
            raise ValueError(f"unknown state {wish!r}")
        note = "forced" if forced else "same" if wish == s["state"] else "moved" if wish in SESSION_STATES[s["state"]] else "refused"
        if note != "refused":
            s["state"] = wish
        return s["state"], note


#: Starts of a device's replies, the state each leads to, and whether the session is active then.
REPLIES = {"OK session_started": ("CONFIG_WAIT", False), "OK control_started": ("STREAMING", True), "OK control_rearmed": ("STREAMING", True), "OK session_stopped": ("IDLE", False)}
#: The device's own names of a state in which its session is active, and the state here.
REPORTED = {"SENSOR_STREAMING": "STREAMING", "CONTROL_ACTIVE": "STREAMING", "CONTROL_STALE": "STALE"}


def _value(words: list[str], name: str, kind: type):
    """The value of name=value among words as a ``kind``; None without one that can be read."""
    for word in words:
        key, equals, value = word.partition("=")
        if equals and key == name:
            try:
                return kind(value)
            except ValueError:
                return None
    return None


class LinkStates(Machine):
    """State of a device's link from its captured text: lines ``sent``, replies, and the numbers of telemetry frames.

    A start or stop that was sent waits ``ack`` seconds for its reply; then a start has failed,
    and a stop has worked if no frame came in the last ``stale`` seconds before.  An active
    session without a frame for ``stale`` seconds is STALE until a reply says otherwise; frames alone change no
    state.  Time passes at rows: what fell due before a row is settled first, as of when it fell due.
    Lines of other kinds, null lines and values that cannot be read change nothing.
    """

    inputs = ("sent", "line", "frame")
    schema = "state string, active int, waiting string, asked double, last_seq long, lapse string"

    def __init__(self, ack: float = 1.0, stale: float = 0.25):
        self.ack, self.stale = ack, stale

    def start(self) -> dict:
        return {"state": "IDLE", "active": False, "waiting": None, "since": None, "frame": None, "asked": 0.0, "seq": 0}

    def _row(self, s: dict, lapse: str) -> tuple:
        return s["state"], int(s["active"]), s["waiting"], s["asked"], s["seq"], lapse

    def _lapse(self, s: dict, now: float) -> str:
        """Settles what fell due up to ``now``; its name."""
        lapse = ""
        if s["waiting"] is not None and now >= s["since"] + self.ack:
            lapse = f"{s['waiting']}_unanswered"
            going = s["waiting"] == "stop" and s["frame"] is not None and s["since"] + self.ack - s["frame"] < self.stale
            s.update(waiting=None, active=going, state="STREAMING" if going else "FAULT" if s["waiting"] == "start" else "IDLE")
        if s["active"] and s["frame"] is not None and now - s["frame"] >= self.stale:
            lapse, s["state"] = lapse or ("" if s["state"] == "STALE" else "stale"), "STALE"
        return lapse

    def _settled(self, s: dict, state: str, active: bool) -> None:
        s.update(state=state, active=active, waiting=None)

    def _heard(self, s: dict, line: str) -> None:
        """A reply of the device."""
        reply = next((r for r in REPLIES if line.startswith(r)), None)
        if reply is not None:
            self._settled(s, *REPLIES[reply])
            if s["state"] == "CONFIG_WAIT":
                s["asked"] = 0.0
        elif line.startswith("OK sensor_streaming"):
            s["state"] = "SENSOR_STREAMING"
        elif line.startswith("OK state="):
            words = line.split()
            state = REPORTED.get(_value(words, "state", str))
            self._settled(s, state or "IDLE", state is not None)
            seq, asked = _value(words, "last_seq", int), _value(words, "value", float)
            s.update(seq=s["seq"] if seq is None else seq, asked=s["asked"] if asked is None else asked)
        elif line.startswith("ERR "):
            self._settled(s, s["state"] if s["active"] else "FAULT", s["active"])

    def step(self, s: dict, t: float, sent: bool, line: str, frame: int) -> tuple:
        lapse = self._lapse(s, t)
        if frame is not None and frame == frame:  # a number that is missing may come as NaN
            s.update(frame=t, seq=int(frame))
        elif isinstance(line, str) and sent:
            order = line.split()[-1:]
            if order == ["START"]:
                s.update(state="AWAITING_START_ACK", active=False, waiting="start", since=t, asked=0.0)
            elif order == ["STOP"]:
                s.update(state="AWAITING_STOP_ACK", waiting="stop", since=t)
        elif isinstance(line, str):
            self._heard(s, line)
        return self._row(s, lapse)

    def timed_out(self, s: dict) -> tuple:
        """The row of a session that has fallen silent: all that can fall due has."""
        return self._row(s, self._lapse(s, math.inf))


#: Detectors by name; ``register_detector`` adds to them.
DETECTORS: dict[str, Callable[..., Machine]] = {"belt_length": BeltTrigger, "level": LevelTrigger}


def register_detector(name: str, cls: type) -> None:
    """Make a machine known by name; a name is given once."""
    if not (isinstance(cls, type) and issubclass(cls, Machine)):
        raise TypeError("a detector must derive from Machine")
    if name in DETECTORS:
        raise ValueError(f"detector {name!r} is registered already")
    DETECTORS[name] = cls


def create_detector(name: str, **options) -> Machine:
    """A machine by its registered name."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name](**options)


def _outputs(machine: Machine) -> dict[str, str]:
    """Type name of each output column."""
    return dict(column.split() for column in machine.schema.split(","))


def run_machine(samples: DataFrame, machine: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session, seq, t, x), the columns to ``keep`` and the machine's columns for every sample, in batch."""
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("seq", "ascending")])
        state = machine.start()
        found = machine.process(state, *[group[c].to_pylist() for c in ("t", *machine.inputs)])
        group = group.select(["session", "seq", "t", "x", *keep])
        for (name, kind), column in zip(_outputs(machine).items(), found, strict=True):
            group = group.append_column(name, pa.array(column, kinds[kind]))
        return group

    kinds_kept = dict(samples.dtypes)
    kept = "".join(f"{c} {kinds_kept[c]}, " for c in keep)
    rows = samples.select(*dict.fromkeys([*machine.fields(), *keep]))
    return rows.groupBy("session").applyInArrow(run, f"session long, seq long, t double, x double, {kept}{machine.schema}")


def stream_step(machine: Machine, stale: float | None = None):
    """The function that ``applyInPandasWithState`` calls; the state is the machine's, as JSON.

    A session that sends nothing for ``stale`` seconds gets one row of the machine's ``timed_out``.
    """
    import json

    names = list(_outputs(machine))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else machine.start()
        if stale is not None and state.hasTimedOut:
            row = machine.timed_out(own)
            state.update((json.dumps(own),))
            yield pd.DataFrame([[key[0], None, None, None, *row]], columns=["session", "seq", "t", "x", *names]).astype({"seq": "Int64"})
            return
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        found = machine.process(own, *[rows[c].tolist() for c in ("t", *machine.inputs)])
        state.update((json.dumps(own),))
        if stale is not None:
            state.setTimeoutDuration(int(stale * 1000))
        result = rows[["session", "seq", "t", "x"]].copy()
        for name, column in zip(names, found, strict=True):
            result[name] = column
        yield result

    return run


def run_machine_stream(samples: DataFrame, machine: Machine, stale: float | None = None) -> DataFrame:
    """``run_machine`` on a stream of samples that come in time order within a session; ``stale`` seconds without one give a row of their own."""
    return samples.select(*machine.fields()).groupBy("session").applyInPandasWithState(
        stream_step(machine, stale), f"session long, seq long, t double, x double, {machine.schema}", "state string", "append", "NoTimeout" if stale is None else "ProcessingTimeTimeout")
