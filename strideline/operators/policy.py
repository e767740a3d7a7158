"""The whole gain policy as a machine: veto, outliers, window, settling, hold, persistence, rate limit."""

from __future__ import annotations

from strideline.operators.folds import Machine
from strideline.sources.sinks import Config


class AssistPolicy(Machine):
    """Gain per stride from its raw gain ``x``, its outlier flag ``ood`` and a safety ``veto``.

    In order: a stride without a raw gain leads toward 0 and changes nothing else; a
    veto leads toward 0; a long enough streak of outliers caps the gain; else the largest
    of the last raw gains is the aim.  Once the gain has stood still for ``settle``
    strides it is recomputed every ``hold`` strides only, while raw gains are still
    remembered.  A rise needs a streak of strides with a deficit, a fall one of strides
    without.  With a ``fixed_gain`` above 0 that is the aim of every stride but a vetoed
    one.  Every path goes through the rate limit.
    """

    inputs = ("x", "ood", "veto")
    schema = "gain double, engaged int, updated int, deficits int, recoveries int"

    def __init__(self, config: Config | None = None):
        self.c = config or Config()

    def start(self) -> dict:
        return {"gain": 0.0, "window": [], "deficits": 0, "recoveries": 0, "streak": 0, "same": 0, "since": 0, "last": None}

    def step(self, s: dict, t: float, x: float | None, ood: bool, veto: bool) -> tuple:
        engaged, updated = False, 1
        if x is None or x != x:
            self._toward(s, 0.0)
        else:
            s["streak"] = s["streak"] + 1 if ood else 0
            engaged = s["streak"] >= self.c.ood_streak
            if veto or engaged:
                s.update(window=[], since=0)
                held = s["gain"] if self.c.ood_policy == "hold" else self.c.ood_safe_gain
                self._toward(s, 0.0 if veto else self._fixed(min(held, self.c.ood_gain)))
            else:
                s["window"] = [*s["window"], x][-self.c.window :]
                updated = int(self._due(s))
                if updated:
                    self._toward(s, self._fixed(self._aim(s)))
        s["same"] = s["same"] + 1 if s["last"] is not None and abs(s["gain"] - s["last"]) <= 1e-12 else 0
        s["last"] = s["gain"]
        return s["gain"], int(engaged), updated, s["deficits"], s["recoveries"]

    def _fixed(self, aim: float) -> float:
        return min(self.c.fixed_gain, self.c.most_gain) if self.c.fixed_gain > 0 else aim

    def _due(self, s: dict) -> bool:
        """Whether the gain may move: always while it is moving, then every ``hold`` strides."""
        s["since"] = (s["since"] + 1) % self.c.hold if s["same"] >= self.c.settle else 0
        return s["since"] == 0

    def _aim(self, s: dict) -> float:
        """Largest gain of the window if its direction has persisted, else the gain as it is."""
        best = max(s["window"])
        s["deficits"], s["recoveries"] = (s["deficits"] + 1, 0) if best > 0 else (0, s["recoveries"] + 1)
        streak = s["deficits"] if best > s["gain"] else s["recoveries"]
        return best if streak >= self.c.persist else s["gain"]

    def _toward(self, s: dict, aim: float) -> None:
        step = min(max(min(aim, self.c.most_gain) - s["gain"], -self.c.most_step), self.c.most_step)
        s["gain"] = min(max(s["gain"] + step, 0.0), self.c.most_gain)
