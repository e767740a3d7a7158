"""Settings of a run: nested frozen dataclasses, their JSON, and overrides by dotted path."""

from __future__ import annotations

import dataclasses
import enum
import json
import typing

from strideline.sources.sinks import Config


class Target(enum.Enum):
    """What distances are measured from."""

    PATIENT = "patient_baseline"
    INTERPOLATED = "interpolated_target"
    HEALTHY = "healthy_region"


@dataclasses.dataclass(frozen=True)
class Detection:
    """The belt trigger and what makes a stride valid, in seconds."""

    rate: float = 100.0
    tau: float = 2.0
    refractory: float = 0.35
    min_samples: int = 15
    stride_time: tuple[float, float] = (0.5, 2.5)


@dataclasses.dataclass(frozen=True)
class Settings:
    """All settings of a run."""

    detection: Detection = Detection()
    policy: Config = Config()
    target: Target = Target.INTERPOLATED


def to_json(settings: object) -> str:
    """Settings as JSON: a nested object for each part, an enum by its value, a tuple as a list."""
    return json.dumps(dataclasses.asdict(settings), default=lambda v: v.value, sort_keys=True)


def from_json(kind: type, text: str) -> typing.Any:
    """Settings of a dataclass from JSON; what is not given keeps its default, an unknown key is an error."""
    return _restored(kind, json.loads(text), "")


def override(settings: typing.Any, path: str, text: str) -> typing.Any:
    """A copy with the value at a dotted path, ``policy.window``, set from a text: JSON, or a word as it stands."""
    name, _, rest = path.partition(".")
    known = typing.get_type_hints(type(settings)) if dataclasses.is_dataclass(settings) else {}
    if name not in known:
        raise KeyError(f"unknown setting: {path}")
    if rest:
        value = override(getattr(settings, name), rest, text)
    else:
        try:
            given = json.loads(text)
        except json.JSONDecodeError:
            given = text
        value = _restored(known[name], given, name)
    return dataclasses.replace(settings, **{name: value})


def _restored(kind: typing.Any, given: typing.Any, path: str) -> typing.Any:
    """A value read from JSON as the type that a field has."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(given, dict):
            raise ValueError(f"{path or 'settings'}: an object is wanted, not {given!r}")
        known = typing.get_type_hints(kind)
        at = lambda k: f"{path}.{k}" if path else k
        unknown = sorted(set(given) - set(known))
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(map(at, unknown))}")
        return kind(**{k: _restored(known[k], v, at(k)) for k, v in given.items()})
    if typing.get_origin(kind) is tuple:
        parts = typing.get_args(kind)
        if not isinstance(given, list) or len(given) != len(parts):
            raise ValueError(f"{path}: a list of {len(parts)} is wanted, not {given!r}")
        return tuple(_restored(p, v, path) for p, v in zip(parts, given, strict=True))
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return kind(given)
    whole = isinstance(given, int) and not isinstance(given, bool)
    if kind is float and (whole or isinstance(given, float)):
        return float(given)
    if (kind is int and whole) or (kind in (str, bool) and isinstance(given, kind)):
        return given
    raise ValueError(f"{path}: {kind.__name__} is wanted, not {given!r}")
