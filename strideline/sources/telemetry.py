"""Captured device telemetry: COBS frames mixed with text lines, decoded to rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Layout of a frame, its type and version, and the longest frame and line.
LAYOUT, FRAME_TYPE, FRAME_VERSION = "<BBHI24h", 1, 1
MOST_FRAME, MOST_LINE = 256, 192


def cobs_encode(data: bytes) -> bytes:
    """Byte stuffing that leaves no zero byte; the terminating zero is not added."""
    out = bytearray()
    for i, block in enumerate(data.split(b"\0")):
        while len(block) >= 254:
            out += b"\xff" + block[:254]
            block = block[254:]
            if not block and i == data.count(b"\0"):
                return bytes(out)
        out += bytes([len(block) + 1]) + block
    return bytes(out)


def cobs_decode(data: bytes) -> bytes | None:
    """Inverse of ``cobs_encode``; None for bytes that it cannot have made."""
    out, at = bytearray(), 0
    while at < len(data):
        code = data[at]
        if code == 0 or at + code > len(data) or 0 in data[at + 1 : at + code]:
            return None
        out += data[at + 1 : at + code]
        at += code
        if code < 255 and at < len(data):
            out.append(0)
    return bytes(out)


def parse_frame(payload: bytes) -> tuple | None:
    """Fields of a frame; None for another size, type or version."""
    if len(payload) != struct.calcsize(LAYOUT):
        return None
    fields = struct.unpack(LAYOUT, payload)
    return fields if fields[:2] == (FRAME_TYPE, FRAME_VERSION) else None


class StreamParser:
    """Parts bytes that come in pieces into text lines and frames, and counts what it had to drop.

    A zero byte opens a frame and the next one ends it; outside frames a newline ends a
    line.  What stands before a zero byte outside a frame is tried as a frame whose opening
    was lost.  A frame that does not decode is dropped; one that grows beyond ``MOST_FRAME``
    is dropped too, and the rest read as text until the next zero byte; a line that
    grows beyond ``MOST_LINE`` is dropped as far as it went.
    """

    def __init__(self) -> None:
        self.held, self.in_frame, self.dropped, self.reason = b"", False, 0, None

    def _drop(self, reason: str) -> None:
        self.dropped, self.reason = self.dropped + 1, reason

    def feed(self, data: bytes) -> list[tuple[str, bytes]]:
        """('line', text) and ('frame', payload) that these bytes complete."""
        out, at = [], 0
        while at < len(data):
            most = MOST_FRAME if self.in_frame else MOST_LINE
            ends = [p for p in (data.find(b"\0", at), -1 if self.in_frame else data.find(b"\n", at)) if p >= 0]
            end = min(ends, default=len(data))
            part = data[at:end] if self.in_frame else data[at:end].replace(b"\r", b"")
            room = most - len(self.held)
            if len(part) > room:  # too long
                self._drop("frame too long" if self.in_frame else "line too long")
                # a frame's byte beyond the limit goes with it; a line begins anew with that byte
                at, self.held = (at + room + 1, b"") if self.in_frame else (end, part[room:][-MOST_LINE:])
                self.in_frame = False
                if at < end or end == len(data):
                    continue
            else:
                self.held, at = self.held + part, end
            if at == len(data):
                break
            out += self._ended(data[at])
            at += 1
        return out

    def _ended(self, stop: int) -> list[tuple[str, bytes]]:
        """What a delimiter completes."""
        held, self.held = self.held, b""
        if self.in_frame:
            self.in_frame = False
            payload = cobs_decode(held) if held else None
            if held and (payload is None or parse_frame(payload) is None):
                self._drop("frame does not decode")
                return []
            return [("frame", payload)] if held else []
        if stop == 0:
            payload = cobs_decode(held) if held else None
            if held:
                return [("frame", payload)] if payload is not None and parse_frame(payload) is not None else []
            self.in_frame = True
            return []
        return [("line", held)] if held else []


    def kept(self) -> tuple[bytes, bool, int, str | None]:
        """What a later parser needs to go on where this one stops."""
        return self.held, self.in_frame, self.dropped, self.reason

    @classmethod
    def resumed(cls, kept: tuple[bytes, bool, int, str | None]) -> StreamParser:
        """A parser that goes on from ``kept``."""
        parser = cls()
        parser.held, parser.in_frame, parser.dropped, parser.reason = kept
        return parser


def split_stream(data: bytes) -> Iterator[tuple[str, bytes]]:
    """('line', text) and ('frame', payload) in the order of a whole capture."""
    yield from StreamParser().feed(data)


#: The 24 scaled fields of a frame in order, and what each is divided by.
FIELDS = {
    "motor_position": 100, "motor_velocity": 100, "motor_current": 100, "motor_current_set": 100, "belt_length": 10, "belt_velocity": 10, "belt_acceleration": 1, "roll": 10, "pitch": 10, "yaw": 10,
    "gyro_x": 100, "gyro_y": 100, "gyro_z": 100, "accel_x": 100, "accel_y": 100, "accel_z": 100, "input_force": 100, "output_force": 100, "spring_torque": 100, "bus_voltage": 100, "bus_current": 100,
    "driver_error": 1, "detect_state": 1, "control_state": 1,
}


def scaled_channels(events: DataFrame) -> DataFrame:
    """(path, at, seq, timestamp, a double for each field): the frames of decoded captures in physical units; time in seconds."""
    frames = events.where("kind = 'frame'")
    return frames.select("path", "at", "seq", (F.col("time10ms") / 100.0).alias("timestamp"), *[(F.col("values")[i] / float(n)).alias(c) for i, (c, n) in enumerate(FIELDS.items())])


def capture_counts(captures: DataFrame) -> DataFrame:
    """(path, frames, lines, dropped, reason) of each capture (path, content)."""
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser, counts = StreamParser(), {"frame": 0, "line": 0}
                for begin in range(0, len(content or b""), PIECE):
                    for kind, _ in parser.feed(content[begin : begin + PIECE]):
                        counts[kind] += 1
                rows.append((path, counts["frame"], counts["line"], parser.dropped, parser.reason))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "frames", "lines", "dropped", "reason"])
    return captures.select("path", "content").mapInArrow(run, "path string, frames long, lines long, dropped long, reason string")


def decode_captures(captures: DataFrame) -> DataFrame:
    """(path, at, kind, seq, time10ms, values, line) for each event of the captures (path, content).

    A capture's events depend on what came before, so one file is one task's work; it is read
    in pieces of ``PIECE`` bytes, and at most ``EVENTS`` events and those of a piece are held at once.
    """
    return captures.select("path", "content").mapInArrow(decoded, "path string, at int, kind string, seq int, time10ms long, values array<int>, line string")


#: Bytes of a capture that are parsed at a time, and events after which a task hands its rows on.
PIECE, EVENTS = 1 << 16, 4096


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of captures (path, content) in batches of bounded size."""
    rows = []
    for batch in batches:
        for i in range(batch.num_rows):
            path, content, parser, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), StreamParser(), 0
            for begin in range(0, content.size if content else 0, PIECE):
                for kind, raw in parser.feed(content[begin : begin + PIECE].to_pybytes()):
                    f = parse_frame(raw) if kind == "frame" else None
                    rows.append((path, at, kind, f[2] if f else None, f[3] if f else None, f[4:] if f else None, raw.decode("latin-1") if not f else None))
                    at += 1
                if len(rows) >= EVENTS:
                    yield _events(rows)
                    rows = []
    if rows:
        yield _events(rows)


def _events(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "at", "kind", "seq", "time10ms", "values", "line"])


_EVENT = "path string, at long, kind string, seq int, time10ms long, values array<int>, line string"


def decode_pieces(pieces: DataFrame) -> DataFrame:
    """A stream of (path, piece, content), pieces of captures, as ``decode_captures`` gives the whole captures' events.

    Pieces of a capture are put in order by ``piece`` within what has arrived, and what a
    piece leaves unfinished is kept until the next, so captures may be cut anywhere.  A piece
    that comes after a later one gives one event of kind ``late`` with its name and is else
    left out.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, in_frame, dropped, reason, at, last = state.get if state.exists else (b"", False, 0, None, 0, None)
        parser = StreamParser.resumed((bytes(held), in_frame, dropped, reason))
        rows = []
        for piece, content in sorted((p, bytes(c or b"")) for b in batches for p, c in zip(b["piece"], b["content"], strict=True)):
            if last is not None and piece <= last:
                rows.append((key[0], None, "late", None, None, None, piece))
                continue
            last = piece
            for kind, raw in parser.feed(content):
                f = parse_frame(raw) if kind == "frame" else None
                rows.append((key[0], at, kind, f[2] if f else None, f[3] if f else None, list(f[4:]) if f else None, raw.decode("latin-1") if not f else None))
                at += 1
        state.update((*parser.kept(), at, last))
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in _EVENT.split(", ")])
        yield found.astype({"at": "Int64", "seq": "Int32", "time10ms": "Int64"})

    kept = "held binary, in_frame boolean, dropped long, reason string, at long, last string"
    return pieces.select("path", "piece", "content").groupBy("path").applyInPandasWithState(run, _EVENT, kept, "append", "NoTimeout")


def encode_captures(samples: DataFrame) -> DataFrame:
    """(path, content): a capture of each session's samples (session, seq, t, x, k), one frame a sample after a line of text.

    The first two values of a frame are k and x in tenths, held to 16 bits; the rest are 0.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("seq", "ascending")])
        out = bytearray()
        for i, (t, x, k) in enumerate(zip(*(group[c].to_pylist() for c in "txk"), strict=True)):
            tenths = [0 if v is None or v != v else int(min(max(round(v * 10), -32768), 32767)) for v in (k, x)]
            frame = struct.pack(LAYOUT, FRAME_TYPE, FRAME_VERSION, i & 0xFFFF, int(round(t * 360000)) & 0xFFFFFFFF, *tenths, *[0] * 22)
            out += f"OK n={i}\n".encode() + b"\0" + cobs_encode(frame) + b"\0"
        return pa.table({"path": pa.array([str(group["session"][0].as_py())]), "content": pa.array([bytes(out)], pa.binary())})
    return samples.select("session", "seq", "t", "x", "k").groupBy("session").applyInArrow(run, "path string, content binary")


def key_value(line: Column, key: str) -> Column:
    """Value of the first ``key=`` up to the next blank; empty if there is none."""
    return F.regexp_extract(line, key + "=([^ ]*)", 1)
