"""MPEG transport streams as media columns.

Storing: a payload of bytes becomes one program with one private-data stream. It is cut into
packetised elementary units of ``UNIT_BYTES``, each with a presentation timestamp and, every
``KEY_UNITS`` units, a random-access point; program tables stand before every random-access point.
Transport packets have 188 bytes, continuity counters per packet id, and stuffing in the last packet
of a unit. The streams are written as a table below the shared folder, with the place, timestamp and
random-access flag of each unit, and read from there.

Reading: the association table gives the map tables' packet ids, these give the elementary streams.
Sections are checked by CRC-32/MPEG-2. Per packet id, repeated packets are dropped and gaps in the
continuity counters are counted, unless the packet announces a discontinuity. Units are put together
from their packets; each is stored with its timestamp, offset, size and whether it can be entered.

Features are the numbers of packets, tables, streams, units, random-access points and continuity
errors, and the first and last timestamp.

Defined cases: a null text is the empty one; bytes that are no packet (sync byte or length wrong, or
flagged as damaged) are counted and skipped; a stream without valid tables yields no units; packets
of a unit whose start is missing are dropped and counted as an error; a very long text is one stream
of as many units as it needs, held whole, a task holding one at a time beside its batch; equal texts
and repeated rows give equal streams, a row each; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table
from graphloom.session import materialise

UNIT_BYTES, KEY_UNITS, PAYLOAD_UNIT = 32_768, 4, 64
#: Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0, 0x1FFF
PMT_PID, ES_PID, PROGRAM, STREAM_ID, STREAM_TYPE = 0x100, 0x101, 1, 0xBD, 0x06
TICKS = 90_000 // 25


def _crc_table() -> list[int]:
    table = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program-specific section with pointer field and CRC, filling one packet's payload."""
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    whole = b"\x00" + section + crc_mpeg(section).to_bytes(4, "big")
    return whole + b"\xff" * (PACKET - 4 - len(whole))


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, control << 4 | counter & 15])


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    return (ticks >> 1).to_bytes(4, "big") + bytes([(ticks & 1) << 7 | 0x7E, 0])


def mux(payload: bytes) -> bytes:
    """Store bytes as a transport stream."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[at : at + UNIT_BYTES]
        pts = k * TICKS
        unit = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + data
        adaptation = b""
        if k % KEY_UNITS == 0:
            out += [_head(PAT_PID, True, 1, tables), _PAT, _head(PMT_PID, True, 1, tables), _PMT]
            tables += 1
            adaptation = b"\x50" + _clock(pts)
        room = PACKET - 4 - (len(adaptation) + 1 if adaptation else 0)
        if len(unit) < room:  # the unit's only packet
            adaptation = (adaptation or b"\x00") + b"\xff" * (PACKET - 5 - len(unit) - max(1, len(adaptation)))
            adaptation = adaptation[: PACKET - 5 - len(unit)]
            out += [_head(ES_PID, True, 3, counter), bytes([len(adaptation)]), adaptation, unit]
            counter += 1
            continue
        out += [_head(ES_PID, True, 3 if adaptation else 1, counter), bytes([len(adaptation)]) + adaptation if adaptation else b"", unit[:room]]
        counter += 1
        rest = unit[room:]
        n = len(rest) // (PACKET - 4)
        if n:
            packets = np.empty((n, PACKET), dtype=np.uint8)
            packets[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 0xFF)
            packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            packets[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=n * (PACKET - 4)).reshape(n, -1)
            out.append(packets.tobytes())
            counter += n
        rest = rest[n * (PACKET - 4) :]
        if rest:
            stuffing = (b"\x00" + b"\xff" * (PACKET - 6 - len(rest)))[: PACKET - 5 - len(rest)]
            out += [_head(ES_PID, False, 3, counter), bytes([len(stuffing)]), stuffing, rest]
            counter += 1
    return b"".join(out)


@dataclass
class Demuxed:
    """What a transport stream holds; ``units`` are (pid, pts or None, random access, offset, size) into ``payload``."""

    packets: int = 0
    damaged: int = 0
    errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, bool, int, int]] = field(default_factory=list)
    payload: bytes = b""

    def feature(self) -> str:
        """The features in one line."""
        times = [u[1] for u in self.units if u[1] is not None]
        entries = sum(u[2] for u in self.units)
        kinds = ",".join(f"{t:02x}" for t in sorted(self.streams.values()))
        return f"packets={self.packets};damaged={self.damaged};programs={len(self.programs)};streams={kinds};units={len(self.units)};entries={entries};errors={self.errors};pts={min(times, default=-1)}-{max(times, default=-1)}"


def _sections(packets: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Whole sections with a right CRC, from the packets of one packet id."""
    held = b""
    for packet, offset, start in zip(packets, offsets.tolist(), starts.tolist(), strict=True):
        data = packet[offset:].tobytes()
        if start:
            pointer = data[0] if data else 0
            held, data = b"", data[1 + pointer :]
        elif not held:
            continue
        held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                break
            section, held = held[:size], held[size:]
            if size >= 12 and crc_mpeg(section) == 0:
                yield section


def _pts(unit: bytes) -> tuple[int | None, int]:
    """(timestamp or None, bytes of header) of a unit that starts with its start code."""
    if len(unit) < 9 or unit[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        return None, min(6, len(unit))
    size = 9 + unit[8]
    if unit[7] & 0x80 and len(unit) >= 14:
        b = unit[9:14]
        return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1, size
    return None, size


def demux(media: bytes) -> Demuxed:
    """Read a transport stream."""
    found = Demuxed(damaged=int(len(media) % PACKET > 0))
    n = len(media) // PACKET
    packets = np.frombuffer(media, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    found.damaged += int(n - np.count_nonzero(good))
    packets = packets if good.all() else packets[good]
    found.packets = len(packets)
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    adapted, loaded = packets[:, 3] & 0x20 > 0, packets[:, 3] & 0x10 > 0
    offsets = np.where(adapted, 5 + packets[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    starts = packets[:, 1] & 0x40 > 0
    loaded &= offsets < PACKET

    def of(pid: int) -> np.ndarray:
        """Packets of an id in order, without repeats; counts gaps."""
        at = np.flatnonzero((pids == pid) & loaded)
        counters = packets[at, 3] & 15
        step = (counters[1:].astype(np.int16) - counters[:-1]) & 15
        repeats = np.zeros(len(at), dtype=bool)
        for k in np.flatnonzero(step == 0).tolist():
            repeats[k + 1] = np.array_equal(packets[at[k]], packets[at[k + 1]])
        announced = flags[at[1:]] & 0x80 > 0
        found.errors += int(np.count_nonzero((step != 1) & ~repeats[1:] & ~announced))
        return at[~repeats]

    at = of(PAT_PID)
    for section in _sections(packets[at], offsets[at], starts[at]):
        if section[0] == 0:
            for k in range(8, len(section) - 4, 4):
                if number := int.from_bytes(section[k : k + 2], "big"):
                    found.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
    for pid in sorted(set(found.programs.values())):
        at = of(pid)
        for section in _sections(packets[at], offsets[at], starts[at]):
            if section[0] == 2:
                k = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while k + 5 <= len(section) - 4:
                    found.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                    k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0x0FFF)
    pieces, size = [], 0
    for pid in sorted(found.streams):
        at = of(pid)
        first = np.flatnonzero(starts[at])
        if len(at) and (not len(first) or first[0] > 0):
            found.errors += 1
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=False):
            own = at[a:b]
            whole = packets[own]
            unit = whole[np.arange(PACKET) >= offsets[own][:, None]].tobytes()
            if unit[:3] != b"\x00\x00\x01":
                found.errors += 1
                continue
            declared = int.from_bytes(unit[4:6], "big")
            if declared:
                unit = unit[: 6 + declared]
            pts, head = _pts(unit)
            data = unit[head:]
            found.units.append((pid, pts, bool(flags[own[0]] & 0x40), size, len(data)))
            pieces.append(data)
            size += len(data)
    found.payload = b"".join(pieces)
    return found


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with zeros up to a positive multiple of ``PAYLOAD_UNIT``, and its size without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT - len(raw)), len(raw)


UNITS = "array<struct<pid: int, pts: long, random_access: boolean, offset: long, size: long>>"
_UNIT = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64())])


def _rows(units: list[tuple[int, int | None, bool, int, int]]) -> list[dict]:
    return [dict(zip(("pid", "pts", "random_access", "offset", "size"), u, strict=True)) for u in units]


def muxed_units(size: int) -> list[tuple[int, int, bool, int, int]]:
    """The units that ``mux`` makes of so many bytes, as in ``Demuxed``."""
    return [(ES_PID, k * TICKS, k % KEY_UNITS == 0, at, min(UNIT_BYTES, size - at)) for k, at in enumerate(range(0, size, UNIT_BYTES))]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, units): every whole text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = [padded(t) for t in part.column("text").to_pylist()]
            units = pa.array([_rows(muxed_units(len(p))) for p, _ in made], pa.list_(_UNIT))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary()), units], ["doc_id", "n_bytes", "media", "units"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_bytes long, media binary, units {UNITS}")


def parse(media: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and what the bytes in ``media`` hold: programs, streams, units, payload digests and features."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_UNIT)]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for stored in part.column("media").to_pylist():
                found = demux(stored or b"")
                rows.append((len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-PAYLOAD_UNIT:]), len(stored or b""), hashlib.sha256(stored or b"").hexdigest(), found.feature(), _rows(found.units)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as transport streams and read back from the files."""
    return parse(materialise(store(table(spark, sf_dir, "documents")), "transport-streams")).drop("units")
