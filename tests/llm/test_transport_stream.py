"""Transport streams: round trips, damage, and the query against a direct computation."""

import hashlib
import random
import zlib

import pytest

from graphloom.llm import transport_stream as M
from tests.llm import data


def test_round_trips():
    rng = random.Random(1)
    for n in [64 * k for k in range(1, 60)] + [M.UNIT_BYTES + d for d in (-64, 0, 64)] + [5 * M.UNIT_BYTES + 64]:
        payload = rng.randbytes(n)
        media = M.mux(payload)
        found = M.demux(media)
        assert found.payload == payload and len(media) % 188 == 0 and not found.errors and not found.damaged
        assert found.programs == {1: M.PMT_PID} and found.streams == {M.ES_PID: M.STREAM_TYPE}
        assert [u[1] for u in found.units] == [k * M.TICKS for k in range(-(-n // M.UNIT_BYTES))]
        assert [u[2] for u in found.units] == [k % M.KEY_UNITS == 0 for k in range(len(found.units))]


def test_crc():
    assert M.crc_mpeg(b"123456789") == 0x0376E6E7


def test_damage():
    payload = random.Random(2).randbytes(64 * 300)
    media = M.mux(payload)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    lost = M.demux(b"".join(packets[:10] + packets[11:]))
    assert lost.errors == 1 and lost.payload != payload
    twice = M.demux(b"".join(packets[:10] + [packets[9]] + packets[10:]))
    assert twice.errors == 0 and twice.payload == payload
    assert M.demux(media[:-1]).damaged == 1
    wrong = M.demux(b"".join([*packets[:5], b"\x00" * 188, *packets[5:]]))
    assert wrong.damaged == 1 and wrong.payload == payload
    table = bytearray(packets[0])
    table[14] ^= 1
    assert M.demux(bytes(table) + b"".join(packets[1:])).units == []
    headless = M.demux(b"".join([*packets[:2], *packets[3:]]))
    assert headless.units == [] and headless.errors == 1
    assert M.demux(b"").feature() == "packets=0;damaged=0;programs=0;streams=;units=0;entries=0;errors=0;pts=-1--1"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ts")
    data.frame(spark).write.parquet(str(path / "documents.parquet"))
    return {r["doc_id"]: r for r in M.op5_transport_stream(spark, str(path)).collect()}


def test_query(found):
    rows = data.documents()
    assert len(found) == len(rows)
    for k, text, _, _ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = found[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = M.mux(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert found[0]["feature"] == found[60]["feature"]


def test_empty(spark):
    assert M.parse(M.store(data.frame(spark, []))).count() == 0


def test_query_reads_what_it_has_written(spark, tmp_path):
    data.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = M.op5_transport_stream(spark, str(tmp_path))
    files = found.inputFiles()
    assert files and all("/transport-streams-" in f for f in files)
    stored = {r["doc_id"]: r for r in spark.read.parquet(*files).collect()}
    rows = found.collect()
    assert len(rows) == len(stored) == len(data.documents())
    for r in rows:
        media = bytes(stored[r["doc_id"]]["media"])
        assert hashlib.sha256(media).hexdigest() == r["media_sha256"]
        assert [tuple(u) for u in stored[r["doc_id"]]["units"]] == M.demux(media).units


def crc_by_bits(data):
    c = 0xFFFFFFFF
    for bit in (byte >> k & 1 for byte in data for k in range(7, -1, -1)):
        c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if c >> 31 ^ bit else 0)
    return c.to_bytes(4, "big")


def plain_stream(payload):
    """The stream of a payload, packet by packet, from the format's description."""
    pat = bytes.fromhex("00b00d0001c100000001e100")
    pmt = bytes.fromhex("02b0120001c10000e101f00006e101f000")
    packets, counters = [], {0: 0, 0x100: 0, 0x101: 0}

    def add(pid, start, adaptation, data):
        control = (2 if adaptation is not None else 0) + 1
        head = bytes([0x47, (0x40 if start else 0) + (pid >> 8), pid & 255, control * 16 + counters[pid] % 16])
        counters[pid] += 1
        packets.append(head + (b"" if adaptation is None else bytes([len(adaptation)]) + adaptation) + data)
        assert len(packets[-1]) == 188

    for number in range(-(-len(payload) // 32768)):
        data, pts = payload[number * 32768 : (number + 1) * 32768], number * 3600
        bits = f"{pts:033b}"
        stamp = int("0010" + bits[:3] + "1" + bits[3:18] + "1" + bits[18:] + "1", 2).to_bytes(5, "big")
        unit = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + data
        clock = None
        if number % 4 == 0:
            for pid, section in ((0, pat), (0x100, pmt)):
                whole = b"\0" + section + crc_by_bits(section)
                add(pid, True, None, whole + b"\xff" * (184 - len(whole)))
            clock = b"\x50" + int(f"{pts:033b}" + "1" * 6 + "0" * 9, 2).to_bytes(6, "big")
        start = True
        while unit:
            adaptation = clock if start else None
            room = 184 - (0 if adaptation is None else 1 + len(adaptation))
            if len(unit) < room:
                size = 183 - len(unit)
                adaptation = ((adaptation or b"\0") + b"\xff" * 184)[:size]
            took = unit[:room]
            add(0x101, start, adaptation, took)
            unit, start = unit[len(took) :], False
    return b"".join(packets)


def test_against_a_plain_writer(found):
    for k, text, _, _ in data.documents():
        raw = (text or "").encode()
        media = plain_stream(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
        units = -(-max(64, len(raw)) // 32768)
        feature = f"packets={len(media) // 188};damaged=0;programs=1;streams=06;units={units};entries={-(-units // 4)};errors=0;pts=0-{(units - 1) * 3600}"
        assert (found[k]["media_bytes"], found[k]["media_sha256"], found[k]["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), feature), k
    for n in [64 * k for k in range(1, 12)] + [32768 * 9 + 64]:
        payload = random.Random(n).randbytes(n)
        assert M.mux(payload) == plain_stream(payload)


def test_query_on_an_empty_table(spark, tmp_path):
    data.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert M.op5_transport_stream(spark, str(tmp_path)).count() == 0
