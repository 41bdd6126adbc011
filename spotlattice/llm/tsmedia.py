"""Media columns as MPEG transport streams.

``mux`` wraps a payload as one elementary stream: PES packets of a fixed share of the payload, each with a presentation
time stamp, cut into 188-byte transport packets with continuity counters. Every ``ACCESS_EVERY``-th PES packet starts a
random-access point, and the program tables (PAT and PMT, with their CRC) stand before every ``TABLES_EVERY``-th. The stream
is private data without a clock reference, and the PMT says so. ``demux`` goes by what the stream says: it finds the PMT
through the PAT's first program (number 0 is the network, not a program) and the elementary stream through the PMT, checks
every program table and every continuity counter, and puts the PES packets together again by their start flags, for any
PIDs and any order of adaptation fields. ``media_features`` stores the time stamps and the byte places of the
random-access points.

Both work on whole payloads with numpy, in memory proportional to one payload.

Defined cases: a null payload is the empty payload; an empty payload is one PES packet without data; packets that are
repeated, lost or damaged raise ``ValueError`` (a repeated packet with its counter unchanged is dropped, as the
standard allows). Payloads are read back bit for bit; equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
STREAM_TYPE_PRIVATE = 0x06
STREAM_ID_PRIVATE = 0xBD
CRC_POLY = 0x04C11DB7
CLOCK = 90_000
PTS_MODULUS = 1 << 33
NO_PCR = 0x1FFF

#: Payload bytes of a PES packet, its duration in ticks of the 90 kHz clock, and PES packets from one PAT to the next, and
#: from one random-access point to the next.
PES_BYTES, PES_TICKS, TABLES_EVERY, ACCESS_EVERY = 2048, 3600, 16, 4
#: Samples are padded with zero bytes to a positive multiple of this.
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | NO_PCR >> 8, NO_PCR & 0xFF, 0xF0, 0, STREAM_TYPE_PRIVATE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | (pts >> 14) & 0xFE, pts >> 7 & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of ALIGN."""
    return data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


def _pes_packets(pes: bytes, counter: int, access: bool) -> np.ndarray:
    """Transport packets of one PES packet. The first has an adaptation field, which tells whether it is a random-access
    point, the last is filled up by stuffing in one."""
    first, full = PACKET - 4 - 2, PACKET - 4
    rest = max(0, len(pes) - first)
    n = 1 + -(-rest // full)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[:, 2] = DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    data = np.frombuffer(pes, np.uint8)
    spare = max(0, first - len(data))
    out[0, 4], out[0, 5] = 1 + spare, 0x40 if access else 0
    out[0, 6 + spare :] = data[:first]
    if n > 1:
        whole, tail = divmod(rest, full)
        out[1 : 1 + whole, 4:] = data[first : first + whole * full].reshape(whole, full)
        if tail:
            gap = full - tail
            out[-1, 3] |= 0x20
            out[-1, 4] = gap - 1
            if gap > 1:
                out[-1, 5] = 0
            out[-1, 4 + gap :] = data[first + whole * full :]
    return out


def mux(payload: bytes) -> bytes:
    parts, counter, tables = [], 0, 0
    for k in range(max(1, -(-len(payload) // PES_BYTES))):
        if k % TABLES_EVERY == 0:
            for packet in (_PAT, _PMT):
                parts.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        chunk = payload[k * PES_BYTES : (k + 1) * PES_BYTES]
        head = b"\0\0\1" + bytes([STREAM_ID_PRIVATE]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(k * PES_TICKS % PTS_MODULUS)
        packets = _pes_packets(head + chunk, counter, k % ACCESS_EVERY == 0)
        counter = (counter + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


@lru_cache(maxsize=256)
def _table_body(raw: bytes, table_id: int) -> bytes:
    """The body of the section in a packet, when its checksum is right."""
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    length = (raw[at + 1] & 0x0F) << 8 | raw[at + 2]
    section = raw[at : at + 3 + length]
    if raw[at] != table_id or crc32_mpeg(section):
        raise ValueError("damaged program table")
    return section[8:-4]


def _tables(packets: np.ndarray, table_id: int, missing: str) -> bytes:
    """The first one's body, when each of the tables has been checked; equal packets are checked once."""
    if not len(packets):
        raise ValueError(missing)
    plain = packets.copy()
    plain[:, 3] &= 0xF0  # but for the counter
    return [_table_body(packet.tobytes(), table_id) for packet in plain][0]


def demux(stream: bytes) -> tuple[bytes, list[int], list[int]]:
    """The payload, the time stamps, and for each random-access point the payload offset where it starts."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    if (p[:, 1] & 0x80).any():
        raise ValueError("transport error flag")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    body = _tables(p[pid == PAT_PID], 0, "no program association table")
    programs = [e for e in zip(*[iter(body)] * 4, strict=False) if e[0] << 8 | e[1]]
    if not programs:
        raise ValueError("no program")
    pmt_pid = (programs[0][2] & 0x1F) << 8 | programs[0][3]
    body = _tables(p[pid == pmt_pid], 2, "no program map table")
    skip = 4 + ((body[2] & 0x0F) << 8 | body[3])
    es_pid = (body[skip + 1] & 0x1F) << 8 | body[skip + 2]
    for x in (PAT_PID, pmt_pid):  # the tables' counters
        counters = p[pid == x, 3] & 15
        if len(counters) > 1 and ((counters[:-1] + 1) & 15 != counters[1:]).any():
            raise ValueError("continuity of tables")
    es = p[pid == es_pid]
    es = es[(es[:, 3] & 0x10) > 0]
    if not len(es):
        raise ValueError("no elementary packets")
    counters = es[:, 3] & 15
    again = np.zeros(len(es), bool)
    again[1:] = (counters[1:] == counters[:-1]) & (es[1:] == es[:-1]).all(axis=1)
    if again.any():
        es, counters = es[~again], counters[~again]
    if ((counters[:-1] + 1) & 15 != counters[1:]).any():
        raise ValueError("continuity of the elementary stream")
    field = (es[:, 3] & 0x20) > 0
    begin = np.where(field, 5 + es[:, 4].astype(np.int32), 4)
    flags = np.where(field & (es[:, 4] > 0), es[:, 5], 0)
    starts = np.flatnonzero(es[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise ValueError("the first packet starts no PES packet")
    keep = np.arange(PACKET) >= begin[:, None]
    data = es[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(PACKET - begin)])
    out, stamps, points, size = [], [], [], 0
    for i, k in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else len(es)
        pes = data[at[k] : at[end]]
        if pes[:3] != b"\0\0\1" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("damaged PES packet")
        if flags[k] & 0x40:
            points.append(size)
        if pes[7] & 0x80:
            stamps.append(_pts_value(pes[9:14]))
        chunk = pes[9 + pes[8] :]
        size += len(chunk)
        out.append(chunk)
    return b"".join(out), stamps, points


def encode(data: Column) -> Column:
    """binary -> the stored stream of the padded payload."""

    @F.pandas_udf("binary")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: mux(pad(bytes(x or b""))))

    return run(data)


def decode(stream: Column) -> Column:
    """The stored stream -> its payload's digests, its size, and the features that were read from it."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pts array<long>, access_points array<long>")
    def run(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in map(bytes, xs):
            payload, stamps, points = demux(x)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(x), hashlib.sha256(x).hexdigest(), stamps, points))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pts", "access_points"])

    return run(stream)


def with_media(df: DataFrame, *, data: str = "text", media: str = "media") -> DataFrame:
    """df with the media column; a string column is taken as UTF-8, null as empty."""
    return df.withColumn(media, encode(F.coalesce(F.col(data).cast("binary"), F.lit(b""))))


def media_features(df: DataFrame, *, media: str = "media", out: str = "media_info") -> DataFrame:
    """df with what the stream holds, as a struct: digests, time stamps and random-access points."""
    return df.withColumn(out, decode(F.col(media)))
