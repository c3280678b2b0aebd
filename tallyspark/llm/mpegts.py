"""Media columns: MPEG transport streams.

``mux`` stores a payload as a transport stream: access units of at most ``UNIT`` bytes, each one a
PES packet with a presentation time stamp; every ``GOP``-th unit is a random-access point, with the
program tables (PAT, PMT) before it. ``demux`` reads any stream of 188-byte packets: it parses the
program tables and their checksums, checks continuity counters, puts the elementary packets back
together and lists each PES packet's time stamps and random-access flag.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat

PACKET, BLOCK = 188, 576
UNIT, GOP = 4 * BLOCK, 8
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
#: Ticks of the 90 kHz clock from one unit to the next, and the first time stamp.
TICKS, FIRST_PTS = 3600, 90_000


@lru_cache(4096)
def crc32_mpeg(section: bytes) -> int:
    """The checksum of program tables: polynomial 0x04C11DB7, not reflected, from all ones."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _pid(pid: int, flags: int = 0xE000) -> bytes:
    return (flags | pid).to_bytes(2, "big")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + _pid(PMT_PID))
PMT = _section(2, PROGRAM, _pid(ES_PID) + b"\xf0\x00" + bytes([STREAM_TYPE]) + _pid(ES_PID) + b"\xf0\x00")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    return np.frombuffer((b"\x47" + _pid(pid, 0x4000) + b"\x10\x00" + section).ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(64)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The packets of a unit of ``size`` bytes without payload and clocks, and where the payload goes."""
    head = 8 + 14  # adaptation field with a clock reference; PES header with a time stamp
    n = 1 + max(0, -(-(size - (PACKET - 4 - head)) // (PACKET - 4)))
    out = np.zeros((n, PACKET), np.uint8)
    place = np.zeros((n, PACKET), bool)
    left = size
    for i in range(n):
        out[i, :4] = [0x47, (0x40 if i == 0 else 0) | ES_PID >> 8, ES_PID & 255, 0x30 if i == 0 else 0x10]
        at = 4 + (head if i == 0 else 0)
        spare = PACKET - at - left
        if i == 0:
            extra = max(spare, 0)
            out[0, 4], out[0, 5] = 7 + extra, 0x10
            out[0, 12 : 12 + extra] = 255
            pes = 12 + extra
            out[0, pes : pes + 9] = [0, 0, 1, 0xBD, (size + 8) >> 8, (size + 8) & 255, 0x84, 0x80, 5]
            at += extra
        elif spare > 0:
            out[i, 3] = 0x30
            out[i, 4] = spare - 1
            if spare > 1:
                out[i, 5] = 0
                out[i, 6 : 4 + spare] = 255
            at += spare
        place[i, at:] = True
        left -= PACKET - at
    return out, np.flatnonzero(place.ravel())


def mux(payload: np.ndarray) -> np.ndarray:
    """The transport stream of a payload of at least one byte."""
    n = -(-len(payload) // UNIT)
    parts = []
    for first, count, size in ((0, len(payload) // UNIT, UNIT), (len(payload) // UNIT, n - len(payload) // UNIT, len(payload) % UNIT)):
        if not count:
            continue
        template, place = _layout(size)
        units = np.broadcast_to(template, (count, *template.shape)).copy().reshape(count, -1)
        units[:, place] = payload[first * UNIT : first * UNIT + count * size].reshape(count, size)
        pts = FIRST_PTS + TICKS * np.arange(first, first + count)
        clock = pts - TICKS
        pes = 5 + int(template[0, 4])
        for j, value in enumerate((clock >> 25, clock >> 17, clock >> 9, clock >> 1, (clock & 1) << 7 | 0x7E, 0)):
            units[:, 6 + j] = value & 255
        for j, value in enumerate((0x21 | pts >> 29 & 0x0E, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)):
            units[:, pes + 9 + j] = value & 255
        random = np.arange(first, first + count) % GOP == 0
        units[random, 5] |= 0x40
        parts.append((units.reshape(count, -1, PACKET), first))
    es = np.concatenate([p.reshape(-1, PACKET) for p, _ in parts])
    es[:, 3] |= (np.arange(len(es)) & 15).astype(np.uint8)
    per_unit = _layout(UNIT)[0].shape[0]
    points = np.arange(-(-n // GOP)) * GOP * per_unit  # packets before each random-access point
    tables = np.stack([_table_packet(0, PAT), _table_packet(PMT_PID, PMT)])
    out = np.insert(es, np.repeat(points, 2), np.tile(tables, (len(points), 1)), axis=0)
    heads = np.repeat(points, 2) + np.arange(2 * len(points))
    out[heads, 3] |= (np.repeat(np.arange(len(points)), 2) & 15).astype(np.uint8)
    return out.reshape(-1)


_COLUMNS = np.arange(PACKET, dtype=np.int64)


@dataclass
class Stream:
    """What ``demux`` found for one elementary stream; payload[starts[i]:starts[i + 1]] is PES packet i."""

    pid: int
    program: int
    stream_type: int
    payload: bytes
    starts: np.ndarray
    pts: np.ndarray
    dts: np.ndarray
    random_access: np.ndarray
    packets: int


@dataclass
class Parsed:
    packets: int = 0
    bad_sync: int = 0
    cc_errors: int = 0
    bad_tables: int = 0
    truncated: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)


def _stamp(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.int64)
    return (b[:, 0] >> 1 & 7) << 30 | b[:, 1] << 22 | (b[:, 2] >> 1) << 15 | b[:, 3] << 7 | b[:, 4] >> 1


def _sections(packets: np.ndarray, start: np.ndarray, body: np.ndarray, bad: Parsed) -> Iterator[bytes]:
    """The sections with a right checksum in packets of one PID; equal packets are read once."""
    seen: dict[bytes, bool] = {}
    rows, pending = np.flatnonzero(body < PACKET), b""
    for i in rows:
        data = packets[i, body[i] :].tobytes()
        if start[i]:
            pointer = data[0]
            chunk, pending = pending + data[1 : 1 + pointer], data[1 + pointer :]
        else:
            chunk, pending = b"", pending + data
        for blob in (chunk, pending):
            while len(blob) >= 3 and blob[0] != 0xFF:
                size = 3 + ((blob[1] & 15) << 8 | blob[2])
                if len(blob) < size:
                    break
                section, blob = blob[:size], blob[size:]
                if section not in seen:
                    seen[section] = len(section) >= 12 and crc32_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big")
                    if seen[section]:
                        yield section
                bad.bad_tables += not seen[section]
            if blob is not chunk and len(blob) < PACKET and (not blob or blob[0] == 0xFF):
                pending = b""


def demux(stored: np.ndarray) -> Parsed:
    """Reads a stream. Packets without the sync byte are counted and left out; bytes after the last whole packet count as truncated."""
    n = len(stored) // PACKET
    out = Parsed(packets=n, truncated=len(stored) - n * PACKET)
    packets = stored[: n * PACKET].reshape(n, PACKET)
    good = packets[:, 0] == 0x47
    out.bad_sync = int(n - good.sum())
    if out.bad_sync:
        packets = packets[good]
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    start = (packets[:, 1] & 0x40) > 0
    has_field, has_body = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0
    body = np.where(has_field, 5 + packets[:, 4].astype(np.int64), 4)
    body = np.where(has_body, np.minimum(body, PACKET), PACKET)
    flags = np.where(has_field & (packets[:, 4] > 0), packets[:, 5], 0)
    counter = packets[:, 3] & 15
    for p in np.unique(pid):
        if p == 0x1FFF:
            continue
        at = np.flatnonzero(pid == p)
        step = (counter[at[1:]].astype(np.int64) - counter[at[:-1]]) & 15
        odd = np.flatnonzero((step != has_body[at[1:]]) & (flags[at[1:]] & 0x80 == 0))
        if len(odd):  # one exact repeat of a packet is allowed
            odd = odd[~((step[odd] == 0) & (packets[at[odd + 1]] == packets[at[odd]]).all(1))]
        out.cc_errors += len(odd)
    kinds: dict[int, tuple[int, int]] = {}
    for section in _sections(packets[pid == 0], start[pid == 0], body[pid == 0], out):
        for i in range(8, len(section) - 4, 4):
            program, where = int.from_bytes(section[i : i + 2], "big"), int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
            if program:
                out.programs[program] = where
    for program, where in out.programs.items():
        mine = pid == where
        for section in _sections(packets[mine], start[mine], body[mine], out):
            i = 12 + ((section[10] & 15) << 8 | section[11])
            while i + 5 <= len(section) - 4:
                kinds[(section[i + 1] & 0x1F) << 8 | section[i + 2]] = (program, section[i])
                i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
    for p, (program, kind) in sorted(kinds.items()):
        mine = pid == p
        rows, begins, heads, marks = packets[mine], start[mine], body[mine], flags[mine]
        first = np.flatnonzero(begins & (heads <= PACKET - 9))
        if len(first):
            rows, heads, marks, first = rows[first[0] :], heads[first[0] :].copy(), marks[first[0] :], first - first[0]
            base = heads[first]
            lead = rows[first[:, None], np.minimum(base[:, None] + np.arange(19), PACKET - 1)]
            pes = (lead[:, 0] == 0) & (lead[:, 1] == 0) & (lead[:, 2] == 1)
            which = np.where(pes, lead[:, 7] >> 6, 0)
            pts = np.where(which >= 2, _stamp(lead[:, 9:14]), -1)
            dts = np.where(which == 3, _stamp(lead[:, 14:19]), pts)
            heads[first] = np.minimum(base + 9 + lead[:, 8], PACKET)
        else:
            rows, pts, dts = rows[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
            heads, marks = heads[:0], marks[:0]
        payload = rows[_COLUMNS >= heads[:, None]]
        sizes = np.concatenate([[0], np.cumsum(PACKET - heads)])
        out.streams.append(Stream(int(p), program, kind, payload.tobytes(), sizes[first] if len(rows) else np.zeros(0, np.int64), pts, dts, (marks[first] & 0x40) > 0 if len(rows) else np.zeros(0, bool), len(rows)))
    return out


def transport_streams(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, stored (binary transport stream) and n_bytes for each row.

    The payload is the text as UTF-8, then bytes 255 up to a positive multiple of ``BLOCK``; a null
    or empty text gives one block of 255. Every row has a row, repeated or not.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, "__text"):
            buf, off = flat.flat(piece.column("__text"))
            yield flat.table({"doc_id": piece.column("doc_id"), "n_bytes": np.diff(off), "stored": pa.array([mux(padded(buf[a:b])).tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())})

    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, stored binary")


def padded(data: np.ndarray) -> np.ndarray:
    out = np.full(max(1, -(-len(data) // BLOCK)) * BLOCK, 255, np.uint8)
    out[: len(data)] = data
    return out


def elementary_packets(streams: DataFrame, stored: str = "stored") -> DataFrame:
    """A row for each PES packet of each stream: doc_id, program, pid, stream_type, unit, pts, dts, random_access, n_bytes, cc_errors, bad_tables.

    A null or empty stream, and one without program tables, has no rows. -1 stands for a time stamp that isn't there.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, "__stored"):
            for ident, blob in zip(piece.column("doc_id"), piece.column("__stored").to_pylist(), strict=True):
                found = demux(np.frombuffer(blob or b"", np.uint8))
                for s in found.streams:
                    k = len(s.starts)
                    yield flat.table({"doc_id": pa.array([ident.as_py()] * k, piece.schema.field("doc_id").type), "program": np.full(k, s.program, np.int32), "pid": np.full(k, s.pid, np.int32), "stream_type": np.full(k, s.stream_type, np.int32), "unit": np.arange(k), "pts": s.pts, "dts": s.dts, "random_access": s.random_access, "n_bytes": np.diff(np.append(s.starts, len(s.payload))), "cc_errors": np.full(k, found.cc_errors), "bad_tables": np.full(k, found.bad_tables)})

    return streams.select("doc_id", F.col(stored).alias("__stored")).mapInArrow(read, f"doc_id {streams.schema['doc_id'].dataType.simpleString()}, program int, pid int, stream_type int, unit long, pts long, dts long, random_access boolean, n_bytes long, cc_errors long, bad_tables long")


def digests(streams: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and counts, from the stored streams read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, "stored"):
            rows = []
            for blob in piece.column("stored").to_pylist():
                found = demux(np.frombuffer(blob, np.uint8))
                s = found.streams[0]
                points = np.flatnonzero(s.random_access)
                feature = f"packets={found.packets};units={len(s.starts)};points={len(points)};pts={s.pts[0]}-{s.pts[-1]};cc_errors={found.cc_errors};bad_tables={found.bad_tables};mean={np.frombuffer(s.payload, np.uint8).mean():.4f}" if len(s.starts) else "none"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, len(s.starts), len(points), found.cc_errors))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_units", "n_points", "cc_errors")
            yield flat.table({"doc_id": piece.column("doc_id"), "n_bytes": piece.column("n_bytes")} | {k: pa.array(v) for k, v in zip(names, zip(*rows, strict=True), strict=True)})

    return streams.mapInArrow(read, f"doc_id {streams.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_points long, cc_errors long")
