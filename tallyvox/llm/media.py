"""MPEG transport streams as a column: multiplex bytes into 188-byte packets, and read such packets back.

A stream is one program with one elementary stream. Program tables come first and again before every TABLE_EVERY
elementary packets; each elementary packet holds up to UNITS units of UNIT bytes, a presentation timestamp and, in
the adaptation field of its first transport packet, a clock reference and the random-access mark. The reader checks
sync bytes, table checksums and continuity counters, reassembles the elementary packets and keeps their timestamps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, text_list

UNIT, UNITS, TABLE_EVERY = 192, 64, 16
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Fixed values of the format.
PACKET, SYNC, PRIVATE_STREAM, PRIVATE_DATA = 188, 0x47, 0xBD, 0x06
#: Ticks of 90 kHz for a unit: 192 samples at 48 kHz.
TICKS = 360


def crc_mpeg(data: bytes) -> int:
    """The 32-bit checksum of program tables: most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    out, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT * UNITS)):
        if number % TABLE_EVERY == 0:
            for table in (_PAT, _PMT):
                out.append(table[:3] + bytes([0x10 | tables & 15]) + table[4:])
            tables += 1
        data, ticks = payload[at : at + UNIT * UNITS], at // UNIT * TICKS
        body = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        rest = len(body) - 176  # the first packet also has 8 bytes of adaptation field
        whole, tail = divmod(rest, 184)
        rows = np.full((1 + whole + (tail > 0), PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0x10
        raw = np.frombuffer(body, np.uint8)
        rows[0, 1] |= 0x40
        rows[0, 3] = 0x30
        rows[0, 4:12] = (7, 0x50, ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, 0)
        rows[0, 12:] = raw[:176]
        rows[1 : 1 + whole, 4:] = raw[176 : 176 + whole * 184].reshape(whole, 184)
        if tail:
            rows[-1, 3], rows[-1, 4] = 0x30, 183 - tail
            if tail < 183:
                rows[-1, 5] = 0
            rows[-1, PACKET - tail :] = raw[-tail:]
        rows[:, 3] |= ((counter + np.arange(len(rows))) & 15).astype(np.uint8)
        counter += len(rows)
        out.append(rows.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: the payload of whole elementary packets, a (timestamp, number of the packet, random access) for each, and counts.

    gaps are jumps of the continuity counter, repeats packets sent twice, damaged elementary packets that are not in the
    payload, and faults what is wrong below them: packets without a sync byte or with an error mark, and damaged tables.
    """

    payload: bytes = b""
    stamps: list[tuple[int, int, bool]] = field(default_factory=list)
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    damaged: int = 0
    faults: list[str] = field(default_factory=list)


def _read_section(packet: np.ndarray, table: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4]
    size = int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF
    section = raw[at : at + 3 + size]
    if section[0] != table or crc_mpeg(section):
        raise ValueError("a program table is damaged")
    return section


_READ: dict[bytes, bytes] = {}


def _section_of(packet: np.ndarray, table: int) -> bytes:
    """As tables repeat from stream to stream, a section that was checked is remembered; there are few of them."""
    key = packet.tobytes()[4:]
    if key not in _READ:
        if len(_READ) > 64:
            _READ.clear()
        _READ[key] = _read_section(packet, table)
    return _READ[key]


def _map_pid(pat: bytes) -> int | None:
    """Where the map of our program is, by an association table."""
    programs = {int.from_bytes(pat[k : k + 2], "big"): int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF for k in range(8, len(pat) - 4, 4)}
    return programs.get(PROGRAM)


def _media_pid(pmt: bytes) -> int:
    """Where the first elementary stream is, by a program map."""
    info = int.from_bytes(pmt[10:12], "big") & 0xFFF
    return int.from_bytes(pmt[13 + info : 15 + info], "big") & 0x1FFF


def _in_force(at: np.ndarray, pid_of: Callable[[int], int | None], packets: int, out: Stream, missing: str) -> np.ndarray:
    """For each packet the pid that the last table before it names; the first table also holds for what comes before it. Every table's checksum is tested; a damaged one is a fault, and the one before it stays in force."""
    named: list[tuple[int, int]] = []
    for i in at:
        try:
            pid = pid_of(i)
        except (ValueError, IndexError):
            out.faults.append("a program table is damaged")
            continue
        if pid is not None:
            named.append((i, pid))
    if not named:
        out.faults.append(missing)
        return np.full(packets, -1)
    where, pids = np.array(named).T
    return pids[np.maximum(np.searchsorted(where, np.arange(packets), side="right") - 1, 0)]


#: Bits of a packet: payload and adaptation field follow, start of an elementary packet, error mark; of the adaptation field: discontinuity, random access, clock.
_PAYLOAD, _ADAPTED, _START, _ERROR, _JUMP, _RANDOM, _CLOCK = 0x10, 0x20, 0x40, 0x80, 0x80, 0x40, 0x10


def _repeats(rows: np.ndarray, equal: np.ndarray, clocked: np.ndarray) -> np.ndarray:
    """Which packets repeat the one before: the same counter and bytes, but for the clock, which is said anew; only one repeat is legal."""
    out = np.zeros(len(rows), bool)
    for i in np.flatnonzero(equal) + 1:
        same = rows[i] == rows[i - 1]
        if clocked[i] and clocked[i - 1]:
            same[6:12] = True
        out[i] = bool(same.all()) and not out[i - 1]
    return out


def demux(media: bytes) -> Stream:
    """Read a transport stream back. What is damaged is left out and reported; nothing is raised.

    All program tables are read; where a later one names another pid, the packets of that pid go on from there. The
    counter of a pid rises with each packet that has a payload: packets of an adaptation field alone do not count, a
    packet sent twice is taken once, and a discontinuity mark lets the counter begin anew. An elementary packet that a
    gap or an error mark falls into, or whose bytes do not all come, is damaged.
    """
    out = Stream(packets=len(media) // PACKET)
    if not media or len(media) % PACKET:
        out.faults.append("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8)[: out.packets * PACKET].reshape(-1, PACKET)
    sound = (rows[:, 0] == SYNC) & (rows[:, 1] & _ERROR == 0)
    out.faults += ["a packet is damaged"] * int((~sound).sum())
    at = np.flatnonzero(sound)
    rows = rows[at] if len(at) < out.packets else rows
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    maps = _in_force(np.flatnonzero(pids == 0), lambda i: _map_pid(_section_of(rows[i], 0)), len(rows), out, "no program")
    streams = _in_force(np.flatnonzero((pids == maps) & (pids != 0)), lambda i: _media_pid(_section_of(rows[i], 2)), len(rows), out, "no program map")
    own = rows[mine := np.flatnonzero(pids == streams)]
    adapted = (own[:, 3] & _ADAPTED > 0) & (own[:, 4] > 0)
    jump, random, clocked = (adapted & (own[:, 5] & bit > 0) for bit in (_JUMP, _RANDOM, _CLOCK))
    full = np.flatnonzero(own[:, 3] & _PAYLOAD)
    # A jump holds for the next packet with a payload, its own or a later one.
    jumps = np.zeros(len(full) + 1, bool)
    jumps[np.searchsorted(full, np.flatnonzero(jump))] = True
    own, mine, jump, random, clocked = own[full], mine[full], jumps[:-1], random[full], clocked[full]
    counters, same_pid = (own[:, 3] & 15).astype(np.int16), np.diff(pids[mine]) == 0
    step = np.diff(counters) % 16
    again = _repeats(own, (step == 0) & same_pid, clocked)
    if again.any():
        out.repeats = int(again.sum())
        kept = ~again
        own, mine, jump, random, counters = own[kept], mine[kept], jump[kept], random[kept], counters[kept]
        same_pid, step = np.diff(pids[mine]) == 0, np.diff(counters) % 16
    lost = np.concatenate([[False], (step != 1) & same_pid & ~jump[1:]]) if len(own) else np.zeros(0, bool)
    out.gaps = int(lost.sum())
    begin = np.minimum(np.where(own[:, 3] & _ADAPTED > 0, 5 + own[:, 4].astype(np.int64), 4), PACKET)
    body = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    starts = np.flatnonzero(own[:, 1] & _START)
    losses = np.concatenate([[0], np.cumsum(lost)])
    bounds = [int(ends[i] - (PACKET - begin[i])) for i in starts] + [len(body)]
    parts = []
    for i, after, a, b in zip(starts, np.append(starts, len(own))[1:], bounds[:-1], bounds[1:], strict=True):
        head = body[a : a + 14]
        size = int.from_bytes(head[4:6], "big")
        if head[:3] != b"\x00\x00\x01" or len(head) < 14 or a + 6 + size > b or losses[after] > losses[i + 1]:
            out.damaged += 1
            continue
        t = head[9:14]
        stamp = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
        out.stamps.append((stamp, int(at[mine[i]]), bool(random[i])))
        parts.append(body[a + 9 + head[8] : a + 6 + size])
    out.damaged += int(len(own) > 0 and (len(starts) == 0 or starts[0] > 0))  # what comes before the first start
    out.payload = b"".join(parts)
    return out


def padded(text: str | None) -> bytes:
    raw = text.encode() if text else b""
    return raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media for every row of docs (doc_id, text): the UTF-8 text (null: empty), padded with spaces, as a transport stream.

    Each row is written on its own, so rows may repeat and equal texts give equal streams; other columns of docs are
    ignored, and an empty table stays empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            ids, texts = batch.column("doc_id"), text_list(batch)
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(part)), pa.array([len((t or "").encode()) for t in part], pa.int64()), pa.array([mux(padded(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


_STAMP = pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())])


def read_media(stored: DataFrame) -> DataFrame:
    """Read the media column back: digests of payload and stored form, the timestamps with random-access points, and a feature.

    The feature has packets, elementary packets, random-access points, the last timestamp, counter gaps, and of the
    8-bit samples the sum, the largest and the number of sign changes around 128. damaged counts elementary packets that
    are not in the payload, faults says what else is wrong with a stream, as distinct texts; a damaged stream never ends
    the task. A null media is an empty stream with its faults.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 100):
            rows = []
            for media in batch.column("media"):
                raw = media.as_buffer().to_pybytes() if media.is_valid else b""
                s = demux(raw)
                samples = np.frombuffer(s.payload, np.uint8)
                turns = int(np.count_nonzero(np.diff(samples >= 128)))
                feature = f"ts:{s.packets};pes:{len(s.stamps)};rap:{sum(r for _, _, r in s.stamps)};pts:{s.stamps[-1][0] if s.stamps else -1};gaps:{s.gaps};sum:{int(samples.sum(dtype=np.int64))};max:{int(samples.max(initial=0))};turns:{turns}"
                stamps = [{"pts": p, "packet": n, "random_access": r} for p, n, r in s.stamps]
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, stamps, s.damaged, sorted(set(s.faults))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_STAMP), pa.int64(), pa.list_(pa.string())]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "damaged", "faults"])

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<struct<pts:long,packet:long,random_access:boolean>>, damaged long, faults array<string>")
