"""Transport streams altered as the standard allows, and damaged, against a reader that goes packet by packet."""

import random

import pytest

from tallyvox.llm import media

P = media.PACKET


def plain_read(raw):
    """(payload, gaps, repeats, damaged), one packet after the other, for streams of one program whose tables stand as written."""
    units, gaps, repeats, before, last, jump, current, early = [], 0, 0, None, None, False, None, 0
    for k in range(len(raw) // P):
        p = raw[k * P : (k + 1) * P]
        if p[0] != 0x47 or p[1] & 0x80 or (p[1] & 0x1F) << 8 | p[2] != media.MEDIA_PID:
            continue
        adapted = p[3] & 0x20 and p[4]
        jump = jump or bool(adapted and p[5] & 0x80)
        if not p[3] & 0x10:
            continue
        if last is not None and p[3] & 15 == last[3] & 15 and before != "repeat":
            a, b = bytearray(p), bytearray(last)
            if adapted and p[5] & 0x10 and last[3] & 0x20 and last[4] and last[5] & 0x10:
                a[6:12] = b[6:12] = bytes(6)
            if a == b:
                repeats, before, last = repeats + 1, "repeat", p
                continue
        lost = last is not None and (p[3] & 15) != (last[3] + 1) & 15 and not jump
        gaps += lost
        before, last, jump = "new", p, False
        data = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40:
            current = [data, False]
            units.append(current)
        elif current is None:
            early = 1
        else:
            current[0] += data
            current[1] |= lost
    parts, damaged = [], early
    for data, lost in units:
        size = int.from_bytes(data[4:6], "big")
        if data[:3] != b"\x00\x00\x01" or len(data) < 6 + size or lost:
            damaged += 1
        else:
            parts.append(data[9 + data[8] : 6 + size])
    return b"".join(parts), gaps, repeats, damaged


def packets(raw):
    return [bytearray(raw[i : i + P]) for i in range(0, len(raw), P)]


def own(ps):
    return [i for i, p in enumerate(ps) if (p[1] & 0x1F) << 8 | p[2] == media.MEDIA_PID]


def empty_packet(counter, mark=0):
    """An adaptation field alone: its counter must not rise."""
    return bytearray([0x47, media.MEDIA_PID >> 8, media.MEDIA_PID & 0xFF, 0x20 | counter, 183, mark]) + bytearray(b"\xff" * 182)


def repeat(ps, i):
    ps.insert(i + 1, bytearray(ps[i]))


def repeat_with_new_clock(ps, i):
    i = next(j for j in own(ps) if ps[j][1] & 0x40)
    ps.insert(i + 1, bytearray(ps[i]))
    ps[i + 1][6:12] = b"\x01\x02\x03\x04\x7e\x00"


def repeat_twice(ps, i):
    ps[i + 1 : i + 1] = [bytearray(ps[i]), bytearray(ps[i])]


def no_payload(ps, i):
    ps.insert(i + 1, empty_packet(ps[i][3] & 15))


def jump_before(ps, i):
    ps.insert(i, empty_packet(0, 0x80))
    for j in own(ps):
        if j > i:
            ps[j][3] = ps[j][3] & 0xF0 | (ps[j][3] + 5) & 15


def lose(ps, i):
    del ps[i]


def error_mark(ps, i):
    ps[i][1] |= 0x80


def no_sync(ps, i):
    ps[i][0] = 0


def lose_start(ps, i):
    del ps[next(j for j in own(ps) if ps[j][1] & 0x40)]


CLEAN = [repeat, repeat_with_new_clock, no_payload, jump_before]
DAMAGE = [repeat_twice, lose, error_mark, no_sync, lose_start]


@pytest.mark.parametrize("change", CLEAN + DAMAGE)
def test_altered_streams(change):
    rng = random.Random(change.__name__)
    for _ in range(25):
        payload = rng.randbytes(media.UNIT * rng.randint(1, 90))
        ps = packets(media.mux(payload))
        for _ in range(1 if change in CLEAN or change is lose_start else rng.randint(1, 3)):
            change(ps, rng.choice(own(ps)[1:] or own(ps)))
        raw = b"".join(ps)
        got = media.demux(raw)
        assert (got.payload, got.gaps, got.repeats, got.damaged) == plain_read(raw)
        if change in CLEAN:
            assert got.payload == payload and got.gaps == got.damaged == 0 and not got.faults


def test_mixed_damage():
    rng = random.Random(8)
    for _ in range(60):
        ps = packets(media.mux(rng.randbytes(media.UNIT * rng.randint(1, 120))))
        for change in rng.choices(CLEAN + DAMAGE, k=rng.randint(1, 6)):
            if len(own(ps)) > 2 and any(ps[j][1] & 0x40 and ps[j][3] & 0x10 for j in own(ps)):
                change(ps, rng.choice(own(ps)[1:]))
        raw = b"".join(ps)
        got = media.demux(raw)
        assert (got.payload, got.gaps, got.repeats, got.damaged) == plain_read(raw)


def test_what_is_no_stream_is_reported(spark):
    for raw in (b"", b"abc", b"\x47" * P, bytes(P * 3), media.mux(b"x" * 192)[:-5], media.mux(b"x" * 192)[P * 2 :]):
        assert media.demux(raw).faults
    rows = spark.createDataFrame([(1, 3, bytearray(b"abc")), (2, 3, None), (3, 3, bytearray(media.mux(b"abc".ljust(192))))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.read_media(rows).collect()}
    assert got[1]["faults"] and got[2]["faults"] and got[1]["payload_bytes"] == 0 and got[3]["faults"] == [] and got[3]["payload_bytes"] == 192 and got[3]["damaged"] == 0
