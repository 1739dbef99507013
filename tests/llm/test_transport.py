import hashlib
import random
import zlib

import pytest
from helpers import empty, odd
from lodestone.llm import transport as T
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 63, 64, 150, 169, 170, 171, 184, 185, 333, 4081, 4095, 4096, 4097, 8192, 20_000])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    media = T.write_stream(payload)
    assert len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))
    read = T.read_stream(media)
    assert read["payload"] == payload and read["lost"] == 0
    assert [u["pts"] for u in read["units"]] == [k * T.UNIT_TICKS for k in range(len(read["units"]))]
    assert [u["random_access"] for u in read["units"]] == [k % T.RANDOM_ACCESS_EVERY == 0 for k in range(len(read["units"]))]
    assert all(media[u["at"] + 1] & 0x40 for u in read["units"])


def test_tables_and_faults():
    media = T.write_stream(b"x" * 9000)
    assert T.read_tables(media) == {T.PROGRAM: {T.STREAM_PID: T.PRIVATE_PES}}
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert T.read_stream(b"".join(packets[:5] + packets[6:]))["lost"] == 1
    assert T.read_stream(b"".join([*packets[:5], packets[4], *packets[5:]]))["payload"] == b"x" * 9000  # a repeated packet
    with pytest.raises(T.BrokenStream, match="step"):
        T.read_stream(media[:-1])
    with pytest.raises(T.BrokenStream, match="missing"):
        T.read_stream(b"".join(packets[2:]))
    broken = bytearray(media)
    broken[10] ^= 1
    with pytest.raises(T.BrokenStream, match="CRC"):
        T.read_stream(bytes(broken))


def test_timestamps_wrap():
    t = (1 << 33) + 12345
    assert T._read_timestamp(T._timestamp(t)) == 12345


def test_digests_and_columns(spark):
    docs = odd(spark).withColumn("media", F.lit("clash")).withColumn("payload", F.lit("clash")).withColumn("key", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = T.media_digests(docs).collect()
    assert len(got) == 11
    for r in got:
        raw = T.padded((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 5)}) == 1
    back = T.read_media(T.write_media(docs)).collect()
    assert all(bytes(r["payload"]).rstrip(b"\0").decode() == (r["text"] or "") and r["fault"] is None and r["lost"] == 0 for r in back)
    broken = spark.createDataFrame([(1, bytearray(b"G" * 188)), (2, None), (3, bytearray(b"zz"))], "doc_id long, media binary")
    assert {r["doc_id"]: r["fault"] is None for r in T.read_media(broken).collect()} == {1: False, 2: True, 3: False}
    assert T.media_digests(empty(spark)).count() == 0


def programs_of_three():
    r = random.Random(11)
    return [T.Stream(1, 0x100, 0x1B, r.randbytes(30_000)), T.Stream(1, 0x101, 0x0F, r.randbytes(9_000)), T.Stream(7, 0x200, 0x06, r.randbytes(17_777))]


def test_several_programs():
    streams = programs_of_three()
    read = T.read_stream(T.write_streams(streams))
    assert read["programs"] == {1: {0x100: 0x1B, 0x101: 0x0F}, 7: {0x200: 0x06}} and read["lost"] == 0
    for s in streams:
        units = [u for u in read["units"] if u["pid"] == s.pid]
        assert b"".join(read["payload"][u["start"] : u["start"] + u["bytes"]] for u in units) == s.payload
        assert all(u["whole"] and u["program"] == s.program for u in units)
        assert [u["clock"] for u in units] == [u["pts"] if u["random_access"] else None for u in units]


def test_reading_begins_at_random_access_points():
    payload = random.Random(5).randbytes(50_000)
    media = T.write_stream(payload)
    read = T.read_stream(media)
    points = [u for u in read["units"] if u["random_access"]]
    assert len(points) == 4
    for u in points:
        assert T.read_stream(media[u["at"] :], read["programs"])["payload"] == payload[u["start"] :]
        assert T.read_stream(media[u["at"] - 2 * 188 :])["payload"] == payload[u["start"] :]  # the tables stand before it


@pytest.mark.parametrize("seed", range(12))
def test_faults_against_a_plain_count_of_packets(seed):
    """Packets are dropped, sent twice or damaged. What must be read follows from which packets are left of each unit."""
    r, media = random.Random(seed), T.write_streams(programs_of_three())
    sent, units, lost, gap = [], [], 0, {}
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        pid = int.from_bytes(p[1:3], "big") & 0x1FFF
        if pid not in (0x100, 0x101, 0x200):
            sent.append(p)
            continue
        body = p[4:] if p[3] < 0x20 else p[5 + p[4] :]
        if p[1] & 0x40:
            units.append({"pid": pid, "bytes": b"", "open": True, "whole": True, "seen": True})
        unit = next(u for u in reversed(units) if u["pid"] == pid)
        what = r.choice(["drop", "error"] if r.random() < 0.06 else ["keep", "keep", "keep", "twice"])
        if what in ("keep", "twice"):
            sent += [p] * (1 + (what == "twice"))
            lost += gap.get(pid, False) is True
            gap[pid] = False
            if unit["open"]:
                unit["bytes"] += body
            continue
        if what == "error":  # any bit may be wrong, those of the id too
            sent.append(bytes([0x47, 0x80 | r.randrange(0x20), r.randrange(256)]) + p[3:])
        if pid in gap:
            gap[pid] = True
        unit["open"] = unit["whole"] = False
        unit["seen"] = unit["seen"] and not p[1] & 0x40
    read = T.read_stream(b"".join(sent))
    seen = [u for u in units if u["seen"]]
    assert [(u["pid"], u["whole"]) for u in read["units"]] == [(u["pid"], u["whole"]) for u in seen]
    assert [read["payload"][u["start"] : u["start"] + u["bytes"]] for u in read["units"]] == [u["bytes"][14:] for u in seen]
    assert read["lost"] == lost > 0


def packet(pid, counter, body, start=False, flags=None):
    """By hand; flags: of the adaptation field, which also stuffs."""
    room = 184 - len(body)
    field = b"" if flags is None and not room else bytes([room - 1]) + (bytes([flags or 0]).ljust(room - 1, b"\xff") if room > 1 else b"")
    assert len(field) == room
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counter & 15]) + field + body


def section(table, ident, body, version=0, now=1):
    head = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 0xFF]) + ident.to_bytes(2, "big") + bytes([0xC0 | version << 1 | now, 0, 0]) + body
    return head + T.section_crc(head).to_bytes(4, "big")


def association(*programs):
    return b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in programs)


def hand_made():
    """A network id, a map of 300 bytes over two packets that begins behind another section, section streams, a table not yet in force."""
    note = bytes([9, 200]) + b"d" * 200
    streams = bytes([0x1B]) + b"\xe1\x01\xf0" + bytes([len(note)]) + note + bytes([0x86]) + b"\xe1\x02\xf0\x00" + bytes([0x06]) + b"\xe1\x03\xf0\x00"
    real = section(2, 3, b"\xe1\x01\xf0\x00" + streams)
    later = section(2, 3, b"\xe1\x01\xf0\x00" + bytes([0x0F]) + b"\xe1\x09\xf0\x00", now=0)
    run = b"\x00" + later + real
    tables = [packet(0, 0, (b"\x00" + section(0, 1, association((0, 0x10), (3, 0x20)))).ljust(184, b"\xff"), True)]
    tables += [packet(0x20, 0, run[:184], True), packet(0x20, 1, run[184:].ljust(184, b"\xff"))]
    return tables


def test_hand_made_tables():
    tables = hand_made()
    assert T.read_tables(b"".join(tables)) == {3: {0x101: 0x1B, 0x102: 0x86, 0x103: 0x06}}
    with pytest.raises(T.BrokenStream, match="missing"):  # the second half of the map comes after a break
        T.read_tables(b"".join([*tables[:2], packet(0x20, 5, tables[2][4:])]))
    # a section's end before the next one's start, by the pointer
    again = section(2, 3, b"\xe1\x01\xf0\x00" + bytes([0x03]) + b"\xe1\x0a\xf0\x00", version=1)
    rest = (b"\x00" + section(2, 3, b"\xe1\x01\xf0\x00", now=0) + section(2, 3, b"\xe1\x01\xf0\xb4" + bytes([9, 178]) + b"n" * 178))[184:]
    pointed = packet(0x20, 1, (bytes([len(rest)]) + rest + again).ljust(184, b"\xff"), True)
    first = (b"\x00" + section(2, 3, b"\xe1\x01\xf0\x00", now=0) + section(2, 3, b"\xe1\x01\xf0\xb4" + bytes([9, 178]) + b"n" * 178))[:184]
    assert T.read_tables(b"".join([tables[0], packet(0x20, 0, first, True), pointed])) == {3: {0x10A: 0x03}}


def test_hand_made_units():
    stamp = lambda mark, t: bytes([mark << 4 | t >> 29 & 14 | 1]) + ((t >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((t & 0x7FFF) << 1 | 1).to_bytes(2, "big")
    both = b"\x00\x00\x01\xe0\x00\x00\x80\xc0\x0a" + stamp(3, (1 << 33) - 100) + stamp(1, (1 << 33) - 400)
    after = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + stamp(2, 3500)
    bare = b"\x00\x00\x01\xbf\x00\x04bare"
    fill = b"\x00\x00\x01\xbe\x00\x03xyz"
    media = hand_made() + [
        packet(0x101, 4, both + b"open length", True), packet(0x103, 0, bare, True), packet(0x101, 5, b" goes on"),
        packet(0x102, 0, b"\x00".ljust(184, b"\xff"), True), packet(0x101, 6, after + b"next", True),
        packet(0x101, 13, b" jumped", flags=0x80), packet(0x103, 1, fill, True), packet(0x1FFF, 0, b"\xff" * 184), packet(0x101, 14, after + b"last", True, flags=0x40),
    ]
    read = T.read_stream(b"".join(media))
    got = [(u["pid"], read["payload"][u["start"] : u["start"] + u["bytes"]], u["pts"], u["dts"], u["random_access"], u["whole"]) for u in read["units"]]
    wrap = 1 << 33
    assert got == [
        (0x101, b"open length goes on", wrap - 100, wrap - 400, False, True),
        (0x103, b"bare", None, None, False, True),
        (0x101, b"next", wrap + 3500, None, False, False),  # the jump is announced, so no loss, but the unit ends there
        (0x103, b"", None, None, False, True),
        (0x101, b"last", 3500, None, True, True),  # behind a jump the clock may be another one
    ]
    assert read["lost"] == 0
    scrambled = bytearray(media[5])
    scrambled[3] |= 0x80
    cut = T.read_stream(b"".join([*media[:5], bytes(scrambled), *media[6:]]))
    assert cut["units"][0]["whole"] is False and cut["payload"].startswith(b"open lengthbare")


def test_large_tables_and_limits():
    many = [T.Stream(n, 0x100 + n, 0x06, b"x" * n) for n in range(1, 401)]  # the association table takes two sections
    read = T.read_stream(T.write_streams(many))
    assert len(read["programs"]) == 400 and [u["bytes"] for u in read["units"]] == list(range(1, 401))
    one = [T.Stream(1, 0x100 + n, 0x06, b"y") for n in range(150)]  # a map over several packets
    assert len(T.read_tables(T.write_streams(one))[1]) == 150
    for bad in ([T.Stream(1, 0x100, 6, b""), T.Stream(2, 0x100, 6, b"")], [T.Stream(0, 0x100, 6, b"")], [T.Stream(1, 0x1FFF, 6, b"")], [T.Stream(1, 0x100 + n, 6, b"") for n in range(300)]):
        with pytest.raises(ValueError):
            T.write_streams(bad)


def test_any_bytes_are_read_or_refused():
    r = random.Random(8)
    media = T.write_streams(programs_of_three())
    for _ in range(300):
        broken = bytearray(media)
        for _ in range(r.randrange(1, 60)):
            at = r.randrange(len(broken))
            broken[at - at % 188 + r.choice([1, 2, 3, 4, 5, 6, 7, 8, 20])] = r.randrange(256)
        try:
            T.read_stream(bytes(broken))
        except T.BrokenStream:
            pass


def test_stored_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 40_000), (2, None)], "doc_id long, text string")
    one, none = sorted(T.read_media(T.write_media(docs)).collect(), key=lambda r: r["doc_id"])
    assert [tuple(s) for s in one["streams"]] == [(T.PROGRAM, T.STREAM_PID, T.PRIVATE_PES)]
    assert [u["pts"] for u in one["access_units"]] == [k * T.UNIT_TICKS for k in range(10)] and sum(u["bytes"] for u in one["access_units"]) == len(one["payload"])
    assert bytes(none["payload"]) == bytes(64)
    replaced = T.write_media(docs, media="text")
    assert replaced.columns == ["doc_id", "text"] and dict(replaced.dtypes)["text"] == "binary"
    assert {r["lost"] for r in T.read_media(replaced, media="text").collect()} == {0}
    clash = T.write_media(docs, media="payload")
    assert [r["fault"] for r in T.read_media(clash, media="payload").collect()] == [None, None]
    digest = {r["doc_id"]: r for r in T.media_digests(docs).collect()}
    assert [(p["pts"], p["at"] % 188) for p in digest[1]["random_access_points"]] == [(0, 0), (4 * T.UNIT_TICKS, 0), (8 * T.UNIT_TICKS, 0)]
    assert digest[1]["feature"].startswith("streams=1;units=10;random_access=3;") and digest[1]["n_bytes"] == 40_000
