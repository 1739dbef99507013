"""Media columns held as MPEG transport streams.

Writing: each payload becomes a stream of a program, most often one private-data stream. Packets of 188 bytes carry a
program association table, a program map table for each program, and packetised elementary stream (PES) packets of at
most ``ACCESS_UNIT`` bytes, each with a presentation timestamp. The first packet of every ``RANDOM_ACCESS_EVERY``-th
access unit has the random-access flag, and the tables are sent again before it, so that a reader can begin there.
Reading: the program tables are parsed (sections checked by CRC, over as many packets as they take), continuity counters
are followed for every stream, elementary packets are reassembled, and their timestamps are given with the byte position
of each random-access point.

Faults. Packets with the error flag are left out, their ids included, as any bit of them may be wrong. A packet that
comes twice counts once. A break of the counters counts as one loss, unless the packet announces it (the discontinuity
flag). An access unit ends at a break: where bytes behind it belong is unknown, so they are dropped up to the next unit,
and the unit is not whole. Scrambled packets end a unit too. Sections with a wrong CRC are left out; a stream none of whose
programs has its tables is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textblocks import binary_slices, slices

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x0100, 1
#: Stream type of private PES data, and the clock of timestamps in Hz.
PRIVATE_PES, CLOCK = 0x06, 90_000
#: Stream ids of private data, audio and video, and the stream types of the last two.
PRIVATE_STREAM_1, AUDIO, VIDEO = 0xBD, 0xC0, 0xE0
AUDIO_TYPES, VIDEO_TYPES = {0x03, 0x04, 0x0F, 0x11}, {0x01, 0x02, 0x1B, 0x24}
#: Stream types that carry sections and no PES packets; stream ids whose packets have no header fields
#: (program stream map, padding, private stream 2, ECM, EMM, DSM-CC, type E, directory), and padding's own.
SECTION_TYPES = {0x05, 0x0A, 0x0B, 0x0C, 0x0D, 0x86}
BARE, PADDING = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}, 0xBE
#: Ids of the two tables, and how many bytes a section's length counts at most.
PAT, PMT, LONGEST_SECTION = 0, 2, 1021
ACCESS_UNIT = 4096
#: Ticks of the clock between access units: 25 a second.
UNIT_TICKS = CLOCK // 25
RANDOM_ACCESS_EVERY = 4
PES_HEADER = 14
#: Programs in one section of the association table.
PROGRAMS_A_SECTION = 250


class BrokenStream(ValueError):
    """The bytes are not a transport stream, or its tables are missing or damaged."""


@dataclass(frozen=True)
class Stream:
    """An elementary stream of a program: its packet id, its type and its bytes."""

    program: int
    pid: int
    kind: int
    payload: bytes


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(section: bytes) -> int:
    c = 0xFFFFFFFF
    for b in section:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes, number: int = 0, last: int = 0) -> bytes:
    if len(body) + 9 > LONGEST_SECTION:
        raise ValueError("a table is longer than a section may be")
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, number, last])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _section_packets(pid: int, section: bytes, counter: int) -> list[bytes]:
    """A section over as many packets as it takes; the first has a pointer of 0, the last is filled up."""
    body, room = b"\x00" + section, PACKET - 4
    return [(bytes([SYNC, (0 if at else 0x40) | pid >> 8, pid & 0xFF, 0x10 | counter + k & 15]) + body[at : at + room]).ljust(PACKET, b"\xff") for k, at in enumerate(range(0, len(body), room))]


def _tables(streams: list[Stream]) -> list[tuple[int, bytes]]:
    """The sections to send, each with its packet id."""
    programs: dict[int, list[Stream]] = {}
    for s in streams:
        programs.setdefault(s.program, []).append(s)
    at = {n: PMT_PID + k for k, n in enumerate(programs)}
    pids = [*at.values(), *(s.pid for s in streams)]
    if len(set(pids)) < len(pids) or not all(0x10 <= p < 0x1FFF for p in pids) or not all(0 < n <= 0xFFFF for n in programs):
        raise ValueError("packet ids clash or are out of range, or a program has no valid number")
    numbers = list(programs)
    parts = [numbers[i : i + PROGRAMS_A_SECTION] for i in range(0, len(numbers), PROGRAMS_A_SECTION)]
    out = [(0, _section(PAT, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | at[n]).to_bytes(2, "big") for n in part), k, len(parts) - 1)) for k, part in enumerate(parts)]
    for n, own in programs.items():
        body = (0xE000 | own[0].pid).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([s.kind]) + (0xE000 | s.pid).to_bytes(2, "big") + b"\xf0\x00" for s in own)
        out.append((at[n], _section(PMT, n, body)))
    return out


def _timestamp(ticks: int, mark: int = 2) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([mark << 4 | 1 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _pes(unit: bytes, ticks: int, kind: int = PRIVATE_PES) -> bytes:
    ident = AUDIO if kind in AUDIO_TYPES else VIDEO if kind in VIDEO_TYPES else PRIVATE_STREAM_1
    return b"\x00\x00\x01" + bytes([ident]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + unit


def _unit_packets(pes: bytes, pid: int, counter: int, clock: int | None) -> list[bytes]:
    """Packets of one PES packet. A random-access point has an adaptation field with its flag and the clock (program clock
    reference); stuffing fills the last packet."""
    out, at, first = [], 0, True
    while at < len(pes):
        field = b""
        if first and clock is not None:
            field = b"\x50" + ((clock & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        if len(pes) - at < room:  # stuff: the adaptation field fills what the unit leaves
            fill = PACKET - 4 - (len(pes) - at)
            field = (field or (b"\x00" if fill > 1 else b"")).ljust(fill - 1, b"\xff")
            adapted, room = bytes([fill - 1]) + field, len(pes) - at
        else:
            adapted = bytes([len(field)]) + field if field else b""
        control = (0x30 if adapted else 0x10) | counter & 15
        out.append(bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF, control]) + adapted + pes[at : at + room])
        at, first, counter = at + room, False, counter + 1
    return out


def write_streams(streams: list[Stream]) -> bytes:
    """One transport stream of all the streams, whose units take turns. Without any bytes it has tables alone."""
    tables, counters, out = _tables(streams), {}, []

    def send(pid: int, packets: list[bytes]) -> None:
        counters[pid] = counters.get(pid, 0) + len(packets)
        out.extend(packets)

    units = max((-(-len(s.payload) // ACCESS_UNIT) for s in streams), default=0)
    for k in range(max(units, 1)):
        again = k % RANDOM_ACCESS_EVERY == 0
        for pid, section in tables if again else ():
            send(pid, _section_packets(pid, section, counters.get(pid, 0)))
        for s in streams:
            if unit := s.payload[k * ACCESS_UNIT : (k + 1) * ACCESS_UNIT]:
                send(s.pid, _unit_packets(_pes(unit, k * UNIT_TICKS, s.kind), s.pid, counters.get(s.pid, 0), k * UNIT_TICKS if again else None))
    return b"".join(out)


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds the payload as one private-data stream. An empty payload gives tables alone."""
    return write_streams([Stream(PROGRAM, STREAM_PID, PRIVATE_PES, payload)])


class _Packets:
    """The header fields of all packets, as columns."""

    def __init__(self, media: bytes):
        whole = len(media) % PACKET == 0
        p = np.frombuffer(media, dtype=np.uint8, count=len(media) // PACKET * PACKET).reshape(-1, PACKET)
        if not whole or (p[:, 0] != SYNC).any():
            raise BrokenStream("packets out of step")
        self.media, self.control = media, p[:, 3]
        self.start, self.sound = p[:, 1] & 0x40 != 0, p[:, 1] & 0x80 == 0
        self.pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]

    def of(self, pids: set[int]) -> Iterator[tuple[int, int, bool, int, int, int]]:
        """(packet id, position, whether a unit starts, control byte, adaptation flags, position of the payload) of sound
        packets of these ids."""
        for i in np.flatnonzero(np.isin(self.pid, list(pids)) & self.sound).tolist():
            at, control, flags = i * PACKET, int(self.control[i]), 0
            body = at + 4
            if control & 0x20:
                size = self.media[body]
                flags = self.media[body + 1] if size else 0
                body = min(body + 1 + size, at + PACKET)
            yield int(self.pid[i]), at, bool(self.start[i]), control, flags, body


class _Counter:
    """Follows the continuity counters: whether a packet is new, and whether packets before it are lost."""

    def __init__(self):
        self.last: dict[int, tuple[int, bytes]] = {}

    def take(self, pid: int, control: int, flags: int, body: bytes) -> tuple[bool, bool]:
        now, before = control & 15, self.last.get(pid)
        self.last[pid] = (now, body)
        if before is None or flags & 0x80:  # the discontinuity flag announces a jump
            return True, False
        if now == before[0] and body == before[1]:
            return False, False
        return True, now != (before[0] + 1) & 15


def _sections(packets: _Packets, pid: int, damaged: list[int]) -> Iterator[bytes]:
    """The sections of a packet id whose CRC holds, each text of them once; damaged gets the ids of others."""
    counter, part, seen = _Counter(), b"", set()
    for _, at, start, control, flags, body in packets.of({pid}):
        data = packets.media[body : at + PACKET]
        if not control & 0x10 or not data:
            continue
        new, lost = counter.take(pid, control, flags, data)
        if not new:
            continue
        if lost or flags & 0x80:
            part = b""
        ends = []
        if start:  # the pointer tells how much of the packet still belongs to the section before
            ends, part = [part + data[1 : 1 + data[0]]] if part else [], data[1 + data[0] :]
        elif part:
            part += data
        for k, run in enumerate([*ends, part]):
            while len(run) >= 3 and run[0] != 0xFF and len(run) >= (size := 3 + ((run[1] & 0x0F) << 8 | run[2])):
                section, run = run[:size], run[size:]
                if section in seen:
                    continue
                if len(section) >= 12 and not section_crc(section):
                    seen.add(section)
                    yield section
                else:
                    damaged.append(pid)
            if k == len(ends):
                part = b"" if run[:1] == b"\xff" else run


def _read_tables(packets: _Packets) -> dict[int, dict[int, int]]:
    maps, programs, damaged = {}, {}, []
    for s in _sections(packets, 0, damaged):
        for k in range(8, len(s) - 7, 4) if s[0] == PAT and s[5] & 1 else ():
            if number := s[k] << 8 | s[k + 1]:
                maps.setdefault((s[k + 2] & 0x1F) << 8 | s[k + 3], set()).add(number)
    for pid, numbers in maps.items():
        for s in _sections(packets, pid, damaged):
            number = s[3] << 8 | s[4]
            if s[0] != PMT or not s[5] & 1 or number not in numbers or len(s) < 16:
                continue
            at, streams = 12 + ((s[10] & 0x0F) << 8 | s[11]), programs.setdefault(number, {})
            while at + 5 <= len(s) - 4:
                streams[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    if not programs:
        raise BrokenStream("a section's CRC does not match" if damaged else "program tables are missing")
    return programs


def read_tables(media: bytes) -> dict[int, dict[int, int]]:
    """Programs, each with its streams' packet ids and types: all that the stream's tables name, from first to last
    version; tables that are not yet in force are left out."""
    return _read_tables(_Packets(media))


def _read_pes(pes: bytes) -> tuple[bytes, int | None, int | None, bool]:
    """Bytes, presentation and decoding timestamp of an elementary packet, and whether it is all there. A length of 0 is
    open. Padding has no bytes."""
    if len(pes) < 6 or pes[:3] != b"\x00\x00\x01":
        return b"", None, None, False
    size, shown, decoded, body = pes[4] << 8 | pes[5], None, None, 6
    end = 6 + size if size else len(pes)
    if pes[3] not in BARE:
        if len(pes) < 9 or len(pes) < 9 + pes[8]:
            return b"", None, None, False
        body = 9 + pes[8]
        if pes[7] & 0x80 and pes[8] >= 5:
            shown = _read_timestamp(pes[9:14])
        if pes[7] & 0xC0 == 0xC0 and pes[8] >= 10:
            decoded = _read_timestamp(pes[14:19])
    return b"" if pes[3] == PADDING else pes[body:end], shown, decoded, len(pes) >= end


def _unwrapped(ticks: int | None, before: int | None) -> int | None:
    """Timestamps have 33 bits: the value nearest to the one before."""
    if ticks is None or before is None:
        return ticks
    return before + (ticks - before + (1 << 32)) % (1 << 33) - (1 << 32)


def read_stream(media: bytes, programs: dict[int, dict[int, int]] | None = None) -> dict:
    """The payload: the bytes of all access units in the order in which they begin. Of each unit: program, packet id,
    timestamps (ticks that go on where the 33 bits wrap), the byte position of its first packet, where its bytes start in
    the payload and how many they are, whether it is a random-access point with the clock there, and whether it is whole.
    ``lost`` counts breaks of the continuity counters. To begin at a random-access point, give the bytes from there and the
    tables read before, or begin at the tables that are sent before it."""
    packets = _Packets(media)
    programs = programs or _read_tables(packets)
    owner = {pid: n for n, streams in programs.items() for pid, kind in streams.items() if kind not in SECTION_TYPES}
    units, open_at, counter, lost, epochs = [], {}, _Counter(), 0, {}
    for pid, at, start, control, flags, body in packets.of(set(owner)):
        data = media[body : at + PACKET]
        if flags & 0x80:
            epochs[pid] = epochs.get(pid, 0) + 1
        if not control & 0x10:
            continue
        new, broken = counter.take(pid, control, flags, data)
        if not new:
            continue
        lost += broken
        if (broken or flags & 0x80 or _scrambled(control)) and pid in open_at:
            units[open_at.pop(pid)]["cut"] = True
        if _scrambled(control):
            continue
        if start:
            # the clock stands in the adaptation field: its flags, then 33 bits of ticks
            clock = int.from_bytes(media[at + 6 : at + 11], "big") >> 7 if flags & 0x10 and body >= at + 12 else None
            open_at[pid] = len(units)
            units.append({"program": owner[pid], "pid": pid, "at": at, "random_access": bool(flags & 0x40), "clock": clock, "epoch": epochs.get(pid, 0), "cut": False, "parts": []})
        if pid in open_at:
            units[open_at[pid]]["parts"].append(data)
    payload, size, shown_before = [], 0, {}
    for u in units:
        unit, shown, decoded, complete = _read_pes(pes := b"".join(u.pop("parts")))
        cut, era = u.pop("cut"), (u["pid"], u.pop("epoch"))
        u["pts"] = _unwrapped(shown, shown_before.get(era))
        u["dts"] = _unwrapped(decoded, u["pts"])
        if u["pts"] is not None:
            shown_before[era] = u["pts"]
        # a unit of open length that was cut may miss bytes
        u["whole"] = complete and not (cut and pes[4:6] == b"\x00\x00")
        u["start"], u["bytes"] = size, len(unit)
        payload.append(unit)
        size += len(unit)
    return {"payload": b"".join(payload), "units": units, "lost": lost, "programs": programs}


def _scrambled(control: int) -> bool:
    return control & 0xC0 != 0


_UNIT = {"program": pa.int32(), "pid": pa.int32(), "pts": pa.int64(), "dts": pa.int64(), "clock": pa.int64(), "at": pa.int64(), "start": pa.int64(), "bytes": pa.int64(), "random_access": pa.bool_(), "whole": pa.bool_()}
_STREAM = {"program": pa.int32(), "pid": pa.int32(), "type": pa.int32()}
UNITS = "array<struct<program:int,pid:int,pts:long,dts:long,clock:long,at:long,start:long,bytes:long,random_access:boolean,whole:boolean>>"
STREAMS = "array<struct<program:int,pid:int,type:int>>"


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def write_media(docs: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add the transport stream of every text's UTF-8 bytes, zero-padded to a positive multiple of 64, to the columns
    ``keep`` (all). Null counts as empty. A column that already has the new one's name is replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != media]
    types = dict(docs.dtypes)

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in slices(part, text):
                made = pa.array([write_stream(padded(t.encode())) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), made], names=[*kept, media])

    needed = dict.fromkeys([*kept, text])
    return docs.select(*[docs[c] for c in needed]).mapInArrow(written, ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{media}` binary"]))


def read_media(frame: DataFrame, media: str = "media") -> DataFrame:
    """Parse a column of transport streams: adds ``payload`` (binary: all access units in the order in which they begin),
    ``access_units`` (their programs, packet ids, timestamps, byte positions, sizes, random-access flags and whether they
    are whole), ``streams`` (those that the tables name), ``lost`` (continuity breaks) and ``fault`` (null, or why the bytes
    can't be read: then the others are null). Null media stays null. Clashing columns are replaced."""
    new = {"payload": "binary", "access_units": UNITS, "streams": STREAMS, "lost": "long", "fault": "string"}
    arrow = [pa.binary(), pa.list_(pa.struct(_UNIT.items())), pa.list_(pa.struct(_STREAM.items())), pa.int64(), pa.string()]
    kept = [c for c in frame.columns if c not in new]
    types = dict(frame.dtypes)

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 5
        try:
            r = read_stream(m)
        except BrokenStream as e:
            return None, None, None, None, str(e)
        streams = [{"program": n, "pid": pid, "type": kind} for n, own in r["programs"].items() for pid, kind in own.items()]
        return r["payload"], r["units"], streams, r["lost"], None

    def parsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, found in binary_slices(part, media):
                got = list(zip(*(one(m) for m in found)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(got, arrow))], names=[*kept, *new])

    return frame.select(*[frame[c] for c in {**dict.fromkeys(kept), media: None}]).mapInArrow(parsed, ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{c}` {t}" for c, t in new.items()]))


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a transport stream (write_media), read the stream back (read_media), and return digests of
    what was stored and read, figures of the stream (feature: streams, units, random-access points, position of the last,
    first and last timestamp, losses, CRC-32 of the payload) and its random-access points with their timestamps and byte
    positions. Null texts count as empty; repeated rows give repeated results; only key and text are read."""
    texts = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    stored = write_media(texts.withColumn("n_bytes", F.octet_length("text").cast("long")), keep=["key", "n_bytes"])
    points = F.transform(F.filter("access_units", lambda u: u["random_access"]), lambda u: F.struct(u["pts"].alias("pts"), u["at"].alias("at")))
    read = read_media(stored).withColumn("points", points)
    end = lambda column, at, field: F.coalesce(F.try_element_at(column, F.lit(at))[field], F.lit(-1))
    figures = {
        "streams": F.size("streams"), "units": F.size("access_units"), "random_access": F.size("points"), "last_at": end("points", -1, "at"),
        "first_pts": end("access_units", 1, "pts"), "last_pts": end("access_units", -1, "pts"), "lost": F.col("lost"), "crc32": F.crc32("payload"),
    }
    return read.select(
        F.col("key").alias(key), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", *[F.concat(F.lit(k + "="), v.cast("string")) for k, v in figures.items()]).alias("feature"), F.col("points").alias("random_access_points"),
    )
