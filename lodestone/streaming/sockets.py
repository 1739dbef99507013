"""Frames from a socket as a stream that can be replayed, and responses to a socket that count once.

Source ``frame_socket`` (options host, port, log; max_frames): a frame is a length of four bytes, big end first, and that
many bytes. A socket gives each byte once, so what has arrived is written to ``log``, a folder that driver and executors
share, before it gets an offset. Offsets count frames from the first one on; a batch reads its frames from the log, also
when it is run again after a failure or from a checkpoint. Files of the log go when Spark has committed all their frames,
but for the last, which tells where to go on. What a connection holds that has not reached the log is lost with it,
unless the other side can send it again: with the option ``resume``, the source begins each connection by the number of
frames it has, as eight bytes, and is sent those that follow.

Sink ``response_socket`` (options host, port): each row's text is sent as one JSON line, tagged with its task's attempt.
The commit sends a line that names the batch and the attempts that count; the receiver takes the lines of a batch it has
not seen when that line comes, and drops those of other attempts. So a batch that is run again counts once.
"""

from __future__ import annotations

import json
import socket
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_HEAD = struct.Struct(">I")


@dataclass
class Piece(InputPartition):
    """Frames first to last (exclusive) of the log's file that begins with frame ``begin``."""

    name: str
    begin: int
    first: int
    last: int

    def __post_init__(self):
        super().__init__(self.name)


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port, self.folder = options["host"], int(options["port"]), options["log"].rstrip("/")
        self.resume = str(options.get("resume", "false")).lower() == "true"
        self.most, self.wait = int(options.get("max_frames", 1000)), float(options.get("wait_seconds", 0.5))
        self.connection, self.pending, self.total = None, b"", None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"connection": None, "pending": b""}  # executors only read the log

    def _log(self) -> list[tuple[int, int, str]]:
        """(begin, end, name) of the log's files, in order."""
        store, root = stores.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        names = [f.base_name for f in store.get_file_info(stores.FileSelector(root)) if f.base_name.endswith(".frames")]
        return sorted((int(n.split("-")[0]), int(n.split("-")[1].split(".")[0]), n) for n in names)

    def _received(self) -> list[bytes]:
        """What has arrived, as far as whole frames go; waits a little for more."""
        frames = []
        try:
            if self.connection is None:
                self.connection = socket.create_connection((self.host, self.port), timeout=self.wait)
                if self.resume:
                    self.connection.sendall(struct.pack(">Q", self.total))
            while len(frames) < self.most:
                while len(self.pending) >= 4 and len(self.pending) >= 4 + (size := _HEAD.unpack_from(self.pending)[0]) and len(frames) < self.most:
                    frames.append(self.pending[4 : 4 + size])
                    self.pending = self.pending[4 + size :]
                if len(frames) >= self.most:
                    break
                more = self.connection.recv(1 << 16)
                if not more:  # the other side has gone; a part of a frame went with it
                    self.connection.close()
                    self.connection, self.pending = None, b""
                    break
                self.pending += more
        except TimeoutError:
            pass
        except OSError:  # nobody listens: asked again with the next trigger
            self.connection, self.pending = None, b""
        return frames

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        if self.total is None:
            held = self._log()
            self.total = held[-1][1] if held else 0
        if frames := self._received():
            store, root = stores.FileSystem.from_uri(self.folder)
            store.create_dir(root, recursive=True)
            draft, end = f"{root}/{uuid.uuid4().hex}.draft", self.total + len(frames)
            with store.open_output_stream(draft) as out:
                out.write(b"".join(_HEAD.pack(len(f)) + f for f in frames))
            store.move(draft, f"{root}/{self.total:020d}-{end:020d}.frames")
            self.total = end
        return {"frame": self.total}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = start["frame"], end["frame"]
        return [Piece(name, a, max(a, low), min(b, high)) for a, b, name in self._log() if a < high and b > low]

    def read(self, partition: Piece) -> Iterator[tuple]:
        store, root = stores.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{root}/{partition.name}") as held:
            for i in range(partition.begin, partition.last):
                (size,) = _HEAD.unpack(held.read(4))
                frame = held.read(size)
                if i >= partition.first:
                    yield i, bytes(frame)

    def commit(self, end: dict) -> None:
        store, root = stores.FileSystem.from_uri(self.folder)
        for _, b, name in self._log()[:-1]:
            if b <= end["frame"]:
                store.delete_file(f"{root}/{name}")

    def stop(self) -> None:
        if self.connection is not None:
            self.connection.close()


class FrameSocket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_socket"

    def schema(self) -> str:
        return "frame_id bigint, frame binary"

    def streamReader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)


@dataclass
class Sent(WriterCommitMessage):
    attempt: str
    rows: int


class ResponseWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, column: str):
        self.address, self.column = (options["host"], int(options["port"])), column

    def _send(self, lines: Iterator[dict]) -> int:
        n = 0
        with socket.create_connection(self.address, timeout=30) as to:
            for n, line in enumerate(lines, 1):
                to.sendall((json.dumps(line) + "\n").encode())
            to.shutdown(socket.SHUT_WR)
            to.recv(1)  # until the receiver has taken all and closes
        return n

    def write(self, parts: Iterator[pa.RecordBatch]) -> Sent:
        attempt = uuid.uuid4().hex
        return Sent(attempt, self._send({"attempt": attempt, "response": r} for part in parts for r in part.column(self.column).to_pylist() if r is not None))

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        told = [m for m in messages if m is not None]
        self._send(iter([{"commit": batchId, "attempts": [m.attempt for m in told], "rows": sum(m.rows for m in told)}]))

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        self._send(iter([{"abort": batchId, "attempts": [m.attempt for m in messages if m is not None]}]))


class ResponseSocket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_socket"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ResponseWriter:
        if len(schema.names) != 1 or schema[0].dataType.simpleString() != "string":
            raise ValueError("one column of text is sent")
        return ResponseWriter(self.options, schema.names[0])


def register(spark: SparkSession) -> None:
    for source in (FrameSocket, ResponseSocket):
        spark.dataSource.register(source)


class Outbox:
    """What a receiver of ``response_socket`` keeps: responses in order of their batches, each batch once."""

    def __init__(self):
        self.waiting: dict[str, list[str]] = {}
        self.batches: dict[int, list[str]] = {}

    def take(self, line: dict) -> None:
        if "response" in line:
            self.waiting.setdefault(line["attempt"], []).append(line["response"])
            return
        rows = [r for a in line["attempts"] for r in self.waiting.pop(a, [])]
        if "commit" in line and line["commit"] not in self.batches:
            if len(rows) != line["rows"]:
                raise ValueError(f"batch {line['commit']} tells {line['rows']} rows, {len(rows)} have come")
            self.batches[line["commit"]] = rows
