import json
import os
import socket
import struct
import threading

import pytest
from lodestone.streaming import sockets
from pyspark.sql import functions as F


class Server:
    """Listens on a free port and hands each connection to a function, on threads of its own."""

    def __init__(self, handle):
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.port, self.handle = self.listener.getsockname()[1], handle
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        while True:
            try:
                connection, _ = self.listener.accept()
            except OSError:
                return
            threading.Thread(target=self.handle, args=(connection,), daemon=True).start()


def camera():
    """A server that sends the frames from the place on that it is told, in pieces that cut through frames."""
    frames, ready = [], threading.Condition()

    def handle(connection):
        with connection:
            (place,) = struct.unpack(">Q", connection.recv(8, socket.MSG_WAITALL))
            while True:
                with ready:
                    if not ready.wait_for(lambda: len(frames) > place, timeout=30):
                        return
                    raw = b"".join(struct.pack(">I", len(f)) + f for f in frames[place:])
                    place = len(frames)
                try:
                    for i in range(0, len(raw), 7):
                        connection.sendall(raw[i : i + 7])
                except OSError:
                    return

    def send(*new):
        with ready:
            frames.extend(new)
            ready.notify_all()

    return Server(handle), send


def receiver():
    box, lock = sockets.Outbox(), threading.Lock()

    def handle(connection):
        with connection, connection.makefile("rb") as lines:
            told = [json.loads(x) for x in lines]
            with lock:
                for line in told:
                    box.take(line)

    return Server(handle), box


def test_frames_are_neither_lost_nor_repeated(spark, tmp_path):
    """A run fails in the middle of a batch, another one goes on from the checkpoint, with a new connection."""
    sockets.register(spark)
    server, send = camera()
    seen = []

    def run(most, fails_at=None):
        def take(rows, batch):
            got = [(r["frame_id"], bytes(r["frame"])) for r in rows.collect()]
            if batch == fails_at:
                raise RuntimeError("on purpose")
            seen.extend(got)

        frames = spark.readStream.format("frame_socket").option("host", "127.0.0.1").option("port", server.port).option("log", f"{tmp_path}/log").option("resume", True).option("max_frames", most).load()
        q = frames.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            for _ in range(4):
                q.processAllAvailable()
        finally:
            q.stop()

    first, last = [b"frame %d" % i * (i + 1) for i in range(10)] + [b""], [b"last", b"one more"]
    send(*first)
    with pytest.raises(Exception, match="on purpose"):
        run(4, fails_at=1)
    assert [f for _, f in seen] == first[:4]
    send(*last)
    run(5)
    assert sorted(seen) == list(enumerate(first + last))
    assert len([n for n in os.listdir(f"{tmp_path}/log") if n.endswith(".frames")]) <= 2


def test_responses_count_once(spark, tmp_path):
    sockets.register(spark)
    server, box = receiver()
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).repartition(3).write.mode("append").parquet(f"{tmp_path}/in/{i}")

    def run(where):
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in/*").select(F.to_json(F.struct("id")).alias("response"))
        q = rows.writeStream.format("response_socket").option("host", "127.0.0.1").option("port", server.port).option("checkpointLocation", f"{tmp_path}/{where}").trigger(availableNow=True).start()
        q.awaitTermination()

    run("state")
    want = sorted(json.dumps({"id": i}, separators=(",", ":")) for i in range(20))
    assert sorted(r for b in box.batches.values() for r in b) == want and len(box.batches) >= 2 and not box.waiting
    run("state")  # nothing new
    run("again")  # all batches run again under their numbers: each counts once
    assert sorted(r for b in box.batches.values() for r in b) == want and not box.waiting


def test_an_aborted_batch_is_not_seen():
    box = sockets.Outbox()
    for line in ({"attempt": "a", "response": "1"}, {"attempt": "b", "response": "2"}, {"abort": 0, "attempts": ["a"]}, {"commit": 0, "attempts": ["b"], "rows": 1}, {"attempt": "c", "response": "3"}, {"commit": 0, "attempts": ["c"], "rows": 1}):
        box.take(line)
    assert box.batches == {0: ["2"]} and not box.waiting
    with pytest.raises(ValueError, match="tells"):
        box.take({"commit": 1, "attempts": ["gone"], "rows": 1})


def test_one_text_column_is_sent(spark, tmp_path):
    sockets.register(spark)
    stream = spark.readStream.format("rate").load()
    with pytest.raises(Exception, match="one column"):
        stream.writeStream.format("response_socket").option("host", "x").option("port", 1).option("checkpointLocation", f"{tmp_path}/s").start().awaitTermination(20)
