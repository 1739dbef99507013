"""Multi-object tracking over a stream of detections, with one state per stream.

A detection joins the nearest track by mean distance of its points, nearest pairs first, if that is at most ``reach``;
others begin a track. A track's counter rises with each hit up to ``hits_most`` and falls with each frame without one; at
0 the track ends. Tracks are reported once they have been seen ``hits_first`` times. Tracks are taken to stay where they
were last seen: no motion is predicted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.state import TTL_MS, with_state

OUTPUT = "stream_id string, frame long, detection long, track long, seen long, distance double"


def assigned(tracks: list[dict], points: list[np.ndarray], reach: float) -> dict[int, tuple[int, float]]:
    """Detection to (track's place, distance): greedy from the nearest pair on, ties by track and detection."""
    pairs = sorted((float(np.hypot(*(np.array(t["points"]) - p).T).mean()), i, j) for i, t in enumerate(tracks) for j, p in enumerate(points) if len(t["points"]) == len(p))
    out, used = {}, set()
    for distance, i, j in pairs:
        if distance <= reach and i not in used and j not in out:
            out[j] = (i, distance)
            used.add(i)
    return out


def advance(state: dict, points: list[np.ndarray], reach: float, hits_most: int) -> list[tuple[int, int, float | None]]:
    """One frame: changes the state, gives (track, seen, distance) for each detection."""
    tracks = state["tracks"]
    met = assigned(tracks, points, reach)
    hit = {i for i, _ in met.values()}
    out = []
    for j, p in enumerate(points):
        if j in met:
            t, distance = tracks[met[j][0]], met[j][1]
            t |= {"points": p.tolist(), "seen": t["seen"] + 1, "left": min(hits_most, t["left"] + 1)}
        else:
            t, distance = {"id": state["next"], "points": p.tolist(), "seen": 1, "left": 1}, None
            state["next"] += 1
            tracks.append(t)
            hit.add(len(tracks) - 1)
        out.append((t["id"], t["seen"], distance))
    for i, t in enumerate(tracks):
        if i not in hit:
            t["left"] -= 1
    state["tracks"] = [t for t in tracks if t["left"] > 0]
    return out


class Tracker(StatefulProcessor):
    """Of each stream: a map of its tracks, and which id comes next after which frame. Both expire."""

    def __init__(self, reach: float, hits_most: int, hits_first: int, ttl_ms: int | None):
        self.reach, self.hits_most, self.hits_first, self.ttl_ms = reach, hits_most, hits_first, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track bigint", "points array<array<double>>, seen bigint, left bigint", self.ttl_ms)
        self.place = handle.getValueState("place", "next bigint, frame bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_, last = self.place.get() if self.place.exists() else (0, None)
        before = sorted((k[0], v) for k, v in self.tracks.iterator())
        state = {"next": next_, "tracks": [{"id": k, "points": [list(p) for p in points], "seen": seen, "left": left} for k, (points, seen, left) in before]}
        new, out = pd.concat(list(rows)).sort_values(["frame", "detection"]), []
        for frame, one in new.groupby("frame", sort=True):
            if last is not None and frame <= last:
                continue
            last = int(frame)
            got = advance(state, [np.array([list(q) for q in p], float) for p in one["points"]], self.reach, self.hits_most)
            out += [(key[0], int(frame), int(d), t, s, x) for d, (t, s, x) in zip(one["detection"], got) if s >= self.hits_first]
        for k in {k for k, _ in before} - {t["id"] for t in state["tracks"]}:
            self.tracks.removeKey((k,))
        for t in state["tracks"]:
            self.tracks.updateValue((t["id"],), (t["points"], t["seen"], t["left"]))
        if last is not None:
            self.place.update((state["next"], last))
        yield pd.DataFrame(out, columns=["stream_id", "frame", "detection", "track", "seen", "distance"])

    def close(self) -> None:
        pass


def tracked(detections: DataFrame, reach: float = 300.0, hits_most: int = 5, hits_first: int = 2, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """detections: stream_id, frame, detection, points array<array<double>>. Frames of one trigger are taken in order;
    a frame that comes after a later one has been handled is left out. A stream without frames for ``ttl_ms`` of
    processing time has ended: its tracks and its ids are forgotten. None keeps them for ever."""
    return with_state(detections.select("stream_id", "frame", "detection", "points"), ["stream_id"], Tracker(reach, hits_most, hits_first, ttl_ms), OUTPUT, "append")
