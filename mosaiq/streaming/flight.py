"""Flight lines of a stream of image positions: sorties are kept until the watermark has passed them, then told line by line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mosaiq.session import ship

MICRO = 1_000_000
#: Images of the open sorties of a mission, the end of what was told, and the last sortie's number.
STATE = "t_us array<bigint>, image_id array<bigint>, yaw array<double>, told bigint, sortie bigint"
OUT = "mission string, sortie long, image_id long, t_us long, line long, direction int"


def lines_of(t: np.ndarray, yaw: np.ndarray, axis: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places on a line of one sortie's images in order of time, with line (from 1) and direction, as flight.flight_lines."""
    apart = np.abs(yaw - axis)
    off = np.minimum(apart % 180, 180 - apart % 180) > tolerance
    direction = np.where(np.minimum(apart % 360, 360 - apart % 360) <= 90, 1, -1)
    step = np.diff(t)
    typical = float(np.median(step[step > 0])) if (step > 0).any() else MICRO
    broken = np.ones(len(t), bool)
    broken[1:] = off[:-1] | (direction[1:] != direction[:-1]) | (step > max(10.0 * MICRO, 5 * typical))
    line = np.cumsum(~off & broken)
    on = np.flatnonzero(~off)
    return on, line[on], direction[on]


def _told(axis: float, tolerance: float, gap: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, ids, yaw, told, sortie = state.get if state.exists else ([], [], [], None, 0)
        new = [f for f in frames if len(f)]
        t = np.concatenate([np.array(t, np.int64), *(f["t_us"].to_numpy(np.int64) for f in new)])
        ids = np.concatenate([np.array(ids, np.int64), *(f["image_id"].to_numpy(np.int64) for f in new)])
        yaw = np.concatenate([np.array(yaw, np.float64), *(f["yaw"].to_numpy(np.float64) for f in new)])
        if told is not None:  # too late: its sortie is told
            kept = t > told
            t, ids, yaw = t[kept], ids[kept], yaw[kept]
        order = np.lexsort((ids, t))
        t, ids, yaw = t[order], ids[order], yaw[order]
        mark = state.getCurrentWatermarkMs() * 1000
        starts = np.flatnonzero(np.concatenate([[len(t) > 0], np.diff(t) > gap])[: len(t)])
        ends = np.append(starts[1:], len(t))
        at, out = 0, []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if t[b - 1] + gap >= mark:
                break
            sortie, told, at = sortie + 1, int(t[b - 1]), b
            on, line, direction = lines_of(t[a:b], yaw[a:b], axis, tolerance)
            out.append(pd.DataFrame({"mission": key[0], "sortie": sortie, "image_id": ids[a:b][on], "t_us": t[a:b][on], "line": line, "direction": direction}))
        t, ids, yaw = t[at:], ids[at:], yaw[at:]
        state.update((t.tolist(), ids.tolist(), yaw.tolist(), told, sortie))
        if len(t):
            state.setTimeoutTimestamp(max(int((t[np.append(np.flatnonzero(np.diff(t) > gap), len(t) - 1)[0]] + gap) // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield from out

    return run


def flight_lines(images: DataFrame, axis: float, tolerance: float = 30.0, gap_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Lines of a stream (mission, image_id, time, yaw): mission, sortie, image_id, t_us, line, direction; append mode.

    Images may come late and in any order inside the watermark. A sortie is told once the watermark is more than
    gap_seconds past its last image, as no image can join it any more; sorties of a mission are numbered from 1. State is the
    images of the open sorties. Rows without mission, time or heading are left out. The lines are those of
    flight.flight_lines over each sortie, as the median interval needs a whole one.
    """
    ship(images.sparkSession)
    own = images.where("mission is not null and time is not null and yaw is not null").withWatermark("time", late)
    own = own.select(F.col("mission").cast("string").alias("mission"), "time", F.col("image_id").cast("long").alias("image_id"), F.unix_micros("time").alias("t_us"), F.col("yaw").cast("double").alias("yaw"))
    return own.groupBy("mission").applyInPandasWithState(_told(axis, tolerance, gap_seconds * MICRO), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
