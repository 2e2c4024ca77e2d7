"""Streams of frames: emission in chunks, and packing into batches, with state per key.

State is one number per key (and the number of chunks), or the frames of a batch that isn't full, whatever
the length of a stream. Late data and
event time play no part: chunks are cut by count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmuro.sources.tars import npy_array, npy_bytes


def emit_chunks(frames: DataFrame, key: str, size: int) -> DataFrame:
    """A stream of frames (key, frames BIGINT, final BOOLEAN) as chunks: key, chunk_no, n_frames, is_final.

    A chunk is emitted when size frames are pending; a final row flushes what is pending, as a chunk with
    is_final if there is any, and ends the key's state.
    """
    kind = dict(frames.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, number = state.get if state.exists else (0, 0)
        final, rows = False, []
        for pdf in batches:
            pending += int(pdf["frames"].fillna(0).sum())
            final = final or bool(pdf["final"].fillna(False).any())
        while pending >= size:
            rows.append((k[0], number, size, False))
            pending, number = pending - size, number + 1
        if final:
            if pending:
                rows.append((k[0], number, pending, True))
            if state.exists:
                state.remove()
        else:
            state.update((pending, number))
        yield pd.DataFrame(rows, columns=[key, "chunk_no", "n_frames", "is_final"])

    return frames.select(key, F.col("frames").cast("long").alias("frames"), "final").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, chunk_no long, n_frames long, is_final boolean", "pending long, number long", "append", GroupStateTimeout.NoTimeout)


def pack_frames(samples: DataFrame, lane: str, batch: int, drop_last: bool = False) -> DataFrame:
    """A stream of samples (lane, place, hiddens, targets, final) as batches of so many frames: lane, batch_no, n_frames, hiddens, targets.

    Frames that don't fill a batch are carried over to the lane's next samples; the state of a lane is
    fewer frames than a batch has. Within a micro-batch samples are taken in order of place. A row with
    final, which may have no frames, flushes what is left, unless drop_last, and ends the lane's state.
    """
    kind = dict(samples.dtypes)[lane]
    out = f"`{lane}` {kind}, batch_no long, n_frames long, hiddens array<array<float>>, targets array<array<int>>"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, left_h, left_t = state.get if state.exists else (0, None, None)
        hs, ts = ([], []) if left_h is None else ([npy_array(left_h)], [npy_array(left_t)])
        held = sum(map(len, ts))
        rows = pd.concat(list(batches)).sort_values("place", kind="stable")  # of one micro-batch
        final = bool(rows["final"].fillna(False).any())
        for h, t in rows[["hiddens", "targets"]].itertuples(index=False):
            if t is None or not len(t):
                continue
            hs.append(np.array([np.asarray(x, np.float32) for x in h]))
            ts.append(np.array([np.asarray(x, np.int32) for x in t]))
            held += len(t)
            if held >= batch:
                h, t = np.concatenate(hs), np.concatenate(ts)
                for at in range(0, held - batch + 1, batch):
                    yield pd.DataFrame([{lane: k[0], "batch_no": number, "n_frames": batch, "hiddens": list(h[at : at + batch]), "targets": list(t[at : at + batch])}])
                    number += 1
                rest = held % batch
                hs, ts, held = ([h[-rest:]], [t[-rest:]], rest) if rest else ([], [], 0)
        if final:
            if held and not drop_last:
                yield pd.DataFrame([{lane: k[0], "batch_no": number, "n_frames": held, "hiddens": list(np.concatenate(hs)), "targets": list(np.concatenate(ts))}])
            if state.exists:
                state.remove()
        else:
            state.update((number, npy_bytes(np.concatenate(hs)) if held else None, npy_bytes(np.concatenate(ts)) if held else None))

    rows = samples.select(lane, "place", "hiddens", "targets", "final")
    return rows.groupBy(lane).applyInPandasWithState(run, out, "number long, hiddens binary, targets binary", "append", GroupStateTimeout.NoTimeout)


def windowed_stats(events: DataFrame, time: str, value: str, by: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Beyond the batch operators: counts and means per window of event time, late rows up to a bound."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
