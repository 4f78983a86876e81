"""Differences between consecutive pictures of a stream, with the last picture of every movie as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "movie long, frame_no long, sse long, max_err long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_no, last = state.get if state.exists else (-1, None)
    # a batch's pictures of one movie, in order; those of earlier batches are gone but for the last
    got = pd.concat(list(batches), ignore_index=True).sort_values("frame_no", kind="stable")
    rows = []
    for no, picture in zip(got["frame_no"].tolist(), got["luma"].tolist(), strict=True):
        if no <= last_no:
            continue
        if last is not None and no == last_no + 1 and len(last) == len(picture):
            d = np.asarray(picture, np.int64) - np.asarray(last, np.int64)
            rows.append((key[0], no, int((d * d).sum()), int(np.abs(d).max(initial=0))))
        last_no, last = no, [int(v) for v in picture]
    if last is not None:
        state.update((last_no, last))
    yield pd.DataFrame(rows, columns=["movie", "frame_no", "sse", "max_err"]).astype("int64")


def frame_deltas(pictures: DataFrame) -> DataFrame:
    """(movie, frame_no, sse, max_err) of a stream (movie, frame_no, luma array<int>).

    Pictures of a movie must arrive in order between batches, within one they are sorted; one that comes after a later
    one is left out, as is a difference over a gap. State is one picture a movie.
    """
    return pictures.groupBy("movie").applyInPandasWithState(_step, OUT, "frame_no long, luma array<int>", "append", GroupStateTimeout.NoTimeout)
