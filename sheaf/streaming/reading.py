"""Last-writer-wins reading state as a stream: micro-batches folded into state by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "updated_at long, reading string, last_read long, n_accepted long"


def reading_state_stream(events: DataFrame, now: int, tolerance: int = 60_000) -> DataFrame:
    """Of a stream (user_id, event_id, stamp, reading, read) the state after each micro-batch, by key; the last row of a
    key is its state. Rows of a micro-batch are taken in order of arrival (event_id); state is one row for each key."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, reading, last, n = state.get if state.exists else (0, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        stamp, read = rows["stamp"].to_numpy(), rows["read"].to_numpy()
        accepted = stamp > np.maximum.accumulate(np.append(top, stamp))[:-1]
        if accepted.any():
            top, reading = stamp[accepted][-1], rows["reading"].to_numpy()[accepted][-1]
            last, n = max(last, read[accepted].max()), n + int(accepted.sum())
        state.update((int(top), reading, int(last), int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "updated_at": [top], "reading": [reading], "last_read": [last], "n_accepted": [n]})

    sane = events.filter(F.col("stamp").between(0, now + tolerance) & F.col("read").between(0, now + tolerance))
    return sane.groupBy("user_id").applyInPandasWithState(fold, f"user_id long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
