"""Folds over the sorted rows of each group, one pass, by the task that has the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that leave a task together.
BATCH = 8192


def fold_rows(df: DataFrame, by: list[str], order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that ``step`` makes of each group's rows in order. Groups are dealt by a shuffle and sorted, nulls first; rows
    stream through the task, so a group of any size needs no more memory than step keeps."""
    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        ahead = next(rows, None)

        def group(key: list) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and [ahead[c] for c in by] == key:
                row, ahead = ahead, next(rows, None)
                yield row

        made: list[dict] = []
        while ahead is not None:
            own = group([ahead[c] for c in by])
            for row in step(own):
                made.append(row)
                if len(made) == BATCH:
                    yield pa.RecordBatch.from_pylist(made, out)
                    made = []
            for _ in own:  # what step left
                pass
        if made:
            yield pa.RecordBatch.from_pylist(made, out)

    return df.repartition(*by).sortWithinPartitions(*by, *[F.col(c).asc_nulls_first() for c in order]).mapInArrow(run, schema)


def type_of(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"
