"""Order-sensitive operators: states, runs, budgets, packing, nesting. Those that a window can express are windows; what compares with an accumulated element is a fold over one group's sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import fold_rows, type_of


def section_state(df: DataFrame, by: list[str], order: list[str], on: Column, off: Column, name: str = "inside") -> DataFrame:
    """Whether a row lies in a section: an on row opens one (it wins over off), an off row ends it and is itself outside."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(w), F.lit(False)))


def continuation(df: DataFrame, by: list[str], order: list[str], seed: Column, follows: Column, name: str = "marked") -> DataFrame:
    """Marks seeds and the unbroken rows after them that follow."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(seed, True).when(~follows, False), ignorenulls=True).over(w)
    return df.withColumn(name, F.coalesce(state, F.lit(False)))


def regular_runs(df: DataFrame, by: list[str], order: list[str], value: str, least: int = 5) -> DataFrame:
    """(by, first, last, n) of maximal runs in which each value is the one before plus 1, of at least so many rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    opened = df.withColumn("__new", F.when(F.col(value) == F.lag(value).over(w) + 1, 0).otherwise(1))
    runs = opened.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("__run")


def running_offset(df: DataFrame, by: list[str], order: list[str], size: str, gap: float = 0, name: str = "offset") -> DataFrame:
    """Where each row begins if rows of the given sizes follow each other with gaps."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.col(size) + F.lit(gap)).over(w), F.lit(0)))


def budgeted_prefix(df: DataFrame, by: list[str], order: list[str], text: str, budget: int, cost: int = 2, least: int = 120) -> DataFrame:
    """The rows of each group while their lengths plus cost stay in the budget; the first over it is cut to what is left and
    kept if that is at least so many characters; nothing after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.length(text) + cost
    upto = df.withColumn("__before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("__before") - cost
    fits = F.length(text) <= left
    kept = upto.filter(fits | ((left >= least) & (F.col("__before") <= budget)))
    return kept.withColumn("kept_text", F.when(fits, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), left.cast("int")))).drop("__before")


def even_sample(df: DataFrame, by: list[str], order: list[str], most: int = 60) -> DataFrame:
    """Of each group all rows, or if it has more than most the ones at round(i (n - 1) / (most - 1)), halves to even."""
    w = Window.partitionBy(*by)
    numbered = df.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    i = F.round(F.col("__r") * (most - 1) / (F.col("__n") - 1))
    hit = F.greatest(*[F.when(F.bround((i + d) * (F.col("__n") - 1) / (most - 1)) == F.col("__r"), ((i + d) >= 0) & ((i + d) <= most - 1)).otherwise(False) for d in (-1, 0, 1)])
    return numbered.filter((F.col("__n") <= most) | hit).drop("__r", "__n")


def pack(df: DataFrame, by: list[str], order: list[str], size: str, items: int = 12, total: int = 6000, name: str = "chunk") -> DataFrame:
    """Greedy chunks of successive rows with at most so many items and so much size; an oversize row stands alone. Gives the
    columns and the chunk's number in the group. A fold that keeps nothing but the running chunk's count and size."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        n, held, chunk = 0, 0, -1
        for r in rows:
            if chunk < 0 or n >= items or held + r[size] > total:
                n, held, chunk = 0, 0, chunk + 1
            n, held = n + 1, held + r[size]
            yield r | {name: chunk}

    slim = df.select(*by, *order, size)
    return fold_rows(slim, by, [*order, size], step, ", ".join([*[type_of(slim, c) for c in slim.columns], f"{name} int"]))


def outline_parents(df: DataFrame, by: list[str], order: str, level: str, levels: int, name: str = "parent") -> DataFrame:
    """The order value of each row's parent: the last earlier row with a smaller level (levels are 1 to levels)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) < k, F.col(order))).over(w) for k in range(1, levels + 1)]
    picked = F.coalesce(*[F.when(F.col(level) == k, last[k - 1]) for k in range(1, levels + 1)])
    return df.withColumn(name, picked)
