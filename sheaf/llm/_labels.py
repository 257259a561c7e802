"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, by: str, sample: int, seed: str, key: str = "doc_id") -> DataFrame:
    """docs joined with labels: of each value of the label ``by`` the rows whose key hash lies under ``sample`` of
    its rows, all if it has no more. Labels of one key count once (the greatest); null labels and keys are left out.

    The sampled labels have about two times ``sample`` rows whatever the input, so they can be broadcast."""
    others = [c for c in labels.columns if c != key]
    known = labels.filter(F.col(by).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in others])
    sizes = {r[0]: r[1] for r in known.groupBy(by).count().collect()}  # a row for each of two label values
    if not sizes:
        return docs.join(known.limit(0), key)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)
    return docs.join(F.broadcast(known.filter(u < share[F.col(by)])), key)
