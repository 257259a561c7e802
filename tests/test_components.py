"""Connected components of long chains."""

from __future__ import annotations

import random

import pytest

from sheaf.operators import components as comp


def test_long_chain_is_one_component(spark):
    """A chain in mixed order: labels that only spread and jump are not done after 50 rounds."""
    order = list(range(500))
    random.Random(5).shuffle(order)
    nodes = spark.createDataFrame([(i,) for i in range(501)], "k long")
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = {r.k: r.component for r in comp.components(nodes, edges, "k").collect()}
    assert got == {i: 0 for i in range(500)} | {500: 500}


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "k long")
    assert {tuple(r) for r in comp.components(nodes, spark.createDataFrame([], "a long, b long"), "k").collect()} == {(1, 1), (2, 2)}


def test_bound_of_roots_is_an_error(spark):
    jaccard_join = pytest.importorskip("sheaf.llm.jaccard_join")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        jaccard_join.roots(edges, most=2)
    assert {tuple(r) for r in jaccard_join.roots(edges).collect()} == {(i, 0) for i in range(1, 41)}
