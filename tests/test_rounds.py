"""Rounds of complete-link merging: what they cost the driver, and that they merge what the ordered process merges."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from pixkin.operators import clusters

EDGE = "id string, source_id string, target_id string, strong boolean, score int, category string"


def ordered(edges) -> dict:
    rows = [("", a, b, score, 4, i) for i, a, b, _, score, _ in edges]
    found = clusters.greedy(pd.DataFrame(rows, columns=["root", "x", "y", "score", "kind", "id"]))
    sizes = found.groupby("core").size()
    return {n: c for n, c in zip(found["cluster"], found["core"]) if sizes[c] > 1}


@pytest.mark.parametrize("finish, most", [(0, 0), (100_000, 0)])
def test_rounds_that_merge_much_need_no_connected_parts(spark, monkeypatch, finish, most):
    rng, calls, known = random.Random(7), [], clusters.components
    monkeypatch.setattr(clusters, "FINISH_PAIRS", finish)
    monkeypatch.setattr(clusters, "components", lambda e: calls.append(1) or known(e))
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(110)}
    edges = [(f"e{a:02d}-{b:02d}", f"n{a:02d}", f"n{b:02d}", True, rng.randint(45, 99), "almost-certain-duplicate") for a, b in sorted(pairs)]
    got = {r.image: r.core for r in clusters.complete_link(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == ordered(edges) and len(calls) <= most


def test_rounds_that_merge_little_take_connected_parts(spark, monkeypatch):
    calls, known = [], clusters.components
    monkeypatch.setattr(clusters, "FINISH_PAIRS", 0)
    monkeypatch.setattr(clusters, "components", lambda e: calls.append(1) or known(e))
    edges = [(f"e{a:02d}-{b:02d}", f"n{a:02d}", f"n{b:02d}", True, 90, "almost-certain-duplicate") for a in range(14) for b in range(a + 1, 14)]  # equal edges: one pair a round is the best of both its ends
    got = {r.image: r.core for r in clusters.complete_link(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == ordered(edges) == {f"n{i:02d}": "n00" for i in range(14)} and len(calls) == 1
