"""Every query ends by its bounds, on the given vectors and on vectors without any structure."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewarden.llm import topk


def given():
    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    table = pq.read_table(path, columns=["vec_id", "embedding"])
    return np.array(table["vec_id"].to_pylist()), np.floor(256 * np.array(table["embedding"].to_pylist(), float)).astype(np.int64)


def isotropic():
    return np.arange(3000), np.floor(32 * np.random.default_rng(1).normal(size=(3000, 48))).astype(np.int64)


def falling():
    rng = np.random.default_rng(2)
    return np.arange(3000), np.floor(200 * rng.normal(size=(3000, 48)) / np.arange(1, 49)).astype(np.int64)


@pytest.mark.parametrize(("made", "most"), [(given, 0.85), (isotropic, 0.9), (falling, 0.75)])
def test_reading_stops_by_the_bounds(made, most):
    ids, x = made()
    lists, asked = topk.Lists(ids, x), ids % 50 == 0
    got: dict = {}
    for i, c, s in lists.top(x[asked], 5, ids[asked]):
        got.setdefault(i, []).append((s, c))
    for i, (own, q) in enumerate(zip(ids[asked], x[asked], strict=True)):
        scores = x @ q
        assert got[i] == [(int(scores[j]), int(ids[j])) for j in np.lexsort((ids, -scores)) if ids[j] != own][:5]
    assert lists.unstopped == 0
    assert lists.entries_read < most * asked.sum() * x.size


def test_zeros_ties_and_copies():
    ids = np.arange(400)
    x = np.zeros((400, 6), np.int64)
    x[200:] = [3, -1, 2, 0, 5, -4]
    got = topk.Lists(ids, x).top(np.array([[0] * 6, [1, 1, 1, 1, 1, 1], [-1, 0, 0, 0, 0, 0]]), 3, np.array([0, 200, 1]))
    assert got == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 201, 5), (1, 202, 5), (1, 203, 5), (2, 0, 0), (2, 2, 0), (2, 3, 0)]
