import numpy as np
import pytest

from qamill.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string"


def rows_of(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        base = rng.normal(size=32)
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            v = base + rng.normal(size=32) * rng.choice([0, 0.02, 0.08, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 2), "x"))
    return rows


def brute(rows):
    n = len(rows)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min([root[i], *root[link[i]]]) for i in range(n)])
        if (new == root).all():
            break
        root = new
    return link.sum(axis=1), root


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, block):
    rows = rows_of()
    links, root = brute(rows)
    got = {r["vec_id"]: r for r in
           E.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] <= links[i] for i in got)
    assert np.mean([got[i]["component_id"] == root[i] for i in got]) > 0.95
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, ""), (3, [2.0, 0.0], 0, ""),
            (4, [1.0, 0.0], 1, ""), (5, [1.0, 0.0], None, ""), (6, None, 0, ""), (7, [], 0, ""),
            (8, [0.0, 0.0], 0, ""), (9, [nan, 1.0], 0, ""), (10, [inf, 1.0], 0, ""),
            (11, [None, 1.0], 0, ""), (12, [1.0, 0.0, 0.0], 0, ""), (None, [1.0, 0.0], 0, ""),
            (14, [1e-30, 0.0], 0, ""), (15, [3e38, 0.0], 0, ""), (None, None, None, None)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert [by[i]["n_links"] for i in (1, 2, 3, 14, 15)] == [6] * 5
    assert {by[i]["component_id"] for i in (1, 2, 3, 14, 15)} == {1}
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True), i
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 20))
    assert np.allclose(np.linalg.norm(E.rotate(x, 4), axis=1), np.linalg.norm(x, axis=1))
