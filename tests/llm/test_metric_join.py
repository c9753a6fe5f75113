import numpy as np
import pytest

from lumenframe.llm import metric_join


def plain(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, *_ in rows}
    for i, v, label in rows:
        for j, w, other in rows:
            if i != j and label == other and usable(v, label) and usable(w, other) and len(v) == len(w):
                a, b = np.array(v, float) / np.abs(v).max(), np.array(w, float) / np.abs(w).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
    least, moved = {i: i for i in links}, True
    while moved:
        moved = False
        for i, near in links.items():
            low = min([least[i], *(least[j] for j in near)])
            moved, least[i] = moved or low < least[i], low
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


def fixture():
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.normal(size=(12, 8))
    for i in range(260):
        v = centres[i % 12] + rng.normal(size=8) * (0.05 + 0.25 * (i % 3)) if i % 2 else rng.normal(size=8)
        rows.append((i, v.tolist(), int(i % 3)))
    angle = lambda t: [float(np.cos(t)), float(np.sin(t))] + [0.0] * 6
    rows += [(1000 - i, angle(0.3 * i), 7) for i in range(12)]  # a chain
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1),
             (404, [float("inf")] + [1.0] * 7, 1), (405, [], 1), (406, rows[1][1], None), (407, [1.0, 2.0], 1),
             (408, [2.0, 4.0], 1), (409, [1e300] * 8, 2), (410, [1e-300] * 8, 2)]
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(9)]
    return rows


@pytest.mark.parametrize(("cell", "pivots"), [(4096, 256), (20, 4), (7, 64)])
def test_matches_brute_force(spark, monkeypatch, cell, pivots):
    monkeypatch.setattr(metric_join, "CELL_ROWS", cell)
    monkeypatch.setattr(metric_join, "MAX_PIVOTS", pivots)
    rows = fixture()
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                    "vec_id long, embedding array<double>, label int, home int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.range_join(vectors).collect()}
    assert got == plain(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric_join.range_join(empty).collect() == []
