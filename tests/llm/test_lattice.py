import numpy as np
import pytest

from strandloom.llm import lattice as lt
from strandloom.llm.simhash import Forest


def test_nearest_e8_is_the_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(200, 8)) * 2
    p = lt.nearest_e8(y)
    assert ((p * 2 == np.rint(p * 2)).all()) and (p.sum(axis=1) % 2 == 0).all()
    near = ((y - p) ** 2).sum(axis=1)
    # none of the 240 neighbours is nearer, and no point of E8 is further than 1 from any place
    assert all((((y - p - r) ** 2).sum(axis=1) >= near - 1e-12).all() for r in lt.roots()) and near.max() <= 1 + 1e-12


def test_cells_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(300, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole = lt.cells(unit)
    assert (np.concatenate([lt.cells(unit[k : k + 7]) for k in range(0, 300, 7)]) == whole).all()


def brute(ids, x, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    forest = Forest(len(ids))
    forest.link(*np.nonzero(near))
    root = forest.roots()
    return near.sum(axis=1) - 1, [min(i for i, r in zip(ids, root) if r == s) for s in root]


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 900)] + rng.normal(size=(900, 32)) * rng.choice([0.02, 0.1, 0.2], size=(900, 1))
    x[100:400] = centres[0] + rng.normal(size=(300, 32)) * 0.05  # a large group of near copies
    x[500:560] = x[500]  # and one of copies
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(5000)[:900].tolist()
    frame = spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, node int")
    found = {r["vec_id"]: r for r in lt.near_duplicates(frame).collect()}
    links, component = brute(ids, x, lt.COSINE)
    got = np.array([found[i]["n_links"] for i in ids])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
    assert np.mean([found[i]["component_id"] == c for i, c in zip(ids, component)]) > 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [1e30, 2e30]), (12, [-1.0, -2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lt.near_duplicates(frame).collect()), key=str)
    same = 5  # the other five of 7, 8, 9, 9, null and 11
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12)] + [(7, same, 7, True), (8, same, 7, False), (9, same, 7, False), (9, same, 7, False), (None, same, 7, False), (11, same, 7, False)]
    assert found == sorted(want, key=str)
    assert lt.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("chunk", [16])
def test_hot_cells_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(lt, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=32) + rng.normal(size=(120, 32)) * 0.02).astype(np.float32)
    found = lt.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in found} == {119} and {r["component_id"] for r in found} == {0}


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [32, 64, 256])
@pytest.mark.parametrize("n", [1000, 50_000, 2_000_000])
def test_recall_of_the_plans(dim, n):
    """Of random pairs at a cosine of just 0.95, the plan for n vectors finds nearly all, in whatever dimension."""
    rng = np.random.default_rng(dim)
    x, y = unit(rng.normal(size=(800, dim))), rng.normal(size=(800, dim))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    a, b = (lt.cells(v, *lt.plan(n)) for v in (x, z))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.97 and (np.bitwise_count(lt.sketches(x) ^ lt.sketches(z)) <= lt.SKETCH).mean() > 0.998


def test_few_unlike_vectors_meet_however_many_there_are():
    rng = np.random.default_rng(8)
    for n in (1000, 8000, 30_000):
        blocks, scale, _ = lt.plan(n)
        found = lt.cells(unit(rng.normal(size=(n, 48))), blocks, scale, 1)[:, 0]
        home, count = np.unique(found[:, 0], return_counts=True)
        at = np.minimum(np.searchsorted(home, found[:, 1:].ravel()), len(home) - 1)
        there = count[at] * (home[at] == found[:, 1:].ravel())
        assert ((count * (count - 1)).sum() + 2 * there.sum()) / n <= 2 * lt.MEET


def test_names_that_clash(spark):
    rows = [(1, [1.0, 2.0], [5], 6, True, 7), (2, [1.0, 2.001], [5], 6, True, 7), (3, [2.0, -1.0], [5], 6, False, 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cells array<long>, copies long, good boolean, sketch long")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lt.near_duplicates(frame).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
