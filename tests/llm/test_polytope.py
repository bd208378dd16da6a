import itertools
import math

import numpy as np
import pytest

from skerry.llm import polytope, queries

TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """n_links and component of every row by all pairs."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if usable(v) else None for _, v, _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = rows[i][2] is not None and rows[i][2] == rows[j][2]
        if same and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            links[i] += 1
            links[j] += 1
            up[find(i)] = find(j)
    oid = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    least_id = {}
    for i in range(len(rows)):
        least_id[find(i)] = min(least_id.get(find(i), oid[i]), oid[i])
    return sorted((oid[i], links[i], least_id[find(i)]) for i in range(len(rows)))


def around(rng, centre, cosine):
    u = rng.normal(size=len(centre))
    u -= (u @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def vectors(dim, seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(n // 6):
            centre = rng.normal(size=dim)
            centre /= np.linalg.norm(centre)
            rows += [(centre, label), *((around(rng, centre, c), label) for c in (0.9995, 0.985, 0.975, 0.9))]
    cloud = rng.normal(size=dim)
    cloud /= np.linalg.norm(cloud)
    rows += [(around(rng, cloud, 0.9925), 1) for _ in range(n)]
    return [(int(i), [float(np.float32(x)) for x in v], label) for i, (v, label) in zip(rng.permutation(10 * len(rows)), rows, strict=False)]


@pytest.mark.parametrize("dim", [64, 100, 3])
def test_links_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(polytope, "PART", 16)  # blocks of a cell in several tasks
    rows = vectors(dim, dim)
    got = polytope.Links(spark.createDataFrame(rows, TABLE)).members()
    assert sorted((r["oid"], r["n_links"], r["component"]) for r in got.collect()) == brute(rows)


def test_odd_vectors(spark):
    e = [1.0, 2.0, 3.0]
    rows = [
        (1, e, 0), (2, e, 0), (2, e, 0), (3, [2.0, 4.0, 6.0], 0), (4, e, 1), (5, e, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0),
        (9, [1.0, float("nan"), 3.0], 0), (10, [1.0, float("inf"), 3.0], 0), (None, e, 0), (11, [], 0), (12, [1.0, 2.0], 0), (13, [-0.0, 1.0], 2),
        (14, [0.0, 1.0], 2), (15, [1e-30, 2e-30, 3e-30], 0), (16, [1e30, 2e30, 3e30], 0), (17, [-1.0, -2.0, -3.0], 0),
    ]
    got = polytope.Links(spark.createDataFrame(rows, TABLE)).members()
    assert sorted((r["oid"], r["n_links"], r["component"]) for r in got.collect()) == brute(rows)


def test_repeats_of_one_vector_make_no_pairs(spark):
    rows = [(i, [1.0] * 8, 0) for i in range(3000)] + [(3000, [1.0] * 7 + [1.01], 0)]
    links = polytope.Links(spark.createDataFrame(rows, TABLE))
    assert links.classes.count() == 2 and links.found().count() <= 3
    assert {(r["n_links"], r["component"]) for r in links.members().collect()} == {(3000, 0)}


@pytest.mark.parametrize("n_hashes", [1, 2, 3])
def test_recall_at_the_threshold(n_hashes):
    rng = np.random.default_rng(n_hashes)
    x = polytope.units(rng.normal(size=(4000, 64)))
    y = np.stack([around(rng, v, 0.98) for v in x])
    a, b = polytope.cells(x, n_hashes), polytope.cells(y, n_hashes)
    assert all(len(set(r)) == len(r) for r in a[:50].tolist())
    met = (a[:, :, None] == b[:, None, :]).any(axis=2).reshape(4000, polytope.TABLES, -1).any(axis=2)
    assert met.mean() > 0.97 and met.any(axis=1).mean() >= 0.9995


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(polytope.hadamard(polytope.hadamard(x)), x) and np.allclose((polytope.hadamard(x) ** 2).sum(1), (x**2).sum(1))


def test_query_and_extra_columns(spark, tmp_path):
    rows = vectors(64, 7, 30)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TABLE}, s1 string, node int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_embedding_near_dedup"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = got.collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    kept = polytope.keep_first(table)
    assert kept.columns == table.columns and sorted(r["vec_id"] for r in kept.collect()) == sorted(r["vec_id"] for r in found if r["kept"])
    assert polytope.Links(table.limit(0)).members().count() == 0
