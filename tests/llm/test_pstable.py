import math

import numpy as np
import pytest

from sparkloom.llm import pstable as M

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.float32(r[1]).astype(float) / np.linalg.norm(np.float32(r[1]).astype(float)) if ok[i] else None for i, r in enumerate(rows)]
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    comp = {}
    for i in range(n):
        if rows[i][0] is not None:
            comp[find(i)] = min(comp.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], comp.get(find(i))) for i in range(n)), key=str)


def data(n, rng):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rows[rng.integers(len(rows))]
            v = np.array(base[1]) + rng.standard_normal(16) * rng.choice([0, 0.01, 0.04, 0.06])
            rows.append((i, [float(np.float32(x)) for x in v], base[2] if rng.random() < 0.9 else 3, "x"))
        else:
            rows.append((i, [float(np.float32(x)) for x in rng.standard_normal(16)], int(rng.integers(2)), "x"))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = data(500, np.random.default_rng(3))
    one = rows[0][1]
    rows += [(9001, None, 1, ""), (9002, [0.0] * 16, 1, ""), (9003, one, None, ""), (9004, [float("nan")] * 16, 1, ""), (9005, [], 1, ""), (9006, one[:8], rows[0][2], "")]
    rows += [(None, one, rows[0][2], ""), (0, one, rows[0][2], ""), (9007, [2 * x for x in one], rows[0][2], ""), (9008, [None, *one[1:]], rows[0][2], "")]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_recall(spark):
    import duckdb

    from sparkloom.llm.queries import op6_pstable_embeddings

    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{d}/embeddings.parquet'").fetchall()
    want = brute(rows)
    got = op6_pstable_embeddings(spark, d).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(300):  # pairs at the threshold itself
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        pairs += [(0, 0, a), (1, 0, 0.98001 * a + math.sqrt(1 - 0.98001**2) * b)]
    for n in (100, 5000, 200_000):  # however many tables the number of rows asks for
        assert M.recall(pairs, n=n) >= 0.99


def test_plan_keeps_the_miss_probability():
    for n in (0, 1, 10**3, 10**6, 10**9):
        k, tables = M.plan(n, 0.98)
        assert (1 - M.collide(0.2) ** k) ** tables <= M.MISS
        assert k == 8 or n * M.collide(math.sqrt(2)) ** k <= M.MATES
    rng = np.random.default_rng(5)  # the probability of one projection, against draws
    for distance in (0.2, 1.0, math.sqrt(2)):
        x = rng.standard_normal(200_000) * distance
        same = np.floor((x + (b := rng.random(200_000) * M.WIDTH)) / M.WIDTH) == np.floor(b / M.WIDTH)
        assert abs(same.mean() - M.collide(distance)) < 0.01


@pytest.mark.parametrize("hashes", [("xxhash64(label, v)", "1"), ("2L", "1"), ("xxhash64(element_at(v, 1))", "1")])
def test_vectors_with_equal_hashes_stay_apart(spark, monkeypatch, hashes):
    monkeypatch.setattr(M, "HASHES", hashes)
    rows = data(120, np.random.default_rng(4))
    rows += [(500 + i, [1.0, *r[1][1:]], r[2], "") for i, r in enumerate(rows[:30])] + [(600, rows[3][1], rows[3][2], "")]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_sketches_lose_no_pair_and_forests_span():
    rng = np.random.default_rng(9)
    for dim in (3, 12, 64):
        m = rng.standard_normal((150, dim))
        m[75:] = m[:75] + rng.standard_normal((75, dim)) * rng.choice([0.001, 0.02, 0.05], (75, 1))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        reach = (math.sqrt(0.04) + 4 * math.sqrt(M.SKETCH) * M.STEP) ** 2
        mine = rng.integers(0, 2, 150)
        hit = m @ m.T >= 0.98
        np.fill_diagonal(hit, False)
        assert not (hit.any(1) & ~M.near_mates(mine, M.sketches(m), 0, 0, reach)).any()
        across = hit & (mine[:, None] != mine[None])
        assert not (across.any(1) & ~M.near_mates(mine, M.sketches(m), 0, 1, reach)).any()
        links, edges = M.judge(mine, np.arange(1, 151), m, np.zeros((150, 0), int), 0, 0, 0.98)
        assert (links == hit @ np.arange(1, 151)).all() and all(hit[a, b] for a, b in edges)
        up = list(range(150))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in zip(*np.nonzero(hit))) and len(edges) == 150 - len({find(x) for x in range(150)})
        links, edges = M.judge(mine, np.arange(1, 151), m, np.zeros((150, 0), int), 0, 1, 0.98)
        assert (links == across @ np.arange(1, 151)).all() and all(across[a, b] for a, b in edges)
        seen = rng.integers(0, 3, (150, 2))  # buckets of earlier tables
        old = (seen[:, None] == seen[None]).any(2)
        links, _ = M.judge(mine, np.ones(150, int), m, seen, 0, 0, 0.98)
        assert (links == (hit & ~old).sum(1)).all()


def test_one_large_group_over_many_blocks(spark, monkeypatch):
    """Hundreds of near copies in one label: every pair is counted once, whatever the blocks."""
    monkeypatch.setattr(M, "BLOCK", 32)
    rng = np.random.default_rng(12)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.05], 1, "") for i in range(400)]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
