import re
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import pivotal as M

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, live = 1.5 * sum(size.values()), {}, list(order)
    while live:
        rate = left / sum(w[s] for s in live)
        over = [s for s in live if w[s] * rate >= 2 * size[s]]
        if not over:
            target |= {s: w[s] * rate for s in live}
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            live.remove(s)
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def rows():
    rng = np.random.default_rng(5)
    out = [(1, None, None, "x"), (2, "", "b", "x"), (None, "a b c", "b", "x"), (None, "a b c", "b", "x")]
    for i in range(3000):
        source = [None, "a", "b", "c", "é", "zz"][min(5, int(rng.exponential(1.3)))]
        out.append((i + 10, "w " * int(rng.integers(0, 60)), source, "x"))
    return out


def test_round_cell_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 50, 40).astype(float)
    x = rng.random(40)
    mean = np.zeros(40)
    for k in range(4000):
        y, at = M.round_cell(x, s, np.random.default_rng([k]))
        assert abs((y * s).sum() - (x * s).sum()) < 1e-6
        assert all(v in (0.0, 1.0) for i, v in enumerate(y) if i != at)
        mean += y / 4000
    assert abs(mean - x).max() < 0.05


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 64)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    sized = M.sizes(df)
    got = M.mix(sized, M.targets(sized)).collect()
    assert len(got) == len(data)
    size = defaultdict(int)
    for _, t, s, _ in data:
        size[s] += words(t)
    want, taken, largest = brute_targets(size), Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = M.mix(sized, M.targets(sized)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_rows_are_repeated(spark):
    from sparkloom.llm.common import stage
    from pyspark.sql import functions as F

    df = stage(spark.createDataFrame(rows(), SCHEMA).withColumn("r", F.monotonically_increasing_id()), "t")
    sized = M.sizes(df, row_col="r")
    mixed = M.mix(sized, M.targets(sized)).cache()
    out = M.mixed_rows(df, mixed, "r")
    assert out.columns == ["doc_id", "text", "source", "size"]
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_empty_and_wordless(spark):
    for data in ([], [(1, None, "a", ""), (2, " ", None, "")]):
        sized = M.sizes(spark.createDataFrame(data, SCHEMA))
        got = M.mix(sized, M.targets(sized)).collect()
        assert len(got) == len(data) and all(r.size == 0 and r.target == 0 for r in got)
