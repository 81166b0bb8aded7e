import random

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash as M
from sparkloom.llm.components import components


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    for edges in ([(i, i + 1) for i in range(120)] + [(200, 200)], [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 400)]):
        df = spark.createDataFrame(edges + [edges[0]], "a long, b long")
        nodes = {x for e in edges for x in e if e[0] != e[1]}
        assert dict(map(tuple, components(df, "a", "b").collect())) == brute_components([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_links_connect_all_pairs(spark, hot, monkeypatch):
    """Both ways of a bucket give the components of all pairs within two bits."""
    monkeypatch.setattr(M, "HOT_BUCKET", hot)
    rnd = random.Random(hot)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rnd.randrange(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    edges = [tuple(r) for r in M.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    assert brute_components(edges, signed) == brute_components(pairs, signed)


@pytest.mark.parametrize("segments", [None, 3, 4, 9, 15])
def test_links_are_the_same_with_any_segments(spark, segments):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    fps |= {f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in list(fps) for _ in range(4)}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    edges = [tuple(r) for r in M.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, segments).collect()]
    assert set(edges) <= set(pairs) and brute_components(edges, signed) == brute_components(pairs, signed)


def test_segments_follow_the_number_of_fingerprints():
    got = [M.segments_for(10**k) for k in range(14)]
    assert got[0] == 5 and got == sorted(got) and got[-1] == 15


def test_documents(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "x y z"]
    for _ in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randrange(5, 400))]
        texts += [" ".join(t)] * rnd.randrange(1, 4)
        t[rnd.randrange(len(t))] = "other"
        texts.append("\t".join(t))
    texts.append(" ".join(rnd.choice(words) for _ in range(70000)))
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "one", 0), (3, "one", 0)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fp(t) for i, t, _ in rows if i is not None}
    pairs = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    want = brute_components(pairs, fp)
    for r in got:
        assert r.fp & (1 << 64) - 1 == (fp[r.id] if r.id is not None else fp[3])
        assert r.component_id == (want[r.id] if r.id is not None else want[3])
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
