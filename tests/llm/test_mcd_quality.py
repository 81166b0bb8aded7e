import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import mcd_quality as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if seen[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "one", "a b c a b c a b", "x " * 40000, "é è \x1c|\x0b<>"]
    texts += ["".join(rnd.choice(["a", "b", " ", " ", "\n", "c", "#", "é"]) for _ in range(rnd.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in M.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.id]), texts[r.id]


def prose(rnd, n, junk=False):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) + ("###" if junk else "") for _ in range(n))


def test_junk_goes_and_clean_stays(spark):
    rnd, rows = random.Random(9), []
    for i in range(600):
        junk = i % 5 == 0
        rows.append((i, prose(rnd, rnd.randrange(60, 400), junk), rnd.choice(["en", None]), rnd.choice(["a", "b", None]), "extra"))
    rows += [(1000, "too short", "en", "a", ""), (1001, None, None, None, None), (None, prose(rnd, 80), "en", "a", ""), (6, rows[6][1], "en", "a", "")]
    rows += [(2000, prose(rnd, 30000), "en", "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    kept = Counter()
    for r in M.report(M.judge(df)).collect():
        if r.doc_id is None or r.doc_id in (6, 2000):
            assert r.kept
        elif r.doc_id >= 1000:
            assert r.base_failed and not r.kept
        else:
            kept[(r.doc_id % 5 == 0, r.kept)] += 1
    assert kept[(True, True)] == 0 and kept[(False, False)] == 0


def test_small_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert M.judge(spark.createDataFrame([], schema)).count() == 0
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, prose(rnd, 60, i == 0), "en", f"s{i}") for i in range(10)], schema)
    assert all(r.kept and r.d2 is None for r in M.judge(df).collect())


def test_distance_equals_numpy(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randrange(60, 300), rnd.random() < 0.2), "en", "s") for i in range(200)]
    j = M.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    r = j[0]
    low = np.array([[1, 0, 0, 0], [r.l21, 1, 0, 0], [r.l31, r.l32, 1, 0], [r.l41, r.l42, r.l43, 1]])
    scatter = low @ np.diag([r.v1, r.v2, r.v3, r.v4]) @ low.T
    center = np.array([r.m1, r.m2, r.m3, r.m4])
    for q in j:
        y = np.array([q.x1, q.x2, q.x3, q.x4]) / M.UNIT - center
        assert np.isclose(q.d2, y @ np.linalg.solve(scatter, y))
    assert sum(not q.kept for q in j) == sum(q.n_symbols > 0 for q in j)


def test_repeated_lines_and_words_alone_are_rejected(spark):
    """70 % repeated lines with 45 % repeated words go, one repeated line of a short text stays, however tight the group."""
    rnd = random.Random(3)
    rows = [(i, "\n".join(prose(rnd, 12) for _ in range(rnd.randrange(6, 30))), "en", "s") for i in range(300)]
    line = prose(rnd, 10)
    for i in range(10):
        fresh = [prose(rnd, 14) for _ in range(6)]
        rows.append((1000 + i, "\n".join(fresh + [" ".join(line.split()[:6])] * 14), "en", "s"))
        rows.append((2000 + i, "\n".join([line, prose(rnd, 40), line]), "en", "s"))
    got = {r.doc_id: r for r in M.report(M.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[i].kept for i in range(300))
    assert all(not got[1000 + i].kept for i in range(10)) and any(not got[1000 + i].base_failed for i in range(10))
    assert all(got[2000 + i].kept for i in range(10))


def fast_mcd(x, floor, rng, starts=200, steps=30):
    """Minimum covariance determinant by random subsets and concentration to convergence, then reweighted: an independent way."""
    n, d = x.shape
    h = (n + d + 1) // 2
    ridge = np.diag(np.square(floor))
    best = (np.inf, None, None)
    for _ in range(starts):
        part = x[rng.choice(n, d + 1, replace=False)]
        for _ in range(steps):
            mu, cov = part.mean(0), np.cov(part.T, bias=True) * M.HALF_FACTOR + ridge
            d2 = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            nxt = x[np.argsort(d2, kind="stable")[:h]]
            if nxt.shape == part.shape and np.array_equal(np.sort(nxt, 0), np.sort(part, 0)):
                break
            part = nxt
        det = np.linalg.det(np.cov(part.T, bias=True) * M.HALF_FACTOR + ridge)
        if det < best[0]:
            best = (det, part.mean(0), np.cov(part.T, bias=True) * M.HALF_FACTOR + ridge)
    _, mu, cov = best
    d2 = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
    inner = x[d2 <= M.REWEIGHT_D2]
    mu, cov = inner.mean(0), np.cov(inner.T, bias=True) * M.REWEIGHT_FACTOR + ridge
    return np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_verdicts_equal_an_independent_estimate(spark, share):
    """Random-subset MCD in numpy gives the same verdicts and nearly the same distances."""
    rnd, rng = random.Random(7), np.random.default_rng(7)
    rows = []
    for i in range(400):
        bad = rnd.random() < share
        text = "\n".join(prose(rnd, rnd.randrange(5, 20), bad and rnd.random() < 0.8) for _ in range(rnd.randrange(8, 20)))
        rows.append((i, text, "en", "s"))
    got = M.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not base_failed").collect()
    x = np.array([[r.x1, r.x2, r.x3, r.x4] for r in got]) / M.UNIT
    want = fast_mcd(x, M.FLOOR, rng)
    ours = np.array([r.d2 for r in got])
    assert ((ours <= M.CUTOFF_D2) == (want <= M.CUTOFF_D2)).mean() > 0.99
    inner = want < M.REWEIGHT_D2
    assert np.abs(ours[inner] - want[inner]).max() < 2 and np.corrcoef(ours[inner], want[inner])[0, 1] > 0.99


def test_labelled_documents(spark):
    """Documents of quality 1 stay and of quality 0 go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id AS id", "quality")
    got = M.judge(docs).where("not base_failed").join(labels, "id").select("quality", "kept").collect()
    clean = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
