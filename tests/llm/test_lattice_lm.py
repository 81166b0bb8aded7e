import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from sparkloom.llm import lattice_lm as M

PATH = P.path("piece_bpe_32k.model")


def enumerate_word(lat, pieces, word):
    """Sum over all segmentations, one by one."""
    s = M.MARK + word
    at = {p: i for i, p in enumerate(pieces) if p}
    total, use = 0.0, Counter()

    def go(i, p, ids):
        nonlocal total
        if i == len(s):
            total += p
            for k in ids:
                use[k] += p
            return
        own = [lat.bytes_at[b] for b in s[i].encode()]
        go(i + 1, p * math.exp(sum(lat.lp[k] for k in own)), ids + own)
        for j in range(i + 1, len(s) + 1):
            k = at.get(s[i:j])
            if k is not None:
                go(j, p * math.exp(lat.lp[k]), ids + [k])

    go(0, 1.0, [])
    return total, use


@pytest.mark.parametrize("word", ["the", "reading", "é", "ab1", "日本", "", "▁a"])
def test_marginal_and_expectation_equal_enumeration(word, monkeypatch):
    pieces = M.vocabulary(PATH)[0]
    lat = M.lattice(PATH)
    p, use = enumerate_word(lat, pieces, word)
    for linear in (32, 0):
        monkeypatch.setattr(M, "LINEAR", linear)
        assert lat.log_word(word) == pytest.approx(math.log(p), rel=1e-9)
        into = [0.0] * len(lat.lp)
        lat.expect(word, 3.0, into)
        assert {k: pytest.approx(3 * v / p, rel=1e-6) for k, v in use.items()} == {k: into[k] for k in use}


def test_prior_is_a_distribution_and_long_words_dont_underflow():
    lat = M.lattice(PATH)
    assert np.exp(lat.logp[lat.logp > -np.inf]).sum() + math.exp(lat.log_end) == pytest.approx(1)
    assert -1e7 < lat.log_word("ab" * 20000) < -1000


@pytest.mark.parametrize("c", ["\u1260", "\U00010348", "\U00013000"])
@pytest.mark.parametrize("ends", [0, 800, 10_000_000])
def test_words_of_byte_spelled_characters_dont_underflow(c, ends):
    """One segmentation, so the log probability is the sum over its pieces and every byte is used as often as it occurs."""
    lat = M.lattice(PATH, None, ends)
    assert c not in M.vocabulary(PATH)[0]
    at = [lat.bytes_at[b] for b in c.encode()]
    mark = lat.log_word("")
    for n in (*range(8, 32), 40):
        assert lat.log_word(c * n) == pytest.approx(mark + n * sum(lat.lp[k] for k in at), rel=1e-9)
        into = [0.0] * len(lat.lp)
        lat.expect(c * n, 2.0, into)
        assert {k: into[k] for k in set(at)} == {k: pytest.approx(2.0 * n * at.count(k), rel=1e-6) for k in set(at)}


def test_frame_with_byte_spelled_words(spark):
    rows = [(i, "the cat " + "\u1260" * (20 + i % 12) + " " + "\U00010348" * (14 + i % 10)) for i in range(30)]
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 30 and all(math.isfinite(r.score) and r.score < -100 for r in got)


def plain_word(pieces, lp, bytes_at, reach, word):
    """Log probability and expected piece use of one word, by sums over all cuts with the textbook formulas."""
    s = M.MARK + word
    n = len(s)
    edges = [(i, j, [pieces[s[i:j]]]) for i in range(n) for j in range(i + 1, min(n, i + reach) + 1) if s[i:j] in pieces]
    edges += [(i, i + 1, [bytes_at[b] for b in s[i].encode()]) for i in range(n)]
    add = lambda xs: (m := max(xs)) + math.log(math.fsum(math.exp(x - m) for x in xs)) if xs else -math.inf
    into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for i, j, ks in edges:
        w = math.fsum(lp[k] for k in ks)
        into[j].append((i, w, ks))
        out[i].append((j, w, ks))
    a, b = [0.0] + [0.0] * n, [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = add([a[i] + w for i, w, _ in into[j]])
    for i in range(n - 1, -1, -1):
        b[i] = add([b[j] + w for j, w, _ in out[i]])
    use = Counter()
    for i in range(n):
        for j, w, ks in out[i]:
            for k in ks:
                use[k] += math.exp(a[i] + w + b[j] - a[n])
    return a[n], use


def brute_scores(rows, rounds):
    """The model column from its definition: prior from ranks, expectation maximisation over all training words, sums of words and end."""
    names, bytes_at, prior = M.vocabulary(PATH)
    pieces = {p: i for i, p in enumerate(names) if p}
    reach = max(map(len, pieces))
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    words, ends = Counter(w for t in train for w in tokens(t)), len(train)
    counts = np.zeros(len(names))
    for r in range(rounds + 1):
        mass = prior * 32000.0 + counts
        total = mass.sum() + ends + 1
        with np.errstate(divide="ignore"):
            lp = np.log(mass / total).tolist()
        if r == rounds:
            break
        counts = np.zeros(len(names))
        for w, c in words.items():
            for k, x in plain_word(pieces, lp, bytes_at, reach, w)[1].items():
                counts[k] += c * x
    of = {w: plain_word(pieces, lp, bytes_at, reach, w)[0] for _, t in rows for w in set(tokens(t))}
    return [(math.log((ends + 1) / total) + math.fsum(of[w] for w in tokens(t))) / math.log(10) for _, t in rows]


@pytest.mark.parametrize("head", [200_000, 40, 0])
def test_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    rows = [(i, f"the Cat and the dog {i % 7} sat on a mat " * (i % 3) + f"word{i} \u00c9t\u00e9 \u65e5\u672c " + "x" * (i * 3)) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "null id"), (7, "again the cat"), (7, "again the cat"), (60, "\u1260" * 45), (61, "abcdefghij" * 30)]
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = sorted(zip([str(i) for i, _ in rows], brute_scores(rows, M.ROUNDS)))
    for (i, w), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.score)), strict=True):
        assert i == str(r.doc_id) and r.score == pytest.approx(w, rel=2e-5)  # counts are summed in thousandths


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_long_words_are_exact_whatever_the_block(monkeypatch, block):
    """Scores and expected counts of long words equal the plain sums over all cuts, with no seam at a block's end."""
    monkeypatch.setattr(M, "BLOCK", block)
    names, bytes_at, _ = M.vocabulary(PATH)
    pieces = {p: i for i, p in enumerate(names) if p}
    lat = M.lattice(PATH)
    for word in ("information" * 40, "http://example.org/" * 21 + "\u65e5\u672c", "a" * 333):
        total, use = plain_word(pieces, lat.lp, bytes_at, lat.reach, word)
        assert lat.log_word(word) == pytest.approx(total, rel=1e-9)
        into = [0.0] * len(lat.lp)
        lat.expect(word, 2.0, into)
        assert {k: pytest.approx(2 * v, rel=1e-6, abs=1e-12) for k, v in use.items()} == {k: into[k] for k in use}


def test_a_training_word_beyond_4096_characters_counts_exactly(spark):
    """Expected counts of a word of 9000 characters are those of its own lattice, not of parts."""
    word = "".join("information theory"[(i * i) % 18] for i in range(9000)).replace(" ", "q")
    lat = M.lattice(PATH, None, 3.0)
    names, bytes_at, _ = M.vocabulary(PATH)
    use = plain_word({p: i for i, p in enumerate(names) if p}, lat.lp, bytes_at, lat.reach, word)[1]
    counts = np.zeros(len(lat.lp))
    for k, x in use.items():
        counts[k] = round(x * 1000) / 1000
    want = M.lattice(PATH, counts, 3.0)
    got = M.train(spark.createDataFrame([(word, 1)], "w string, c long"), PATH, 3.0, rounds=1)
    seen = want.logp > -np.inf
    assert np.allclose(got.logp[seen], want.logp[seen], atol=1e-6)


def test_head_is_chosen_by_a_threshold_on_counts(spark):
    words = spark.createDataFrame([(f"w{i}", max(1, 1000 // (i + 1)), 0.0) for i in range(500)] + [("v" * 80, 10**6, 0.0), ("u", 0, 0.0)], "w string, c long, s double")
    for most in (0, 1, 10, 100, 600):
        top = M.most_frequent(words, most).collect()
        assert len(top) <= most and top == sorted(top, key=lambda r: -r.c) or {r.c for r in top} == {r.c for r in words.collect() if r.c and len(r.w) <= 64 and top and r.c >= min(x.c for x in top)}
        rest = [r.c for r in words.where("length(w) <= 64").collect() if r.w not in {x.w for x in top}]
        assert not top or min(r.c for r in top) > max(rest, default=0)
    assert len(M.most_frequent(words, 600).collect()) == 500 and len(M.most_frequent(words, 10).collect()) >= 8


def brute(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    lp = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(i, held(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), None]), n, sum(map(lp, [*tokens(t), None]))) for i, t in rows], held, tokens


def check(rows, got):
    want, held, tokens = brute(rows)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(got, key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g.base_score == pytest.approx(w[5], abs=1e-6)
    return got


def test_frame_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 5)
    rows = [(i, "the cat and the dog " * (i % 4) + f"Word{i} É") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "null id word"), (7, "the THE\x0bthe\x1ce"), (7, "the THE\x0bthe\x1ce"), (102, "long " * 70000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, w string")
    got = check(rows, M.score(df, PATH).collect())
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert M.score(df.limit(0), PATH).count() == 0


def test_query_learns(spark):
    """Scores are the trained lattice's, and training helps held-out texts."""
    import duckdb

    from sparkloom.llm.queries import op4_lattice_lm

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = check(rows, op4_lattice_lm(spark, d).collect())
    prior, text = M.lattice(PATH), dict(rows)
    before = sum(sum(map(prior.log_word, M.lower(text[r.doc_id] or "").split())) / M.LN10 for r in got if r.held_out)
    assert sum(r.score for r in got if r.held_out) > before
