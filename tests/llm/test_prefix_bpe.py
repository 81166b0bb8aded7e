import random

import public_tokenizers as P
import pytest
import tiktoken

from sparkloom.llm import prefix_bpe as M

RANKS = M.read_ranks(P.path("byte_bpe_50k.tiktoken"))
BRUTE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return M.TextEncoder(M.PrefixBPE(RANKS), P.PATTERN)


def texts():
    rnd = random.Random(7)
    out = ["", " ", "\n\n", "a" * 3000, "ab" * 900, "<|endoftext|>", "x'll we's 's", "\x1c \x85!\x1f a"]
    return out + ["".join(rnd.choice(" \n\t'sthe é\x1c!1　̀日🙂ßA") for _ in range(rnd.randrange(80))) for _ in range(3000)]


def test_equals_the_reference_encoder(encoder):
    for s in texts():
        ids, decoded = encoder.text(s)
        assert ids == BRUTE.encode_ordinary(s)
        assert decoded == s.encode()


def test_append_and_edit_are_exact(encoder):
    bpe, rnd = encoder.bpe, random.Random(3)
    for _ in range(150):
        data = "".join(rnd.choice("theingrandst ") for _ in range(rnd.randrange(1, 300))).encode()
        last = bpe.table(data)
        more, table = bpe.append(data, last, b"ther")
        assert table == bpe.table(more)
        at = rnd.randrange(len(data) + 1)
        new, table, done = bpe.edit(data, last, at, min(rnd.randrange(6), len(data) - at), rnd.choice([b"", b"zq", b"ing"]))
        assert table == bpe.table(new)
        assert done <= len(new) - at


def test_frame_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "null id", "y"), (3, "same", "z"), (3, "same", "z"), (4, "word " * 60000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = M.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == 6
    for r in got:
        text = {1: "", 2: "", None: "null id", 3: "same", 4: "word " * 60000}[r.doc_id]
        assert r.ids == BRUTE.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert M.digests(M.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0


def test_query(spark):
    import duckdb
    import hashlib

    from sparkloom.llm.queries import op10_prefix_bpe

    d = "/root/testdata/sf0.001"
    want = {}
    for i, t in duckdb.sql(f"select doc_id, coalesce(text, '') from '{d}/documents.parquet'").fetchall():
        ids = BRUTE.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op10_prefix_bpe(spark, d).collect()}
    assert got == want
