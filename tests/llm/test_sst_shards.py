import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from sparkloom.llm import sst_shards as M

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)  # as it is: no switch of the library is touched


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids + [1]


def test_chunked_encoding_equals_whole_texts():
    rnd = random.Random(5)
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|> <|startoftext|>", "a<|endoftext|>b", "É<|endoftext|>\u0301x <|startoftext|><|endoftext|>", "<|endoftext", "日<|endoftext|>本", "<|endoftext|>'s it's  <|x|>", "İ<|ENDOFTEXT|>"]
    texts = ["", "ΑΣ ΑΣ", *special, "a" * 500] + ["".join(rnd.choice([*special, " ", "abc", "É", "'s", "x'", "日", "."]) for _ in range(rnd.randrange(9))) for _ in range(500)]
    texts += ["".join(rnd.choice(" \n\t'sthe é\x1c!1　̀ÉΣİßＡ日🙂") for _ in range(rnd.randrange(70))) for _ in range(2000)]
    enc = M.ChunkEncoder(PATH, "<u2")
    want = [np.asarray(LIB.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert enc.texts(texts) == want == [enc.whole(t) for t in texts]
    assert LIB.encode("<|endoftext|>", add_special_tokens=False).ids == [49407] and not LIB.encode_special_tokens


def test_latin_letters_and_marks():
    """Every Latin-1 character between letters, apostrophes and digits."""
    chars = [chr(c) for c in range(256)]
    texts = [f"{a}{c}{b}" for c in chars for a in ("ab", "A", "1", "'", "", "\xaa") for b in ("cd", "'s", "1", "'", "", ".")]
    enc = M.ChunkEncoder(PATH, "<u2")
    assert enc.texts(texts) == [np.asarray(x.ids, "<u2").tobytes() for x in LIB.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_lookup(spark):
    rows = [(5, "five words are in here"), (None, "no id"), (-3, None), (7, ""), (5, "five again"), (2**62, "big " * 50000), (0, "zero\nline")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, start string")
    manifest = M.write_shards(df, PATH, 1, shards=3).cache()
    got = M.read_shards(manifest).collect()
    want, start = [], 0
    hashed = dict(map(tuple, df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, ''))").collect()))
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""])):
        want.append((i, start, len(ids(t)), ids(t)))
        start += len(ids(t))
    assert sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == [(b, a, c, d) for a, b, c, d in want]
    shards = manifest.collect()
    assert sorted(x.tolist() for x in M.lookup(shards, 5)) == sorted([ids("five again"), ids("five words are in here")])
    assert [x.tolist() for x in M.lookup(shards, None)] == [ids("no id")]
    assert M.lookup(shards, 6) == []


def test_many_blocks(spark):
    df = spark.range(3000).selectExpr("id * 7 - 9000 doc_id", "repeat(concat('w', id, ' '), 40) text")
    shards = M.write_shards(df, PATH, 1, shards=2).collect()
    assert sum(r.n_docs for r in shards) == 3000
    for k in (-9000, 0 * 7 - 9000 + 7 * 1234, 2999 * 7 - 9000):
        n = (k + 9000) // 7
        assert [x.tolist() for x in M.lookup(shards, k)] == [ids(f"w{n} " * 40)]
    assert M.lookup(shards, -8999) == []


def test_hot_identifiers_go_on_in_further_shards(spark):
    """Most rows share one identifier or none: no shard gets them all, and a lookup finds every one."""
    rows = [(9, f"text number {i}") for i in range(600)] + [(None, f"without {i % 3}") for i in range(600)] + [(i + 10, "alone") for i in range(50)]
    shards = M.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 1, shards=8).collect()
    assert len(shards) == 8 and max(r.n_docs for r in shards) < 400
    assert sorted(x.tolist() for x in M.lookup(shards, 9)) == sorted(ids(t) for i, t in rows if i == 9)
    assert len(M.lookup(shards, None)) == 600
    read = M.read_shards(spark.createDataFrame(shards, M.MANIFEST)).collect()
    at = 0
    for r in sorted(read, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(read, key=lambda r: r.start)]
    assert keys == sorted(keys) and len(keys) == len(rows)


def test_files_of_failed_attempts_go(spark, tmp_path):
    left = tmp_path / "shard-000000-old.sst"
    left.write_bytes(b"torn")
    shards = M.write_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, 1, path=f"file://{tmp_path}").collect()
    assert sorted(str(f) for f in tmp_path.glob("*.sst")) == sorted(r.path.removeprefix("file://") for r in shards)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.read_shards(M.write_shards(df, PATH, 1)).count() == 0


def test_query(spark):
    import duckdb

    from sparkloom.llm.queries import op3_token_shards

    d, want, start = "/root/testdata/sf0.001", [], 0
    for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet' order by doc_id").fetchall():
        x = ids(t)
        want.append((i, start, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, op3_token_shards(spark, d).collect())) == want
