"""The pipeline against what each stage must do, on a small table with planted cases."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline as M
from sparkloom.llm import prefix_bpe, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"
BRUTE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def planted():
    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    rows = [[i, prose(rnd.randrange(60, 300)), "en", f"s{i % 3}"] for i in range(240)]
    rows += [[300 + i, rows[i][1], "en", "s0"] for i in range(20)]  # exact copies
    rows += [[0, rows[0][1], "en", "s0"]]  # a repeated row
    long = prose(30000)
    rows += [[400, long, "en", "s1"], [401, long + " tail", "en", "s1"]]  # near copies
    rows += [[500 + i, " ".join(w + "###" for w in prose(100).split()), "en", "s2"] for i in range(30)]  # junk
    rows += [[600, None, "en", "s0"], [601, "", None, None], [602, "short", "en", "s1"], [None, prose(90), "en", "s1"]]
    rows += [[700, prose(70) + ' password = "hunter2hunter2" ' + prose(20), "en", "s2"]]
    return [(*r, None if r[1] is None else len(r[1]), "x") for r in rows]


def brute_targets(have, total):
    """Shares 3, 1, 2 of the total by source; a source stops at twice its words, the rest goes on."""
    weight = dict(zip(sorted(have), (3, 1, 2)))
    goal = {}
    while True:
        open_ = {s: w for s, w in weight.items() if s not in goal}
        rate = (total - sum(goal.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if w * rate > 2 * have[s]]
        if not over:
            return goal | {s: w * rate for s, w in open_.items()}
        goal |= {s: 2 * have[s] for s in over}


def test_stages(spark):
    data = planted()
    docs = spark.createDataFrame(data, SCHEMA)
    kept = M.quality_rules(spark, docs, "")
    assert kept.columns == [*COLUMNS, "row"]
    good = kept.collect()
    ids = Counter(r.doc_id for r in good)
    assert not {600, 601, 602} & set(ids) and not any(i is not None and 500 <= i < 600 for i in ids)
    assert len(good) == len(data) - 33
    one = M.simhash_dedup(spark, kept, "")
    left = one.collect()
    ids = Counter(r.doc_id for r in left)
    assert set(ids) == {*range(240), 400, 700, None} and set(ids.values()) == {1} and one.columns == kept.columns
    safe = {r.doc_id: r for r in M.secret_scan(spark, one, "").collect()}
    text = {r.doc_id: r.text for r in left}
    for i, r in safe.items():
        if i == 700:
            assert "hunter2" not in r.text and "[secret]" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == text[i] and r.n_chars == len(r.text)
    mixed = M.mix_sources(spark, M.stage(spark.createDataFrame(list(safe.values()), one.schema), "t"), "")
    taken = mixed.collect()
    assert mixed.columns == one.columns and max(Counter(r.doc_id for r in taken).values()) <= 2
    words = lambda rs: Counter({s: sum(len(r.text.split()) for r in rs if r.source == s) for s in ("s0", "s1", "s2")})
    have, got = words(safe.values()), words(taken)
    goal = brute_targets(have, 1.5 * sum(have.values()))
    for s in have:  # every source ends within its largest document of its target
        assert abs(got[s] - goal[s]) <= max(len(r.text.split()) for r in safe.values() if r.source == s)
    coded = M.encode_bpe(spark, mixed, "").collect()
    want = sorted((str(r.doc_id), tuple(BRUTE.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in taken)
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded_sha256) for r in coded) == want
    assert all(r.n_tokens == len(r.ids) for r in coded)


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(planted(), SCHEMA).drop("row").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).drop("row").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert M.run(spark, f"{tmp_path}/a").count() > 200
    assert M.run(spark, f"{tmp_path}/b").count() == 0


def test_dedup_keeps_one_of_each_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = simhash.near_duplicates(docs).collect()
    want = sorted({r.component_id for r in found})
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_dedup_by_identifier_null_last_and_clashing_names(spark):
    rows = [(7, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (None, "x y z", 4), (None, "x y z", 5), (9, None, 6), (8, "", 7), (3, "a b c d e f", 8)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, __row long"))
    assert got.columns == ["doc_id", "text", "__row"]
    left = sorted(map(tuple, got.collect()), key=str)
    assert [r[0] for r in left] == [3, 8, None] and left[2][1] == "x y z"


def test_secret_in_a_very_long_text(spark):
    from sparkloom.llm import secrets_crf

    text = "some plain words " * 200000 + ' password = "hunter2hunter2" ' + "and more " * 200000
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    got = secrets_crf.redact(docs, secrets_crf.fit(docs), chars_col="n_chars").first()
    assert "hunter2" not in got.text and got.n_chars == len(got.text) and got.text.startswith("some plain words") and got.text.endswith("and more ")
