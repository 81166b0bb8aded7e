"""Concurrent writers, crashes and transactions of the catalog."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from sparkloom.sources import catalog as K
from sparkloom.types import ColumnDef


def columns():
    return [ColumnDef("k", "INT", primary_key=True), ColumnDef("v", "TEXT")]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def values(c, table="t"):
    return sorted((r.k, r.v) for r in c.table(table).collect())


def test_concurrent_inserts_lose_nothing(spark, root):
    first = K.Catalog(spark, root)
    first.create_table("t", columns())
    writers = [K.Catalog(spark, root) for _ in range(3)]  # as of three processes
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: writers[i % 3].insert("t", [[i, f"v{i}"]]), range(12)))
    assert values(first) == [(i, f"v{i}") for i in range(12)]
    assert sorted(r["_row_id"] for r in first.rows("t").collect()) == list(range(1, 13))


def test_inserts_add_folders_and_are_folded(spark, root, monkeypatch):
    monkeypatch.setattr(K, "MOST_PARTS", 4)
    c = K.Catalog(spark, root)
    c.create_table("t", columns())
    for i in range(7):
        c.insert("t", [[i, "x"]])
        assert len(c._state("t")["parts"]) <= 4
    assert values(c) == [(i, "x") for i in range(7)]
    with pytest.raises(K.ConstraintError):
        c.insert("t", [[3, "again"]])
    with pytest.raises(K.ConstraintError):
        c.insert("t", [[8, "a"], [8, "b"]])
    assert len(values(c)) == 7


def test_a_stale_claim_stops_writers_and_no_reader(spark, root, monkeypatch):
    monkeypatch.setattr(K, "TRIES", 2)
    c = K.Catalog(spark, root)
    c.create_table("t", columns())
    c.insert("t", [[1, "a"]])
    c._claim(f"{c._dir('t')}/claim-{c._version('t') + 1:012d}")  # a writer that died before it published
    with pytest.raises(K.ConflictError, match="claim"):
        c.insert("t", [[2, "b"]])
    assert values(c) == [(1, "a")]


def test_transactions(spark, root):
    c, other = K.Catalog(spark, root), K.Catalog(spark, root)
    c.create_table("t", columns())
    c.begin()
    c.insert("t", [[1, "a"]])
    c.create_table("u", columns())
    c.insert("u", [[1, "b"]])
    assert values(c) == [(1, "a")] and c.table_names() == ["t", "u"]
    assert values(other) == [] and other.table_names() == ["t"]
    c.commit()
    assert values(other) == [(1, "a")] and values(other, "u") == [(1, "b")]
    c.begin()
    c.delete("t")
    c.drop_table("u")
    assert c.table_names() == ["t"]
    c.rollback()
    assert values(c) == [(1, "a")] and c.table_names() == ["t", "u"]
    c.begin()
    c.insert("t", [[2, "mine"]])
    other.insert("t", [[3, "theirs"]])
    with pytest.raises(K.ConflictError):
        c.commit()
    assert values(c) == [(1, "a"), (3, "theirs")]
    for wrong in (c.commit, c.rollback):
        with pytest.raises(ValueError):
            wrong()


def test_a_crash_after_the_commit_record_is_finished_by_the_next_opener(spark, root):
    c = K.Catalog(spark, root)
    c.create_table("t", columns())
    c.create_table("u", columns())
    c.begin()
    c.insert("t", [[1, "a"]])
    c.insert("u", [[1, "b"]])
    pending, c.pending = c.pending, None
    c._write(f"{root}/commit-crashed", json.dumps([[d, t, s] for (d, t), s in sorted(pending.items())]))
    assert values(c) == []
    late = K.Catalog(spark, root)
    assert values(late) == [(1, "a")] and values(late, "u") == [(1, "b")]
    assert values(c) == [(1, "a")]
