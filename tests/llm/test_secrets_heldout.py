"""Precision and recall of the secret scan on a family of secrets that the model never learned from, in real document texts."""

import duckdb
import pytest

import secrets_heldout as H
from sparkloom.llm import secrets_crf as M


@pytest.fixture(scope="module")
def texts():
    found = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) > 200 order by doc_id").fetchall()
    return [t for (t,) in found]


def measure(model, cases):
    hit = missed = false = 0
    for text, (a, b), real, _ in cases:
        got = [(s, e) for s, _, e in M.scan_text(text, model)]
        over = [(s, e) for s, e in got if s < b and a < e]
        if real:  # the whole value must go
            whole = bool(over) and min(over)[0] <= a and max(e for _, e in over) >= b
            hit += whole
            missed += not whole
        elif over:
            false += 1
    return hit / (hit + missed), hit / (hit + false)


def test_precision_and_recall_on_another_family(texts):
    model = M.fit()
    for seed in (5, 6):
        recall, precision = measure(model, H.planted(texts, 1500, seed))
        assert recall > 0.95 and precision > 0.97


def test_documents_without_secrets_get_no_spans_of_the_model(texts):
    model = M.fit()
    found = [[s for s in M.scan_text(t, model) if s[1] == 3] for t in texts]
    assert sum(map(bool, found)) <= len(texts) * 0.002


def test_what_plain_values_lose(texts):
    """Values that could be any word are found beside a word of credentials only: alone in a text they're O by rule."""
    model = M.fit()
    value = "CopperWindowTunnel"
    asked = f"some words before, passphrase: {value} and after"
    alone = f"some words before, {value} and after"
    assert M.mask(asked, M.scan_text(asked, model), "*") == "some words before, passphrase: * and after"
    assert M.scan_text(alone, model) == []
