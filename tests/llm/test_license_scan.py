import random

import numpy as np
import pytest

from sparkloom.llm import license_scan as M
from sparkloom.llm.license_templates import templates

TEMPLATES = templates()
INDEX = M.Index(TEMPLATES)
SCHEMA = "doc_id long, text string, license string"


def brute(template, text):
    """Best local alignment over the whole matrix, of equal scores the most matched words; the places it matches."""
    n, m = len(template), len(text)
    best = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    top, where = (0, 0), (0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s, k = best[i - 1][j - 1]
            same = template[i - 1] == text[j - 1]
            ways = [(0, 0), (s + 1, k + 1) if same else (s - 1, k), (best[i - 1][j][0] - 1, best[i - 1][j][1]), (best[i][j - 1][0] - 1, best[i][j - 1][1])]
            best[i][j] = max(w for w in ways if w[0] >= 0)
            if best[i][j] > top:
                top, where = best[i][j], (i, j)
    return top, where


def test_winnowing_guarantee():
    rnd = random.Random(1)
    for _ in range(300):
        h = [rnd.randrange(50) for _ in range(rnd.randrange(1, 40))]
        got = M.winnow(h)
        assert all(any(a <= i < a + M.WINDOW for i in got) for a in range(max(1, len(h) - M.WINDOW + 1)))


def test_alignment_equals_full_matrix():
    """Score, matched words, coverage and span of templates with replaced, lost and inserted words, against the whole matrix."""
    rnd = random.Random(2)
    unique = 0
    for _ in range(300):
        t = [rnd.randrange(1000) for _ in range(rnd.randrange(5, 40))]
        x = t[:]
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(x))
            x[k : k + rnd.randrange(2)] = [2000 + rnd.randrange(9)] * rnd.randrange(2)
            if not x:
                x = [0]
        before, after = ([90000 + rnd.randrange(9) for _ in range(rnd.randrange(12))] for _ in range(2))
        text = before + x + after
        value, pairs = M.align(t, text, len(before))
        (score, matched), (i, j) = brute(t, text)
        assert divmod(value, len(t) + 1) == (score, matched) and len(pairs) == matched
        assert all(t[a] == text[b] for a, b in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        if len(set(t)) == len(t) and pairs:  # with distinct words the end of the best alignment is one place
            # the same from behind gives where it starts
            _, (back_i, back_j) = brute(t[::-1], text[::-1])
            if (pairs[-1][0] + 1, pairs[-1][1] + 1) == (i, j) and (len(t) - pairs[0][0], len(text) - pairs[0][1]) == (back_i, back_j):
                unique += 1
    assert unique > 150


def test_random_alignments_equal_full_matrix_within_the_band():
    rnd = random.Random(5)
    for _ in range(200):
        t = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))]
        x = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))]
        value, _ = M.align(t, x, 0, band=9)  # the band holds the whole matrix
        assert divmod(value, len(t) + 1) == brute(t, x)[0]


def scan(text):
    return [(n, m, round(c, 3)) for n, _, _, m, c in M.scan_text(INDEX, text.encode())]


@pytest.mark.parametrize(
    ("notice", "want"),
    [
        ("This work is licensed under the GNU General Public License, version 1.", "GPL-1.0#1"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0#1"),
        ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0#1"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0#1"),
        ("This work is licensed under the GNU Library General Public License, version 3.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0#1"),
        ("This work is not licensed under the GNU General Public License, version 3.", None),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-ND 2.5.", None),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0#2"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0#2"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1#1"),
        ("Licensed under the Apache License, Version 2.1.", None),
        ("Licensed under the Apache License, Version 2.0.1", None),
        ("released under an MIT license", "MIT#3"),
        ("Released under the BSD License", None),
        ("SPDX-License-Identifier: MIT", "MIT#spdx"),
        ("SPDX-License-Identifier: MIT-0", "MIT-0#spdx"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0#spdx"),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", None),
    ],
)
def test_deciding_words(notice, want):
    got = scan(f"Some text stands before it. {notice} and some more of it after.")
    assert [g[0] for g in got] == ([want] if want else [])


def test_every_template_is_found_as_itself_only():
    for name, text in TEMPLATES.items():
        got = scan(f"words before\n{text}\nwords after")
        assert len(got) == 1 and got[0][2] == 1 and (got[0][0] == name or sorted(M._WORD.findall(TEMPLATES[got[0][0]].lower())) == sorted(M._WORD.findall(text.lower()))), (name, got)


def test_changed_texts():
    rnd = random.Random(9)
    whole = TEMPLATES["GPL-3.0#text"].split()
    for k in range(40, len(whole), 90):
        whole[k] = "replaced"
    whole[2000:2000] = [f"inserted{rnd.randrange(9)}" for _ in range(40)]  # longer than the band
    (name, matched, share), = scan(" ".join(whole))
    assert name == "GPL-3.0#text" and 0.95 < share < 1 and matched > 5000
    grant = TEMPLATES["MIT#2"]
    assert [g[0] for g in scan(grant.replace("without restriction", "without any restriction at all"))] == ["MIT#2"]
    assert scan(grant.replace("any person", "any person for noncommercial purposes")) == []
    assert scan(grant.replace("hereby granted", "hereby not granted")) == []
    half = " ".join(grant.split()[:80])
    assert scan(half) == []
    padded = grant.split()
    for k in range(len(padded) - 1, 0, -3):
        padded[k:k] = ["pad"]  # a third more words in between: under the coverage
    assert scan(" ".join(padded)) == []


def test_finds_edited_and_repeated_notices(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for k, name in enumerate(n for n in TEMPLATES if "#spdx" not in n and "#3" not in n):
        words = TEMPLATES[name].split()
        if len(words) > 40:  # two words that decide nothing
            plain = [i for i, w in enumerate(words) if w.isalpha() and not {w.lower()} & (M.NAMES | M.TURNS) and 9 < i < len(words) - 9]
            words[plain[0]] = "changed"
            del words[plain[3]]
        pad = " ".join(rnd.choice(["é", "the", "of", "xyzzy"]) for _ in range(300))
        rows.append((k, f"{pad}\n{' '.join(words)}\n{pad}", "x"))
        want[k] = (name, len(pad) + 1, " ".join(words))
    rows += [(500, None, ""), (501, "", ""), (None, TEMPLATES["MIT#1"], ""), (7000, ("Released under the MIT License.\nother words here\n") * 3000, ""), (7001, "of the and the of this is", "")]
    got = M.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    text = {r[0]: r[1] for r in rows}
    for k, (name, start, notice) in want.items():
        best = [r for r in by[k] if r.license == name]
        assert len(best) == 1 and best[0].coverage >= 0.8, name
        found = text[k][best[0].start : best[0].end]
        assert abs(best[0].start - start) < 12 and abs(len(found) - len(notice)) < 12 and found in notice
    assert len(by[7000]) == 3000 and all(r.license == "MIT#1" and r.coverage == 1 for r in by[7000])
    assert len(by[None]) == 1 and not {500, 501, 7001} & set(by)
    assert M.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.scan(spark.createDataFrame(rows, SCHEMA), templates={}).count() == 0


def test_query_finds_every_license_line(spark):
    import duckdb

    from sparkloom.llm.queries import op2_license_scan

    d = "/root/testdata/sf0.01"
    lines = {
        "Apache-2.0#1": "Licensed under the Apache License, Version 2.0",
        "MIT#1": "Released under the MIT License",
        "GPL-3.0#1": "This work is licensed under the GNU General Public License, version 3",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    }
    want = set()
    for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        for name, line in lines.items():
            at = (t or "").lower().find(line.lower())
            while at >= 0:
                want.add((i, name, at, at + len(line)))
                at = t.lower().find(line.lower(), at + 1)
    got = {(r.doc_id, r.license, r.start, r.end) for r in op2_license_scan(spark, d).collect()}
    assert got == want
