"""License scan: winnowed template fingerprints pick candidates, banded alignment and deciding words judge them.

Templates and texts are sequences of lower-cased [a-z0-9]+ words. A template's fingerprints are those of its GRAM-word
shingles that winnowing selects (the smallest hash of every WINDOW consecutive ones), so any GRAM + WINDOW - 1 words
that a text copies from a template hold a fingerprint; of templates up to SHORT words every shingle is one. They form
an inverted index from shingle to (template, place), bounded by the templates; every shingle of every text is looked up
in it. Hits of one template on neighbouring diagonals form a candidate, which is aligned word by word within BAND of
its diagonal: a match counts 1, a mismatch or a gap -1, and the template's ends may hang out. Aligned pieces of one
template that follow each other in both are chained, so a longer insertion splits no match.

A match needs `coverage`: matched words over the template's words and the words inserted in between. And it needs the
deciding words: names (lesser, affero, noncommercial, ...) of the template must all be matched and none may be
inserted, nor a word that turns a grant round (not, except, ...); its numbers must be matched, and no further number may follow one.
Whole texts (over LONG words) tolerate a few such differences and leave numbers aside. A text that fails here is another
license or a changed one, and isn't reported under the template's name.

A long template is a candidate where SHARE of its fingerprints are found in the text; less can't reach the coverage
unless every few words are changed.

Defined results: null and word-less texts match nothing; a text may match several templates and one template several
times; of matches that share half of the smaller one's words only the one with more matched words is reported, of equal
ones the first by name; null and repeated identifiers are rows like any other; an empty table or no template gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import ship
from sparkloom.llm.license_templates import NAMES, TURNS, templates as public_templates

GRAM, WINDOW, BAND = 3, 3, 8
#: Up to so many words every shingle of a template is a fingerprint; beyond LONG a template is a whole text.
SHORT, LONG = 60, 400
#: Share of a long template's fingerprints that a text, and each candidate in it, must hold.
SHARE, PIECE_SHARE = 0.1, 0.02
#: Rows of a template that an alignment goes on beyond the candidate's first and last hit.
MARGIN = 64
#: Share of the template's and the inserted words that a match needs.
COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9]+")
_BYTES = re.compile(rb"[a-z0-9]+")
#: What may follow a version or an identifier without making it another one.
_GOES_ON = re.compile(rb"(?:\.([0-9]+)|-([a-z0-9]+))")
_SAME = frozenset([b"0", b"only", b"or", b"style"])


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash of every window, the last of equal ones."""
    n = len(hashes)
    if n <= window:
        return [min(range(n), key=lambda i: (hashes[i], -i))] if n else []
    return sorted({min(range(a, a + window), key=lambda i: (hashes[i], -i)) for a in range(n - window + 1)})


def is_number(word: str) -> bool:
    return not word.isalpha()


class Index:
    """The inverted index of template fingerprints over the templates' own words."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        texts = [_WORD.findall(templates[n].lower()) for n in self.names]
        words = sorted({w for t in texts for w in t} | NAMES | TURNS)
        self.bytes_place = {w.encode(): i for i, w in enumerate(words)}
        self.place = {w: i for i, w in enumerate(words)}
        self.named = {self.place[w] for w in NAMES}
        self.turning = {self.place[w] for w in TURNS}
        self.number = {i for i, w in enumerate(words) if is_number(w)}
        self.words = [[self.place[w] for w in t] for t in texts]
        self.size = len(words) + 1
        posts: list[tuple[int, int, int]] = []
        self.prints = []
        for k, t in enumerate(texts):
            n = len(t) - GRAM + 1
            keys = self.keys(np.array(self.words[k], np.int64), np.arange(max(n, 0)))
            hashes = [xxhash.xxh64_intdigest(" ".join(t[i : i + GRAM])) for i in range(n)]
            at = range(max(n, 0)) if len(t) <= SHORT else winnow(hashes)
            self.prints.append(len(at))
            posts += [(int(keys[i]), k, i) for i in at]
        posts.sort()
        self.post_keys = np.array([p[0] for p in posts], np.int64)
        self.post_of = np.array([p[1] for p in posts], np.int64)
        self.post_at = np.array([p[2] for p in posts], np.int64)

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for g in range(GRAM):
            key = key * self.size + ids[at + g]
        return key

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Template -> (diagonal, text place) of every fingerprint found; ids are -1 for words of no template."""
        n = len(ids) - GRAM + 1
        if n <= 0 or not len(self.post_keys):
            return {}
        known = np.ones(n, bool)
        for g in range(GRAM):
            known &= ids[g : g + n] >= 0
        at = np.flatnonzero(known)
        key = self.keys(ids, at)
        lo, hi = np.searchsorted(self.post_keys, key, "left"), np.searchsorted(self.post_keys, key, "right")
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for x in np.flatnonzero(hi > lo).tolist():
            i = int(at[x])
            for p in range(lo[x], hi[x]):
                out[int(self.post_of[p])].append((i - int(self.post_at[p]), i))
        return out


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """Value and matched (template, text) places of the best local alignment within the band around the diagonal.

    The value is score * (words + 1) + matched words: of equal scores the one with more matched words.
    """
    unit, width, n = len(template) + 1, 2 * band + 1, len(text)
    best, off, where = 0, 0, (-1, 0)
    row, backs = [0] * width, []
    for i, w in enumerate(template):
        new, back = [0] * width, bytearray(width)
        for b in range(width):
            j = i + diagonal + b - band  # this cell ends at text place j
            v = step = 0
            if 0 <= j < n:
                if text[j] == w:
                    v, step = row[b] + unit + 1, 1
                elif row[b] > unit:
                    v, step = row[b] - unit, 2
            if b + 1 < width and row[b + 1] - unit > v:  # a template word without a text word
                v, step = row[b + 1] - unit, 3
            if b and 0 <= j < n and new[b - 1] - unit > v:  # a text word without a template word
                v, step = new[b - 1] - unit, 4
            new[b], back[b] = v, step
            if v > best or v == best and v and abs(b - band) < off:  # of equal ones the nearest to the diagonal
                best, off, where = v, abs(b - band), (i, b)
        backs.append(back)
        row = new
    pairs = []
    i, b = where
    while i >= 0 and 0 <= b < width and backs[i][b]:
        step = backs[i][b]
        if step == 1:
            pairs.append((i, i + diagonal + b - band))
        if step == 4:
            b -= 1
        else:
            i -= 1
            b += step == 3
    return best, pairs[::-1]


def candidates(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """(middle diagonal, first and last template place hit, hits): hits go on with a candidate while the template goes on
    and the band holds them. A hit that goes back in the template begins another copy, however close the copies are.
    """
    out: list[tuple[int, int, int, int]] = []
    running: list[list[int]] = []  # lowest and highest diagonal, first and last template place, last text place, hits
    close = lambda g: out.append(((g[0] + g[1]) // 2, g[2], g[3], g[5]))
    for d, i in sorted(hits, key=lambda x: (x[1], -x[0])):
        still = []
        for g in running:
            if i - g[4] > size + BAND:
                close(g)
            else:
                still.append(g)
        running = still
        for g in running:
            if i - d > g[3] and i > g[4] and max(g[1], d) - min(g[0], d) <= BAND:
                g[:] = [min(g[0], d), max(g[1], d), g[2], i - d, i, g[5] + 1]
                break
        else:
            running.append([d, d, i - d, i - d, i, 1])
    for g in running:
        close(g)
    return out


def chains(pieces: list[list[tuple[int, int]]], size: int) -> list[list[tuple[int, int]]]:
    """Pieces of one template joined where the next goes on in template and text, after at most a quarter of the template's words."""
    out: list[list[tuple[int, int]]] = []
    for piece in sorted(pieces, key=lambda p: (p[0][1], p[0][0])):
        if out:
            t, x = out[-1][-1]
            rest = [(a, b) for a, b in piece if a > t and b > x]
            if 2 * len(rest) > len(piece) and rest[0][1] - x - 1 <= max(BAND, size // 4):
                out[-1] = out[-1] + rest
                continue
        out.append(piece)
    return out


def judged(index: Index, k: int, pairs: list[tuple[int, int]], ids: np.ndarray, words: list[bytes]) -> float:
    """Coverage of the template by the pairs, 0 where the deciding words differ."""
    template = index.words[k]
    inserted = sum(max(0, (b2 - b1) - (a2 - a1)) for (a1, b1), (a2, b2) in zip(pairs, pairs[1:]))
    share = len(pairs) / (len(template) + inserted)
    matched_t, matched_x = {a for a, _ in pairs}, {b for _, b in pairs}
    missing = [w for a, w in enumerate(template) if a not in matched_t]
    lo, hi = pairs[0][1], pairs[-1][1] + 1
    # a word in the place of the template's first or last ones is an inserted one, too
    lo, hi = max(0, lo - pairs[0][0]), min(len(words), hi + len(template) - 1 - pairs[-1][0])
    extra = [b for b in range(lo, hi) if b not in matched_x]
    wrong = sum(w in index.named for w in missing) + sum(int(ids[b]) in index.named or int(ids[b]) in index.turning for b in extra)
    if len(template) > LONG:
        return share if wrong <= 2 + len(template) // 1000 else 0.0
    numbers = sum(w in index.number for w in missing)
    numbers += sum(words[b].isdigit() and words[b] != b"0" and b - 1 in matched_x and words[b - 1].isdigit() for b in extra)
    return 0.0 if wrong or numbers else share


def matches(index: Index, ids: np.ndarray, words: list[bytes], coverage: float = COVERAGE) -> list[tuple[int, int, int, int, float]]:
    """(template, first word, end word, matched words, coverage) of one text."""
    found: dict[tuple[int, int, int], tuple[int, float]] = {}
    for k, hits in index.hits(ids).items():
        template = index.words[k]
        size = len(template)
        least = 1
        if size > SHORT:
            if len(hits) < SHARE * index.prints[k]:
                continue
            least = max(1, int(PIECE_SHARE * index.prints[k]))
        pieces = []
        for middle, first, last, n in candidates(hits, size):
            if n < least:
                continue
            a, z = (0, size) if size <= SHORT else (max(0, first - MARGIN), min(size, last + GRAM + MARGIN))
            lo = max(0, a + middle - BAND)
            part = ids[lo : max(lo, z + middle + BAND)].tolist()
            _, pairs = align(template[a:z], part, middle + a - lo)
            if pairs:
                pieces.append([(i + a, j + lo) for i, j in pairs])
        for pairs in chains(pieces, size):
            if len(pairs) >= coverage * size:
                share = judged(index, k, pairs, ids, words)
                if share >= coverage:
                    found[k, pairs[0][1], pairs[-1][1] + 1] = (len(pairs), share)
    kept: list[tuple[int, int, int, int, float]] = []
    taken: list[tuple[int, int]] = []  # disjoint and sorted by start
    for (k, a, b), (m, share) in sorted(found.items(), key=lambda x: (-x[1][0], index.names[x[0][0]], x[0][1])):
        p = bisect_right(taken, (a, float("inf")))
        near = taken[max(0, p - 1) : p + 1]
        shared = [min(b, z) - max(a, s) for s, z in near]
        if any(2 * x >= min(b - a, z - s) for x, (s, z) in zip(shared, near) if x > 0):
            continue
        if all(x <= 0 for x in shared):
            taken.insert(p, (a, b))
        kept.append((k, a, b, m, share))
    return sorted(kept, key=lambda x: (x[1], x[0]))


def scan_text(index: Index, raw: bytes, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end in code points, matched words, coverage) of every match in one text (UTF-8)."""
    low = raw.lower()
    words = _BYTES.findall(low)
    ids = np.fromiter(map(index.bytes_place.get, words, repeat(-1)), np.int64, len(words))
    got = matches(index, ids, words, coverage)
    if not got:
        return []
    where = [m.span() for m in _BYTES.finditer(low)]
    out = []
    for k, i, j, m, share in got:
        start, end = where[i][0], where[j - 1][1]
        last = index.words[k][-1]
        if len(index.words[k]) <= SHORT and (last in index.number or last in index.named):  # version 2 isn't version 2.1, MIT isn't MIT-0
            more = _GOES_ON.match(low, end)
            if more and (more[1] or more[2]) not in _SAME:
                continue
        begin = len(raw[:start].decode())
        out.append((index.names[k], begin, begin + len(raw[start:end].decode()), m, share))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, start, end (code points), matched words and coverage of every match; one narrow Arrow pass."""
    ship(docs.sparkSession)
    # a few hundred templates of bounded size: some 2 MB for a worker
    shared = docs.sparkSession.sparkContext.broadcast(Index(public_templates() if templates is None else templates))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("license", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("start", "end", "matched_words")), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = [(n, *x) for n, t in enumerate(b.column(1)) for x in scan_text(index, t.as_py(), coverage)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
