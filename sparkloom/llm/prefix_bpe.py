"""Byte-level BPE by prefix dynamic programming.

For a byte string s let last[i] be the last token of the BPE encoding of s[:i]. BPE encodings have two
properties that make this table enough: the encoding of s[:i] without its last token is the encoding of the
shorter prefix, and of the tokens that end at i exactly one is compatible with last[] where it starts. Two
adjacent tokens are compatible if BPE on their joined bytes gives those two tokens back. So the table is
filled left to right, appends only extend it, and an edit changes it only from the edit to the place where
old and new tables agree over one longest-token length.

Defined results: null text is the empty text; the empty text has no ids and decodes to no bytes. Rows are
independent of each other, so ties, repeated rows and empty tables need no rule. Extra input columns are
not carried: the result has the id column, `ids` and `decoded`.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import ship

#: A piece of text that can be split off before the pattern is applied: no match of the pattern spans the border
#: between a character that is no white space and one that is (white space here is the Unicode property).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: So is the border between a letter and a full stop or comma, which lets "word", "word," and "word." share ids.
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
SEGMENT = re.compile(f"[{_WS}]*[{_LETTER}]+(?=[.,{_WS}])|[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Segments in each of the two generations that a worker keeps: a full young generation becomes the old one.
CACHE_SEGMENTS = 200_000
#: Token pairs whose fit one worker keeps.
FITS = 400_000
#: Longer segments aren't kept.
CACHE_CHARS = 64


class PrefixBPE:
    """Encoder and decoder over a table of token bytes to ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every ending of a token, with its own rank or -1: endings of a prefix are followed only while they are here.
        self.ending = {b[i:]: -1 for b in ranks for i in range(1, len(b))} | ranks
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"no token for the single bytes {missing[:5]}")
        self._before: tuple[bytes, list[int]] = (b"", [-1])  # the string encoded last and its table
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token in self._halves:
            return self._halves[token]
        whole = self.bytes_of[token]
        found = None
        if len(whole) > 1:
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]])
                    if r is not None and r != token and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    raise ValueError(f"token {token} can't be reached by merges")
                parts[at : at + 2] = [best]
            found = (parts[0], parts[1])
        self._halves[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens keeps the border between them.

        Undo merges from the latest on. At each step the two tokens touching the border are those that exist just
        before the merge undone last; if their own merge ranks lower than every merge undone so far it happens first.
        """
        key = left << 24 | right
        known = self._fits.get(key)
        if known is not None:
            return known
        joined, ranks = self.bytes_of, self.ranks
        bound = None  # merges of this rank or later have been undone: only earlier ones can cross the border
        strict = False
        ok = True
        while True:
            r = ranks.get(joined[left] + joined[right])
            if r is not None and (bound is None or r < bound or (not strict and r == bound)):
                ok = False
                break
            a, b = self.halves(left), self.halves(right)
            # the later merge is undone first; on a tie the left one happened first, so the right one is undone
            if a is not None and (b is None or left > right):
                bound, strict, left = left, True, a[1]
            elif b is not None:
                bound, strict, right = right, False, b[0]
            else:
                break
        if len(self._fits) > FITS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Fill last[start+1 .. stop] given last[: start+1]; last[0] is unused."""
        ending, fits, known = self.ending.get, self.fits, self._fits.get
        for i in range(start + 1, stop + 1):
            j = i
            while True:  # longer and longer endings of data[:i], as far as some token ends so
                j -= 1
                t = ending(data[j:i])
                if t < 0:
                    continue
                if j:
                    ok = known(last[j] << 24 | t)
                    if ok is None:
                        ok = fits(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                break

    def table(self, data: bytes) -> list[int]:
        last = [-1]
        self.extend(data, last, 0, len(data))
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole string, read backwards from its table."""
        out, i, size = [], len(last) - 1, self.bytes_of
        while i:
            out.append(last[i])
            i -= len(size[last[i]])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        t = self.ranks.get(data)
        if t is not None:
            return [t]  # every token of a rank file encodes to itself
        return self.walk(self.table(data))

    def encode_next(self, data: bytes) -> list[int]:
        """The ids of the whole string, from the table of the string before: positions of the common prefix are kept.

        Strings that come sorted share most of their prefixes.
        """
        t = self.ranks.get(data)
        if t is not None:
            return [t]
        before, last = self._before
        same, most = 0, min(len(before), len(data))
        while same < most and before[same] == data[same]:
            same += 1
        last = last[: same + 1]
        self.extend(data, last, same, len(data))
        self._before = (data, last)
        return self.walk(last)

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """data + more and its table; only the new positions are computed."""
        data += more
        last = last[:]
        self.extend(data, last, len(last) - 1, len(data))
        return data, last

    def edit(self, data: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int], int]:
        """Replace data[at : at+removed]; returns the new bytes, table and the number of positions recomputed."""
        new = data[:at] + inserted + data[at + removed :]
        table, shift, same = last[: at + 1], len(inserted) - removed, 0
        i = at
        while i < len(new):
            self.extend(new, table, i, i + 1)
            i += 1
            # behind the insertion: as soon as one longest token's span agrees, all further positions do
            same = same + 1 if i - self.longest >= at + len(inserted) and table[i] == last[i - shift] else 0
            if same >= self.longest:
                table += last[i - shift + 1 :]
                break
        return new, table, i - at

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder:
    """Splits texts by a pattern, encodes each match separately and keeps the ids of frequent segments.

    Ids are packed as little-endian 32-bit integers, so a text's ids are joined, not copied one by one.
    """

    def __init__(self, bpe: PrefixBPE, pattern: str):
        self.bpe, self.split = bpe, regex.compile(pattern).findall
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def segment(self, s: str) -> tuple[bytes, bytes]:
        """Packed ids of a segment and the bytes that they decode to."""
        ids: list[int] = []
        for m in self.split(s):
            ids += self.bpe.encode_next(m.encode())
        return array("i", ids).tobytes(), self.bpe.decode(ids)

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of whole texts and the bytes that they decode to.

        What the texts hold of new segments is encoded in sorted order, so that each goes on from the one before.
        """
        found = [SEGMENT.findall(s) for s in texts]
        kept, older = self.kept, self.older
        missing = set().union(*found).difference(kept)
        if missing:
            now = {s: older[s] for s in missing if s in older}
            new = sorted(missing.difference(now))
            for s in new:
                now[s] = self.segment(s)
            if len(kept) + len(now) > CACHE_SEGMENTS:  # what these texts need stays at hand, the rest becomes the older generation
                self.older, self.kept = kept, {s: kept[s] for f in found for s in f if s in kept}
                kept = self.kept
            kept.update(now)
        out = []
        for f in found:
            got = list(map(kept.__getitem__, f))
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        if missing:
            for s in new:
                if len(s) > CACHE_CHARS:
                    del kept[s]
        return out

    def text(self, s: str) -> tuple[list[int], bytes]:
        ids, decoded = self.packed([s])[0]
        return array("i", ids).tolist(), decoded


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(PrefixBPE(read_ranks(path)), pattern)


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of up to so many rows and, beyond a first row, so many bytes of text."""
    ends = [0, *accumulate(pc.binary_length(batch.column(column)).to_pylist())]
    at = 0
    while at < batch.num_rows:
        end = at + 1
        while end < batch.num_rows and end - at < rows and ends[end + 1] - ends[at] <= size:
            end += 1
        yield batch.slice(at, end - at)
        at = end


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids array<int> of every whole text, and decoded binary: the bytes of those ids.

    A narrow, Arrow-batched pass without a shuffle; a worker holds the rank table and one slice of texts.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                both = enc.packed(part.column(1).to_pylist())
                ends = array("i", [0, *accumulate(len(x[0]) // 4 for x in both)])
                ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join([x[0] for x in both]))])
                col = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), ids)
                yield pa.RecordBatch.from_arrays([part.column(0), col, pa.array([x[1] for x in both], pa.binary())], names=[id_col, "ids", "decoded"])
        enc.older = {}  # an idle worker, which other stages use again, keeps one generation at most

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return src.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, and SHA-256 of the decimal ids joined by a space and of the decoded bytes."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
