"""Language-model scores by the likelihood of the subword lattice.

A text is its words (lower-cased A-Z, split at ASCII white space) and an end. A word is spelled by pieces of an
existing vocabulary, the first of which carries the word mark, or by single bytes; its probability is the sum over all
segmentations of the product of their pieces' probabilities, taken by the forward recursion over the lattice. Words
follow each other independently, so a document's log probability is the sum over its words and its end.

The vocabulary's scores weight the pieces before any text is seen: the file at hand ranks its pieces (score = -rank),
and rank r counts as r + 2.7 to the power -1, normalised. Expectation maximisation over the training words then
replaces them by expected counts, with the prior worth PRIOR_MASS pieces; the end's probability comes from the number
of training documents.

Everything gathered grows with the corpus and stays distributed: the table of all words with their training counts,
each word's lattice probability computed there once. At most HEAD of the most frequent words go to the workers as a
bounded dictionary, chosen by a threshold on their counts that a histogram gives; the rest of a document's words is
joined with the table by word. Only piece counts, bounded by the vocabulary's size, the histogram and the HEAD words
come to the driver.

Defined results: null text is the empty text (its end only); a null identifier counts as the empty text in the fold
rule, so it is in training; repeated rows are rows; without training words base and model rest on their priors;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import ship, stage

MARK = "▁"
PRIOR_MASS = 32000.0
ROUNDS = 2
#: Most frequent words kept by every worker; longer words than HEAD_BYTES are never among them. Their counts are ranked
#: in HEAD_STEPS steps an octave.
HEAD, HEAD_BYTES, HEAD_STEPS = 200_000, 64, 16
#: Characters of a word whose forward values are held at once; of longer words they are run again, block by block.
BLOCK = 1 << 16
#: Distinct words a counting task holds before it hands them on.
FLUSH = 300_000
#: Up to so many characters the recursion over one word runs on plain probabilities, beyond in log space. A word whose
#: plain probability comes below TINY (some 15 characters spelled by bytes) is run again in log space: above it, whatever
#: underflowed on the way is no part of the sum's digits.
LINEAR, TINY = 32, 1e-250
LN10 = math.log(10)


class Lattice:
    """Pieces, their log probabilities, and the recursions over one word."""

    def __init__(self, pieces: list[str], bytes_at: list[int], logp: np.ndarray, log_end: float):
        self.logp, self.log_end, self.bytes_at = logp, log_end, bytes_at
        self.root: dict = {}
        self.reach = max([1, *map(len, pieces)])  # characters of the longest piece
        for i, p in enumerate(pieces):
            if p:
                node = self.root
                for c in p:
                    node = node.setdefault(c, {})
                node[0] = i
        self.p = np.exp(logp).tolist()
        self.lp = logp.tolist()
        self._char: dict[str, tuple[float, float]] = {}

    def _bytes(self, c: str) -> tuple[float, float]:
        got = self._char.get(c)
        if got is None:
            x = sum(self.lp[self.bytes_at[b]] for b in c.encode())
            got = self._char[c] = (math.exp(x), x)
        return got

    def log_word(self, word: str) -> float:
        """Log probability of the word: the sum over all its segmentations."""
        s = MARK + word
        n, root, p = len(s), self.root, self.p
        if n > LINEAR:
            return self._log_total(s)[0]
        a = [0.0] * (n + 1)
        a[0] = 1.0
        for i in range(n):
            x = a[i]
            a[i + 1] += x * self._bytes(s[i])[0]
            node = root
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                k = node.get(0)
                if k is not None:
                    a[j + 1] += x * p[k]
        return math.log(a[n]) if a[n] >= TINY else self._log_total(s)[0]

    def _log_block(self, s: str, start: int, carry: list[float]) -> list[float]:
        """Forward log values of a block and of the places its pieces reach; carry has what came from before the block."""
        stop = min(len(s), start + BLOCK)
        a = carry + [-math.inf] * (stop - start)

        def add(j: int, x: float) -> None:
            y = a[j]
            hi, lo = (x, y) if x > y else (y, x)
            a[j] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi

        for i in range(start, stop):
            x = a[i - start]
            add(i + 1 - start, x + self._bytes(s[i])[1])
            node = self.root
            for j in range(i, len(s)):
                node = node.get(s[j])
                if node is None:
                    break
                k = node.get(0)
                if k is not None:
                    add(j + 1 - start, x + self.lp[k])
        return a

    def _log_total(self, s: str) -> tuple[float, list[list[float]]]:
        """Log probability of all segmentations, and what each block got from before it: enough to run any block again."""
        carry, before = [0.0] + [-math.inf] * self.reach, []
        for start in range(0, len(s), BLOCK):
            before.append(carry)
            a = self._log_block(s, start, carry)
            carry = a[min(BLOCK, len(s) - start) :]
        return carry[0], before

    def expect(self, word: str, times: float, into: list[float]) -> None:
        """Add the expected use of every piece in `times` occurrences of the word."""
        s = MARK + word
        if len(s) > LINEAR or not self._expect(s, times, into):
            self._log_expect(s, times, into)

    def _expect(self, s: str, times: float, into: list[float]) -> bool:
        """On plain probabilities; False, and nothing added, where they come near underflow."""
        n, root, p = len(s), self.root, self.p
        a = [0.0] * (n + 1)
        a[0] = 1.0
        edges = []
        for i in range(n):
            x = a[i]
            w = self._bytes(s[i])[0]
            edges.append((i, i + 1, -1, w))
            a[i + 1] += x * w
            node = root
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                k = node.get(0)
                if k is not None:
                    w = p[k]
                    a[j + 1] += x * w
                    edges.append((i, j + 1, k, w))
        if a[n] < TINY:
            return False
        b = [0.0] * n + [times / a[n]]
        for i, j, k, w in reversed(edges):
            y = w * b[j]
            b[i] += y
            if k >= 0:
                into[k] += a[i] * y
            else:
                for c in s[i].encode():
                    into[self.bytes_at[c]] += a[i] * y
        return True

    def _log_expect(self, s: str, times: float, into: list[float]) -> None:
        """In log space, from the last block to the first: a block's forward values are there only while it's run back."""
        total, before = self._log_total(s)
        after = [-total] + [-math.inf] * self.reach  # backward log values from the end of the block on
        for at in range(len(before) - 1, -1, -1):
            start = at * BLOCK
            size = min(BLOCK, len(s) - start)
            a = self._log_block(s, start, before[at])
            b = [-math.inf] * size + after
            for i in range(start + size - 1, start - 1, -1):
                x = a[i - start]
                edges = [(i + 1, -1, self._bytes(s[i])[1])]
                node = self.root
                for j in range(i, len(s)):
                    node = node.get(s[j])
                    if node is None:
                        break
                    k = node.get(0)
                    if k is not None:
                        edges.append((j + 1, k, self.lp[k]))
                here = -math.inf
                for j, k, w in edges:
                    y = w + b[j - start]
                    hi, lo = max(y, here), min(y, here)
                    here = hi + (math.log1p(math.exp(lo - hi)) if lo > -math.inf else 0.0)
                    use = times * math.exp(min(0.0, x + y))
                    if k >= 0:
                        into[k] += use
                    else:
                        for c in s[i].encode():
                            into[self.bytes_at[c]] += use
                b[i - start] = here
            after = b[: self.reach + 1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], list[int], np.ndarray]:
    """Pieces ('' where one never spells text), places of the 256 bytes, prior probabilities from the file's scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, bytes_at, rank = [], [0] * 256, np.zeros(n)
    for i in range(n):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        usable = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and score > -1e8
        pieces.append(piece if usable and piece == lower(piece) else "")
        rank[i] = -score if pieces[-1] else np.nan
        if sp.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
            rank[i] = n
    prior = np.where(np.isnan(rank), 0.0, 1 / (np.nan_to_num(rank) + 2.7))
    return pieces, bytes_at, prior / prior.sum()


def lower(text: str) -> str:
    """A-Z only."""
    return text.encode().lower().decode()


def lattice(path: str, counts: np.ndarray | None = None, ends: float = 0.0) -> Lattice:
    pieces, bytes_at, prior = vocabulary(path)
    mass = prior * PRIOR_MASS + (counts if counts is not None else 0.0)
    total = mass.sum() + ends + 1.0
    with np.errstate(divide="ignore"):
        return Lattice(pieces, bytes_at, np.log(mass / total), math.log((ends + 1.0) / total))


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """w, c: every word of every text with its count in training texts (0 where it's in held-out texts only)."""
    src = docs.select(held_out(id_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            for w in unseen:
                seen.setdefault(w, 0)
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "c"])
            seen.clear()
            unseen.clear()
            return out

        seen: Counter = Counter()
        unseen: set = set()
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = t.as_py().lower().split()
                (unseen if h else seen).update(words)
                if len(seen) + len(unseen) > FLUSH:
                    yield rows()
        if seen or unseen:
            yield rows()

    return src.mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def train(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> Lattice:
    """Expectation maximisation over the words with their training counts; piece counts are summed per partition."""
    counts = None
    for _ in range(rounds):
        before = counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lat = lattice(path, before, ends)
            into = [0.0] * len(lat.lp)
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    lat.expect(w, c, into)
            used = [i for i, x in enumerate(into) if x]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([into[i] for i in used], pa.float64())], names=["piece", "n"])

        # summed in 1/1000 pieces as whole numbers: the same whatever the order
        got = words.where("c > 0").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum(F.round(F.col("n") * 1000).cast("decimal(38,0)")).alias("n")).collect()
        counts = np.zeros(len(vocabulary(path)[0]))
        for r in got:
            counts[r.piece] = float(r.n) / 1000
    return lattice(path, counts, ends)


def most_frequent(words: DataFrame, most: int | None = None) -> DataFrame:
    """The words above a count, at most `most` (HEAD) of them: the count is where a histogram of log counts leaves that many."""
    most = HEAD if most is None else most
    ranked = words.where((F.octet_length("w") <= HEAD_BYTES) & (F.col("c") > 0)).withColumn("b", F.floor(F.log2(F.col("c").cast("double")) * HEAD_STEPS).cast("int"))
    total, least = 0, None
    for b, n in sorted(map(tuple, ranked.groupBy("b").agg(F.count("*").alias("n")).collect()), reverse=True):  # at most 64 * HEAD_STEPS rows
        total += n
        if total > most:
            break
        least = b
    return ranked.where(F.lit(False) if least is None else F.col("b") >= least).drop("b")


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (word unigram) and score, both log10."""
    spark = docs.sparkSession
    ship(spark)
    words = stage(count_words(docs, id_col, text_col), "words")
    ends = docs.where(~held_out(id_col)).count()
    total = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n_train = (total[0] or 0) + ends
    distinct = (total[1] or 0) + (1 if ends else 0)
    base_of = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (distinct + 1)))
    lat = train(words, path, ends, rounds)
    model = spark.sparkContext.broadcast((lat.logp, lat.log_end))  # one number a piece

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bytes_at, _ = vocabulary(path)
        mine = Lattice(pieces, bytes_at, *model.value)
        for b in batches:
            s = [mine.log_word(w) / LN10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["w", "c", "s"])

    words = stage(words.mapInArrow(scored, "w string, c long, s double"), "scored-words")
    top = most_frequent(words).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as out:
        out.write_table(top)
    head = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del top, sink
    end_base, end_score = float(base_of(np.float64(ends))), lat.log_end / LN10

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(head.value).read_all()
        place = {w: i for i, w in enumerate(known["w"].cast(pa.binary()).to_pylist())}
        c, s = known["c"].to_numpy().astype(np.int64), known["s"].to_numpy().astype(float)
        c, s, b0 = np.append(c, 0), np.append(s, 0.0), np.append(base_of(c.astype(float)), 0.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cols: list[list] = [[], [], [], [], []]
                for t in part.column(3):
                    words = t.as_py().lower().split()
                    i = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    rest = Counter([words[k] for k in np.flatnonzero(i < 0)])
                    for x, v in zip(cols, (len(words) + 1, int((c[i] > 0).sum()) + (ends > 0), float(b0[i].sum()) + end_base, float(s[i].sum()) + end_score, list(rest.items()))):
                        x.append(v)
                flat = [p for x in cols[4] for p in x]
                ends_at = np.concatenate([[0], np.cumsum([len(x) for x in cols[4]])]).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.binary()).cast(pa.string()), pa.array([p[1] for p in flat], pa.int64())], names=["w", "n"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.ListArray.from_arrays(pa.array(ends_at), tail)],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "b", "s", "tail"],
                )

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    fields = [*src.schema.fields[:3], *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")), *(T.StructField(x, T.DoubleType()) for x in "bs"), T.StructField("tail", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])))]
    first = stage(src.mapInArrow(passed, T.StructType(fields)), "passed")
    tail = first.select("row", F.explode("tail").alias("x")).select("row", "x.w", "x.n").join(words, "w")
    exact = lambda c: F.sum((F.col("n") * c).cast("decimal(28,10)"))  # noqa: E731  (sums don't depend on the order)
    base = F.log10((F.col("c") + F.lit(0.5)) / F.lit(float(n_train + 0.5 * (distinct + 1))))
    tail = tail.groupBy("row").agg(exact(base).alias("tb"), exact(F.col("s")).alias("ts"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tk"))
    out = first.drop("tail").join(tail.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tk", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("b") + zero("tb")).alias("base_score"), (F.col("s") + zero("ts")).alias("score"))
