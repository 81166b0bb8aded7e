"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is cut into m consecutive segments on a ring. If two fingerprints differ in at most t
bits, then by the pigeonring principle there is a start from which every chain of l consecutive segments has at
most floor(l * t / m) differing bits, for all l up to m. The chains of budget zero must be equal, so the longest
of them is the index key: fingerprints meet only in the buckets of an equal chain. Longer chains are tested in
order of length, and only what survives all of them is a link by the full Hamming distance (the chain of length m).

Equal fingerprints are one class before any pairing, so exact copies never meet each other. A bucket of distinct
fingerprints beyond HOT_BUCKET isn't paired: two of its members at distance t <= 2 share a fingerprint at distance
at most 1 from both, so each member names itself and its neighbours in one bit outside the key, and members that
name the same one are chained (they are within 2 bits of each other). That is exact, linear in the bucket, and
spread by the named fingerprint.

Defined results: null and word-less texts have fingerprint zero and are linked like any other; with fewer words
than a shingle the whole sequence is the shingle; rows with a null identifier get a fingerprint and component null
if all rows of their class lack one, and never give a component its name; repeated identifiers are kept as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import new_name, ship, stage
from sparkloom.llm.components import components

BITS = 64
#: Buckets with more distinct fingerprints go the exact linear way.
HOT_BUCKET = 256
_ONES = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is set if it is in more than half of all shingles' hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    starts = [0] + [x + 1 for x in ends]
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # long texts by parts: the bit matrix stays small
        hi = min(n, lo + 65536)
        h = np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo + shingle - 1 : hi + shingle - 1])], np.uint64, hi - lo)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << _ONES).sum())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every whole text; one narrow Arrow pass."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["id", "fp"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near duplicates: the one with the smallest identifier, null last.

    Whole rows never enter Python and are compared with the row numbers that go: those are narrow, and few enough to be
    sent to every task where few rows go (the planner decides by their size); otherwise rows are shuffled by number.
    """
    number = new_name(docs, "row")
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", compression="zstd")
    prints = stage(fingerprints(rows, shingle, id_col=number, text_col=text_col).withColumnRenamed("id", "row"), "row-fingerprints")
    # the identifier of a row is joined to its number for classes with company alone
    shared = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    classes = stage(shared, "classes")
    parts = components(links(classes.select("fp"), distance, segments), "a", "b").withColumnRenamed("node", "fp")
    linked = stage(classes.join(parts, "fp", "left").where("n > 1 OR component IS NOT NULL").select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("c")), "linked")
    met = prints.join(linked, F.col("fp") == F.col("f")).select("c", "row")
    named = rows.select(F.col(number).alias("r"), F.col(id_col).alias("id")).join(met, F.col("r") == F.col("row"))
    named = stage(named.select("c", F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("k")), "in-company")
    stays = named.groupBy("c").agg(F.min("k").alias("k")).select(F.col("k.row").alias("s"))
    goes = stage(named.select(F.col("k.row").alias("g")).join(stays, F.col("g") == F.col("s"), "left_anti"), "goes")
    return rows.join(goes, rows[number] == F.col("g"), "left_anti").drop(number)


def ring(distance: int, segments: int) -> tuple[list[tuple[int, int]], list[int], int]:
    """(shift, width) of each segment, the budget of each chain length, and the length of the key chain."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    budget = [l * distance // segments for l in range(segments + 1)]
    key = max(l for l in range(1, segments + 1) if budget[l] == 0)
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], budget, key


def _mask(parts: list[tuple[int, int]], start: int, length: int) -> int:
    m = 0
    for i in range(start, start + length):
        shift, width = parts[i % len(parts)]
        m |= ((1 << width) - 1) << shift
    return m - (1 << 64) if m >> 63 else m


def segments_for(classes: int, distance: int = 2, most: int = 15) -> int:
    """The fewest segments whose key chain tells so many fingerprints apart that a bucket holds about 16 at most.

    More segments make a longer key chain (25 bits of 64 with 5, 30 with 15, for two differing bits) and more postings.
    """
    for m in range(2 * distance + 1, most + 1, distance):
        parts, _, key = ring(distance, m)
        bits = min(sum(parts[(s + i) % m][1] for i in range(key)) for s in range(m))
        if classes <= 16 << bits:
            return m
    return m


def links(classes: DataFrame, distance: int = 2, segments: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all pairs within the distance.

    The number of segments follows the number of fingerprints unless it's given; the result is the same with any.

    Buckets up to HOT_BUCKET give every pair that passes all chains; hotter ones give chains over shared
    one-bit neighbours, which connect the same fingerprints (exact for distance <= 2).
    """
    if not 1 <= distance <= 2:
        raise ValueError("the exact way for hot buckets covers distances 1 and 2")
    segments = segments or segments_for(classes.count(), distance)
    if segments <= distance:
        raise ValueError("more segments than differing bits are needed")
    parts, budget, key = ring(distance, segments)
    masks = F.array(*[F.lit(_mask(parts, s, key)) for s in range(segments)])
    posted = classes.select("fp", F.posexplode(masks).alias("s", "mask"))
    posted = posted.select("fp", F.col("s").cast("byte").alias("s"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    posted = stage(posted, "postings")
    sizes = posted.groupBy("s", "k").agg(F.count("*").alias("n")).where("n > 1")
    hot = stage(sizes.where(F.col("n") > HOT_BUCKET).select("s", "k"), "hot-buckets")
    warm = sizes.where(F.col("n") <= HOT_BUCKET).select("s", "k")
    bucketed = posted.join(warm, ["s", "k"])
    left, right = bucketed.withColumnRenamed("fp", "a"), bucketed.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # the chains of each start, shortest first; the last is the whole ring: the Hamming distance itself
    passes = F.lit(False)
    for s in range(segments):
        chain = F.lit(True)
        for l in range(key + 1, segments + 1):
            chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(_mask(parts, s, l)))) <= budget[l])
        passes = passes | ((F.col("s") == s) & chain)
    pairs = left.join(right, ["s", "k"]).where(F.col("a") < F.col("b")).where(passes).select("a", "b")
    # hot buckets: one-bit neighbours outside the key
    free = F.array(*[F.lit(~_mask(parts, s, key)) for s in range(segments)])
    crowded = posted.join(hot, ["s", "k"]).select("fp", "s", F.element_at(free, F.col("s").cast("int") + 1).alias("free"))
    bit = F.explode(F.sequence(F.lit(-1), F.lit(63)))
    named = crowded.select("fp", "s", "free", bit.alias("bit")).select("fp", "s", F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)").bitwiseAND(F.col("free"))).alias("flip"), "bit")
    named = named.where("bit < 0 or flip <> 0").select("fp", "s", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    lowest = named.groupBy("s", "near").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("s", "near", "a")
    chained = named.join(lowest, ["s", "near"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(chained).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """id, fp and component_id (the smallest identifier reachable over links) of every document."""
    prints = prints if prints is not None else stage(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    parts = components(links(classes, distance, segments), "a", "b").withColumnRenamed("node", "fp")
    parts = stage(parts.join(classes, "fp").select("fp", "component", "first"), "linked")
    named = parts.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = parts.select("fp", "component").join(named, "component").select("fp", F.col("component_id").alias("c"))
    of_class = classes.join(linked, "fp", "left").select(F.col("fp").alias("f"), F.when(F.col("c").isNull(), F.col("first")).otherwise(F.col("c")).alias("component_id"))
    # a hot class is one row here and many in prints: the larger side is split by skew-join handling, the smaller is unique per key
    return prints.join(of_class, prints.fp == of_class.f).select("id", "fp", "component_id")
