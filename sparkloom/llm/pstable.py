"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised; K projections on Gaussian directions, shifted at random and quantised by WIDTH, give a bucket
in each of a number of tables, and only vectors that share a bucket (and a label) meet. `plan` sets both numbers from
the rows of the largest label: K so that a vector meets MATES unrelated ones in a bucket at most, tables so that a pair
exactly at the threshold is missed with probability MISS, closer pairs far less. `recall` measures it against brute
force. Everything that meets is checked exactly, in double precision, so no pair below the threshold is ever linked.

Equal vectors of one label are one class: copies never meet, and count through the class's size. Classes go by two
hashes; where different vectors ever shared both, classes would go by the vectors themselves.

Buckets with company are followed up in two steps. First every class brings a sketch only: its coordinates along
SKETCH orthonormal directions, which are never farther apart than the vectors. What has no mate within the threshold's
distance there goes, so vectors are shuffled for near vectors alone, whatever else shares their buckets. Then vectors
are compared. In both steps a bucket is cut into blocks of BLOCK classes and every pair of blocks is one task-sized
matrix product, however large the bucket. A pair is judged in the first table where it shares a bucket, elsewhere not
again. A block pair reports per class the number of linked vectors and a spanning forest of the links, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing (component_id is their own vec_id). Vectors of different lengths never link. Rows with a
null vec_id are compared and counted like others but can't name a component; if a whole component has no vec_id,
its component_id is null. Repeated vec_ids are separate rows. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_staged, ship, stage
from sparkloom.llm.components import components

WIDTH, SEED = 1.5, 20
#: Unrelated vectors that a vector meets in a bucket, about; probability that a pair at the threshold shares no bucket.
MATES, MISS = 0.25, 1e-5
BLOCK, SKETCH = 512, 12
#: Sketch coordinates are kept as 16-bit multiples of this.
STEP = 1 / 8192


def collide(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two vectors at this distance is the same."""
    x = width / distance
    normal = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(rows: int, threshold: float, width: float = WIDTH) -> tuple[int, int]:
    """Projections and tables for so many vectors of one label."""
    near, far = collide(math.sqrt(max(2 - 2 * threshold, 1e-9)), width), collide(math.sqrt(2), width)
    k = max(8, math.ceil(math.log(max(rows, 1) / MATES) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def hash_functions(dim: int, tables: int, k: int, width: float = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.random(tables * k) * width


def buckets(unit: np.ndarray, tables: int, k: int, width: float = WIDTH, seed: int = SEED, of: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit bucket key per row and table: table, dimension, `of` (a hash of the label) and quantised projections, mixed."""
    a, b = hash_functions(unit.shape[1], tables, k, width, seed)
    q = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1]), q.shape[:2]).copy()
    if of is not None:
        key ^= of.astype(np.int64).view(np.uint64)[:, None]
    for i in range(k):
        key = (key ^ q[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Coordinates along SKETCH orthonormal directions as 16-bit steps; missing directions are zero."""
    dim = unit.shape[1]
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim, 1]).standard_normal((dim, min(dim, SKETCH))))
    out = np.zeros((len(unit), SKETCH), np.int16)
    out[:, : q.shape[1]] = np.clip(np.rint(unit @ q / STEP), -32767, 32767)
    return out


def _usable(spec: str) -> str:
    return f"{spec} IS NOT NULL AND size({spec}) > 0 AND NOT exists({spec}, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity')) AND exists({spec}, c -> c <> 0)"


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix: each node's row is read once."""
    n, out = len(hit), []
    fresh = hit.any(axis=1)
    for root in np.flatnonzero(fresh).tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(hit[x] & fresh).tolist()
            fresh[new] = False
            out += [(x, y) for y in new]
            todo += new
    return out


def near_mates(mine: np.ndarray, sketch: np.ndarray, lo: int, hi: int, most: float) -> np.ndarray:
    """Of the rows of a pair of blocks those whose sketch is within the distance of another's (of the other block)."""
    s = sketch.astype(np.float64) * STEP
    if lo == hi:
        square = (s * s).sum(1)
        d = square[:, None] + square[None] - 2 * s @ s.T
        np.fill_diagonal(d, np.inf)
        return d.min(axis=1) <= most
    a, b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    out = np.zeros(len(s), bool)
    if len(a) and len(b):
        x, y = s[a], s[b]
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        out[a], out[b] = d.min(axis=1) <= most, d.min(axis=0) <= most
    return out


def judge(mine: np.ndarray, sizes: np.ndarray, unit: np.ndarray, before: np.ndarray, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links within a pair of blocks (within one where lo = hi): linked vectors per row, and a forest of the links.

    before has the rows' buckets in all earlier tables: pairs that share one of them were judged there.
    """
    if lo == hi:
        a = b = np.arange(len(sizes))
    else:
        a, b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    hit = (unit[a] @ unit[b].T) >= threshold
    if lo == hi:
        np.fill_diagonal(hit, False)
    if hit.any():
        for t in range(before.shape[1]):
            hit &= before[a, t, None] != before[None, b, t]
    links = np.zeros(len(sizes), np.int64)
    if not hit.any():
        return links, []
    links[a] = hit @ sizes[b]
    if lo == hi:
        return links, forest(hit)
    links[b] = hit.T @ sizes[a]
    whole = np.zeros((len(a) + len(b),) * 2, bool)
    whole[: len(a), len(a) :] = hit
    whole[len(a) :, : len(a)] = hit.T
    at = np.r_[a, b].tolist()
    return links, [(at[x], at[y]) for x, y in forest(whole)]


def _stretches(batches: Iterator[pa.RecordBatch], run: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and block pair: run gets tables of whole stretches of equal ones, with their places."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(rows: pa.Table, until_end: bool) -> tuple[list[tuple[int, int]], int]:
        group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
        starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
        ends = np.r_[starts[1:], group.shape[1]]
        done = len(starts) if until_end else len(starts) - 1  # the last stretch may go on
        return [(s, e) for s, e in zip(starts[:done].tolist(), ends[:done].tolist()) if e - s > 1], int(ends[done - 1]) if done else 0

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            rows = pa.Table.from_batches(held).combine_chunks()
            at, done = cut(rows, False)
            if at:
                yield run(rows, at)
            held = rows.slice(done).to_batches()
            size = rows.num_rows - done
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        at, _ = cut(rows, True)
        if at:
            yield run(rows, at)


def _block_pairs(met: DataFrame, block: int) -> DataFrame:
    """met (cls, t, bucket, m) with lo, hi and mine: a class sits in one block and goes to each pair of blocks that has it."""
    met = met.withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    met = met.withColumn("mine", F.expr("CAST(pmod(xxhash64(cls, bucket), blocks) AS INT)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("cls", "t", "bucket", F.col("mine").cast("long").alias("mine"), F.least("mine", "other").cast("long").alias("lo"), F.greatest("mine", "other").cast("long").alias("hi"))


def _dealt(rows: DataFrame) -> DataFrame:
    """By ranges of bucket and block pair, which hold about equally many rows; whole pairs of blocks stay together."""
    order = ["bucket", "lo", "hi"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _in_company(posted: DataFrame) -> DataFrame:
    full = posted.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    return posted.join(full, "bucket")


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """id, n_links (other vectors linked directly) and component_id of every row."""
    spark = rows.sparkSession
    ship(spark)
    block = BLOCK
    src = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    src = src.withColumn("ok", F.expr(f"label IS NOT NULL AND coalesce({_usable('v')}, FALSE)"))
    # equal vectors of one label are one class; -0.0 is 0.0
    src = src.withColumn("v", F.expr("IF(ok, transform(v, c -> c + 0D), NULL)"))
    src = stage(src.withColumn("h", F.expr(f"IF(ok, {HASHES[0]}, NULL)")).withColumn("h2", F.expr(f"IF(ok, {HASHES[1]}, NULL)")).withColumn("of", F.expr("IF(ok, xxhash64(label), NULL)")), "vectors")
    most = src.where("ok").groupBy("of", F.size("v")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables = plan(most, threshold, width)
    same = ["h", "h2"]
    counted = [F.count("*").alias("n"), F.min("id").alias("first"), F.first("of").alias("of")]
    cls = stage(src.where("ok").groupBy(*same).agg(F.min("v").alias("v"), F.max("v").alias("most"), F.min("label").alias("label"), F.max("label").alias("last"), *counted), "equal-vectors")
    if not cls.where("v <> most OR label <> last").isEmpty():  # different vectors with equal hashes: the vectors are the key
        drop_staged(cls)
        same = ["h", "h2", "label", "v"]
        cls = stage(src.where("ok").groupBy(*same).agg(*counted), "equal-vectors")
    wanted = [c for c in (*same, "n", "first") if c != "v"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("v"))
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            dims, of = np.diff(at), b.column(b.schema.get_field_index("of")).to_numpy()
            unit = np.zeros(len(flat))
            keys, sketch = np.zeros((len(dims), tables), np.int64), np.zeros((len(dims), SKETCH), np.int16)
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                for lo in range(0, len(here), 2048):
                    part = here[lo : lo + 2048]
                    places = at[part][:, None] + np.arange(dim)
                    m = flat[places]
                    m = m / np.abs(m).max(axis=1, keepdims=True)
                    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                    unit[places] = m
                    keys[part], sketch[part] = buckets(m, tables, k, width, seed, of[part]), sketches(m, seed)
            cols = [b.column(b.schema.get_field_index(c)) for c in ("cls", *wanted)]
            lists_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            units = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(unit[at[0] : at[-1]]))
            yield pa.RecordBatch.from_arrays([*cols, lists_of(keys), pa.array([x.tobytes() for x in sketch], pa.binary()), units, *([lists] if "v" in same else [])], names=["cls", *wanted, "keys", "sketch", "unit", *(["v"] if "v" in same else [])])

    types = {f.name: f.dataType.simpleString() for f in cls.schema.fields}
    schema = "cls long, " + ", ".join(f"{c} {types[c]}" for c in wanted) + ", keys array<long>, sketch binary, unit array<double>" + (", v array<double>" if "v" in same else "")
    made = cls.withColumn("cls", F.monotonically_increasing_id()).select("cls", *wanted, "of", "v")
    cls = stage(made.mapInArrow(keyed, schema), "classes")
    # buckets by their narrow keys first: only those with company are followed up
    met = _in_company(cls.select("cls", F.posexplode("keys").alias("t", "bucket")))
    reach = (math.sqrt(max(2 - 2 * threshold, 0.0)) + 4 * math.sqrt(SKETCH) * STEP) ** 2

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rows: pa.Table, at: list[tuple[int, int]]) -> pa.RecordBatch:
            num = {c: rows.column(c).to_numpy() for c in ("cls", "t", "bucket", "mine", "lo", "hi")}
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.int16).reshape(-1, SKETCH)
            keep = np.zeros(len(sketch), bool)
            two = np.array([s for s, e in at if e - s == 2 and num["lo"][s] == num["hi"][s]], int)
            if len(two):  # most buckets in company hold two classes: all at once
                d = (sketch[two].astype(np.float64) - sketch[two + 1]) * STEP
                near = two[(d * d).sum(1) <= reach]
                keep[near] = keep[near + 1] = True
            for s, e in at:
                if e - s > 2 or num["lo"][s] != num["hi"][s]:
                    keep[s:e] = near_mates(num["mine"][s:e], sketch[s:e], num["lo"][s], num["hi"][s], reach)
            return pa.RecordBatch.from_arrays([pa.array(num[c][keep]) for c in ("cls", "t", "bucket")], names=["cls", "t", "bucket"])

        return _stretches(batches, run, 16 * block)

    narrow = _block_pairs(met, block).join(cls.select("cls", "sketch"), "cls")
    near = stage(_dealt(narrow).mapInArrow(sift, "cls long, t int, bucket long").distinct(), "near")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rows: pa.Table, at: list[tuple[int, int]]) -> pa.RecordBatch:
            num = {c: rows.column(c).to_numpy() for c in ("cls", "n", "t", "mine", "lo", "hi")}
            units, befores = rows.column("unit").chunk(0), rows.column("before").chunk(0)
            u, flat = units.offsets.to_numpy(), units.values.to_numpy()
            p, early = befores.offsets.to_numpy(), befores.values.to_numpy()
            shape = np.stack([np.diff(u), num["t"]])

            def alike(s: int, e: int) -> list[np.ndarray]:
                """The rows of a stretch: one group, unless vectors of other lengths or tables have the bucket's key by chance."""
                whole, here = np.arange(s, e), shape[:, s:e]
                if (here == here[:, :1]).all():
                    return [whole]
                _, kind = np.unique(here, axis=1, return_inverse=True)
                return [whole[kind.ravel() == x] for x in range(kind.max() + 1)]

            out: list[tuple] = []
            for of in (g for s, e in at for g in alike(s, e)):
                parts = [values[ends[of[0]] : ends[of[-1] + 1]] if len(of) == of[-1] + 1 - of[0] else np.concatenate([values[ends[x] : ends[x + 1]] for x in of]) for values, ends in ((flat, u), (early, p))]
                parts = [x.reshape(len(of), -1) for x in parts]
                links, edges = judge(num["mine"][of], num["n"][of], *parts, num["lo"][of[0]], num["hi"][of[0]], threshold)
                ids = num["cls"][of]
                out += [(int(ids[x]), int(links[x]), None) for x in np.flatnonzero(links).tolist()]
                out += [(int(ids[x]), 0, int(ids[y])) for x, y in edges]
            cols = list(zip(*out)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cls", "links", "to"])

        return _stretches(batches, run, 2 * block)

    work = _block_pairs(_in_company(near), block).join(cls.select("cls", "n", "keys", "unit"), "cls")
    work = work.select("cls", "t", "bucket", "mine", "lo", "hi", "n", F.expr("slice(keys, 1, t)").alias("before"), "unit")
    found = stage(_dealt(work).mapInArrow(compare, "cls long, links long, to long"), "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links")).withColumnRenamed("cls", "c")
    parts = components(found.where("to IS NOT NULL"), "cls", "to").withColumnRenamed("node", "c2")
    named = cls.drop("keys", "sketch", "unit").join(parts, F.col("cls") == F.col("c2"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").join(counts, F.col("cls") == F.col("c"), "left")
    named = named.select(*[F.col(c).alias(f"c_{c}") for c in same], (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    on = [F.col(c) == F.col(f"c_{c}") for c in same]
    out = src.where("ok").select("id", *same).join(named, on).select("id", F.col("links").alias("n_links"), "component_id")
    return out.unionByName(src.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


#: The two hashes of a vector and its label.
HASHES = ("xxhash64(label, v)", "hash(v, label)")


def recall(rows: list[tuple[int, object, list[float]]], threshold: float = 0.98, n: int | None = None) -> float:
    """Share of all pairs at or above the threshold that meet in some bucket, against brute force (driver side, for a sample).

    n: as planned for so many rows of one label.
    """
    k, tables = plan(len(rows) if n is None else n, threshold)
    m = np.array([r[2] for r in rows], float)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    keys = buckets(m, tables, k)
    hit = np.triu(m @ m.T >= threshold, 1)
    pairs = list(zip(*np.nonzero(hit)))
    return sum((keys[i] == keys[j]).any() for i, j in pairs) / len(pairs) if pairs else 1.0
