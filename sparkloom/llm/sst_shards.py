"""Token-id shards as sorted string tables.

A shard holds documents in key order:

    file   := block* bloom index footer
    block  := zstd(entry*)                      about BLOCK_BYTES before compression
    entry  := varint shared | varint unshared | varint value_len | key[shared:] | value
    value  := token ids, little-endian unsigned 32-bit where a shard needs them, else 16-bit (footer flag)
    bloom  := bit array over the distinct keys of the shard
    index  := zstd(key length, last key, offset, length, documents, ids before the block)* one per block
    footer := offsets and sizes, counts, Bloom hash count, id width, magic        fixed size

The first entry of a block shares nothing, so a block is read on its own: a lookup tests the Bloom filter, finds
the first block whose last key is not below the key by binary search in the index, and scans that block.

Keys are 9 bytes: 0x00 for a null identifier, else 0x01 and the identifier as big-endian with its sign bit turned,
so byte order is identifier order and nulls come first. Repeated keys are kept, ordered by a hash of their text.

Defined results: null text is the empty text (the end id only); null identifiers are a key of their own; an empty
table writes no shard; extra input columns are ignored.
"""

from __future__ import annotations

import io
import json
import re
import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import new_path, ship

BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MAGIC = b"SLSST001"
FOOTER = struct.Struct("<QQQQQQIBB6x8s")  # bloom at, bloom bytes, index at, index bytes, documents, ids, hashes, width, 0
#: Text bytes that one shard should hold: as many as make MANY_SHARDS of the table, within these bounds.
SHARD_TEXT_BYTES, LARGE_SHARD_TEXT_BYTES, MANY_SHARDS = 32 << 20, 1 << 30, 50_000

MANIFEST = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())]
)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Streams one shard; holds one block, the keys for the filter and the index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.block_docs = io.BytesIO(), b"", 0
        self.index, self.keys, self.docs, self.ids, self.ids_before = io.BytesIO(), bytearray(), 0, 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block_docs:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        if key != self.last or not self.docs:
            self.keys += key
        self.block.write(varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:])
        self.block.write(value)
        self.last = key
        self.block_docs += 1
        self.docs += 1
        self.ids += len(value) // self.width
        if self.block.tell() >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.block_docs:
            return
        data = self.pack.compress(self.block.getvalue())
        self.out.write(data)
        self.index.write(varint(len(self.last)) + self.last + varint(self.at) + varint(len(data)) + varint(self.block_docs) + varint(self.ids_before))
        self.at += len(data)
        self.block, self.block_docs, self.ids_before = io.BytesIO(), 0, self.ids

    def close(self) -> None:
        self.flush()
        n = len(self.keys) // 9
        bits = max(64, n * BLOOM_BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for i in range(n):
            for p in bloom_places(bytes(self.keys[9 * i : 9 * i + 9]), bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        index = self.pack.compress(self.index.getvalue())
        filt = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(filt + index)
        self.out.write(FOOTER.pack(self.at, len(filt), self.at + len(filt), len(index), self.docs, self.ids, BLOOM_HASHES, self.width, 0, MAGIC))


class Reader:
    """Random access to one shard: footer, filter and index are read at once, blocks as they are needed."""

    def __init__(self, file, size: int):
        self.file = file
        foot = self._read(size - FOOTER.size, FOOTER.size)
        self.bloom_at, bloom_n, index_at, index_n, self.docs, self.ids, self.hashes, self.width, _, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        filt = self._read(self.bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", filt[:8])[0], filt[8:]
        data = zstandard.decompress(self._read(index_at, index_n)) if index_n else b""
        self.last_keys, self.blocks, at = [], [], 0
        while at < len(data):
            n, at = read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            at += n
            row = []
            for _ in range(4):
                x, at = read_varint(data, at)
                row.append(x)
            self.blocks.append(tuple(row))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, _, _ = self.blocks[block]
        data, i, key = zstandard.decompress(self._read(at, n), max_output_size=0), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            rest, i = read_varint(data, i)
            size, i = read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + size]
            i += size

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier, in file order."""
        key, out = key_of(doc_id), []
        if not self.docs or not self.may_hold(key):
            return out
        for b in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for k, v in self.entries(b):
                if k == key:
                    out.append(self.array(v))
                elif k > key:
                    return out
        return out

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for b in range(len(self.blocks)):
            for k, v in self.entries(b):
                yield id_of(k), v


#: Text is cut at spaces and newlines, which normalizer and pattern of the vocabulary drop. A chunk is cut again behind
#: its first letters (small, Latin-1) where a Latin-1 character follows that is neither a letter nor an apostrophe: there
#: the pattern always cuts, and nothing composes.
_LATIN_WORD = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
_LATIN_PARTS = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([\x00-\x26\x28-\x40\x5b-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf].*)", re.S).fullmatch
CACHE_CHUNKS = 500_000
CACHE_CHARS = 64


class Known(dict):
    """Chunk to ids. What isn't known is looked for in the older generation, else noted to be encoded: then a list stands
    for it until `settle` puts the ids in."""

    def __init__(self, older: dict):
        super().__init__()
        self.older, self.new, self.parts = older, {}, []

    def __missing__(self, chunk: str) -> bytes | list:
        found = self.older.get(chunk)
        if found is None:
            found = []
            m = _LATIN_PARTS(chunk)
            if m:
                self.parts.append((chunk, found, self[m[1]], self[m[2]]))
            else:
                self.new[chunk] = found
        self[chunk] = found
        return found


class ChunkEncoder:
    """Whole-text encoding with the tokenizers library, one call for the chunks that a worker hasn't met.

    No token spans a cut, so a text's ids are those of its chunks, joined. A Latin-1 text is composed already, and
    each of its characters has one lower-case character, so it can be put in lower case (as the vocabulary's
    normalizer does) before chunks are looked up. The strings of added tokens are what the library makes of them by
    default, one id: it finds them in the text as it stands, before anything else, so texts are cut there first.
    `whole` is the plain call that tests hold this against.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype, self.code = dtype, {"<u2": "H", "<u4": "I"}[dtype]
        self.known = Known({})
        kind = json.loads(Path(path).read_text())
        suffix = kind["model"].get("end_of_word_suffix")
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        steps = [x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the chunks are right for vocabularies that compose, drop white space and lower the case")
        added = kind.get("added_tokens") or []
        if any(x.get(k) for x in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens are found as they stand")
        self.added = {x["content"] for x in added}
        self.added_lower = [x.lower() for x in self.added]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> list[str]:
        if not self._spells(text):
            return self._plain(text)
        out = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(part)
            else:  # in lower case other letters could spell an added token
                out += self._chunks(part) if self._spells(part) else self._plain(part)
        return out

    def _spells(self, text: str) -> bool:
        """Whether the text may hold an added token, in any case of letters."""
        low = text.lower()
        return any(x in low for x in self.added_lower)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Runs without space and newline; empty ones between two of those stand for no ids."""
        return text.replace("\n", " ").split(" ")

    @classmethod
    def _plain(cls, text: str) -> list[str]:
        if text.isascii():
            return cls._chunks(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return cls._chunks(text)
        return cls._chunks(text.lower())

    def _joined(self, words: list[str]) -> list[bytes] | None:
        """The ids of words of letters by one call, as a text of them, cut where a token ends a word."""
        ids = np.array(self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None  # what isn't one token sequence a word is left to be encoded by itself
        data, size = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        ends = (ends * size).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def settle(self) -> None:
        """Encode what was new; the lists that stood for it get their ids."""
        known = self.known
        words = [c for c in known.new if _LATIN_WORD(c)]
        rest = [c for c in known.new if not _LATIN_WORD(c)]
        for lo in range(0, len(words), 512):
            part = words[lo : lo + 512]
            got = self._joined(part)
            if got is None:
                rest += part
                continue
            for c, v in zip(part, got, strict=True):
                known.new[c].append(v)
                known[c] = v
        for c, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            v = array(self.code, e.ids).tobytes()
            known.new[c].append(v)
            known[c] = v
        bytes_of = lambda x: x if type(x) is bytes else x[0]
        for chunk, stand, a, b in known.parts:
            v = bytes_of(a) + bytes_of(b)
            stand.append(v)
            known[chunk] = v
        for c in [c for c in known.new if len(c) > CACHE_CHARS] + [p[0] for p in known.parts if len(p[0]) > CACHE_CHARS]:
            known.pop(c, None)
        known.new, known.parts = {}, []

    def texts(self, texts: list[str]) -> list[bytes]:
        known = self.known
        found = [list(map(known.__getitem__, self.cut(t))) for t in texts]
        fresh = bool(known.new or known.parts)
        if fresh:
            self.settle()
        out = [b"".join([x if type(x) is bytes else x[0] for x in f]) if fresh else b"".join(f) for f in found]
        if len(known) > CACHE_CHUNKS:  # the rest of what is needed comes back from the older generation
            known.older = {}
            self.known = Known(dict(known))
        return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str, dtype: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, dtype)


def _vocabulary_width(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(top, end_id) < 1 << 16 else 4


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id and write one shard per range of identifiers; returns the manifest.

    One shuffle, by range of identifier, text hash and row; a task sorts (spilling) and streams one shard. Files are
    written under attempt-unique names that the manifest lists, so a repeated or speculative task leaves no torn shard
    behind; what the manifest doesn't list is deleted. An identifier repeated beyond one shard's size goes on in the next.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "token-shards")
    width = _vocabulary_width(tokenizer_path, end_id)
    dtype = "<u2" if width == 2 else "<u4"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if shards is None:
        total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        each = min(max(SHARD_TEXT_BYTES, total // MANY_SHARDS), LARGE_SHARD_TEXT_BYTES)
        shards = max(1, spark.sparkContext.defaultParallelism, -(-total // each))
    # an identifier with many rows, or the null one, goes on in the next shard: rows that agree in it are dealt by text, equal ones by row
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    src = src.withColumn("h", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())
    ranged = src.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, end = chunk_encoder(tokenizer_path, dtype), np.asarray([end_id], dtype).tobytes()
        shard = TaskContext.get().partitionId()
        writer = out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(path)
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(out, width)
                for i, v in zip(part.column(0).to_pylist(), enc.texts(part.column(1).to_pylist()), strict=True):
                    writer.add(key_of(i), v + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/{name}", "n_docs": writer.docs, "n_ids": writer.ids}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # the manifest (a row per shard) is taken once: the files exist from here on, under the names of its attempts
    rows = ranged.mapInArrow(run, MANIFEST).collect()
    listed = {r.path.rsplit("/", 1)[1] for r in rows}
    fs, base = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.base_name.startswith("shard-") and f.base_name not in listed:
                fs.delete_file(f.path)
    return spark.createDataFrame(sorted(rows, key=lambda r: r.shard), MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, from the files: doc_id, start, n_tokens, ids (little-endian u32 bytes).

    start counts the ids of all documents before it; it comes from a running sum over the manifest's few rows.
    """
    spark = manifest.sparkSession
    ship(spark)
    rows, start, before = sorted(manifest.collect(), key=lambda r: r.shard), 0, []
    for r in rows:
        before.append((r.path, start))
        start += r.n_ids
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    if not before:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(p) as f:
                    out: list[tuple] = []
                    held = 0
                    for i, v in (r := Reader(f, f.size())):
                        n = len(v) // r.width
                        out.append((i, at, n, r.array(v).astype("<u4").tobytes()))
                        at += n
                        held += 4 * n
                        if held > 4 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return spark.createDataFrame(before, "path string, start long").repartition(len(before)).mapInArrow(run, schema)


def lookup(manifest_rows: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document by binary search, shard by shard as the filters allow."""
    found = []
    for r in manifest_rows:
        fs, p = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_file(p) as f:
            found += Reader(f, f.size()).get(doc_id)
    return found


def checksums(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
