"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: prefix-compressed blocks, a sparse index with one entry for each block,
a Bloom filter of the keys, and a footer of fixed size at the end. A lookup asks the filter, searches the index by
bisection and reads one block. Ids take 2 bytes each where all of them fit, else 4.

    block   entries: shared key bytes, other key bytes, count of ids (varints), the other key bytes, ids; then crc32
    index   for each block: first key, place, size, ids before it in the shard, entries
    footer  FOOTER, see below

The key of doc_id is a byte (0: null, 1: not) and 8 bytes that sort as the number does, so null comes first. Rows that
share a doc_id are all kept, ordered by a hash of their texts; they may span shards, which are ranges of doc_id, hash and row
number sized by the texts' bytes. An empty or null text is the end id alone. An empty table makes no shard.
Shards are written under another name and then renamed, so that a repeated task leaves whole files only.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir, read_vocabulary, settled, table, text_or_empty, vocabulary_path
from .pieces import LibraryEncoder, four_bytes, once

END_ID = 2
BLOCK_BYTES = 64 << 10
#: Bytes of text for a shard at most, and at least where more shards than four for each core would hold less.
MOST_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
#: Keys of one look-up, and shards whose offsets are summed in one task.
LOOKUP_KEYS = 100_000
SUMMED = 4096
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"WFSST\x00\x00\x01"
#: ids' width, documents, ids, places and sizes of index and filter, the index's crc32
FOOTER = struct.Struct("<BQQQQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


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


def probes(key: bytes, bits: int) -> list[int]:
    """The filter's bits for a key, by double hashing."""
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard to a stream. Keys come in ascending order; only the open block, the index and the keys' hashes are held."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.place = stream, width, 0
        self.block, self.entries, self.first, self.before = bytearray(), 0, b"", b""
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashed: list[bytes] = []
        self.docs = self.ids = self.block_start = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, 32 bits each."""
        if key < self.before:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < len(key) and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.first, self.block_start = key, self.ids
        n = len(ids) // 4
        self.block += varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:]
        self.block += np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        self.entries += 1
        self.docs += 1
        self.ids += n
        if key != self.before or self.docs == 1:
            self.hashed.append(key)
        self.before = key
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.place
        self.stream.write(data)
        self.place += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.entries:
            at, size = self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index.append((self.first, at, size, self.block_start, self.entries))
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(size) + varint(start) + varint(n) for k, at, size, start, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.hashed))
        bloom = bytearray(-(-bits // 8))
        for key in self.hashed:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at = self._put(index)
        bloom_at = self._put(struct.pack("<Q", bits) + bytes(bloom))
        self._put(FOOTER.pack(self.width, self.docs, self.ids, *index_at, *bloom_at, zlib.crc32(index), MAGIC))


class Reader:
    """Reads a shard from a file that can seek."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        self.width, self.docs, self.ids, index_at, index_size, self.bloom_at, self.bloom_size, crc, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        index = self._read(index_at, index_size)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole shard")
        self.index, self.bloom, at = [], None, 0
        while at < len(index):
            n, at = read_varint(index, at)
            key, at = index[at : at + n], at + n
            numbers = []
            for _ in range(4):
                x, at = read_varint(index, at)
                numbers.append(x)
            self.index.append((key, *numbers))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, place, size, start, n = self.index[k]
        data = self._read(place, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a damaged block")
        at, key = 0, b""
        for _ in range(n):
            shared, at = read_varint(data, at)
            other, at = read_varint(data, at)
            count, at = read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            raw = data[at : at + count * self.width]
            at += len(raw)
            yield key, start, np.frombuffer(raw, "<u2").astype("<u4").tobytes() if self.width == 2 else raw
            start += count

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in the shard, its ids) in order."""
        for k in range(len(self.index)):
            yield from self._block(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, self.bloom_size)
        (bits,) = struct.unpack_from("<Q", self.bloom)
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in probes(key, bits))

    def get(self, key: bytes) -> list[tuple[int, bytes]]:
        """(ids before it, its ids) of every row with this key."""
        if not self.may_hold(key):
            return []
        out = []
        k = max(0, bisect.bisect_left(self.index, key, key=lambda e: e[0]) - 1)  # rows of one key may begin in the block before
        while k < len(self.index) and self.index[k][0] <= key:
            out += [(start, ids) for found, start, ids in self._block(k) if found == key]
            k += 1
        return out


def file_system(uri: str):
    """A pyarrow file system and the path there, for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_count(size: int, cores: int) -> int:
    """How many shards hold so many bytes of text."""
    return max(1, -(-size // MOST_BYTES), min(-(-size // LEAST_BYTES), 4 * cores))


def write_shards(docs: DataFrame, vocabulary: str, directory: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write documents' ids to shards in directory, which all executors share. Returns shard, path, first and last (keys), n_docs, n_ids and start (ids of earlier shards)."""
    spark = docs.sparkSession
    import json

    text = read_vocabulary(vocabulary)
    spec = json.loads(text)
    largest = max(max(spec["model"]["vocab"].values()), max((t["id"] for t in spec["added_tokens"]), default=0), end_id)
    width, blob = 2 if largest < 1 << 16 else 4, spark.sparkContext.broadcast(text)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        shards = shard_count(size, spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # what the encoder remembers holds no cycles
        coder, writer, end = once(LibraryEncoder, blob.value), None, four_bytes([end_id])
        shard, first = TaskContext.get().partitionId(), b""
        system, base = file_system(directory)
        final, part = f"{base}/shard-{shard:06d}.sst", f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids = coder.many(t.as_py() for t in batch.column(1))
            for doc_id, own in zip(batch.column(0).to_pylist(), ids):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    stream = system.open_output_stream(part)
                    writer, first = Writer(stream, width), key_of(doc_id)
                writer.add(key_of(doc_id), own + end)
        if writer is not None:
            writer.close()
            stream.close()
            system.move(part, final)
            columns = {"shard": pa.array([shard], pa.int32()), "path": [final], "first": [first], "last": [writer.before], "n_docs": [writer.docs], "n_ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(columns)

    made = settled(ordered.mapInArrow(write, "shard int, path string, first binary, last binary, n_docs long, n_ids long"), "shards")
    # offsets of groups of shards, then of the shards in each
    group = F.floor(F.col("shard") / SUMMED)
    sums = made.groupBy(group.alias("__group")).agg(F.sum("n_ids").alias("__ids"))
    earlier = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SUMMED shards
    sums = sums.select("__group", F.coalesce(F.sum("__ids").over(earlier), F.lit(0)).alias("__base"))
    before = Window.partitionBy("__group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("__group", group).withColumn("__own", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.join(F.broadcast(sums), "__group").select(*made.columns, (F.col("__base") + F.col("__own")).alias("start"))


def read_shards(manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(directory)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                with system.open_input_file(path) as f:
                    for key, start, ids in Reader(f).scan():
                        rows.append((id_of(key), base + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 10_000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    return manifest.select("path", "start").repartition(min(count, 10_000)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def looked_up(manifest: DataFrame, directory: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, start and ids (little-endian, 32 bits each) of every row with one of these doc_ids, LOOKUP_KEYS of them at most.

    A shard is opened only if one of them lies between its first and last key; there its filter, its index and single blocks are read.
    """
    keys = sorted({key_of(i) for i in doc_ids})
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"at most {LOOKUP_KEYS} keys are looked up at once; read_shards reads all")
    wanted = manifest.sparkSession.sparkContext.broadcast(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(directory)
        for batch in batches:
            for path, first, last, base in zip(*(c.to_pylist() for c in batch.columns)):
                own = wanted.value[bisect.bisect_left(wanted.value, first) : bisect.bisect_right(wanted.value, last)]
                if not own:
                    continue
                with system.open_input_file(path) as f:
                    reader = Reader(f)
                    for key in own:
                        if rows := reader.get(key):
                            starts, ids = zip(*rows)
                            yield pa.RecordBatch.from_arrays([pa.array([id_of(key)] * len(rows), pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return manifest.select("path", "first", "last", "start").repartition(min(max(1, manifest.count()), 10_000)).mapInArrow(find, "doc_id long, start long, ids binary")


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_dir(spark, "sstable")
    manifest = write_shards(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), directory)
    return read_shards(manifest, directory)
