"""Token ids in sorted-string-table shards.

A shard holds documents in ascending id order:

    data blocks   entries with prefix-compressed keys and a restart every RESTART entries,
                  zstd-compressed, each followed by the crc32 of its stored bytes
    filter        Bloom filter over the keys
    index         for each block: first key, place, stored size, entries, ids before it
    footer        fixed size; says where the others lie, the width of ids, totals, magic

A key is the id as 8 bytes big-endian with its sign bit turned, so byte order is numeric
order; a null id has the empty key, which comes first. A lookup reads footer, filter and
index once, then one block by binary search.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, store, tokens

BLOCK_BYTES = 64 << 10
SHARD_FILE_BYTES = 256 << 20
READ_ROWS = 16_384
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"AEROSST1"
FOOTER = struct.Struct("<QQQQQQBB6x8s")
MANIFEST = "path string, first_key binary, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return ((a + i * (b | 1)) % size for i in range(BLOOM_HASHES))


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.n_ids = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.n, self.last, self.first, self.before = bytearray(), [], 0, b"", None, self.n_ids

    def add(self, key: bytes, ids: bytes) -> None:
        """`ids`: little-endian unsigned 32-bit; keys come in ascending order."""
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if self.first is None:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.n_ids += len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if not self.n:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        stored = self.zip.compress(raw)
        at, size = self._put(stored + struct.pack("<I", zlib.crc32(stored)))
        self.index.append(struct.pack("<BQQQQ", len(self.first), at, size, self.n, self.before) + self.first)
        self._new_block()

    def close(self) -> None:
        self._flush()
        size = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(size // 8 + 1, np.uint8)
        for k in self.keys:
            for b in _bits(k, size):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at, bloom_size = self._put(bloom.tobytes())
        index_at, index_size = self._put(b"".join(self.index))
        self._put(FOOTER.pack(bloom_at, bloom_size, index_at, index_size, len(self.keys), self.n_ids, self.width, len(self.index) > 0, MAGIC))
        self.bloom_bits = size


class Reader:
    """Lookups and scans; `file` has read_at(size, place) and size()."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        *places, self.n_docs, self.n_ids, self.width, _, magic = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        bloom_at, bloom_size, index_at, index_size = places
        self.bloom, self.bloom_bits = file.read_at(bloom_size, bloom_at), max(64, self.n_docs * BLOOM_BITS)
        raw, at, self.blocks = file.read_at(index_size, index_at), 0, []
        entry = struct.Struct("<BQQQQ")
        while at < len(raw):
            n, *place = entry.unpack_from(raw, at)
            at += entry.size
            self.blocks.append((raw[at : at + n], *place))
            at += n
        self.firsts = [b[0] for b in self.blocks]

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, size, _, _ = self.blocks[i]
        stored = self.file.read_at(size, at)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(stored[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * (n + 1)], list(struct.unpack(f"<{n}I", raw[-4 * (n + 1) : -4]))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            value = data[at + rest : at + rest + size]
            at += rest + size
            yield key, value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._entries(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with this key."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bloom_bits)):
            return []
        found: list[bytes] = []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.blocks) and self.firsts[i] <= key:
            data, restarts = self._block(i)
            lo, hi = 0, len(restarts) - 1  # the last restart whose key is below `key`
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if next(self._entries(data, restarts[mid]))[0] < key else (lo, mid - 1)
            for k, value in self._entries(data, restarts[lo]):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
            i += 1
        return found


def write(documents: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_FILE_BYTES) -> DataFrame:
    """Encode and write all documents; the manifest: a row per shard, in key order by
    first_key. A task begins a new shard after about `shard_bytes`, at the next key, so rows
    of one key share a shard and what a writer holds doesn't grow with the partition.

    Defined cases: a null text is empty and holds the end id alone; a null id comes first;
    rows of one id follow each other in text order; an empty table has no shards. Ids are
    integers; other columns are not read."""
    spark = documents.sparkSession
    common.text_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc, out, writer = tokens.encoder(tokenizer), None, None
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "first_key": pa.array([first], pa.binary()), "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

        for b in common.rows_of(batches, tokens.SHARD_BYTES):
            for k, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                key = key_of(k)
                if writer is not None and writer.at >= shard_bytes and key != writer.keys[-1]:
                    yield closed()
                    writer = None
                if writer is None:
                    path, out = store.create(folder, ".sst")
                    writer, first = Writer(out, width), key
                writer.add(key, ids + end)
        if writer is not None:
            yield closed()

    return common.saved(ranged.mapInArrow(common.lean(run), MANIFEST), "sst-manifest")[0]


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document."""
    shards = manifest.count()  # files, not documents
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", base.alias("base")).repartition(max(1, shards))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.opened(path) as file:
                    for key, ids in Reader(file).scan():
                        n = len(ids) // 4
                        rows.append((id_of(key), at, n, zlib.crc32(ids)))
                        at += n
                        if len(rows) == READ_ROWS:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return placed.mapInArrow(common.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
