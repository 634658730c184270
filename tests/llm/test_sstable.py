from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
from tokenizers import Tokenizer

from aerolith.llm import common, sstable, store


class Memory(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]

    def size(self):
        return len(self.getvalue())


def test_shard_round_trip_and_lookups(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    rng = random.Random(1)
    for width in (2, 4):
        keys = sorted([None] * 2 + [rng.randint(-(2**63), 2**63 - 1) for _ in range(300)] + [5] * 40, key=lambda k: sstable.key_of(k))
        rows = [(sstable.key_of(k), np.array([rng.randrange(60000) for _ in range(rng.randint(1, 30))], "<u4").tobytes()) for k in keys]
        out = Memory()
        w = sstable.Writer(out, width)
        for k, v in rows:
            w.add(k, v)
        w.close()
        r = sstable.Reader(out)
        assert list(r.scan()) == rows and r.n_docs == len(rows) and len(r.blocks) > 5
        assert [sstable.id_of(k) for k, _ in rows] == keys
        for k in {k for k, _ in rows}:
            assert r.get(k) == [v for x, v in rows if x == k]
        hits = sum(bool(r.get(sstable.key_of(10**6 + i))) for i in range(500))
        assert hits == 0


def test_table_equals_brute_force(spark):
    docs = [(i * 7 - 90, "the word %d and one" % i * (i % 5)) for i in range(120)] + [(None, "null id"), (500, None), (501, ""), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").repartition(5)
    path, folder = vocabularies.path("byte_bpe_50k.json"), common.new_path(spark, "sst")
    manifest = sstable.write(df, path, 0, folder)
    lib, at, want = Tokenizer.from_file(path), 0, []
    for k, t in sorted(docs, key=lambda d: (sstable.key_of(d[0]), d[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sstable.read(manifest).collect()), key=str) == sorted(want, key=str)
    found = []
    for r in manifest.collect():
        with store.opened(r.path) as f:
            found += sstable.Reader(f).get(sstable.key_of(3))
    assert len(found) == 2
    assert sstable.read(sstable.write(df.limit(0), path, 0, folder)).count() == 0


def test_shards_are_cut_by_bytes_between_keys(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i // 3, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(300)] + [(50, "very long " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    path = vocabularies.path("byte_bpe_50k.json")
    whole, cut = (sstable.write(df, path, 0, common.new_path(spark, "sst"), shard_bytes=n) for n in (1 << 30, 2000))
    assert cut.count() > 2 * whole.count()
    want = sorted(map(tuple, sstable.read(whole).collect()))
    monkeypatch.setattr(sstable, "READ_ROWS", 7)
    assert sorted(map(tuple, sstable.read(cut).collect())) == want and len(want) == 301
    ranges = []
    for r in cut.collect():
        with store.opened(r.path) as f:
            keys = [k for k, _ in sstable.Reader(f).scan()]
        ranges.append((bytes(r.first_key), keys[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # no key in two shards
