from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest

from aerolith.llm import common, store, warc


def test_framing_round_trip_and_damage():
    for payload in (b"", b"x", bytes(range(256)) * 100, b"\r\n0\r\n\r\n" * 9):
        assert warc.unframed(warc.framed(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.unframed(b"5\r\nabcdXX\r\n0\r\n\r\n")


def brute(rows):
    best = {}
    for k, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and k is not None:
            best[p] = max(k, best.get(p, k))
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        first = best.get(p) if len(p) >= 1000 else None
        again = first is not None and first != k
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None, None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    rng = random.Random(2)
    big = ["é<p>\r\n\r\nWARC/1.1\r\n" * rng.randint(60, 9000) for _ in range(4)]
    rows = [(i, f"http://h/{i}", rng.choice(["", "short", *big, "y" * rng.randint(0, 40_000)])) for i in range(60)]
    rows += [(60, None, None), (61, "http://a b\nc", "x"), (None, "u", big[0]), (3, rows[3][1], rows[3][2]), (99, "u", big[1]), (99, "u", big[1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = common.new_path(spark, "warc")
    archives = warc.write(df, folder, segment_bytes=5000)
    assert sorted(map(tuple, warc.read(archives).collect()), key=str) == brute(rows)
    # the archives are what other readers expect: a record a member, lengths that hold
    kinds = set()
    for a in archives.collect():
        data = store.opened(a.path).read()
        n = 0
        for fields, _ in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(data))):
            n += 1
            kinds.add(fields["warc-type"])
            if fields["warc-type"] == "continuation":
                assert int(fields["warc-segment-number"]) > 1 and fields["warc-segment-origin-id"]
        assert n == a.n_records
    assert kinds == {"response", "revisit", "continuation"}


def test_lost_segment_is_reported(spark):
    folder = common.new_path(spark, "warc")
    parts = list(warc.records(7, "u", b"z" * 9000, hashlib.sha1(b"z" * 9000).hexdigest(), None, 2000))
    paths = []
    for keep in (parts, parts[:-1], parts[:1] + parts[2:], parts[::-1]):
        address, out = store.create(folder, ".warc.gz")
        out.write(b"".join(gzip.compress(p) for p in keep))
        out.close()
        paths.append(address)
    for path, good in zip(paths, (True, False, False, True), strict=True):
        r = warc.read(spark.createDataFrame([(path, 1)], "path string, n_records long")).collect()
        assert len(r) == 1 and r[0].page_id == 7 and (r[0].problem is None) == good and (r[0].payload_bytes == 9000) == good


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df, common.new_path(spark, "warc"))).count() == 0
