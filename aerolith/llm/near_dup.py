"""Near-duplicate documents by HyperMinHash, banding and exact confirmation.

A document's set is its distinct shingles, as 64-bit hashes. Documents of equal sets are one
class with the smallest id as its representative; only representatives go on.

Sketch: 2**8 buckets, each with the smallest hash that falls in it, kept as its leading-zero
count and 10 mantissa bits. Pairs of buckets are merged to 128 registers for 32 bands of 4;
a band of empty registers is none. At a similarity of 0.85 a pair misses every band with a
chance of 6e-11, and sparse sets, in which a differing shingle spoils one band, with less.

Candidates never go through all pairs of a group:
1. In each band bucket every member is paired with the smallest one. Pairs that the sizes
   rule out, or whose collision-corrected estimate lies five standard errors below the
   threshold, go; the others are confirmed on full sets. Components follow.
2. Buckets that still hold several components are compared, in blocks, by registers only.
   A block with few pairs above the estimate's margin gives them to exact confirmation.
3. Blocks with many such pairs, as in large groups of near copies, are joined to families;
   their full sets are multiplied block by block, exactly, and only links that join two
   components come out. Blocks are bounded in rows and bytes, so no group is in one task.

Defined cases: null or word-less texts have empty sets and are linked with nothing; fewer
words than a shingle are one shingle of them all; rows of one doc_id are one document,
linked by it; a null doc_id gives a null component and is kept; repeated rows give a row each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE_WORDS = 3
#: Numerator and denominator of the least similarity that links.
LEAST = (85, 100)
BUCKET_BITS, MANTISSA_BITS = 8, 10
BANDS, BAND_REGISTERS = 32, 4
SHARD_BYTES = 1 << 20
BLOCK_ROWS = 1024
BLOCK_BYTES = 24 << 20
#: A block with more estimated pairs than this per row goes to families.
SPARSE_PAIRS = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))
SKETCH = "doc_id long, n int, fp binary, bands array<long>, registers binary"


def shingle_sets(texts: list[str | None], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, begins = words.joined(texts)
    start, end = words.spans(data, words.NON_SPACE)
    h = words.hashes(data, start, end)
    bound = np.searchsorted(start, begins)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(k):
        rolled[: len(h) - j] += h[j:] * _MIX[j]
    rolled = words.mixed(rolled)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for j, x in enumerate(h[a:b]):
                whole = whole * _MIX[3] + x * _MIX[j % 3]
            out.append(words.mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2**BUCKET_BITS registers per set; 0 is an empty one, and a smaller hash has
    a smaller register: bit length (the leading zeros' complement), then mantissa bits."""
    out = np.zeros((len(sets), 1 << BUCKET_BITS), np.uint16)
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return out
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(h), bool)  # sets are sorted: the first of a bucket is its smallest
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    rest = h[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    shift = length - 1 - MANTISSA_BITS
    right, left = np.maximum(shift, 0).astype(np.uint64), np.maximum(-shift, 0).astype(np.uint64)
    mantissa = ((rest >> right) << left).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    out[row[first], bucket[first]] = 1 + (np.maximum(length, 0) << MANTISSA_BITS | mantissa)
    return out


def band_keys(regs: np.ndarray) -> list[list[int]]:
    """Keys of the bands that are not empty. A merged register is the smaller of its
    buckets' with the bucket it came from."""
    merge = (1 << BUCKET_BITS) // (BANDS * BAND_REGISTERS)
    wide = regs.reshape(len(regs), BANDS * BAND_REGISTERS, merge).astype(np.uint64)
    wide = np.where(wide == 0, np.uint64(1 << 40), wide * np.uint64(merge) + np.arange(merge, dtype=np.uint64))
    low = wide.min(2).reshape(len(regs), BANDS, BAND_REGISTERS)
    there = (low < np.uint64(1 << 40)).any(2)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4], there.shape).copy()
    for j in range(BAND_REGISTERS):
        key = words.mixed(key * _MIX[j % 4] + low[:, :, j])
    signed = key.view(np.int64)
    return [signed[i][there[i]].tolist() for i in range(len(regs))]


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of rows of registers, and the registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    # registers of different hashes agree with a chance of about 0.34 / 2**MANTISSA_BITS
    by_chance = (used - same) * (0.169919487 * 2 / 2**MANTISSA_BITS)
    return (same - by_chance) / np.maximum(used, 1), used


def likely(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Not five standard errors below the threshold."""
    value, used = estimated(a, b)
    t = least[0] / least[1]
    return value >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 0.01


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, set size, set fingerprint, band keys and registers of every row."""
    common.text_batches(docs.sparkSession)

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            sets = shingle_sets(shard["text"].to_pylist(), k)
            regs = registers(sets)
            marks = [np.array([len(s), s.sum(dtype=np.uint64), words.mixed(s * _MIX[0]).sum(dtype=np.uint64)], np.uint64).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([shard["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary()), pa.array(band_keys(regs), pa.list_(pa.int64())), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "fp", "bands", "registers"])

    return docs.mapInArrow(common.lean(run), SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set) of the documents in `ids` (id)."""
    wanted = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([shard["doc_id"].combine_chunks(), pa.array([s.tobytes() for s in shingle_sets(shard["text"].to_pylist(), k)], pa.binary())], ["doc_id", "set"])

    return wanted.mapInArrow(common.lean(run), "doc_id long, set binary")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with `column` of `table` (doc_id, column) for each end."""
    at_b = table.select(F.col("doc_id").alias("b"), F.col(column).alias("of_b"))
    at_a = table.select(F.col("doc_id").alias("a"), F.col(column).alias("of_a"))
    one = common.salted_lookup(pairs, "b", F.xxhash64("a"), at_b, "inner")
    return common.salted_lookup(one, "a", F.xxhash64("b"), at_a, "inner").select("a", "b", "of_a", "of_b")


def confirmed(pairs: DataFrame, docs: DataFrame, sketch: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link: estimated by registers, then compared on full sets."""
    spark = docs.sparkSession

    def close(batches):
        for b in batches:
            if b.num_rows:
                both = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(likely(*both, least)))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    near, _ = common.saved(_with_both(pairs, sketch.select("doc_id", "registers"), "registers").mapInArrow(common.lean(close), "a long, b long"), "near-pairs")
    ids, _ = common.saved(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    common.text_batches(spark)
    sets, _ = common.saved(_sets(docs, ids, k), "sets")

    def equal(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and least[1] * both >= least[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.saved(_with_both(near, sets, "set").mapInArrow(common.lean(equal), "a long, b long").distinct(), "links")[0]


def _in_blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row of a group once for every pair of blocks that its own is in: columns i, j,
    own, so that all pairs of rows meet and no task gets more than two blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])


def _judge(regs: np.ndarray, comp: np.ndarray, n: np.ndarray, rep: np.ndarray, own: np.ndarray, least: tuple[int, int]) -> list[np.ndarray]:
    """a, b, kind of one block. Kind 0: pairs of two components to confirm. Kind 1: too many
    of them; the block's rows, each tied to the first, as part of a family."""
    lo, hi = least
    across = bool((own != own[0]).any())
    found, room = [], SPARSE_PAIRS * len(rep) + 64
    step = max(1, 8192 // len(rep))
    for x in range(0, len(rep), step):
        i, j = np.nonzero(np.arange(x, min(x + step, len(rep)))[:, None] < np.arange(len(rep))[None])
        i += x
        ok = (comp[i] != comp[j]) & (hi * np.minimum(n[i], n[j]) >= lo * np.maximum(n[i], n[j]))
        if across:  # pairs within a block have their turn there
            ok &= own[i] != own[j]
        i, j = i[ok], j[ok]
        near = likely(regs[i], regs[j], least)
        found.append((i[near], j[near]))
        room -= int(near.sum())
        if room < 0:
            return [np.full(len(rep), rep.min()), rep, np.ones(len(rep), np.int32)]
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return [np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), np.zeros(len(i), np.int32)]


def _sparse_or_dense(least: tuple[int, int]):
    """Judges the blocks of a partition that is sorted by (key, i, j), many in each batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def blocks(table: pa.Table, last: bool):
            """Judged rows of all blocks of `table` that are complete, and what is left."""
            key, i, j, rep, n, comp, own = (table[c].to_numpy() for c in ("key", "i", "j", "rep", "n", "comp", "own"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *cuts.tolist(), *([len(key)] if last else [])]
            regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(key), -1)
            n = n.astype(np.int64)
            made = [_judge(regs[a:b], comp[a:b], n[a:b], rep[a:b], own[a:b], least) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 3
            out = pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, JUDGED, strict=True)], schema=JUDGED)
            return out, table.slice(edges[-1])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * BLOCK_ROWS:
                out, rest = blocks(pa.Table.from_batches(held), False)
                yield out
                held = rest.to_batches()
        if sum(x.num_rows for x in held):
            yield blocks(pa.Table.from_batches(held), True)[0]

    return run


def _family_links(least: tuple[int, int]):
    lo, hi = least

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a block of full sets, exactly, as many as join its components."""
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        size = np.array([len(s) for s in sets], np.int64)
        rep, comp = pdf["rep"].to_numpy(), pdf["comp"].to_numpy()
        row = np.repeat(np.arange(len(sets), dtype=np.int64), size)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        shared = count[column] > 1  # a shingle of one set alone is in no intersection
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        step = 2048
        for c in range(0, int(column.max(initial=-1)) + 1, step):
            a, b = np.searchsorted(column, [c, c + step])
            holds = np.zeros((len(sets), step), np.float32)
            holds[row[a:b], column[a:b] - c] = 1
            both += holds @ holds.T
        parent = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for x in range(len(sets) - 1):
            inter = both[x, x + 1 :].astype(np.int64)
            at = np.flatnonzero((hi * inter >= lo * (size[x] + size[x + 1 :] - inter)) & (inter > 0)) + x + 1
            for y in at.tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((int(rep[x]), int(rep[y])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (rep) with comp, their component so far."""
    return common.salted_lookup(rows, "rep", F.lit(0), found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))).withColumn("comp", F.coalesce("comp", "rep"))


def linked(docs: DataFrame, sketch: DataFrame, classes: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) between class representatives, enough to join what is connected."""
    lo, hi = least
    reps = sketch.join(classes.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi")
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), "n")
    shared = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    shared, _ = common.saved(shared.select(F.col("key").alias("shared"), F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    hits, _ = common.saved(rows.join(shared, F.col("key") == F.col("shared")).select("key", "rep", "n", "lead", "lead_n"), "hits")
    fits = (F.col("rep") != F.col("lead")) & (hi * F.least("n", "lead_n") >= lo * F.greatest("n", "lead_n"))
    stars = hits.where(fits).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(stars, docs, sketch, k, least)
    found, _ = common.saved(components(links), "components")
    # buckets in which several components are left; pairs with the first one are done
    placed, _ = common.saved(_component(hits.where("rep <> lead").select("key", "rep", "n"), found), "placed")
    still = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high")
    still, _ = common.saved(still.select(F.col("key").alias("open"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_ROWS)).cast("int").alias("blocks")), "open")
    if still.isEmpty():
        return links
    rows = placed.join(still, F.col("key") == F.col("open")).select("key", "rep", "n", "comp", "blocks")
    regs = sketch.select(F.col("doc_id").alias("rep"), "registers")
    rows = _in_blocks(common.salted_lookup(rows, "rep", F.xxhash64("key"), regs, "inner"), "key", "blocks")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    common.text_batches(docs.sparkSession, 4 * BLOCK_ROWS)
    judged, _ = common.saved(rows.mapInArrow(common.lean(_sparse_or_dense(least)), "a long, b long, kind int"), "judged")
    few = judged.where("kind = 0").select("a", "b").distinct()
    links = links.unionByName(confirmed(few, docs, sketch, k, least))
    ties = judged.where("kind = 1").select("a", "b").distinct()
    if ties.isEmpty():
        return links
    found, _ = common.saved(components(links), "components")
    family, _ = common.saved(components(ties).select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    sets = _sets(docs, family.select(F.col("rep").alias("id")), k).select(F.col("doc_id").alias("rep"), "set")
    sets, _ = common.saved(_component(sets.join(family, "rep"), found), "family-sets")
    size = sets.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 2 / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    size, _ = common.saved(size.select(F.col("family").alias("of"), "blocks"), "family-sizes")
    rows = _in_blocks(sets.join(size, F.col("family") == F.col("of")), "family", "blocks")
    more, _ = common.saved(rows.groupBy("family", "i", "j").applyInPandas(_family_links(least), "a long, b long"), "family-links")
    return links.unionByName(more)


def clustered(documents: DataFrame, k: int = SHINGLE_WORDS, least: tuple[int, int] = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = _texts(documents, doc_id, text)
    sketch, _ = common.saved(sketches(docs, k), "sketches")
    known = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes, _ = common.saved(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = linked(docs.where("doc_id IS NOT NULL"), known, classes, k, least)
    member = common.salted_lookup(known.select("doc_id", "fp"), "fp", F.xxhash64("doc_id"), classes)
    ties = links.unionByName(member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found, _ = common.saved(components(ties), "components")
    out = common.salted_lookup(sketch.select("doc_id", "n"), "doc_id", F.lit(0), found.select(F.col("node").alias("doc_id"), "component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(documents: DataFrame, k: int = SHINGLE_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """`documents` with one document of each component, the one of the smallest id."""
    gone = clustered(documents, k, least).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone, _ = common.saved(gone, "near-duplicates")
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__gone"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, u.i, u.i + 2) AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
