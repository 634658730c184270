"""Best-fit packing of tokenised documents with large-item matching.

Only counts by length decide a packing, so the plan is made over a histogram of at most
`capacity` rows: pieces above a third of the capacity are matched greedily, largest with
the largest that still fits, at most two to a sequence; smaller ones then fill the smallest
gap they fit, largest first. The plan maps the rank of a piece among those of its length to
a sequence and a place by arithmetic, so pieces are placed where they lie, in any number of
tasks. Ranks come from counts by (length, salt): a length that holds most pieces is split.

Defined cases: a null text is empty and gives one piece, the end id alone; repeated rows
are packed as often as they occur; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 4096
SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of a document of at most `capacity` ids; with_ids adds them as
    little-endian unsigned 32-bit integers."""
    common.text_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        enc, n = tokens.encoder(tokenizer), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in common.rows_of(batches, tokens.SHARD_BYTES):
            rows = []
            for k, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((k, i, at // 4, len(own) // 4, zlib.crc32(own), n % SALTS, own))
                    n += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()][: 6 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"][: 6 + with_ids]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

    return docs.mapInArrow(common.lean(run), PIECES + ", ids binary" * with_ids)


@dataclass
class Plan:
    """Rows sorted by (length, first rank): pieces from `rank` on, `per` to a sequence,
    from sequence `first` and place `offset` on."""

    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, "right") - 1
        n = rank - self.rank[i]
        return self.first[i] + n // self.per[i], self.offset[i] + n % self.per[i] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Greedy matching of large lengths, then best fit of the others, by counts."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the gaps there are, ascending
    bins = 0

    def take(n: int, items: int, per: int, first: int, offset: int) -> None:
        rows.append((n, used[n], per, first, offset))
        used[n] += items
        left[n] -= items

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    waiting = list(large)
    while waiting:
        n = waiting[-1]
        if not left[n]:
            waiting.pop()
            continue
        i = bisect.bisect_right(waiting, capacity - n) - 1
        while i >= 0 and (not left[waiting[i]] or waiting[i] == n and left[n] < 2):
            if not left[waiting[i]]:
                waiting.pop(i)
            i -= 1
        m = waiting[i] if i >= 0 else None
        if m is None:
            many = left[n]
            take(n, many, 1, bins, 0)
            open_gap(capacity - n, bins, many)
        else:
            many = left[n] // 2 if m == n else min(left[n], left[m])
            take(n, many, 1, bins, 0)
            take(m, many, 1, bins, n)
            open_gap(capacity - n - m, bins, many)
        bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                many = -(-left[n] // (capacity // n))
                open_gap(capacity, bins, many)
                bins += many
                continue
            gap = sizes[i]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[i]
            per = gap // n
            full = min(many, left[n] // per)
            if full:
                take(n, full * per, per, first, capacity - gap)
                open_gap(gap - per * n, first, full)
            first, many = first + full, many - full
            if many and left[n]:
                rest = left[n]
                take(n, rest, per, first, capacity - gap)
                open_gap(gap - rest * n, first, 1)
                first, many = first + 1, many - 1
            open_gap(gap, first, many)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*table, sequences=bins)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`table`, written pieces, with sequence_id and offset."""
    spark = table.sparkSession
    counts = table.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most capacity x SALTS rows, whatever the input
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = counts.select("length", "salt", before.alias("base"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    made = spark.sparkContext.broadcast(plan(dict(zip(lengths["length"].to_pylist(), lengths["n"].to_pylist(), strict=True)), capacity))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = table.withColumn("within", within).join(F.broadcast(based), ["length", "salt"])
    columns = [c for c in table.columns if c != "salt"]
    ranked = ranked.select(*columns, (F.col("base") + F.col("within") - 1).cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = made.value.place(b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()) if b.num_rows else (np.array([], np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name != "salt")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return ranked.mapInArrow(common.lean(run), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, for pieces that carry them: at most `capacity`
    ids come together."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def run(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    table, _ = common.saved(pieces(documents, tokenizer, end_id, capacity), "pieces")
    return pack(table, capacity)
