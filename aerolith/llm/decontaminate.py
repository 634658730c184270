"""Benchmark decontamination with an FM-index per training shard.

A shard is some megabytes of consecutive documents of one partition. Its words become
symbols of the phrases' alphabet; words outside it end a run, as no phrase can hold them,
and runs shorter than the shortest phrase are left out. All phrases are searched backwards
at once through wavelet-matrix ranks, their places read from sampled suffix positions, and
overlapping places merged into removal spans. Documents are never shuffled.

Defined cases: a null or word-less text has no words, no hits and stays; null or word-less
items hold no phrase; items with a null id are removed from texts but not listed; rows of
one item id count as one item; repeated document rows give a row each; document ids are
integers; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Phrases are sent to the executors in groups of at most so many bytes of item text, which
#: make tables of some 300 MB. The result does not depend on it.
GROUP_BYTES = 32 << 20

SCHEMA = "doc_id long, row_hash long, n_words long, hits array<struct<start:int,end:int>>, items array<string>"


class Phrases:
    """The windows of a bounded group of items: an alphabet and rows of symbols."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        data, begins = words.joined(texts)
        start, end = words.spans(data, words.ALNUM)
        raw = words.LOWER[data].tobytes()
        hashed = words.hashes(data, start, end)
        self.alphabet, first, symbol = np.unique(hashed, return_index=True, return_inverse=True)
        self.words = [raw[start[i] : end[i]] for i in first]
        self.ids = sorted({str(x) for x in ids if x is not None})
        self._windows(symbol.astype(np.int32) + 1, np.searchsorted(start, begins), ids, window)
        self.shortest = int(self.lengths.min(initial=window))

    def _windows(self, symbol: np.ndarray, bounds: np.ndarray, ids: list, window: int) -> None:
        """Distinct windows as rows of symbols, with the places in `ids` of their items."""
        n = np.diff(bounds)
        many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        item = np.repeat(np.arange(len(n)), many)
        begin = bounds[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(window, n[item])

        def column(of: np.ndarray, k: int) -> np.ndarray:
            return np.where(length[of] > k, symbol[np.minimum(begin[of] + k, len(symbol) - 1)], 0) if len(of) else np.zeros(0, np.int32)

        every = np.arange(len(item))
        hashed = np.zeros(len(item), np.uint64)
        for k in range(window):
            hashed = words.mixed(hashed + column(every, k).astype(np.uint64))
        order = np.argsort(hashed, kind="stable")
        # equal windows are neighbours now; a hash alone makes none equal
        new = np.append(True, hashed[order[1:]] != hashed[order[:-1]])[: len(order)]
        for k in range(window):
            c = column(order, k)
            new[1:] |= c[1:] != c[:-1]
        first = order[new]
        self.lengths = length[first]
        self.rows = np.stack([column(first, k) for k in range(window)], 1)
        at = {x: i for i, x in enumerate(self.ids)}
        owner = np.array([at[str(x)] if x is not None else -1 for x in ids], np.int64)[item[order]]
        pairs = np.unique(np.stack([np.cumsum(new) - 1, owner])[:, owner >= 0], axis=1)
        self._owner = pairs[1].astype(np.int32)
        self._owner_begin = np.searchsorted(pairs[0], np.arange(len(first) + 1))

    def owners(self, phrase: int) -> list[str]:
        """Ids of the items that hold a phrase."""
        return [self.ids[i] for i in self._owner[self._owner_begin[phrase] : self._owner_begin[phrase + 1]].tolist()]

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(hashed), np.int64)
        at = np.searchsorted(self.alphabet, hashed)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == hashed, at + 1, 0)


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Found:
    """One shard's result: words per document, word spans hit and item ids."""

    def __init__(self, texts: list[str | None], phrases: Phrases):
        self.data, begins = words.joined(texts)
        self.start, self.end = words.spans(self.data, words.ALNUM)
        self.begins = begins
        self.first = np.searchsorted(self.start, begins)
        self.hits: dict[int, list[tuple[int, int]]] = {}
        self.items: dict[int, set[str]] = {}
        if not len(phrases.rows) or not len(self.start):
            return
        symbol = phrases.symbols(words.hashes(self.data, self.start, self.end))
        edge = np.zeros(len(symbol) + 1, bool)
        edge[self.first] = True
        known = symbol > 0
        begin = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
        stop = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
        long = stop - begin >= phrases.shortest
        begin, size = begin[long], (stop - begin)[long]
        if not len(begin):
            return
        # each run, then one separator; `word` gives the shard's word of each place
        offset = np.append(0, np.cumsum(size + 1))
        word = np.arange(offset[-1]) - np.repeat(offset[:-1] - begin, size + 1)
        text = np.where(np.isin(np.arange(offset[-1]), offset[1:] - 1), 0, symbol[np.minimum(word, len(symbol) - 1)])
        index = FMIndex(text, len(phrases.alphabet))
        low, high = index.search(phrases.rows, phrases.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        lo = word[index.locate(rows)]
        hi = lo + phrases.lengths[phrase]
        raw = words.LOWER[self.data].tobytes()
        doc = np.searchsorted(self.first, lo, "right") - 1
        for d, p, a, b in zip(doc.tolist(), phrase.tolist(), lo.tolist(), hi.tolist(), strict=True):
            # exact check: a hash is not a word
            if all(raw[self.start[w] : self.end[w]] == phrases.words[text_symbol - 1] for w, text_symbol in zip(range(a, b), phrases.rows[p].tolist(), strict=False)):
                self.hits.setdefault(d, []).append((a, b))
                self.items.setdefault(d, set()).update(phrases.owners(p))

    def spans(self, d: int) -> list[tuple[int, int]]:
        """Merged word spans of a document, counted from its first word."""
        own = self.hits.get(d, [])
        return [(a - int(self.first[d]), b - int(self.first[d])) for a, b in _merged(np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64))]


def phrase_groups(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text", limit: int = GROUP_BYTES) -> Iterator[Phrases]:
    """The benchmark in groups small enough to send: one, unless it is larger than `limit`."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = -(-size // limit) or 1
    for g in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g)
        got = own.toArrow()
        yield Phrases(got["id"].to_pylist(), got["text"].to_pylist(), window)


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", limit: int = GROUP_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, merged word spans hit, sorted item ids. A benchmark
    above `limit` bytes is searched group by group and the spans are united per row."""
    spark = documents.sparkSession
    common.text_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).alias("text"))

    def searched(phrases: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches):
            for shard in common.rows_of(batches, SHARD_BYTES):
                found = Found(_column(shard, "text"), sent.value)
                count = np.diff(found.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        shard["doc_id"].combine_chunks(),
                        shard["row_hash"].combine_chunks(),
                        pa.array(count, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in found.spans(d)] for d in range(len(count))], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(found.items.get(d, ())) for d in range(len(count))], pa.list_(pa.string())),
                    ],
                    ["doc_id", "row_hash", "n_words", "hits", "items"],
                )

        return docs.mapInArrow(common.lean(run), SCHEMA)

    groups = [searched(p) for p in phrase_groups(benchmark, window, limit=limit)]
    if len(groups) == 1:
        return groups[0]
    all_rows = groups[0].withColumn("g", F.lit(0))
    for i, g in enumerate(groups[1:], 1):
        all_rows = all_rows.unionByName(g.withColumn("g", F.lit(i)))
    return united(all_rows)


def united(rows: DataFrame) -> DataFrame:
    """Rows of several groups of phrases, `g`, united per document id and text; a row that is
    repeated comes out as often as it was in group 0."""
    spans = F.array_sort(F.flatten(F.collect_list(F.when(F.size("hits") > 0, F.col("hits")))))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    own = rows.groupBy("doc_id", "row_hash", "n_words").agg(merged.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count(F.when(F.col("g") == 0, 1)).alias("n"))
    return own.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "row_hash", "n_words", "hits", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """`raw` without spans of its words, which stand at [start, end)."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : start[a]])
        at = int(end[b - 1])
    return b"".join([*parts, raw[at:]])


def cleaned_text(texts: list[str | None], phrases: Phrases) -> list[str | None]:
    """Texts without their hit spans, searched again until nothing is hit: what a removal
    brings together may hold a phrase too. Untouched texts come back as they are."""
    out = list(texts)
    todo = list(range(len(out)))
    while todo:
        found = Found([out[i] for i in todo], phrases)
        again = []
        for d in sorted(found.hits):
            base, of = int(found.begins[d]), slice(int(found.first[d]), int(found.first[d + 1]))
            raw = found.data[base : found.begins[d + 1] - 1].tobytes()
            out[todo[d]] = _cut(raw, found.start[of] - base, found.end[of] - base, found.spans(d)).decode()
            again.append(todo[d])
        todo = again
    return out


def _with_texts(shard: pa.Table, new: list[str | None], text: str) -> pa.Table:
    """`shard` with changed texts, n_chars counted anew, without texts that lost all words."""
    old = _column(shard, text)
    changed = [a != b for a, b in zip(old, new, strict=True)]
    if not any(changed):
        return shard
    keep = pa.array([not c or bool(words.spans(np.frombuffer(b.encode(), np.uint8), words.ALNUM)[0].size) for c, b in zip(changed, new, strict=True)])
    at = shard.schema.get_field_index(text)
    shard = shard.set_column(at, shard.schema.field(at), pa.array(new, shard.schema.field(at).type))
    if "n_chars" in shard.schema.names:
        at = shard.schema.get_field_index("n_chars")
        old_n = _column(shard, "n_chars")
        shard = shard.set_column(at, shard.schema.field(at), pa.array([len(b) if c else n for c, b, n in zip(changed, new, old_n, strict=True)], shard.schema.field(at).type))
    return shard.filter(keep)


def _cleaned_once(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """`documents` without the word spans of `hits`, which has a row per id and text."""
    own = F.struct(F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.col("text")).alias("h"))
    joined = documents.withColumn("__of", own).join(hits, F.col("__of").eqNullSafe(F.col("__key")), "left").drop("__of", "__key")

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            spans = _column(shard, "__hits")
            shard = shard.drop_columns(["__hits"])
            new = _column(shard, "text")
            for i, own_spans in enumerate(spans):
                if own_spans:
                    data = np.frombuffer(new[i].encode(), np.uint8)
                    new[i] = _cut(data.tobytes(), *words.spans(data, words.ALNUM), [(x["start"], x["end"]) for x in own_spans]).decode()
            yield from _with_texts(shard, new, "text").combine_chunks().to_batches()

    return joined.select(*documents.columns, "__hits").mapInArrow(common.lean(run), documents.schema)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = GROUP_BYTES) -> DataFrame:
    """`documents` without benchmark passages, n_chars counted anew; a document of which no
    word is left goes. All passages found in a text are cut at once, and what is left is
    searched again until nothing is found: what a cut brings together may be a passage too.
    A benchmark above `limit` bytes is searched group by group, with the same result.

    Reads doc_id (integers), text and, where it is there, n_chars; other columns and all
    other rows stay as they are. No column may be named __of, __key or __hits. Null and
    word-less texts stay; equal rows fare alike; an empty benchmark changes nothing."""
    spark = documents.sparkSession
    common.text_batches(spark)
    groups = list(phrase_groups(benchmark, window, limit=limit))
    if len(groups) > 1:
        out = documents
        while True:
            found = find(out, benchmark, window, limit=limit).where(F.size("hits") > 0)
            key = F.struct(F.col("doc_id").alias("i"), F.col("row_hash").alias("h")).alias("__key")
            hits, _ = common.saved(found.select(key, F.col("hits").alias("__hits")).dropDuplicates(["__key"]), "hits")
            if hits.isEmpty():
                return out
            out, _ = common.saved(_cleaned_once(out, hits), "cleaned")
    sent = spark.sparkContext.broadcast(groups[0])

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            yield from _with_texts(shard, cleaned_text(_column(shard, "text"), sent.value), "text").combine_chunks().to_batches()

    return documents.mapInArrow(common.lean(run), documents.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, u.i, u.i + least(10, len(w)) - 1) AS g FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS u(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, u.i AS i, l.n AS n, list_slice(w, u.i, u.i + l.n - 1) AS g FROM d, l, unnest(range(1, len(w) - l.n + 2)) AS u(i)),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
