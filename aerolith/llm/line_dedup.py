"""Substring deduplication by hashes of sentences, lines or paragraphs over all documents.

A unit is a sentence (a line is cut at sentence ends; kind "sentence"), a whole line, or a
paragraph. A sentence of fewer than `COUNTED` words belongs to the unit before it. A unit of
more than `WHOLE` words is cut again behind a word where the hash of it and the next is the
least within `RADIUS` places, if that leaves `COUNTED` words on both sides, so that a passage
inside longer text is cut alike wherever it stands. Units are normalised (A-Z lower-cased,
white space collapsed) and hashed to 128 bits. Of equal units over the whole table the
earliest, by document id and place, stays; the others are repeats. A run of neighbouring
repeats is removed when it holds `min_words` words: short lines and chance phrases alone
stay. The places of removed runs are those of the original text.

Digests are grouped with map-side minima; only units whose digest occurs twice travel
further, by a join on written tables, which the adaptive planner splits where one digest
holds a large part of all units.

Defined cases: null and blank texts and those of fewer than `COUNTED` words have no units and
stay as they are; a null doc_id ranks before all others; rows equal in id and text are one
document and all keep or lose the same units; rows of one id, null included, and different text do not rank at equal places; a
document of nothing but repeats keeps its row, with no text left; ids are integers; extra
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 20
COUNTED = 5
WHOLE = 15
RADIUS = 5
UNITS = "doc_id long, row_hash long, place int, start int, end int, words int, digest binary"
_PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*")
_LINE = re.compile(r"[^\n]+")
_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
#: A word that ends a sentence, and the last characters that such a word can have.
_ENDS = re.compile(r"[.!?。！？][\"')\]’”»]*\Z")
_LAST = frozenset(".!?。！？\"')]’”»")
_CACHED_WORDS = 1 << 18
_hashed: dict[str, int] = {}


def _word_hash(word: str) -> int:
    if len(_hashed) >= _CACHED_WORDS:
        _hashed.clear()
    found = _hashed[word] = int(hashlib.md5(_normal(word)).hexdigest()[:7], 16)
    return found


def _normal(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _cuts(words: list[str]) -> list[int]:
    """Places behind which a long unit is cut: strictly below what goes before."""
    known = _hashed.get
    h = [known(w) or _word_hash(w) for w in words]
    pairs = [(a * 1000003 + b) % 1073741789 for a, b in zip(h, h[1:], strict=False)]
    least = []
    for i in range(COUNTED - 1, len(words) - COUNTED):
        p = pairs[i]
        if pairs[i - 1] > p <= pairs[i + 1] and p <= min(pairs[i + 1 : i + RADIUS + 1]) and p < min(pairs[max(0, i - RADIUS) : i]):
            least.append(i + 1)
    return least


def _sentences(text: str):
    """(words, start, end) of each unit of a text."""
    tokens = _TOKEN.findall(text.rstrip(_SPACES))
    ends = list(accumulate(map(len, tokens)))
    words = [t.lstrip(_SPACES) for t in tokens]
    n = len(words)
    breaks = [i for i, t in enumerate(tokens) if "\n" in t]
    breaks += [i for i, w in enumerate(words, 1) if w[-1] in _LAST and _ENDS.search(w)]
    heads = sorted({0, n, *breaks})
    starts = [0, *(a for a, b in zip(heads[1:], heads[2:], strict=False) if b - a >= COUNTED), n]
    for a, b in zip(starts, starts[1:], strict=False):
        cuts = [a + c for c in _cuts(words[a:b])] if b - a > WHOLE else []
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            if x < y:
                yield words[x:y], ends[x] - len(words[x]), ends[y - 1]


def _whole(text: str, pattern: re.Pattern):
    for m in pattern.finditer(text):
        found = list(_WORD.finditer(text, m.start(), m.end()))
        if found:
            yield [x.group() for x in found], found[0].start(), found[-1].end()


def units_of(text: str | None, kind: str = "sentence"):
    """(place, start, end, words, digest) of the units of a text, offsets in code points."""
    found = _sentences(text or "") if kind == "sentence" else _whole(text or "", {"line": _LINE, "paragraph": _PARAGRAPH}[kind])
    for place, (words, start, end) in enumerate(found):
        if len(words) >= COUNTED:
            yield place, start, end, len(words), hashlib.blake2b(_normal(" ".join(words)), digest_size=16).digest()


def units(documents: DataFrame, kind: str = "sentence", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    common.text_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).alias("text"))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "row_hash", "place", "start", "end", "words", "digest"]

    def run(batches):
        for b in batches:
            rows = [(k, h, *u) for k, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for u in units_of(t, kind)]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.mapInArrow(common.lean(run), UNITS)


def removals(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """l_id, l_hash, removed (start, end), of rows that lose a run of units."""
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "start")
    twice = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    twice, _ = common.saved(twice.select(F.col("digest").alias("again"), "first"), "repeated")
    lost = found.join(twice, F.col("digest") == F.col("again")).where(~rank.eqNullSafe(F.col("first")))
    own = ["doc_id", "row_hash"]
    once = lost.select(*own, "place", "start", "end", "words").repartition(*own).dropDuplicates([*own, "place"])
    run = F.col("place") - F.row_number().over(Window.partitionBy(*own).orderBy("place"))
    runs = once.withColumn("run", run).groupBy(*own, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words")).where(F.col("words") >= min_words)
    return runs.groupBy(F.col("doc_id").alias("l_id"), F.col("row_hash").alias("l_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))


def cut(text: Column, removed: Column) -> Column:
    """`text` without the spans (start, end), nor the space after each, nor the line feed
    after one that begins its line."""
    begins = F.concat(F.transform(removed, lambda x: x["start"]), F.array(F.length(text)))

    def resume(x: Column) -> Column:
        after = F.substring(text, x["end"] + 1, F.lit(1))
        whole = (x["start"] == 0) | (F.substring(text, x["start"], F.lit(1)) == "\n")
        return x["end"] + F.when((after == " ") | ((after == "\n") & whole), 1).otherwise(0)

    resumes = F.concat(F.array(F.lit(0)), F.transform(removed, resume))
    return F.array_join(F.zip_with(resumes, begins, lambda a, b: F.substring(text, a + 1, b - a)), "")


def dedup(documents: DataFrame, min_words: int = MIN_WORDS, kind: str = "sentence", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_removed runs, removed spans of the original text, and the text that is left."""
    found, path = common.saved(units(documents, kind, doc_id, text), "units")
    gone, _ = common.saved(removals(found, min_words), "removals")
    common.drop(documents.sparkSession, path)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row_hash"), F.col(text).alias("text"))
    # texts are never sorted and their removals never broadcast, at any size
    joined = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("row_hash") == F.col("l_hash")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"), F.when(F.size("removed") > 0, cut(F.col("text"), F.col("removed"))).otherwise(F.col("text")).alias("text"))


def digest(deduped: DataFrame) -> DataFrame:
    """`dedup` with its spans as text: start-end, comma-joined."""
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return deduped.select("doc_id", "n_removed", spans.alias("removed"), "text")


ORACLE_SQL = r"""
WITH k AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS toks FROM documents),
t AS (SELECT doc_id, u.i AS i, toks[u.i] AS tok FROM k, unnest(range(1, len(toks) + 1)) AS u(i)),
w AS (SELECT doc_id, i, trim(tok, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS word, contains(tok, chr(10)) AS line, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM t),
a AS (SELECT *, e - length(word) AS s, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             line OR coalesce(lag(regexp_matches(word, '[.!?。！？]["'')\]’”»]*$')) OVER (PARTITION BY doc_id ORDER BY i), true) AS fresh FROM w),
b AS (SELECT *, ('0x' || substr(md5(low), 1, 7))::BIGINT AS h, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS sent FROM a),
c AS (SELECT *, i = 1 OR (fresh AND count(*) OVER (PARTITION BY doc_id, sent) >= 5) AS head FROM b),
h AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY i) AS j, count(*) OVER (PARTITION BY doc_id, unit) AS size, (h * 1000003 + lead(h) OVER (PARTITION BY doc_id, unit ORDER BY i)) % 1073741789 AS p FROM h),
d AS (SELECT *, size > 15 AND j >= 5 AND size - j >= 5 AND p < min(p) OVER (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
                AND p <= min(p) OVER (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS least FROM l),
f AS (SELECT *, count(*) FILTER (head OR prev) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (SELECT *, coalesce(lag(least) OVER (PARTITION BY doc_id ORDER BY i), false) AS prev FROM d)),
g AS (SELECT doc_id, place, min(s) AS s, max(e) AS e, count(*) AS n, string_agg(low, ' ' ORDER BY i) AS unit FROM f GROUP BY doc_id, place HAVING count(*) >= 5),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, s) > 1 AS again FROM g) WHERE again),
v AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM r) GROUP BY doc_id, run HAVING sum(n) >= 20),
x AS (SELECT v.doc_id, s, e, e + CASE WHEN substr(text, e + 1, 1) = ' ' OR (substr(text, e + 1, 1) = chr(10) AND (s = 0 OR substr(text, s, 1) = chr(10))) THEN 1 ELSE 0 END AS z FROM v JOIN documents USING (doc_id)
      UNION ALL SELECT doc_id, length(text), NULL, NULL FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, s, e, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY s, e NULLS LAST), 0) AS begin FROM x),
o AS (SELECT y.doc_id, count(e) AS n_removed, string_agg(y.s || '-' || e, ',' ORDER BY y.s, e) FILTER (e IS NOT NULL) AS removed, string_agg(substr(text, begin + 1, y.s - begin), '' ORDER BY y.s, e NULLS LAST) AS text FROM y JOIN documents USING (doc_id) GROUP BY y.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, o.text FROM documents d LEFT JOIN o USING (doc_id)
"""
