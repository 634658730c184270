"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules come from each whole text. Lines are normalised (lower case, white space
collapsed and trimmed) and hashed; a line found in more than `max_docs` distinct documents
of one host is boilerplate there and goes. A document that passes the base rules is
rejected as depleted when boilerplate holds more than `max_share` percent of its word
characters. Rows of one id are one document; lines are cut and hashed once, into a written
table without texts that both steps read.

Defined cases: a null or blank text has no words and fails the base rules; a null host is
a host of its own; rows with a null id are one document where host and text are equal;
repeated rows give a row each, with equal results; only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more documents of a host than this is boilerplate.
MAX_DOCS = 10
#: A document with more of its word characters in boilerplate than this is depleted.
MAX_SHARE_PERCENT = 50


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(s: Column) -> Column:
    """Words in the windows of `s`, (hash, place) sorted, whose hash a neighbour shares."""
    same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    places = F.transform(twice, lambda k: F.get(s, k)["i"])
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def _source(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def base(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, row_hash and the base counts of each row."""
    n = F.size("w")
    d = _source(documents, doc_id, text, host).withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != ""))
    d = d.withColumn("h", F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    numbered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    n_repeat = F.when((n < 4) | (F.size(F.array_distinct("h")) == F.size("h")), F.lit(0)).otherwise(_let(numbered, _marked))
    # a text without a line feed has no earlier line
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n_dup = F.when(F.contains("text", F.lit("\n")), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    return d.select(
        "doc_id",
        F.xxhash64("host", "text").alias("row_hash"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
    )


def line_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row per line with a word: doc_id, row_hash, place, host, line_hash, word characters."""
    d = _source(documents, doc_id, text, host).select("doc_id", "host", F.xxhash64("host", "text").alias("row_hash"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    d = d.withColumn("line", F.trim(F.regexp_replace("line", SPACE, " "))).where(F.col("line") != "")
    return d.select("doc_id", "row_hash", "place", "host", F.xxhash64(F.lower("line")).alias("line_hash"), F.length(F.replace("line", F.lit(" "), F.lit(""))).alias("chars"))


def boilerplate(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines of a host in more than `max_docs` of its distinct documents. The first step
    counts by host, line and document, so a line that fills a host is spread before it is
    summed."""
    unknown = F.when(F.col("doc_id").isNull(), F.col("row_hash")).alias("unknown")
    once = lines.groupBy("host", "line_hash", "doc_id", unknown).agg(F.lit(1).alias("one"))
    return once.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, max_docs: int = MAX_DOCS, max_share: int = MAX_SHARE_PERCENT) -> DataFrame:
    """Base counts, boilerplate characters and the verdict of every row."""
    lines, _ = common.saved(line_rows(documents, doc_id, text, host), "lines")
    frequent, _ = common.saved(boilerplate(lines, max_docs).select(F.col("host").alias("b_host"), F.col("line_hash").alias("b_hash")), "boilerplate")
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("line_hash") == F.col("b_hash")), "left_semi")
    once = hit.groupBy("doc_id", "row_hash", "place").agg(F.max("chars").alias("chars"))
    lost = once.groupBy(F.col("doc_id").alias("l_id"), F.col("row_hash").alias("l_hash")).agg(F.sum("chars").alias("boilerplate_chars"), F.count("*").alias("n_boilerplate_lines"))
    counted = base(documents, doc_id, text, host)
    out = counted.join(lost, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("row_hash") == F.col("l_hash")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    chars = F.coalesce("boilerplate_chars", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * chars <= max_share * F.col("word_chars"))).alias("kept"),
        F.coalesce("n_boilerplate_lines", F.lit(0)).cast("long").alias("n_boilerplate_lines"),
        chars.cast("long").alias("boilerplate_chars"),
    )


def kept_text(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, row_hash and the text without its host's boilerplate lines, of each row that
    has any. A document's own lines are gathered, never those of a host."""
    lines, _ = common.saved(line_rows(documents, doc_id, text, host), "lines")
    frequent, _ = common.saved(boilerplate(lines, max_docs).select(F.col("host").alias("b_host"), F.col("line_hash").alias("b_hash")), "boilerplate")
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("line_hash") == F.col("b_hash")), "left_semi")
    places = hit.groupBy(F.col("doc_id").alias("l_id"), F.col("row_hash").alias("l_hash")).agg(F.collect_set("place").alias("gone"))
    d = _source(documents, doc_id, text, host).withColumn("row_hash", F.xxhash64("host", "text"))
    d = d.join(places, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("row_hash") == F.col("l_hash")))
    return d.select("doc_id", "row_hash", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n").alias("text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, u.i AS i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
n AS (SELECT doc_id, host, trim(regexp_replace(u.x, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM w, unnest(l) AS u(x)),
f AS (SELECT host, lower(line) AS line FROM n GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
b AS (SELECT doc_id, sum(length(replace(n.line, ' ', ''))) AS c, count(*) AS k FROM n JOIN f ON n.host IS NOT DISTINCT FROM f.host AND lower(n.line) = f.line GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w || [''], 'string_agg', ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        coalesce(b.k, 0)::BIGINT AS n_boilerplate_lines, coalesce(b.c, 0)::BIGINT AS boilerplate_chars
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * boilerplate_chars <= 50 * word_chars AS kept, n_boilerplate_lines, boilerplate_chars FROM e
"""
