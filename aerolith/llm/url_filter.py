"""URL rules whose decisions reach a page's aliases.

A page is one with the targets of its canonical link and of its immediate refresh. With
`forms`, it is also one with pages whose urls differ only in scheme, tracking parameters or
a last slash, which no link says: off by default. Connected components over those edges are the classes of aliases. A url that a rule fits
has that rule's verdict. Any other takes its class's: allow if a url of the class is
explicitly allowed, else block if one is blocked, else allow.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule,
has no aliases and is allowed; a null html has no links; a rule of no path fits every path;
of rules equally long the first given wins; repeated rows give a row each; ids of any type
come out as they are; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: (action, rule): the rule's host is what comes before its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Up to so many rules are one expression; more are a table that is joined.
INLINE_RULES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parts(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def judged(urls: DataFrame, rules=RULES) -> DataFrame:
    """`urls` (with host and path) and the rule and action that fit, or null."""
    if len(rules) <= INLINE_RULES:
        rule = action = None
        for act, text in sorted(rules, key=lambda r: -len(r[1])):
            h, p = _parts(text)
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
            action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
        null = F.lit(None).cast("string")
        return urls.withColumns({"rule": null if rule is None else rule, "action": null if action is None else action})
    spark = urls.sparkSession
    table = spark.createDataFrame([(*_parts(r), r, a, -i) for i, (a, r) in enumerate(rules)], "r_host string, r_path string, rule string, action string, turn int")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host", "path").distinct()
    fit = hosts.withColumn("r_host", F.explode(suffixes)).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "turn", "rule", "action")).alias("best"))
    best = best.select("host", "path", "best.rule", "best.action")
    return urls.join(best, ["host", "path"], "left")


def node_of(url: Column, forms: bool = False) -> Column:
    """A url with scheme and host in lower case and no fragment; with `forms` also without
    scheme, tracking parameters and last slash. Null for no url."""
    if not forms:
        begin = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
        rest = F.regexp_replace(F.substring(url, F.length(begin) + 1, F.length(url)), r"(?s)#.*$", "")
        return F.when(F.contains(url, F.lit("://")) & (host_of(url) != ""), F.concat(F.translate(begin, _UPPER, _LOWER), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1), _UPPER, _LOWER)
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    query = F.array_join(F.filter(F.split(F.regexp_extract(tail, r"(?s)\?(.*)$", 1), "&"), lambda q: ~q.rlike(r"^utm_") & (q != "")), "&")
    path = F.regexp_replace(F.regexp_extract(tail, r"(?s)^([^?]*)", 1), r"/+$", "")
    return F.when(F.contains(url, F.lit("://")) & (host != ""), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _targets(html: Column) -> Column:
    """Addresses of canonical links and refreshes, as they stand in the page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINK), F.lit(0))
    address = lambda t: F.when(t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(t.rlike(r"(?is)^<meta\b.*http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise("")
    return F.filter(F.transform(tags, address), lambda a: a != "")


def _absolute(target: Column, url: Column) -> Column:
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    base = F.concat(scheme, F.lit("://"))
    return F.when(F.contains(target, F.lit("://")), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(base, host, target)).otherwise(F.concat(base, host, F.when(folder == "", "/").otherwise(folder), target))


def links(pages: DataFrame, url: str = "url", html: str = "html", forms: bool = False) -> DataFrame:
    """Edges (a, b) between normalised urls, with each end's url."""
    own = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.contains("url", F.lit("://")))
    own = own.withColumn("target", F.explode(_targets(F.col("html")))).select("url", _absolute(F.col("target"), F.col("url")).alias("target"))
    return own.select("url", "target", node_of(F.col("url"), forms).alias("a"), node_of(F.col("target"), forms).alias("b"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", forms: bool = False) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; `redirects` (source,
    target urls) adds edges to those in the pages."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    seen, _ = common.saved(links(p, forms=forms), "links")
    if redirects is not None:
        more = redirects.select(F.col("source").alias("url"), "target", node_of(F.col("source"), forms).alias("a"), node_of(F.col("target"), forms).alias("b"))
        seen = seen.unionByName(more)
    member = components(seen.select("a", "b"))
    p = p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url"), forms).alias("node"))
    p = judged(p, rules)
    # what rules say of every url that is known, as a page or as an end of an edge
    ends = seen.select(F.col("url"), F.col("a").alias("node")).unionByName(seen.select(F.col("target").alias("url"), F.col("b").alias("node")))
    ends = judged(ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    said = p.select("node", "action").unionByName(ends.select("node", "action")).where("action IS NOT NULL AND node IS NOT NULL").distinct()
    said = said.join(member, "node", "left").select(F.coalesce("component", "node").alias("component"), "action")
    # a written table of classes with a verdict; min("allow", "block") is allow
    verdicts, _ = common.saved(said.groupBy("component").agg(F.min("action").alias("inherited")), "verdicts")
    unruled = p.where("rule IS NULL")
    place = F.coalesce(F.xxhash64("page_id"), F.lit(0))
    unruled = common.salted_lookup(unruled, "node", place, member)
    unruled = unruled.withColumn("component", F.coalesce("component", "node"))
    unruled = common.salted_lookup(unruled, "component", place, verdicts)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return p.where("rule IS NOT NULL").withColumn("verdict", F.col("action")).select(*columns).unionByName(unruled.withColumn("verdict", F.coalesce("inherited", F.lit("allow"))).select(*columns))


#: The pages of the test tables hold no link that crosses classes of urls, so the rules alone decide there.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) AS t(action, h, d, rule)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)
"""
