"""URL filters: dated list entries joined as of each capture's fetch time.

Entries (key, action, listed_on) are events: ``block`` and ``allow`` begin, and
``drop`` ends what an earlier entry of the same key said. Sorted by date, each
entry becomes the validity interval up to its key's next one. A key is a host, which
stands for its subdomains too, or a host and first path segment (``host/segment``);
case counts in the segment only.
A capture is judged by the entry active at its fetch time whose key is the most
specific (most labels; with a segment before without).

Captures meet the list by (host, segment, fetch time): those triples are made
distinct first, so a hot host costs a row per segment and time, not per capture,
and the verdicts come back over the same triples, which spreads a hot host. Suffixes
that no entry names (a bare ``org`` is one of most captures) are dropped by a filter of
fixed size before anything is moved; the rest joins the intervals by key and one of
``SALTS`` shares, so that a listed suffix of many hosts isn't one task's. Nothing else
is broadcast unless its measured size allows it.

Null or unparsable URLs and null fetch times are never blocked, with null host and
entry. Entries with a null key or date are ignored; of entries with the same key
and date the last in (action, entry_id) order counts. Repeated captures are judged
alike. Empty tables work on either side. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.rows import may_have
from causeway.shared import cut

#: Fixed values of the query: it has no list and no fetch times of its own, so both follow from the pages.
FIRST_DAY, DAYS = "2024-01-01", 360
#: Shares that the captures of one key are dealt to.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null where there is none."""
    raw = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(raw, "^.*@", ""), "\\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """First path segment, or an empty string."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def key_of(key: Column) -> Column:
    """An entry's key with its host in lower case; a path segment keeps its case, as a capture's does."""
    host = F.substring_index(key, "/", 1)
    return F.concat(F.lower(host), F.substring(key, F.length(host) + 1, F.length(key)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, entry_id, action, since, until); entries of one key are bounded by how often it was listed."""
    rows = entries.where("key IS NOT NULL AND listed_on IS NOT NULL").groupBy(key_of(F.col("key")).alias("key"), "listed_on").agg(F.max(F.struct("action", "entry_id")).alias("e"))
    until = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    return rows.select("key", "e.entry_id", "e.action", F.col("listed_on").alias("since"), until.alias("until")).where("action <> 'drop'")


def keys_of(host: Column, segment: Column) -> Column:
    """(key, rank) pairs that may judge a capture: every suffix of its host, with its segment and without."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (2 * (F.size(labels) - i)).alias("rank")))
    narrow = F.transform(suffixes, lambda s: F.struct(F.concat(s["key"], F.lit("/"), segment).alias("key"), (s["rank"] + 1).alias("rank")))
    return F.when(segment == "", suffixes).otherwise(F.concat(suffixes, narrow))


def judge(captures: DataFrame, entries: DataFrame, url="url", fetched="fetched", page_id="page_id") -> DataFrame:
    """(page_id, host, fetched, entry_id, entry_key, since, blocked) of every capture."""
    rows = captures.select(F.col(page_id).alias("page_id"), F.col(fetched).alias("fetched"), host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("segment"))
    asked = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "segment", "fetched").distinct()
    keyed = asked.select("*", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("k")).select("host", "segment", "fetched", "k.key", "k.rank")
    spans = cut(intervals(entries))
    keyed = may_have(keyed.withColumn("code", F.xxhash64("key")), "code", spans.select(F.xxhash64("key").alias("code")).distinct())[0].drop("code")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("host", "segment", "fetched"), F.lit(SALTS)).cast("int"))
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = keyed.join(spans, ["key", "salt"]).where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    verdict = active.groupBy("host", "segment", "fetched").agg(F.max_by(F.struct("entry_id", "key", "since", "action"), "rank").alias("v"))
    out = rows.join(verdict, ["host", "segment", "fetched"], "left")
    return out.select("page_id", "host", "fetched", F.col("v.entry_id").alias("entry_id"), F.col("v.key").alias("entry_key"), F.col("v.since").alias("since"), F.coalesce(F.col("v.action") == "block", F.lit(False)).alias("blocked"))


def code(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def derived_entries(pages: DataFrame) -> DataFrame:
    """The query's list: hosts, their parents and host/segment keys, dated by a hash of the key."""
    rows = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).where("host IS NOT NULL").distinct()
    parent = F.regexp_extract("host", "^[^.]*\\.(.*\\..*\\..*)$", 1)
    keys = rows.select(F.explode(F.array("host", parent, F.when(F.col("segment") != "", F.concat("host", F.lit("/"), "segment")))).alias("key")).where("key <> ''").distinct()
    keys = keys.withColumn("c", code(F.col("key")))
    day = lambda n: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")), "yyyy-MM-dd")
    plan = F.array(
        F.when(F.col("c") % 3 == 0, F.struct(F.lit("block").alias("action"), (F.col("c") % 200).alias("n"))),
        F.when(F.col("c") % 6 == 0, F.struct(F.lit("drop").alias("action"), (F.col("c") % 200 + 30 + F.col("c") % 50).alias("n"))),
        F.when(F.col("c") % 12 == 0, F.struct(F.lit("block").alias("action"), (F.col("c") % 200 + 120).alias("n"))),
        F.when(F.col("c") % 5 == 1, F.struct(F.lit("allow").alias("action"), (F.col("c") % 150 + 60).alias("n"))),
    )
    rows = keys.select("key", F.explode(plan).alias("e")).where("e IS NOT NULL")
    return rows.select("key", "e.action", day(F.col("e.n")).alias("listed_on"), F.concat_ws("@", "key", day(F.col("e.n"))).alias("entry_id"))


def capture_day(page_id: Column) -> Column:
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(page_id * 7, F.lit(DAYS)).cast("int")), "yyyy-MM-dd")


def oracle() -> str:
    host = r"regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')"
    segment = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)"
    day = lambda n: f"strftime(DATE '{FIRST_DAY}' + CAST({n} AS INTEGER), '%Y-%m-%d')"
    return rf"""
WITH p AS (SELECT page_id, NULLIF(lower({host}), '') AS host, {segment} AS segment, {day(f"(page_id * 7) % {DAYS}")} AS fetched FROM pages),
k AS (SELECT DISTINCT key FROM (SELECT host AS key FROM p UNION ALL SELECT regexp_extract(host, '^[^.]*\.(.*\..*\..*)$', 1) FROM p
  UNION ALL SELECT host || '/' || segment FROM p WHERE segment <> '') AS x WHERE key IS NOT NULL AND key <> ''),
c AS (SELECT key, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS c FROM k),
e AS (SELECT key, 'block' AS action, {day("c % 200")} AS d FROM c WHERE c % 3 = 0
  UNION ALL SELECT key, 'drop', {day("c % 200 + 30 + c % 50")} FROM c WHERE c % 6 = 0
  UNION ALL SELECT key, 'block', {day("c % 200 + 120")} FROM c WHERE c % 12 = 0
  UNION ALL SELECT key, 'allow', {day("c % 150 + 60")} FROM c WHERE c % 5 = 1),
u AS (SELECT key, d, max(action) AS action FROM e GROUP BY key, d),
v AS (SELECT key, action, d AS since, lead(d) OVER (PARTITION BY key ORDER BY d) AS until FROM u),
q AS (SELECT DISTINCT host, segment, fetched, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
s AS (SELECT host, segment, fetched, array_to_string(l[i:], '.') AS suffix, 2 * (len(l) - i) AS r FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM q) AS y),
a AS (SELECT host, segment, fetched, suffix AS key, r FROM s UNION ALL SELECT host, segment, fetched, suffix || '/' || segment, r + 1 FROM s WHERE segment <> ''),
m AS (SELECT a.host, a.segment, a.fetched, a.key, v.action, v.since, row_number() OVER (PARTITION BY a.host, a.segment, a.fetched ORDER BY a.r DESC) AS n
  FROM a JOIN v ON a.key = v.key AND v.action <> 'drop' AND v.since <= a.fetched AND (v.until IS NULL OR a.fetched < v.until))
SELECT p.page_id, p.host, p.fetched, m.key || '@' || m.since AS entry_id, m.key AS entry_key, m.since, COALESCE(m.action = 'block', FALSE) AS blocked
FROM p LEFT JOIN m ON p.host = m.host AND p.segment = m.segment AND p.fetched = m.fetched AND m.n = 1
"""
