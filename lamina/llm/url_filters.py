"""URL filters as a temporal list join (DataFrame functions only).

A filter list is a log of dated entries: from its date on an entry adds a key to a list or removes it.
Per list and key the log becomes disjoint validity intervals, and an as-of join evaluates each capture
against the entries that were active when it was fetched. A key is a domain (it covers its subdomains)
or a domain with leading path segments, as many as the deepest entry has. The longest active key decides; a block
beats an allowance of equal length. A user name in a url is no part of its host.

Scale: both sides carry the key and the month, so the as-of join is an equi-join with a filter on dates:
an entry meets only the captures of its key and month, and a key that a third of all captures share is
split by month, and further by AQE. Each distinct (url, date) is judged once. The pages' html is never
read.

Defined cases: a null or unparsable url and a null date match nothing and are not blocked; entries with a
null list, key, date or an action other than add or remove are ignored; of the entries of one list, key and date a
removal wins; very long urls are read whole; repeated captures are judged alike and all returned; without entries nothing is blocked;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import pick

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?+([^/?#:@]+)"
SEGMENTS = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)"
BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url: Column, levels: int) -> Column:
    """The keys that may list a url: its domains of two labels and more, and its host with up to `levels`
    leading path segments."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.filter(F.split(F.regexp_extract(url, SEGMENTS, 1), "/"), lambda s: s != "")
    depth = F.least(F.lit(levels), F.size(path))
    cuts = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(cuts, lambda i: F.concat_ws("/", host(url), F.array_join(F.slice(path, 1, i), "/")))
    return F.when(host(url) != "", F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: still valid): when each listed key was active. entries: list, key, action, since."""
    known = pick(entries, "list", "key", "action", "since").filter(
        F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("since").isNotNull()
    )
    log = known.groupBy("list", "key", "since").agg(F.max("action").alias("action"))  # "remove" after "add"
    by_date = W.partitionBy("list", "key").orderBy("since")
    before = log.withColumn("_before", F.lag("action").over(by_date))
    changes = before.filter(F.col("_before").isNull() | (F.col("_before") != F.col("action")))
    return changes.withColumn("until", F.lead("since").over(by_date)).filter(F.col("action") == "add").select("list", "key", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with n_active, decided_by ("list:key", null if none), since, blocked."""
    captures = pick(captures, "page_id", "url", "fetched")
    span = captures.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()
    first, last = F.lit(span["first"]).cast("date"), F.lit(span["last"]).cast("date")
    valid = intervals(entries).filter((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    months = F.explode(
        F.sequence(
            F.trunc(F.greatest("since", first), "month"),
            F.trunc(F.least(F.coalesce(F.date_sub("until", 1), last), last), "month"),
            F.expr("interval 1 month"),
        )
    )
    valid = valid.select("list", "key", "since", "until", months.alias("month"))
    deepest = entries.agg(F.max(F.size(F.split("key", "/")) - 1).alias("levels")).first()["levels"] or 0
    asked = captures.select("url", "fetched").distinct()
    keyed = asked.select(
        "url", "fetched", F.trunc("fetched", "month").alias("month"), F.explode(url_keys(F.col("url"), deepest)).alias("key")
    )
    active = keyed.join(valid, ["key", "month"]).filter(
        (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    )
    best = F.struct(
        F.length("key").alias("size"), (F.col("list") == BLOCK).alias("blocks"), F.col("key"), F.col("list"), F.col("since")
    )
    judged = active.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.max(best).alias("best"))
    return captures.join(judged, ["url", "fetched"], "left").select(
        "page_id",
        "url",
        "fetched",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.concat_ws(":", "best.list", "best.key").alias("decided_by"),
        F.col("best.since").alias("since"),
        F.coalesce(F.col("best.blocks"), F.lit(False)).alias("blocked"),
    ).withColumn("decided_by", F.when(F.col("decided_by") != "", F.col("decided_by")))


def _number(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 4), 16, 10).cast("int")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the tables hold no fetch dates, so one in 2024 follows from the page's id."""
    named = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return pick(pages, "page_id", "url").select(
        "page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(named, 1) % 366).alias("fetched")
    )


def derived_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries made from the pages' own hosts and sections: a third of the hosts is blocked from
    some day on, half of these are removed again 90 days later, and of those a part returns; a fifth of the
    sections (host and first path segment) is allowed."""
    urls = pick(pages, "url").filter(host(F.col("url")) != "")
    hosts = urls.select(host(F.col("url")).alias("key")).distinct()
    day = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("key"), 5) % 300)
    own = _number(F.col("key"), 1)
    listed = hosts.filter(own % 3 == 0).select(F.lit(BLOCK).alias("list"), "key", day.alias("day"), own.alias("own"))
    entry = lambda df, action, after: df.select("list", "key", F.lit(action).alias("action"), F.date_add("day", after).alias("since"))
    sections = (
        urls.select(F.element_at(F.filter(url_keys(F.col("url"), 1), lambda k: F.contains(k, F.lit("/"))), 1).alias("key"))
        .filter("key is not null")
        .distinct()
    )
    allowed = sections.filter(own % 5 == 0).select(F.lit(ALLOW).alias("list"), "key", day.alias("day"))
    return (
        entry(listed, "add", 0)
        .unionByName(entry(listed.filter(F.col("own") % 2 == 0), "remove", 90))
        .unionByName(entry(listed.filter(F.col("own") % 4 == 0), "add", 150))
        .unionByName(entry(allowed, "add", 0))
    )


ORACLE_SQL = r"""
with c as (
  select page_id, url, date '2024-01-01' + cast(('0x' || substr(md5(coalesce(cast(page_id as varchar), 'null')), 1, 4)) as int) % 366 as fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) as host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1), '/'), lambda s: s <> '') as path
  from pages
), h as (
  select key, cast(('0x' || substr(md5(key), 1, 4)) as int) as own,
    date '2024-01-01' + cast(('0x' || substr(md5(key), 5, 4)) as int) % 300 as day, section
  from (select distinct host as key, false as section from c where host <> ''
    union select distinct host || '/' || path[1], true from c where host <> '' and len(path) > 0)
), e as (
  select 'block' as list, key, 'add' as action, day as since from h where not section and own % 3 = 0
  union all select 'block', key, 'remove', day + 90 from h where not section and own % 3 = 0 and own % 2 = 0
  union all select 'block', key, 'add', day + 150 from h where not section and own % 3 = 0 and own % 4 = 0
  union all select 'allow', key, 'add', day from h where section and own % 5 = 0
), v as (
  select *, lead(since) over (partition by list, key order by since) as until from e
), k as (
  select distinct url, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, least(2, len(path)) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')))) as key
  from c where host <> ''
), a as (
  select k.url, k.fetched, v.*, row_number() over (partition by k.url, k.fetched order by length(v.key) desc, v.list desc, v.key desc) as place,
    count(*) over (partition by k.url, k.fetched) as n
  from k join v on k.key = v.key and v.action = 'add' and v.since <= k.fetched and (v.until is null or k.fetched < v.until)
)
select c.page_id, c.url, cast(c.fetched as varchar) as fetched, coalesce(a.n, 0) as n_active,
  a.list || ':' || a.key as decided_by, cast(a.since as varchar) as since,
  coalesce(a.list = 'block', false) as blocked
from c left join a on c.url = a.url and c.fetched = a.fetched and a.place = 1
"""
