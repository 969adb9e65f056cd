"""URL lists over time: dated entries become validity intervals, and each capture meets those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callweave.session import table, written

#: Days that one bucket of the interval join covers.
BUCKET = 64
#: Intervals up to this number (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys(url: Column) -> Column:
    """What an entry may name to cover a URL: its host, each domain above that, and the host with each folder of the path, ended by /."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")  # "", folders, and the last name
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(h, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array())
    return F.when(h != "", F.concat(domains, folders)).otherwise(F.array())


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, verdict, day) -> key, verdict, since, until: verdict holds from its day to before the key's next entry, which until names (null: none follows).

    Verdicts are block, allow, or none, which only ends what was before. Of entries of one key and day the verdict that sorts
    last holds. Entries with a null are left out, and so are intervals of none.
    """
    own = entries.where("key IS NOT NULL AND verdict IS NOT NULL AND day IS NOT NULL").groupBy(F.lower("key").alias("key"), F.col("day").cast("date").alias("since")).agg(F.max("verdict").alias("verdict"))
    return own.withColumn("until", F.lead("since").over(W.partitionBy("key").orderBy("since"))).where("verdict <> 'none'").select("key", "verdict", "since", "until")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """page_id, url, fetched, key, verdict, since, blocked: one row for each row of captures.

    Of the entries active on the day of the fetch that cover the URL, the longest key decides (then the one that sorts
    last); key, verdict and since are null where there is none; blocked is verdict = block. Hosts and keys are lower-cased. A null
    or hostless URL, or a null day, meets nothing. Repeated rows are judged alike, null ids stay; extra columns are not read.

    The join is made once for each different URL and day, not for each capture. Its keys hold a bucket of days, so that a key
    whose entries change daily does not meet all of its intervals; keys that many rows share are split by Spark.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("fetched"))
    days = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    last = days.agg(F.max("fetched")).first()[0]
    valid = intervals(entries)
    if last is not None:
        valid = valid.where(F.col("since") <= F.lit(last))
    end = F.least(F.date_sub("until", 1), F.lit(last).cast("date"))
    span = F.sequence(F.floor(day_number(F.col("since")) / BUCKET), F.floor(day_number(F.coalesce(end, F.col("since"))) / BUCKET))
    valid = written(valid.select("key", "verdict", "since", "until", F.explode(span).alias("bucket")))
    valid = F.broadcast(valid) if valid.count() <= BROADCAST_ROWS else valid
    asked = days.select("url", "fetched", F.explode(F.array_distinct(keys(F.col("url")))).alias("key"), F.floor(day_number(F.col("fetched")) / BUCKET).alias("bucket"))
    met = asked.join(valid, ["key", "bucket"]).where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = met.groupBy("url", "fetched").agg(F.max(F.struct(F.length("key").alias("long"), "key", "verdict", "since")).alias("m")).select("url", "fetched", "m.key", "m.verdict", "m.since")
    out = rows.join(best, ["url", "fetched"], "left")
    return out.select(F.col("id").alias(id_col), "url", "fetched", "key", "verdict", "since", F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"))


FIRST_DAY = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """pages with a day of the fetch: page_id modulo 366 days after the first of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list with a history for all hosts of pages: each host, its folder /en/ and the domain of its last two labels, on days drawn from their MD5."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h <> ''").distinct()
    names = hosts.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("h").alias("key")), F.struct(F.lit(1).alias("kind"), F.concat("h", F.lit("/en/")).alias("key")), F.struct(F.lit(2).alias("kind"), F.regexp_extract("h", r"([^.]*\.[^.]*)$", 1).alias("key")))).alias("n")).select("n.kind", "n.key").where("key <> ''").distinct()
    draw = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    e = lambda verdict, n: F.struct(F.lit(verdict).alias("verdict"), day(n).alias("day"))
    host_days = F.array(e("block", draw % 200), e("none", draw % 200 + 60 + draw % 50), e("block", draw % 200 + 150))
    other = F.array(e("allow", draw % 300))
    domain = F.array(e("block", draw % 100), e("none", draw % 100 + 90))
    days = F.when(F.col("kind") == 0, host_days).when(F.col("kind") == 1, other).otherwise(domain)
    return names.select("key", F.explode(days).alias("e")).select("key", "e.verdict", "e.day")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(captures_of(pages), entries_of(pages))


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
             string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS parts
           FROM pages),
hosts AS (SELECT DISTINCT h FROM p WHERE h <> ''),
names AS (SELECT DISTINCT kind, key FROM (
    SELECT 0 AS kind, h AS key FROM hosts UNION ALL SELECT 1, h || '/en/' FROM hosts
    UNION ALL SELECT 2, regexp_extract(h, '([^.]*\.[^.]*)$', 1) FROM hosts) WHERE key <> ''),
drawn AS (SELECT *, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS k FROM names),
entries AS (
    SELECT key, 'block' AS verdict, k % 200 AS n FROM drawn WHERE kind = 0
    UNION ALL SELECT key, 'none', k % 200 + 60 + k % 50 FROM drawn WHERE kind = 0
    UNION ALL SELECT key, 'block', k % 200 + 150 FROM drawn WHERE kind = 0
    UNION ALL SELECT key, 'allow', k % 300 FROM drawn WHERE kind = 1
    UNION ALL SELECT key, 'block', k % 100 FROM drawn WHERE kind = 2
    UNION ALL SELECT key, 'none', k % 100 + 90 FROM drawn WHERE kind = 2),
dated AS (SELECT key, DATE '2024-01-01' + CAST(n AS INTEGER) AS since, max(verdict) AS verdict FROM entries GROUP BY ALL),
valid AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM dated),
asked AS (SELECT DISTINCT url, fetched, key FROM (
    SELECT url, fetched, unnest(list_transform(generate_series(1, len(string_split(h, '.'))), lambda i: array_to_string(list_slice(string_split(h, '.'), i, 1000000), '.'))) AS key FROM p WHERE h <> ''
    UNION ALL SELECT url, fetched, unnest(list_transform(generate_series(1, len(parts) - 1), lambda i: h || array_to_string(list_slice(parts, 1, i), '/') || '/')) FROM p WHERE h <> '' AND len(parts) > 1)),
best AS (SELECT url, fetched, max({'long': length(key), 'key': key, 'verdict': verdict, 'since': since}) AS m
         FROM asked JOIN valid USING (key) WHERE verdict <> 'none' AND since <= fetched AND (until IS NULL OR fetched < until) GROUP BY ALL)
SELECT page_id, url, fetched, m.key AS key, m.verdict AS verdict, m.since AS since, coalesce(m.verdict = 'block', false) AS blocked
FROM p LEFT JOIN best USING (url, fetched)
"""
