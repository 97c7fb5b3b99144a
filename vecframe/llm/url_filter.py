"""URL filters as a temporal list join.

A list is a log of dated entries: on a date a key (a host, a domain, or a host with a path prefix) starts or stops being
blocked or allowed.  The entries of each key become validity intervals, and every capture looks up the keys its URL can
match (host, parent domains, path prefixes) as of its fetch time.  The most specific key that is active decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of a list
ENTRY_SCHEMA = "key string, since timestamp_ntz, action string"
#: Places in which a key of the list meets those who ask for it.
SALTS = 16


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): each entry holds until the next of its key; until is null for the last.

    action is block, allow or remove (nothing holds afterwards).  Of entries of one key and time the greatest action
    (remove, then block, then allow) holds; entries with a null field are void.
    """
    rank = F.when(F.col("action") == "remove", 3).when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1)
    e = entries.select(F.lower("key").alias("key"), F.col("since"), "action", rank.alias("rank")).where("key is not null and since is not null and rank is not null")
    e = e.groupBy("key", "since").agg(F.max_by("action", "rank").alias("action"))
    # One key changes a few times in its life, so that its rows may meet in one task.
    e = e.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))
    return e.where("action <> 'remove'")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host without user, port or trailing dot, and path; null where the URL has no host."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^?#]*)", 1)
    authority = F.substring_index(rest, "/", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(authority, "@", -1)), r":\d*$", ""), r"\.+$", "")
    path = F.substr(rest, F.length(authority) + F.lit(1))
    return F.when(host != "", host), F.when(host != "", path)


def depth_of(key: Column) -> Column:
    """How deep a key goes: a host with a path prefix by its directories (positive), a bare host by its labels (negative)."""
    return F.when(F.contains(key, F.lit("/")), F.size(F.split(key, "/")) - 2).otherwise(-F.size(F.split(key, r"\.")))


def _salt(rows: Column) -> Column:
    return F.pmod(rows, F.lit(SALTS)).cast("int")


def _all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _met(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """Asked rows with the interval of their key that holds at their time.  A key that many ask is met in SALTS places."""
    spans = spans.select(F.col("key"), "action", "since", "until", _all_salts())
    return asked.withColumn("salt", _salt(F.xxhash64("host", "path", "fetched"))).join(spans, ["key", "salt"]).where("fetched >= since and (until is null or fetched < until)").drop("salt")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """A row per row of captures: id, url, host, fetched, action (block, allow or null), matched key and interval start, blocked.

    A host with a path prefix beats a bare host, which beats its parent domains; of either kind the longer the better.  Of
    the keys that a URL could match only those are made that are as deep as some key of the list (for paths: of the list
    for that host), so that work grows with the URL and not with its square, however long it is.

    A capture without a host or a fetch time matches nothing and isn't blocked.  Repeated captures each get their row, as
    captures are told apart by their place and not their id; ids may be null.  Other columns, whatever their names, play
    no part.  An empty list blocks nothing; an empty table gives nothing.
    """
    host, path = url_parts(F.col("url"))
    c = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").cast("timestamp_ntz").alias("fetched"))
    c = c.withColumns({"host": host, "path": path})
    # Distinct questions only: a hot host asks the same few over and over.
    asked = c.where("host is not null and fetched is not null").select("host", "path", "fetched").distinct()
    spans = intervals(entries).withColumn("depth", depth_of(F.col("key")))
    # Domains: how many labels the list's bare hosts have is a handful of numbers.
    many = sorted(-r["depth"] for r in spans.where("depth < 0").select("depth").distinct().collect())
    labels = F.split("host", r"\.")
    of = lambda n: F.when(F.size(labels) >= n, F.struct((F.lit(-1_000_000_000) + n).alias("weight"), F.array_join(F.slice(labels, -n, n), ".").alias("key")))
    domains = asked.select("host", "path", "fetched", F.explode(F.filter(F.array(*[of(n) for n in many]), lambda k: k.isNotNull())).alias("k")).select("host", "path", "fetched", "k.*") if many else None
    # Path prefixes: as deep as the list has some for the host.
    deep = spans.where("depth > 0").groupBy(F.substring_index("key", "/", 1).alias("host")).agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    dirs = F.filter(F.split(F.regexp_replace("path", r"^/|[^/]*$", ""), "/"), lambda d: d != "")
    inside = asked.withColumn("salt", _salt(F.xxhash64("path", "fetched"))).join(deep.select("host", "depths", _all_salts()), ["host", "salt"]).withColumn("dirs", dirs)
    inside = inside.withColumn("weight", F.explode(F.filter("depths", lambda n: n <= F.size("dirs"))))
    prefix = F.concat("host", F.lit("/"), F.array_join(F.slice("dirs", F.lit(1), F.col("weight")), "/"), F.lit("/"))
    met = _met(inside.select("host", "path", "fetched", "weight", prefix.alias("key")), spans)
    if domains is not None:
        met = met.unionByName(_met(domains, spans))
    best = met.groupBy("host", "path", "fetched").agg(F.max_by(F.struct("action", "key", "since"), "weight").alias("hit"))
    out = c.join(best, ["host", "path", "fetched"], "left")
    return out.select(F.col("id").alias(id_col), "url", "host", "fetched", F.col("hit.action").alias("action"), F.col("hit.key").alias("matched_key"), F.col("hit.since").alias("active_since"), F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"))


def entry_frame(spark, rows) -> DataFrame:
    """Entries from (key, 'YYYY-MM-DD', action) tuples."""
    raw = spark.createDataFrame(list(rows), T.StructType([T.StructField(n, T.StringType()) for n in ("key", "since", "action")]))
    return raw.select("key", F.to_date("since").cast("timestamp_ntz").alias("since"), "action")
