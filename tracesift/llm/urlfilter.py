"""URL filters by a temporal list join.

List entries are dated: an entry is added or removed at a time. They become validity intervals (from, to) of a key. A key is
a host suffix, alone or with a path prefix of whole segments. Captures are first joined to the hosts on the list, by the suffixes of
their hosts that are as long as a listed host can be; only then are keys with paths made, of the depths that the list has under
that host. Short intervals are gathered by (key, period), others by (key, one of SPREAD parts), so that
a capture meets those of its own time by an equi-join that spreads a hot host; the as-of condition is evaluated there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD_DAYS = 32
#: Intervals of more periods, and open ones, aren't cut by period.
SHORT = 16
#: Parts among which the captures of a key with such an interval are spread.
SPREAD = 16


def host_of(url: Column) -> Column:
    """Lower-case host; empty where the URL has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path without query and fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def suffixes_of(host: Column, most: int) -> Column:
    """Suffixes of whole labels, of up to ``most`` labels; none of an empty host."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    found = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def depth_of(key: Column) -> Column:
    """Path segments of a list key."""
    return F.size(F.split(key, "/")) - 1


def intervals(entries: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (exclusive, null: still valid) from dated entries (key, at, action ``add`` or ``remove``).

    Adding what is valid, or removing what isn't, changes nothing; of entries at one instant a removal comes last.
    Entries with a null in any of the three columns are ignored."""
    order = Window.partitionBy("key").orderBy("at", "on")
    rows = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    rows = rows.groupBy("key", "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    rows = rows.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    return rows.withColumn("valid_to", F.lead("at").over(order)).where("on = 1").select("key", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """Each row of ``captures`` with host, blocked, entry (the longest key valid at fetch time, ties by key) and since.

    A null URL, one without a host or a null fetch time matches nothing. Equal rows get equal results; an empty
    list blocks nothing; an empty table gives no rows. Only the three named columns are read."""
    days = F.lit(PERIOD_DAYS)
    period = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("int")
    rows = captures.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(at).alias("at"))
    spans = intervals(entries)
    until = period(F.col("valid_to"))
    short = F.coalesce(until - period(F.col("valid_from")) < SHORT, F.lit(False))
    spans = spans.withColumn("period", F.explode(F.when(short, F.transform(F.sequence(period(F.col("valid_from")), F.when(short, until).otherwise(period(F.col("valid_from")))), lambda p: F.struct(F.lit(True).alias("short"), p.alias("at")))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda p: F.struct(F.lit(False).alias("short"), p.alias("at"))))))
    spans = spans.groupBy("key", "period").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spans"))
    hosts = entries.where("key IS NOT NULL").select(F.substring_index("key", "/", 1).alias("suffix"), depth_of(F.col("key")).alias("depth"))
    hosts = hosts.groupBy("suffix").agg(F.collect_set("depth").alias("depths"))
    most = hosts.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 0
    asked = rows.where("at IS NOT NULL").distinct().withColumn("suffix", F.explode(suffixes_of(host_of(F.col("url")), most)))
    segments = F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != "")
    depths = F.filter("depths", lambda d: d <= F.size("segments"))
    asked = asked.join(hosts, "suffix").withColumn("segments", segments).withColumn("depth", F.explode(depths))
    asked = asked.select("id", "url", "at", F.concat_ws("/", F.array("suffix"), F.slice("segments", F.lit(1), F.col("depth"))).alias("key"))
    periods = F.array(F.struct(F.lit(True).alias("short"), period(F.col("at")).alias("at")), F.struct(F.lit(False).alias("short"), F.pmod(F.xxhash64("url", "at"), F.lit(SPREAD)).cast("int").alias("at")))
    asked = asked.withColumn("period", F.explode(periods))
    hit = F.filter("spans", lambda s: (s["valid_from"] <= F.col("at")) & (s["valid_to"].isNull() | (F.col("at") < s["valid_to"])))
    met = asked.join(spans, ["key", "period"]).withColumn("hit", hit).where("size(hit) > 0")
    best = met.groupBy("id", "url", "at").agg(F.max(F.struct(F.length("key").alias("n"), "key", F.col("hit")[0]["valid_from"].alias("since"))).alias("best"))
    out = rows.alias("r").join(best.alias("b"), F.expr("r.id <=> b.id AND r.url = b.url AND r.at = b.at"), "left")
    return out.select(F.col("r.id").alias(id), F.col("r.url").alias("url"), host_of(F.col("r.url")).alias("host"), F.col("r.at").alias(at), F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("entry"), F.col("best.since").alias("since"))
