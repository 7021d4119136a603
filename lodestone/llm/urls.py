"""URL filters as a temporal join with dated lists.

List events (add, remove) of a rule become validity intervals. All rules that bear on a key (a host and its parent domains,
or a URL) are merged into one timeline of segments that do not overlap, each with the rule that decides. An as-of join then
gives every capture the segment of its key that holds at its fetch time. Segments and captures meet on (key, month), so a
capture is compared with the segments of its own month alone; where one (key, month) holds many captures, as in a single
crawl, they are salted and that key's segments of the month go to every salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, Scratch


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::\d*)?(?:[/?#]|$)", 1)
    return F.when(host != "", host)


def url_key(url: Column) -> Column:
    """Host and path, without scheme, query, fragment and final slashes; null where there is no host."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*(/[^?#]*)?", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def validity(events: DataFrame) -> DataFrame:
    """kind, rule, action, valid_from, valid_to of list events (kind, rule, action, event, at).

    An interval opens at an ``add`` and ends at the next ``remove`` of the same rule and action (open: null). Repeated adds
    and removes change nothing; of events at one time the remove counts first. Events with a null rule or time are left out.
    """
    by = Window.partitionBy("kind", "rule", "action").orderBy("at", F.when(F.col("event") == "remove", 0).otherwise(1))
    known = events.where(F.col("rule").isNotNull() & F.col("at").isNotNull() & F.col("event").isin("add", "remove"))
    turns = known.withColumn("was", F.lag("event").over(by)).where(F.col("event") != F.coalesce("was", F.lit("remove")))
    spans = turns.withColumn("valid_to", F.lead("at").over(by)).where("event = 'add'")
    return spans.select("kind", "rule", "action", F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def timelines(scratch: Scratch, name: str, spans: DataFrame) -> DataFrame:
    """key, valid_from, valid_to, action, rule: per key, segments without overlap, of spans (key, rank, action, rule, ...).

    Where several spans hold, the highest rank decides, ``allow`` before ``block`` on a tie, then the rule's name.
    """
    spans = scratch.write(spans, f"{name}-spans")
    times = spans.select("key", F.col("valid_from").alias("t")).union(spans.where("valid_to is not null").select("key", "valid_to")).distinct()
    cuts = times.withColumn("t_next", F.lead("t").over(Window.partitionBy("key").orderBy("t")))
    held = cuts.join(spans, "key").where("valid_from <= t and (valid_to is null or t < valid_to)")
    first = F.max(F.struct("rank", (F.col("action") == "allow").alias("a"), "rule", "action"))
    lines = held.groupBy("key", "t", "t_next").agg(first.alias("m")).select("key", F.col("t").alias("valid_from"), F.col("t_next").alias("valid_to"), "m.action", "m.rule")
    return scratch.write(lines, name)


def as_of(captures: DataFrame, segments: DataFrame, key: str, time: str, prefix: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Each row of ``captures`` once, with the action and rule of the segment of ``key`` that holds at ``time`` (else null).

    Both are written tables. A (key, month) with more than ``hot_share`` of all captures is dealt to salts that hold no more;
    there are at most ``1 / hot_share`` such, so that their list is small at any size.
    """
    left = captures.withColumn("_m", F.trunc(F.col(time), "month"))
    known = left.agg(F.unix_micros(F.max(time)).alias("last"), F.count("*").alias("total")).first()
    last = F.timestamp_micros(F.lit(known["last"]).cast("bigint"))
    most = max(1, int(known["total"] * hot_share))
    hot = left.where(F.col(key).isNotNull() & F.col("_m").isNotNull()).groupBy(F.col(key).alias("_key"), F.col("_m").alias("_month")).count().where(F.col("count") > most)
    hot = F.broadcast(hot.select("_key", "_month", F.ceil(F.col("count") / most).cast("int").alias("_salts")))
    end = F.least(F.coalesce("valid_to", last), last)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    held = segments.where(F.col("valid_from") <= last).select(F.col("key").alias("_key"), "valid_from", "valid_to", F.col("action").alias(f"{prefix}_action"), F.col("rule").alias(f"{prefix}_rule"), F.explode(months).alias("_month"))
    dealt = held.join(hot, ["_key", "_month"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    salted = left.join(hot, (F.col(key) == F.col("_key")) & (F.col("_m") == F.col("_month")), "left").drop("_key", "_month")
    salted = salted.withColumn("_s", F.pmod(F.xxhash64(*captures.columns), F.coalesce("_salts", F.lit(1))).cast("int"))
    same = (F.col(key) == F.col("_key")) & (F.col("_m") == F.col("_month")) & (F.col("_s") == F.col("_salt")) & (F.col(time) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(time) < F.col("valid_to")))
    return salted.join(dealt, same, "left").drop("_key", "_m", "_month", "_s", "_salt", "_salts", "valid_from", "valid_to")


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, host, verdict (allow or block), rule, rule_kind of every capture (page_id, url, fetched_at).

    A URL rule goes before domain rules, a longer domain before a shorter one. No rule that holds, no host, or no fetch time:
    allow, with a null rule. Repeated captures are judged each; other columns are not read; without captures or events the
    result is empty or all allowed.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    spans = scratch.write(validity(events), "spans")
    seen = captures.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), url_key(F.col("url")).alias("_url"))
    seen = scratch.write(seen, "captures", "zstd")
    hosts = seen.where("host is not null").select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    domains = hosts.withColumn("rule", suffix).join(spans.where("kind = 'domain'"), "rule")
    by_host = timelines(scratch, "by-host", domains.select(F.col("host").alias("key"), F.length("rule").alias("rank"), "action", "rule", "valid_from", "valid_to"))
    by_url = timelines(scratch, "by-url", spans.where("kind = 'url'").select(F.col("rule").alias("key"), F.lit(1).alias("rank"), "action", "rule", "valid_from", "valid_to"))
    hosted = scratch.write(as_of(seen, by_host, "host", "fetched_at", "host"), "hosted", "zstd")
    joined = as_of(hosted, by_url, "_url", "fetched_at", "url")
    return joined.select(
        "page_id", "url", "fetched_at", "host",
        F.coalesce("url_action", "host_action", F.lit("allow")).alias("verdict"),
        F.coalesce("url_rule", "host_rule").alias("rule"),
        F.when(F.col("url_rule").isNotNull(), "url").when(F.col("host_rule").isNotNull(), "domain").alias("rule_kind"),
    )


def drawn_list(captures: DataFrame) -> DataFrame:
    """A dated list for tables that come without one: events drawn by MD5 from the captures' hosts, domains and URLs."""
    seen = captures.select(host_of(F.col("url")).alias("host"), url_key(F.col("url")).alias("u")).where("host is not null")
    keys = (
        seen.select(F.lit("domain").alias("kind"), F.col("host").alias("rule"))
        .union(seen.select(F.lit("domain"), F.substring_index("host", ".", -2)))
        .union(seen.select(F.lit("url"), "u"))
        .distinct()
    )
    part = lambda a, n: F.conv(F.substring(F.md5("rule"), a, n), 16, 10).cast("int")
    drawn = keys.withColumn("action", F.when(part(1, 1) < 10, "block").otherwise("allow")).where(part(2, 1) < 12)
    first, stays, gap = part(3, 3) % 600, part(6, 2), part(8, 2) + 1
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda days: F.dateadd(begin, days).cast("timestamp")
    event = lambda name, days: F.struct(F.lit(name).alias("event"), at(days).alias("at"))
    events = F.array(event("add", first), event("remove", first + stays), event("add", first + stays + gap))
    return drawn.select("kind", "rule", "action", F.explode(events).alias("e")).select("kind", "rule", "action", "e.event", "e.at")
