"""URL filters: every capture is judged by the list entries that were active when it was fetched.

An entry is dated and says what holds for a pattern from then on: "block", "allow" or "remove" (no longer listed). The
entries of a pattern become validity intervals [since, until). A pattern is a domain, which holds for the host and all
below it, or a host with the beginning of a path in whole segments. An as-of join looks up all patterns that a
capture could match, and of those active at its time the longest decides.

Of a url only beginnings are tried that are no deeper than the deepest pattern of the list. Captures are made distinct by (url, time) first, and the intervals of a pattern are one row, so neither a
frequent address nor a frequent host multiplies rows; where the join shuffles, adaptive execution can split a frequent host,
as the list has one row for it. The list is held by every task only if Spark finds it below its broadcast limit.

Everything is DataFrame expressions.

Defined cases: a very long url costs time in proportion to its length; an empty list matches nothing, and an empty table of captures gives an empty
one; a null, empty or unreadable url and a null time match nothing (action null, not blocked); of several
entries for a pattern at one time, "block" goes before "allow" and "allow" before "remove"; entries with nulls count
nothing; repeated captures each get a row; other columns of the captures are kept unless they clash with the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ORDER = ("remove", "allow", "block")


def host_of(url: Column) -> Column:
    """The lower-cased host of a url without user, port and a final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column, labels_most: int, steps_most: int) -> Column:
    """The patterns that match a url and are not longer than any of a list: its host, the domains above of at most ``labels_most`` labels, and the host with
    each beginning of the path of at most ``steps_most`` steps. Work is in proportion to the url, however long it is."""
    labels, steps = F.split(host_of(url), r"\."), F.slice(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 1, max(steps_most, 1))
    first = F.greatest(F.size(labels) - (labels_most - 1), F.lit(1))
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host_of(url) != "", F.array_distinct(F.concat(F.array(host_of(url)), domains, F.coalesce(below, none) if steps_most else none)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until, action) from (pattern, action, since): what holds for a pattern, and when. ``until`` is
    null for what still holds."""
    rank = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("action"))
    known = entries.where(F.col("pattern").isNotNull() & F.col("since").isNotNull() & F.col("action").isin(*_ORDER))
    daily = known.groupBy(F.lower("pattern").alias("pattern"), "since").agg(F.max(rank).alias("rank"))
    order = Window.partitionBy("pattern").orderBy("since")
    changed = daily.withColumn("was", F.lag("rank").over(order)).where("was is null or was <> rank")
    spans = changed.select("pattern", "since", F.lead("since").over(order).alias("until"), F.element_at(F.array(*map(F.lit, _ORDER)), F.col("rank").cast("int")).alias("action"))
    return spans.where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with ``pattern`` and ``action`` of the entry that decided, and ``blocked``."""
    spans = F.sort_array(F.collect_list(F.struct("since", "until", "action"))).alias("spans")
    lists = intervals(entries).groupBy("pattern").agg(spans)
    host, path = F.substring_index("pattern", "/", 1), F.split("pattern", "/")
    deepest = lists.agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(F.size(path) - 1).alias("steps")).first()  # two numbers
    seen = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_time")).where("_url is not null and _time is not null").distinct()
    tried = seen.select("_url", "_time", F.explode(patterns_of(F.col("_url"), deepest["labels"] or 1, deepest["steps"] or 0)).alias("pattern"))
    at = F.filter("spans", lambda s: (s["since"] <= F.col("_time")) & (s["until"].isNull() | (F.col("_time") < s["until"])))
    active = tried.join(lists, "pattern").select("_url", "_time", "pattern", F.try_element_at(at, F.lit(1))["action"].alias("action")).where("action is not null")
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "action")).alias("best")
    decided = active.groupBy("_url", "_time").agg(best).select("_url", "_time", F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"))
    rest = captures.drop("pattern", "action", "blocked")
    out = rest.join(decided, (rest[url_col] == decided["_url"]) & (rest[time_col] == decided["_time"]), "left").drop("_url", "_time")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))
