"""URL filters from dated lists: every capture is judged by the entries active when it was fetched.

A list is a stream of dated entries that add or remove a pattern. Per pattern they become validity
intervals, and an as-of join looks up, for every capture and every pattern it could match, the
interval that contains its fetch day. Patterns are host names (which cover their subdomains) and
host-and-path prefixes (which end at a path segment), so a lookup is an equality join on a few keys
per capture.

Captures are reduced to distinct (key, day) before they meet the intervals, and verdicts return by
(key, day): a host that holds a third of all captures becomes one row per day and path.

Nulls and edges: an entry without a pattern, day or action is ignored; of several entries for a
pattern on one day, a removal wins. A capture without a url or a day matches nothing. Repeated rows
are judged alike. Hosts compare in lower case, paths in their own; user, port, query, fragment and empty path
segments (so a pattern's last slash too) don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import materialise

_URL = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def normal_pattern(pattern: Column) -> Column:
    """A pattern as ``lookup_keys`` writes it: host in lower case, path in its own, no empty segments."""
    parts = F.split(pattern, "/")
    path = F.filter(F.slice(parts, 2, F.size(parts)), lambda s: s != "")
    return F.nullif(F.array_join(F.concat(F.array(F.lower(parts[0])), path), "/"), F.lit(""))


def lookup_keys(url: Column, segments: int) -> Column:
    """All patterns that cover a url: its host and parent domains, and its path prefixes of up to ``segments``."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    count = F.least(F.size(parts), F.lit(segments))
    prefixes = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))) \
        .otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(hosts, prefixes)))


def validity_intervals(entries: DataFrame, pattern: str = "pattern", day: str = "day",
                       action: str = "action") -> DataFrame:
    """``(pattern, since, until)``: the pattern is active from ``since`` to before ``until`` (null: still)."""
    plain = entries.select(normal_pattern(F.col(f"`{pattern}`")).alias("pattern"), F.col(f"`{day}`").cast("long").alias("day"),
                           (F.col(f"`{action}`") == "add").alias("on"))
    daily = plain.where("pattern is not null and day is not null and on is not null") \
        .groupBy("pattern", "day").agg(F.min("on").alias("on"))       # one row per pattern and day at most
    order = Window.partitionBy("pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("on").over(order)).where(F.col("on") != F.coalesce("was", F.lit(False)))
    return changes.withColumn("until", F.lead("day").over(order)).where("on") \
        .select("pattern", F.col("day").alias("since"), "until")


def judged_captures(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url",
                    day: str = "day") -> DataFrame:
    """``(id, host, day, n_matches, blocked, pattern, since)`` per capture.

    ``pattern`` is the longest active pattern that covers the capture (ties: the first by text) and
    ``since`` the day its interval began.
    """
    rows = captures.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"),
                           F.col(f"`{day}`").cast("long").alias("day"))
    spans = materialise(validity_intervals(entries))
    # No prefix beyond the longest pattern of the list can match: one number on the driver.
    longest = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    seen = rows.where("url is not null and day is not null").select("url", "day").distinct()
    keyed = materialise(seen.select("url", "day", F.explode(lookup_keys(F.col("url"), longest)).alias("pattern")))
    asked = keyed.select("day", "pattern").distinct()
    active = materialise(asked.join(spans, "pattern").where(
        (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
        .select("day", "pattern", "since"))
    hits = keyed.join(active, ["day", "pattern"])
    verdicts = hits.groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.min(F.struct((-F.length("pattern")).alias("size"), "pattern", "since")).alias("best"))
    return rows.join(verdicts, ["url", "day"], "left").select(
        F.col("id").alias(id), host_of(F.col("url")).alias("host"), F.col("day").alias(day),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))
