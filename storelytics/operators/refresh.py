"""When to fetch a page again: a request counts only if the last kept one for its URL is old enough.

Whether a request is kept depends on the one kept before it, which no window function expresses. But the request that would be kept after a
given one does not: it is the URL's first at or after that one's time and the waiting time. That makes a graph of successors, found
by one range sort for all URLs; the kept requests are those on the way from each URL's first. They are found by pointer doubling: after k
rounds a pointer has gone 2^k steps, and the requests known to be kept have doubled in number. The number of rounds is the
logarithm of the longest chain of kept requests, and a URL with any number of requests spans as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics.functions.ordered import later_pieces, ranged
from storelytics.session import cut

TTL_HOURS = 24


def _wait(hours: int):
    return F.make_dt_interval(hours=F.lit(hours))


def refresh_due(requests: DataFrame, ttl_hours: int = TTL_HOURS, since: DataFrame | None = None) -> DataFrame:
    """Kept requests (url, at) out of ``requests`` (url, at).

    ``since`` (url, next_at) tells from when on a URL known from before may be fetched again.
    """
    asked = requests.select("url", "at").dropna()
    if since is not None:
        late = F.col("next_at").isNull() | (F.col("at") >= F.col("next_at"))
        asked = asked.join(since, "url", "left").filter(late).select("url", "at")
    steps = successors(cut(asked.groupBy("url", "at").agg(F.count("*").alias("_n")).drop("_n")), ttl_hours)
    first = steps.groupBy("url").agg(F.min("at").alias("_first"))
    led_to = steps.filter(F.col("next").isNotNull()).select("url", F.col("next").alias("at")).distinct()
    # What is neither a URL's first nor a successor is never kept.
    onward = steps.join(led_to.withColumn("_led", F.lit(True)), ["url", "at"], "left").join(first, "url")
    kept = F.col("at") == F.col("_first")
    at = cut(onward.filter(kept | F.col("_led")).select("url", "at", "next", kept.alias("kept")))
    while not at.filter("kept AND next IS NOT NULL").isEmpty():
        hit = at.filter("kept AND next IS NOT NULL").select("url", F.col("next").alias("at"), F.lit(True).alias("_hit"))
        step = at.filter(F.col("next").isNotNull()).select("url", F.col("at").alias("next"), F.col("next").alias("_next"))
        moved = at.join(hit, ["url", "at"], "left").join(step, ["url", "next"], "left")
        at = cut(moved.select("url", "at", F.col("_next").alias("next"), (F.col("kept") | F.coalesce("_hit", F.lit(False))).alias("kept")))
    return at.filter("kept").select("url", "at")


def successors(asked: DataFrame, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """(url, at, next): for each of the distinct requests the URL's first at or after ``at`` and the waiting time, or NULL."""
    none = F.lit(None).cast("timestamp_ntz")
    due = asked.select("url", (F.col("at") + _wait(ttl_hours)).alias("t"), F.lit(0).alias("kind"), "at")
    rows = ranged(due.unionByName(asked.select("url", F.col("at").alias("t"), F.lit(1).alias("kind"), none.alias("at"))), ["url", "t", "kind"])
    request = F.when(F.col("kind") == 1, F.col("t"))
    # From the end of a piece to its beginning, the least request so far is the next one.
    behind = Window.partitionBy("url", "_piece").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.min(request).over(behind)).filter("kind = 0")
    # Only pieces that hold part of a URL's rows and are not its last need what later pieces hold.
    later = later_pieces(rows, ["url"], F.min(request), F.min)
    return here.join(later, ["url", "_piece"], "left").select("url", "at", F.coalesce("_here", "_later").alias("next"))
