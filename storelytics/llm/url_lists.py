"""URL filters in time: every capture judged by the list entries in force when it was fetched.

A list is a log: at some time a pattern is put on it with ``block`` or ``allow``, or taken off with ``remove``. An entry holds from
its time until the next entry of its pattern: a validity interval. Patterns are hosts with all below them (``example.org``) or
path prefixes of one host (``example.org/en/``). Hosts are lower-cased, paths are taken as they are. A capture is looked up under each of its patterns as of its fetch time; the
most specific pattern in force decides.

The as-of join sorts entries and look-ups together by (pattern, time) over range partitions, so a host with a third
of all captures spans as many tasks as its rows need. Each partition fills the last entry forward; what it needs from the
partitions before is one row each. Look-ups of patterns that are on no list are left out before the sort.

Entries without pattern, time or a known status are ignored. Of entries of one pattern and time the greatest status by name
holds, the others for no time; repeated entries change nothing. Captures without a URL, host or time match nothing and are
kept. Rows are told apart by place, so ``captures`` must be a table at rest; all of its columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics.llm.common import cut

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def patterns(url: str) -> Column:
    """The patterns a URL falls under, from the least specific to the most."""
    body = f"""
        transform(array(named_struct('host', lower(regexp_extract({url}, R'{_HOST}', 1)), 'path', regexp_extract({url}, R'{_PATH}', 1))), u ->
            if(coalesce(u.host, '') = '', cast(array() AS array<string>), transform(array(split(u.host, '[.]')), l -> concat(
                transform(sequence(least(2, size(l)), size(l)), n -> array_join(slice(l, size(l) - n + 1, n), '.')),
                transform(array(split(u.path, '/')), s -> if(size(s) < 2, cast(array() AS array<string>), concat(
                    if(size(s) < 3, cast(array() AS array<string>),
                       transform(sequence(2, size(s) - 1), n -> concat(u.host, array_join(slice(s, 1, n), '/'), '/'))),
                    if(s[size(s) - 1] = '', cast(array() AS array<string>), array(concat(u.host, u.path))))))[0]))[0]))[0]"""
    return F.expr(body)


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of ``order`` and written, with the number of their range."""
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _reach(rows: DataFrame, order: list[str], value: Column, ahead: bool) -> DataFrame:
    """``rows`` with ``_reached``: the nearest value that is not null, before each row in ``order`` or after it.

    ``rows`` come from ``_sorted``. The window is one range of rows; ranges hand on one value each.
    """
    keys = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_value", value)
    end = f"{'min_by' if ahead else 'max_by'}(_value, struct({', '.join(order)})) FILTER (WHERE _value IS NOT NULL)"
    ends = valued.groupBy("_part").agg(F.expr(end).alias("_end"))
    others = Window.orderBy(F.col("_part").desc() if ahead else F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(others).alias("_carried"))
    filled = valued.withColumn("_within", F.last("_value", ignorenulls=True).over(within))
    # One row per range: the hint is for a table as small as the list of partitions.
    return filled.join(F.broadcast(carried), "_part").withColumn("_reached", F.coalesce("_within", "_carried")).drop("_value", "_within", "_carried")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, status, since, until) from ``entries`` (pattern, status, at); the last of a pattern has no ``until``."""
    known = entries.filter("pattern IS NOT NULL AND at IS NOT NULL AND status IN ('block', 'allow', 'remove')")
    # Hosts are alike in any case, paths are not.
    pattern = F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.expr("substr(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    rows = _sorted(known.select(pattern.alias("pattern"), "at", "status").distinct(), ["pattern", "at", "status"])
    ahead = _reach(rows, ["pattern", "at", "status"], F.struct("pattern", "at"), ahead=True)
    until = F.when(F.col("_reached.pattern") == F.col("pattern"), F.col("_reached.at"))
    return ahead.select("pattern", "status", F.col("at").alias("since"), until.alias("until")).filter("until IS NULL OR since < until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with the ``pattern`` that decides, its ``status``, ``since`` and ``until``, and ``blocked``."""
    valid = cut(intervals(entries))
    placed = captures.withColumn("_row", F.monotonically_increasing_id())
    looked = placed.select("_row", F.col(at).alias("at"), F.posexplode(patterns(url)).alias("rank", "pattern")).filter("at IS NOT NULL")
    listed = looked.join(valid.select("pattern").distinct(), "pattern", "left_semi")
    entry = F.struct("pattern", "status", "since", "until")
    both = listed.select("pattern", "at", F.lit(1).alias("kind"), "_row", "rank", F.lit(None).cast(
        "struct<pattern:string,status:string,since:timestamp_ntz,until:timestamp_ntz>").alias("entry")).unionByName(
        valid.select("pattern", F.col("since").alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("_row"), F.lit(0).alias("rank"), entry.alias("entry")))
    order = ["pattern", "at", "kind", "_row"]
    found = _reach(_sorted(both, order), order, F.col("entry"), ahead=False).filter("kind = 1 AND _reached.pattern = pattern")
    force = found.filter("_reached.status <> 'remove' AND (_reached.until IS NULL OR at < _reached.until)")
    best = force.groupBy("_row").agg(F.max_by("_reached", "rank").alias("_best"))
    joined = placed.join(best, "_row", "left")
    return joined.select(
        *captures.columns, *[F.col(f"_best.{c}").alias(c) for c in ("pattern", "status", "since", "until")],
        F.coalesce(F.col("_best.status") == "block", F.lit(False)).alias("blocked"),
    )
