"""URL filters that change over time, in DataFrame operations only.

A list is a table of dated entries (rule, value, day, action). A rule is ``host`` (the host itself
and all hosts below it) or ``prefix`` (host and beginning of the path, without scheme). An action
``block`` or ``allow`` holds from its day until the next entry of the same rule and value; an entry
``remove`` ends it. Entries thus become validity intervals, and a capture is judged by those that
hold at its time: the as-of join.

Of the intervals that hold, a prefix goes before a host, a longer value before a shorter one. A
capture without any is allowed. Of entries of one value and day the smallest action counts.

The join is on (value, span of ``SPAN_DAYS`` days): an interval has a row for each span in which
the captures lie, so a value with a long history meets only what is near in time. A pair of value
and span that holds much of the captures is salted by ``join_spread``.

Captures without host or time are allowed, repeated ones judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from topicvote.llm.common import HOT_SHARE, column
from topicvote.session import materialise

SPAN_DAYS = 32
RULES = ("host", "prefix")


def bare(url: Column) -> Column:
    """host/path of a URL without scheme, user, port, query and fragment; the host in lower case."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    authority = F.substring_index(rest, "/", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.concat(host, F.substring(rest, F.length(authority) + 1, F.length(rest)))


def candidates(address: Column) -> Column:
    """All (rule, value, weight) that can match host/path: the host and its parents, and every
    beginning of the path that ends at a slash or at the end. The weight orders them."""
    host = F.substring_index(address, "/", 1)
    labels = F.split(host, r"\.")
    parts = F.split(address, "/")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.struct(
            F.lit(RULES[0]).alias("rule"),
            F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("value"),
            (F.size(labels) - k).alias("weight"),
        ),
    )
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k > 1),
        lambda k: F.struct(
            F.lit(RULES[1]).alias("rule"),
            F.array_join(F.slice(parts, 1, k), "/").alias("value"),
            (k + 1000).alias("weight"),
        ),
    )
    return F.when(host != "", F.concat(hosts, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """rule, value, action, from_day, to_day (exclusive, null: open) of dated entries."""
    once = entries.filter("value IS NOT NULL AND day IS NOT NULL").groupBy("rule", "value", "day").agg(
        F.min("action").alias("action")
    )
    following = W.partitionBy("rule", "value").orderBy("day")
    return (
        once.select("rule", "value", "action", F.col("day").alias("from_day"), F.lead("day").over(following).alias("to_day"))
        .filter("action != 'remove'")
    )


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join in which a key with at least 1/1000 of the left rows (1000 keys at most) is dealt
    over as many salts as it has thousandths; its right rows are repeated for each salt, under
    2000 times in all."""
    total = left.count()
    least = -(-total // HOT_SHARE)
    hot = materialise(
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") * HOT_SHARE >= F.lit(total))
        .select(*keys, F.ceil(F.col("_n") / F.lit(max(1, least))).cast("int").alias("_salts")),
        "hot_keys",
    )
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return dealt.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"]).drop("_salt")


RESULTS = ("verdict", "rule", "value", "since")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (capture_id, url, day) with verdict, rule, value and since (the day from which
    the deciding entry holds). capture_id is unique and not null; url and day may repeat.

    A column of ``captures`` with one of these four names comes out as ``capture_<name>``, with more
    underscores if that is taken too; all others keep their names. A capture without a url or day, or
    without an entry that holds, is allowed; no captures or no entries give as many rows as there are
    captures. Urls of any length are read as a whole."""
    span = lambda day: F.floor(F.col(day) / SPAN_DAYS)
    read = captures.select(
        column(captures, "capture_id"), column(captures, "day"), F.explode(candidates(bare(column(captures, "url")))).alias("one")
    )
    asked = materialise(
        read.filter("day IS NOT NULL").select("capture_id", "day", "one.*", span("day").alias("span")), "asked"
    )
    reach = asked.agg(F.min("span").alias("low"), F.max("span").alias("high")).first()
    low, high = (F.lit(0 if x is None else x) for x in (reach["low"], reach["high"]))
    first = F.greatest(span("from_day"), low)
    last = F.least(F.coalesce(F.floor((F.col("to_day") - 1) / SPAN_DAYS), high), high)
    spread = (
        intervals(entries).withColumn("spans", F.when(first <= last, F.sequence(first, last)))
        .withColumn("span", F.explode("spans"))
        .select("rule", "value", "span", "action", "from_day", "to_day")
    )
    holding = join_spread(asked, spread, ["rule", "value", "span"], "capture_id").filter(
        "from_day <= day AND (to_day IS NULL OR day < to_day)"
    )
    best = holding.groupBy("capture_id").agg(
        F.max_by(F.struct("action", "rule", "value", "from_day"), "weight").alias("best")
    )
    names: list[str] = []
    for c in captures.columns:
        name = f"capture_{c}" if c in RESULTS else c
        while name != c and (name in captures.columns or name in names):
            name += "_"
        names.append(name)
    found = best.select(F.col("capture_id").alias("_capture"), F.struct("best").alias("_found"))
    mine = captures.select(
        column(captures, "capture_id").alias("_capture"),
        F.struct(*[column(captures, c).alias(f"c{k}") for k, c in enumerate(captures.columns)]).alias("_own"),
    )
    entry = F.col("_found.best")
    return mine.join(found, "_capture", "left").select(
        *[F.col(f"_own.c{k}").alias(name) for k, name in enumerate(names)],
        F.coalesce(entry.getField("action"), F.lit("allow")).alias("verdict"),
        entry.getField("rule").alias("rule"),
        entry.getField("value").alias("value"),
        entry.getField("from_day").alias("since"),
    )
