"""Secrets by how many owners share them, in DataFrame operations only.

Fixed patterns find base spans: assigned secrets, access keys and long hexadecimal strings. A
wider pattern proposes opaque strings: 20 or more characters with a small letter, a capital and a
digit. The values of all spans are hashed, and each hash is counted over the corpus by distinct
owners and distinct repositories. A value in at least ``COMMON_OWNERS`` owners or
``COMMON_REPOSITORIES`` repositories is a widely copied example, others look live. Base spans
always stay; an opaque string becomes a span if it looks live and touches no base span.

Texts are read once. Only rows with a match go on, without their texts. A value that many rows
share is counted after distinct (value, owner) rows were made map-side, and its verdict comes back
by ``join_groups``. Null texts are empty; a null owner or repository is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from topicvote.llm.common import column, join_groups
from topicvote.session import materialise

COMMON_OWNERS = 3
COMMON_REPOSITORIES = 6

KINDS = ("assign", "access", "hex", "opaque")
WORDS = "(?i:(password|passwd|secret|token|api_?key))"
ASSIGN = WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
PATTERNS = (ASSIGN, ACCESS, f"(?<![0-9a-f]){HEX}", f"(?<![A-Za-z0-9+/_-]){OPAQUE}")
VALUE_GROUP = (2, 0, 0, 0)
LEAST = (6, 20, 24, 20)


def _matches(text: Column, kind: int) -> Column:
    """Matches of a kind: kind, n, lead (characters since the match before), size, valid, digest.
    What is between matches comes from splitting at them; the pattern has none that are empty."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(VALUE_GROUP[kind]))
    lead = F.split(text, PATTERNS[kind], -1)
    zipped = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(lead, 1, F.size(whole)).alias("lead"))

    def match(m: Column, n: Column) -> Column:
        found = m.getField("value")
        valid = F.length(found) >= LEAST[kind]
        if KINDS[kind] == "opaque":
            valid = valid & found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")
        return F.struct(
            F.lit(kind).alias("kind"),
            n.alias("n"),
            F.length(m.getField("lead")).alias("lead"),
            F.length(m.getField("whole")).alias("size"),
            valid.alias("valid"),
            F.sha2(found, 256).alias("digest"),
        )

    none = "array<struct<kind:int,n:int,lead:int,size:int,valid:boolean,digest:string>>"
    return F.when(text.rlike(PATTERNS[kind]), F.transform(zipped, match)).otherwise(F.array().cast(none))


def scan(docs: DataFrame, id_column: str, text_column: str, owner: Column, repository: Column) -> DataFrame:
    """row, doc_id, owner, repository, matches: written, so that row numbers stay."""
    text = F.coalesce(column(docs, text_column), F.lit(""))
    rows = docs.select(
        column(docs, id_column).alias("doc_id"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.concat(*[_matches(text, k) for k in range(len(KINDS))]).alias("matches"),
    )
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scan")


def ownership(values: DataFrame) -> DataFrame:
    """digest, owners, repositories: distinct ones of each digest (digest, owner, repository)."""
    counts = [
        values.select("digest", F.struct(name).alias("of"))
        .distinct()
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias(total))
        for name, total in (("owner", "owners"), ("repository", "repositories"))
    ]
    return counts[0].join(counts[1], "digest")


def spans(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    common_owners: int = COMMON_OWNERS,
    common_repositories: int = COMMON_REPOSITORIES,
) -> tuple[DataFrame, DataFrame]:
    """The scan, and all spans: row, kind, start, end, digest, owners, repositories, live."""
    rows = scan(docs, id_column, text_column, owner, repository)
    one = F.explode("matches").alias("m")
    placed = W.partitionBy("row", "kind").orderBy("n")
    flat = rows.select("row", "owner", "repository", one).select("row", "owner", "repository", "m.*")
    end = F.sum(F.col("lead") + F.col("size")).over(placed)
    found = materialise(
        flat.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("size"))
        .filter("valid")
        .drop("n", "lead", "size", "valid"),
        "spans",
    )
    judged = join_groups(found, ownership(found), "digest").withColumn(
        "live", (F.col("owners") < common_owners) & (F.col("repositories") < common_repositories)
    )
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(W.partitionBy("row").orderBy("start", "kind"))
    after = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")))
    touched = (F.coalesce(before, F.col("start")) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end"))
    kept = (
        judged.withColumn("touched", touched)
        .filter(base | (F.col("live") & ~F.col("touched")))
        .drop("touched", "owner", "repository")
    )
    return rows, kept


def report(docs: DataFrame, owner: Column, repository: Column, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of every row;
    the last two count spans by what their owners say."""
    rows, kept = spans(docs, owner, repository, **options)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("written"))
    count = lambda test: F.count(F.when(test, 1))
    by_row = kept.groupBy("row").agg(
        *[count(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.array_sort(F.collect_list(one)).alias("found"),
        count(F.col("live")).alias("n_live"),
        count(~F.col("live")).alias("n_example"),
    )
    joined = lambda found: F.array_join(F.transform(found, lambda s: s["written"]), ",")
    full = by_row.select(
        "row",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        "n_live",
        "n_example",
    )
    zero = F.lit(0).cast("long")
    empty = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    names = full.columns[1:]
    without = rows.filter(F.size("matches") == 0).select("doc_id", *[empty.get(n, zero).alias(n) for n in names])
    some = rows.filter(F.size("matches") > 0).select("row", "doc_id").join(full, "row", "left")
    some = some.select("doc_id", *[F.coalesce(n, empty.get(n, zero)).alias(n) for n in names])
    return without.unionByName(some)
