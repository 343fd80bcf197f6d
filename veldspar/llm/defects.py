"""One surviving record for each group of reports of the same defect.

Groups: reports of one repo, owner and kind (spelling aside) whose lines are
linked by steps of at most ``gap``. Lines are linked over the distinct lines
of an owner, not over its reports, so a group of any number of copies costs
one row per line.

Method: iterative truth discovery. A claim is a witness's word for the value
of a field of a defect. Every witness has a reliability; the value with the
highest sum of the reliabilities of its witnesses wins; the reliability of a
witness is the share of its claims that won; both are computed in turns until
the reliabilities stand still.

The witnesses for message, severity and confidence are the sources of the
reports, each with one voice a value however often it repeats it, starting
from the given trust. The value of the field ``record`` is the report that
stands for the defect, and its witnesses are completeness, recency and trust:
each nominates the report that is first by it, then by the next of the three
in turn, then by the least ``ord``. A report at least as complete, recent and
trusted as every other is nominated by all three and wins whatever their
reliabilities are; that all three agree is at the same time the exact check.

Nulls: blank texts, NaN and texts that stand for nothing claim no value. A
source that stands for nothing has trust 0 and shares one reliability. A
report without repo, owner, kind or line is linked to none and stands alone.
A report without a time is less recent than any with one.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.keys import holds_number, holds_something, something, spelling, trimmed
from veldspar.session import checkpointed

_log = logging.getLogger(__name__)

FIELDS = ("message", "severity", "confidence")
#: The witnesses of the field ``record``.
COMPLETE, RECENT, TRUSTED = "#complete", "#recent", "#trusted"
#: Witnesses up to which reliabilities travel inside the plan; those of more are joined as a table.
PLAN_WITNESSES = 10_000


def records(findings: DataFrame, trust: DataFrame, once: bool = True) -> DataFrame:
    """One row per record (``ord``), or per delivery of it, with its group key and its three grades."""
    rated = trust.select(spelling("source").alias("_src"), F.col("trust").cast("int").alias("_trust")).where("_src is not null").groupBy("_src").agg(F.max("_trust").alias("_trust"))
    complete = sum((F.when(h, 1).otherwise(0) for h in (holds_something("message"), holds_number("severity"), holds_something("confidence"), holds_something("source"))), F.lit(0))
    one = findings.select(
        "ord", "repo", trimmed("owning_fqn").alias("owner"), spelling("subcategory").alias("sub"), "line", "reported_at", complete.alias("complete"),
        F.when(holds_something("source"), spelling("source")).otherwise(F.lit("")).alias("_src"),
        something("message").alias("message"), F.when(holds_number("severity"), F.col("severity")).alias("severity"), F.upper(something("confidence")).alias("confidence"),
        F.when(holds_something("source"), spelling("source")).alias("source"),
    ).where("ord is not null")
    if once:
        one = one.groupBy("ord").agg(F.min_by(F.struct(*[c for c in one.columns if c != "ord"]), F.lit(0)).alias("r")).select("ord", "r.*")
    return one.join(F.broadcast(rated), "_src", "left").withColumn("trust", F.coalesce("_trust", F.lit(0))).drop("_trust")


def with_defects(recs: DataFrame, gap: int = 3) -> DataFrame:
    """``recs`` with ``_gkey``: the owner's key and the first line of the linked run."""
    key = ["repo", "owner", "sub"]
    known = F.col("repo").isNotNull() & F.col("owner").isNotNull() & F.col("sub").isNotNull() & F.col("line").isNotNull()
    lines = recs.where(known).select(*key, "line").distinct()
    w = W.partitionBy(*key).orderBy("line")
    starts = lines.withColumn("_new", F.when(F.col("line").cast("long") - F.lag("line").over(w) <= gap, F.lit(None)).otherwise(F.col("line")))
    runs = starts.withColumn("_start", F.last("_new", ignorenulls=True).over(w)).select(*key, "line", "_start")
    joined = recs.join(runs, [*key, "line"], "left")
    return joined.withColumn(
        "_gkey", F.when(F.col("_start").isNotNull(), F.concat_ws("\x00", *key, F.col("_start").cast("string"))).otherwise(F.concat(F.lit("\x01"), F.col("ord").cast("string")))
    ).drop("_start")


def _nominations() -> list[Column]:
    """Aggregates: the report that each witness of ``record`` names, and the least and greatest ``ord``."""
    later, low = F.struct("reported_at").alias("r"), (-F.col("ord")).alias("o")
    turns = {COMPLETE: ("complete", later, "trust"), RECENT: (later, "trust", "complete"), TRUSTED: ("trust", "complete", later)}
    return [*[F.max(F.struct(*turn, low)).alias(w) for w, turn in turns.items()], F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")]


def _merged() -> list[Column]:
    return [*[F.max(w).alias(w) for w in (COMPLETE, RECENT, TRUSTED)], F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord")]


def _record_claims(nominated: DataFrame) -> DataFrame:
    """(gid, field, value, vid, latest, by) for the defects of two records or more."""
    named = F.array(*[F.struct((-F.col(f"`{w}`.o")).alias("vid"), F.lit(w).alias("w")) for w in (COMPLETE, RECENT, TRUSTED)])
    whom = nominated.where("first_ord < last_ord").select("first_ord", named.alias("n"), F.explode(F.array_distinct(F.transform(named, lambda x: x["vid"]))).alias("vid"))
    by = F.transform(F.filter("n", lambda x: x["vid"] == F.col("vid")), lambda x: x["w"])
    return whom.select(F.col("first_ord").alias("gid"), F.lit("record").alias("field"), F.lit(None).cast("string").alias("value"), "vid", F.lit(None).cast("timestamp_ntz").alias("latest"), by.alias("by"))


def _field_claims(recs: DataFrame) -> DataFrame:
    """The claims of the sources, one row a value."""
    claim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS])).alias("c")
    claims = recs.select("gid", "ord", "_src", "reported_at", claim).select("gid", "ord", "_src", "reported_at", "c.field", "c.value").where("value is not null")
    return claims.groupBy("gid", "field", "value").agg(F.min("ord").alias("vid"), F.max("reported_at").alias("latest"), F.collect_set("_src").alias("by")).select("gid", "field", "value", "vid", "latest", "by")


def discovered(claims: DataFrame, start: dict[str, float], max_rounds: int | None = None, tolerance: float = 1e-3) -> tuple[DataFrame, dict[str, float]]:
    """((gid, field, value, vid, by, votes) of the winners, witness -> reliability).

    ``claims`` is (gid, field, value, vid, latest, by): a row per value with
    the witnesses that claim it; ``vid`` tells the values of a field apart.
    Of equal votes the latest wins, then the least ``vid``. Only values that
    another one contests are voted on again; the others win in every round.
    Witnesses absent from ``start`` begin at one half.

    Rounds go on until no reliability moves by more than ``tolerance``. They
    end too when reliabilities come back that were there before, since they
    would then go round for ever; ``max_rounds`` can bound them. How many there
    were, the last change and what ended them is logged.
    """
    claims = checkpointed(claims)
    key = ["gid", "field"]

    def counted(rows: DataFrame) -> dict[str, int]:
        """A row per witness; witnesses are classes of tools and criteria."""
        return {r.w: r.n for r in rows.select(F.explode("by").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}

    every = counted(claims)
    reliability = {w: start.get(w, 0.5) for w in sorted(every)}
    contested = claims.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key)
    open_ = checkpointed(claims.select(*key, "vid", "latest", "by").join(contested, key, "left_semi"))
    all_open = counted(open_)
    seen, rounds, change = {tuple(reliability.items())}, 0, float("inf")
    while max_rounds is None or rounds < max_rounds:
        right = counted(_elected(open_, reliability))
        new = {w: (n - all_open.get(w, 0) + right.get(w, 0) + 1) / (n + 2) for w, n in every.items()}
        change = max((abs(new[w] - reliability[w]) for w in new), default=0.0)
        reliability = {w: new[w] for w in sorted(new)}
        rounds += 1
        state = tuple(reliability.items())
        if change <= tolerance or state in seen:
            break
        seen.add(state)
    _log.info("truth discovery: %d rounds, last change %.6f, %s", rounds, change, "settled" if change <= tolerance else "not settled")
    return _elected(claims, reliability, "value"), reliability


def _elected(values: DataFrame, reliability: dict[str, float], *carried: str) -> DataFrame:
    """The winner of each (gid, field), with its witnesses and votes."""
    if len(reliability) <= PLAN_WITNESSES:
        weights = F.from_json(F.lit(json.dumps(reliability)), "map<string,double>")
        votes = F.aggregate("by", F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
        weighed = values.withColumn("votes", F.round(votes, 9))
    else:
        table = values.sparkSession.createDataFrame(list(reliability.items()), "w string, weight double")
        key = ["gid", "field", "vid"]
        sums = values.select(*key, F.explode("by").alias("w")).join(table, "w").groupBy(*key).agg(F.round(F.sum("weight"), 9).alias("votes"))
        weighed = values.join(sums, key)
    top = F.max(F.struct("votes", "latest", (-F.col("vid")).alias("low"), "by", *carried))
    return weighed.groupBy("gid", "field").agg(top.alias("t")).select("gid", "field", *[F.col(f"t.{c}").alias(c) for c in carried], (-F.col("t.low")).alias("vid"), F.col("t.by").alias("by"), F.col("t.votes").alias("votes"))


def representatives(findings: DataFrame, trust: DataFrame, gap: int = 3, max_rounds: int | None = None) -> DataFrame:
    """(first_ord, best_ord, is_best) of the defects of two records or more.

    The records are graded and nominated line by line before anything is
    moved, so a defect of any number of copies is a row per line.
    """
    key = ["repo", "owner", "sub"]
    recs = records(findings, trust, once=False)
    for k in (*key, "line"):
        recs = recs.where(F.col(k).isNotNull())
    lines = recs.groupBy(*key, "line").agg(*_nominations())
    w = W.partitionBy(*key).orderBy("line")
    new = F.when(F.col("line").cast("long") - F.lag("line").over(w) <= gap, 0).otherwise(1)
    runs = lines.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(*key, "_run").agg(*_merged())
    winners, _ = discovered(_record_claims(runs), {}, max_rounds)
    return winners.select(F.col("gid").alias("first_ord"), F.col("vid").alias("best_ord"), (F.size("by") == 3).alias("is_best"))


def numbered(grouped: DataFrame) -> DataFrame:
    """``gid``, the least ``ord`` of the defect, in place of its long key."""
    ids = grouped.groupBy("_gkey").agg(F.min("ord").alias("gid"))
    return grouped.join(ids, "_gkey").drop("_gkey")


def best_records(findings: DataFrame, trust: DataFrame, gap: int = 3, max_rounds: int | None = None) -> DataFrame:
    """One row per defect.

    (first_ord, repo, owner, sub, first_line, last_line, n_records, best_ord,
    is_best, message, severity, confidence, source, support). ``best_ord`` is
    the elected record; ``is_best`` says that completeness, recency and trust
    all named it. ``source`` is that of the most trusted, latest report that
    has one; ``support`` the votes of the three values.
    """
    recs = checkpointed(numbered(with_defects(records(findings, trust), gap)))
    nominated = recs.groupBy("gid").agg(*_nominations())
    start = {r._src: (r.t + 1) / 6 for r in recs.groupBy("_src").agg(F.max("trust").alias("t")).collect()}  # a row per source
    winners, _ = discovered(_field_claims(recs).unionByName(_record_claims(nominated)), start, max_rounds)
    elected = winners.groupBy("gid").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS], F.round(F.sum(F.when(F.col("field") != "record", F.col("votes"))), 6).alias("support"),
        F.max(F.when(F.col("field") == "record", F.struct("vid", F.size("by").alias("n")))).alias("rec"),
    )
    tops = recs.groupBy("gid").agg(
        F.min_by(F.struct("repo", "owner", "sub"), "ord").alias("k"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n_records"),
        F.max(F.when(F.col("source").isNotNull(), F.struct("trust", "reported_at", "source")))["source"].alias("source"),
    )
    out = tops.join(elected, "gid", "left").withColumnRenamed("gid", "first_ord")
    return out.select(
        "first_ord", "k.repo", "k.owner", "k.sub", "first_line", "last_line", "n_records", F.coalesce("rec.vid", "first_ord").alias("best_ord"), F.coalesce(F.col("rec.n") == 3, F.lit(True)).alias("is_best"),
        "message", F.col("severity").cast("double").alias("severity"), "confidence", "source", "support",
    )
