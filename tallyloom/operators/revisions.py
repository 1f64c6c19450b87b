"""Revisions of reports: chains of superseded ones, the current one of each, and what changed.

A committed report is never edited: a correction is a draft on top of the revision it corrects, and once published
it supersedes that one, which stays. A table of revisions has ``revision_id``, ``parent_id`` (null for a first one)
and ``status`` (DRAFT, PUBLISHED or SUPERSEDED).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of pointer doubling: chains of up to 2 ** 40 revisions.
MOST_ROUNDS = 40


def rooted(revisions: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Every revision with ``root_id``, the first of its chain, and ``depth``, its steps from there.

    Pointers are doubled: after k rounds each row knows its ancestor 2 ** k steps up, so a chain of n takes log2(n)
    joins on ids rather than n. Each round is written by ``store`` (frame, name), so neither lineage nor lost
    executors make earlier rounds run again, and only rows that haven't reached their root are joined.
    A parent that isn't in the table ends a chain, as a null one does. Revisions in a circle get no root; both are null.
    """
    ids = revisions.select(F.col("revision_id").alias("known_id"))
    rows = revisions.select("revision_id", "parent_id").join(ids, F.col("parent_id") == F.col("known_id"), "left")
    rows = rows.select("revision_id", F.coalesce("known_id", "revision_id").alias("up"), F.col("known_id").isNotNull().cast("long").alias("depth"), F.col("known_id").isNull().alias("done"))
    rows = store(rows, "pointers-0")
    open_ = rows.where(~F.col("done")).count()
    for k in range(1, MOST_ROUNDS + 1):
        if not open_:
            break
        above = rows.select(F.col("revision_id").alias("above_id"), F.col("up").alias("above_up"), F.col("depth").alias("above_depth"), F.col("done").alias("above_done"))
        moved = rows.where(~F.col("done")).join(above, F.col("up") == F.col("above_id")).select("revision_id", F.col("above_up").alias("up"), (F.col("depth") + F.col("above_depth")).alias("depth"), F.col("above_done").alias("done"))
        rows = store(rows.where("done").unionByName(moved), f"pointers-{k}")
        left = rows.where(~F.col("done")).count()
        # Rows on a circle never end; they are all that is left once a whole round settles nobody.
        if left == open_:
            break
        open_ = left
    known = rows.where("done").select(F.col("revision_id").alias("id_"), F.col("up").alias("root_id"), "depth")
    return revisions.join(known, F.col("revision_id") == F.col("id_"), "left").drop("id_")


def current(rows: DataFrame) -> DataFrame:
    """For each chain the published revision furthest from the root, null if none is, and the numbers of revisions and drafts.

    Of two published at one depth, a fork, the one of greater id is current; ``forked`` says that there were several.
    """
    published = F.col("status") == "PUBLISHED"
    last = F.max(F.when(published, F.struct("depth", "revision_id")))
    got = rows.where(F.col("root_id").isNotNull()).groupBy("root_id").agg(last.alias("last"), F.count(F.lit(1)).alias("n_revisions"), F.count_if(F.col("status") == "DRAFT").alias("n_drafts"), F.count_if(published).alias("n_published"))
    return got.select("root_id", F.col("last.revision_id").alias("current_id"), F.col("last.depth").alias("depth"), "n_revisions", "n_drafts", (F.col("n_published") > 1).alias("forked"))


def publish(revisions: DataFrame, drafts: DataFrame) -> DataFrame:
    """The table after the drafts named by ``revision_id`` are published: each supersedes its parent.

    A draft whose parent isn't published any more is stale: it stays a draft. ``outcome`` says what became of a named one.
    """
    named = drafts.select(F.col("revision_id").alias("named_id")).distinct()
    state = revisions.select(F.col("revision_id").alias("up_id"), F.col("status").alias("up_status"))
    rows = revisions.join(named, F.col("revision_id") == F.col("named_id"), "left").join(state, F.col("parent_id") == F.col("up_id"), "left")
    fresh = F.col("up_id").isNull() | (F.col("up_status") == "PUBLISHED")
    outcome = F.when(F.col("named_id").isNull(), None).when(F.col("status") != "DRAFT", "NOT_A_DRAFT").when(~fresh, "STALE").otherwise("PUBLISHED")
    rows = rows.withColumn("outcome", outcome)
    # Of several drafts on one parent only the smallest id is published; the others have become stale by it.
    winners = rows.where("outcome = 'PUBLISHED' AND up_id IS NOT NULL").groupBy("up_id").agg(F.min("revision_id").alias("winner_id"))
    rows = rows.join(winners.withColumnRenamed("up_id", "won_up"), F.col("up_id") == F.col("won_up"), "left")
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "PUBLISHED") & F.col("winner_id").isNotNull() & (F.col("winner_id") != F.col("revision_id")), "STALE").otherwise(F.col("outcome")))
    over = winners.select(F.col("up_id").alias("over_id"))
    rows = rows.drop("named_id", "up_id", "up_status", "won_up", "winner_id").join(over, F.col("revision_id") == F.col("over_id"), "left")
    status = F.when(F.col("outcome") == "PUBLISHED", "PUBLISHED").when(F.col("over_id").isNotNull(), "SUPERSEDED").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("over_id")


def differences(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """What each revision changed against another: ``revision_id``, ``before_id``, ``code``, both values and ``change``.

    ``facts``: revision_id, code, value; ``pairs``: revision_id, before_id. Facts that are equal, null and null included, aren't listed.
    Either side is shuffled once, by pair and code; no side has to fit anywhere.
    """
    side = lambda key, name: pairs.join(facts.withColumnRenamed("revision_id", "fact_of"), F.col(key) == F.col("fact_of")).select(F.col("revision_id"), F.col("before_id"), "code", F.struct("value").alias(name))
    both = side("revision_id", "after").withColumn("before", F.lit(None).cast(f"struct<value:{facts.schema['value'].dataType.simpleString()}>"))
    both = both.unionByName(side("before_id", "before").withColumn("after", F.lit(None).cast(f"struct<value:{facts.schema['value'].dataType.simpleString()}>")))
    got = both.groupBy("revision_id", "before_id", "code").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(~F.col("before.value").eqNullSafe(F.col("after.value")), "CHANGED")
    return got.withColumn("change", change).where(F.col("change").isNotNull()).select("revision_id", "before_id", "code", F.col("before.value").alias("before"), F.col("after.value").alias("after"), "change")
