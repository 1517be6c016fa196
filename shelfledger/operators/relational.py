"""Relational helpers that stay linear under a hot key.

A window puts a whole group into one task, so windows run only over data already
aggregated to a bounded grain (a calendar day, a block of positions). Everything
on raw rows is a grouped aggregate joined back on its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import bankers_round, first_by, safe_div


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Join on shared names, NULL matching NULL; the left key columns are kept."""
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_any(left: DataFrame, right: DataFrame, keys: Sequence[str],
             order: Sequence[str]) -> DataFrame:
    """Left join keeping one match per key: the first by ``order``.

    The choice is an aggregate (``min_by``), so map tasks reduce hot keys first.
    """
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_one"))
    return left.join(one, list(keys), "left").select(
        *left.columns, *[F.col(f"_one.{c}").alias(c) for c in rest])


def join_hot(left: DataFrame, right: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """Left join on one key, whose hot values are dealt to several tasks and whose NULLs meet no join.

    A key is hot that has more than one in ``least`` of the left rows; there are fewer than
    ``least`` of these whatever the data, so their list is broadcast. A hot key's rows
    are dealt by their content to as many parts as ``least`` times its share, and the right
    row, of which there is one for a key, is repeated for each part.
    """
    known = left.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = (counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * least > F.col("_all"))  # one row
           .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") * least / F.col("_all")).cast("int").alias("_parts")))
    dealt = known.join(F.broadcast(hot), known[key] == hot["_hot"], "left")
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*left.columns), F.col("_parts"))).otherwise(0).cast("int")
    dealt = dealt.withColumn("_part", part).drop("_hot", "_parts")
    rest = [c for c in right.columns if c != key]
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    repeated = (right.join(F.broadcast(hot), right[key] == hot["_hot"], "left")
                .select(F.col(key).alias("_key"), copies.alias("_copy"), *rest))
    met = dealt.join(repeated, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_copy")), "left")
    kinds = {f.name: f.dataType for f in right.schema}
    without = left.filter(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    return met.select(*left.columns, *rest).unionByName(without)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows carrying the latest ``ts`` of their key, ties kept.

    Joined back on key and time together, so one key's history is spread over
    the tasks instead of sorted in one.
    """
    top = df.groupBy(*keys).agg(F.max(ts).alias("_ts"))
    top = top.select(*[F.col(k).alias(f"_{k}") for k in keys], "_ts")
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(top[f"_{k}"]) for k in keys],
                  df[ts] == top["_ts"])
    return df.join(top, cond, "left_semi")


def share_of(df: DataFrame, keys: Sequence[str], value: str, out: str,
             digits: int | None = None) -> DataFrame:
    """Value over its group total, the totals joined back; no keys means the grand total."""
    if keys:
        totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
        joined = join_null_safe(df, totals, keys)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("_total"))))  # one row
    share = safe_div(F.col(value), F.col("_total"))
    if digits is not None:
        share = bankers_round(share, digits)
    return joined.withColumn(out, share).drop("_total")


def top1(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Row with the largest value per key; ties go to the lowest ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(tie))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def pick_other_row(df: DataFrame, cond: Column, value: str, out: str) -> DataFrame:
    """Attach one row's value to every row (a scalar lookup, NULL when absent)."""
    return df.crossJoin(F.broadcast(df.filter(cond).agg(F.max(value).alias(out))))  # one row


def first_known(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """Every row with the first known ``value`` of its group by ``order``; NULL where none is known.

    The choice is an aggregate joined back, so a large group is reduced where it lies.
    """
    one = df.groupBy(*keys).agg(first_by(value, order).alias("_first"))
    return join_null_safe(df, one, keys).withColumn(out, F.col("_first")).drop("_first")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_time: str,
              value: str) -> DataFrame:
    """Latest ``value`` of the key set strictly before the left row's day; of one day, the last.

    Both sides shrink to one row per key and day before the only window, which
    therefore sees at most two rows per calendar day; no pair of a left and a
    right row is formed except the final equi-join's single match.
    """
    days = right.groupBy(key, F.to_date(right_time).alias("_day")).agg(F.max_by(value, right_time).alias("_v"))
    asked = left.select(key, F.col(left_day).alias("_day")).distinct()
    both = (days.withColumn("_q", F.lit(False))
            .unionByName(asked.select(key, "_day", F.lit(None).cast(days.schema["_v"].dataType).alias("_v"),
                                      F.lit(True).alias("_q"))))
    # A question sorts before the values of its own day, so equal days do not match.
    w = W.partitionBy(key).orderBy("_day", F.col("_q").desc()).rowsBetween(W.unboundedPreceding, -1)
    answers = (both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
               .filter("_q").select(F.col(key).alias("_k"), "_day", value))
    return (left.join(answers, (left[key] == answers["_k"]) & (left[left_day] == answers["_day"]), "left")
            .drop("_k", "_day"))


def transpose_long(df: DataFrame, ids: Sequence[str], values: Sequence[tuple[str, str]],
                   name: str = "index", value: str = "value") -> DataFrame:
    """Wide to long with labelled rows, in the given order (``index_no``)."""
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("index_no"), F.lit(label).alias(name),
                 F.col(c).cast("double").alias(value))
        for i, (c, label) in enumerate(values)])
    return df.select(*ids, F.explode(rows).alias("_r")).select(
        *ids, "_r.index_no", f"_r.{name}", f"_r.{value}")


def hierarchy_root(nodes: DataFrame, node: str, parent: str, out: str,
                   materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Topmost ancestor of every node; NULL for a node without parent.

    Every round doubles the distance each pointer spans, so a tree of depth d
    takes log2(d) joins. A round that brings no further node to a root proves
    that the rest sits on or below a cycle; those nodes get NULL. Each round is
    written out, which keeps the plan flat and survives lost executors.
    """
    ids = nodes.select(F.col(node).alias("_id"))
    links = nodes.filter(F.col(parent).isNotNull()).select(
        F.col(node).alias("_id"), F.col(parent).alias("_anc"))
    links = links.join(ids.withColumnRenamed("_id", "_anc"), "_anc", "left_semi").select("_id", "_anc")
    up = links.select(F.col("_id").alias("_anc"), F.lit(True).alias("_more"))
    jump = materialize(links.join(up, "_anc", "left").select(
        "_id", "_anc", F.col("_more").isNull().alias("_done")))
    open_before = None
    while True:
        open_now = jump.filter(~F.col("_done")).count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        far = jump.select(F.col("_id").alias("_anc"), F.col("_anc").alias("_far"),
                          F.col("_done").alias("_far_done"))
        moved = jump.filter(~F.col("_done")).join(far, "_anc").select(
            "_id", F.col("_far").alias("_anc"), F.col("_far_done").alias("_done"))
        jump = materialize(jump.filter("_done").unionByName(moved))
    roots = jump.filter("_done").select(F.col("_id").alias(node), F.col("_anc").alias(out))
    return nodes.join(roots, node, "left")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union all by name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
