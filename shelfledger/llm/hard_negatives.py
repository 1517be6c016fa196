"""Hard negatives by a vertical scan of dimensions (BOND).

Vectors lie column by column. For an anchor the dimensions are read in descending order
of the anchor's magnitude; after each few of them, the least and greatest contribution
that the remaining ones can still make bound every candidate's score, and candidates that
cannot be among the results leave the bitmap. What is left after the last dimension has
its exact score. Scores are integers, so bounds and windows are exact.

All anchors meet all rows, in blocks: the rows in parts, and the anchors in parts, each
pair of parts one group. A first pass finds each anchor's best rows of its own label, a
second one the best of other labels in the windows below their scores. Each part gives a
few rows for an anchor; these are merged. No part depends on labels, so a hot label or a
common vector lies in many parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Candidates so few that the remaining dimensions are read at once.
FEW = 16
#: Rows and anchors that meet in one group at most, about.
ROWS, ANCHORS = 1 << 16, 1 << 13
#: Components beyond are taken as this, so that a score of up to 65,536 dimensions fits a long.
LIMIT = 1 << 23
#: Stands for a null vec_id, which comes after all others in ties.
NO_ID = (1 << 63) - 1


def usable(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, ``v`` in integers."""
    x = F.col("embedding")
    fit = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == float("inf")))
    limit = F.lit(LIMIT).cast("double")
    whole = F.transform(x, lambda c: F.greatest(-limit, F.least(limit, F.floor(c.cast("double") * SCALE).cast("double"))).cast("int"))
    return rows.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label").cast("long") if label is None else label).alias("label"), whole.alias("v"))


def matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A row for each dimension; short vectors end in zeros."""
    flat = vectors.combine_chunks()
    ends = flat.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), dims))
    at = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat.flatten().to_numpy()
    return out.T.copy()


class Scan:
    """Rows of a part, by label, dimension by dimension."""

    def __init__(self, rows: pa.Table, dims: int) -> None:
        ids = rows["vec_id"].to_numpy()
        labels = rows["label"].to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.columns = matrix(rows["v"], dims)[:, order]
        self.bounds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]))

    def range(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest value of each dimension there."""
        if (start, stop) not in self.bounds:
            part = self.columns[:, start:stop]
            self.bounds[start, stop] = part.min(axis=1), part.max(axis=1)
        return self.bounds[start, stop]

    def read(self, anchor: np.ndarray, start: int, stop: int, stays: Callable[[np.ndarray, float, float], np.ndarray],
             without: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
        """Rows from ``start`` to ``stop`` but for ``without`` that stay to the end, and their exact scores.

        ``stays`` takes scores so far and what the remaining dimensions add at least and at
        most, and gives a bitmap.
        """
        if start == stop or (start, stop) == without:
            return np.zeros(0, int), np.zeros(0, np.int64)
        low, high = self.range(start, stop)
        most = np.abs(anchor) @ np.maximum(np.abs(low), np.abs(high))
        kind = np.float64 if most < 2 ** 52 else np.int64  # both exact
        anchor = anchor.astype(kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        low, high = (anchor[order] * x[order].astype(kind) for x in (low, high))
        rest = [np.append(np.cumsum(f(low, high)[::-1])[::-1], 0) for f in (np.minimum, np.maximum)]
        at, score = None, np.zeros(stop - start, kind)
        if without[0] < without[1]:
            at = np.r_[start:without[0], without[1]:stop]
            score = np.zeros(len(at), kind)
        k = 0
        while k < len(order):
            end = len(order) if len(score) <= FEW else min(k + STEP, len(order))
            dims = order[k:end]
            part = self.columns[dims, start:stop] if at is None else self.columns[dims[:, None], at]
            score = score + anchor[dims] @ part.astype(kind, copy=False)
            k = end
            keep = stays(score, rest[0][k], rest[1][k])
            if not keep.all():
                at = np.flatnonzero(keep) + start if at is None else at[keep]
                score = score[keep]
            if not len(score):
                break
        return np.arange(start, stop) if at is None else at, score.astype(np.int64)


def top(ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n``: higher scores, then smaller ids."""
    if len(score) > 4 * n:
        least = np.partition(score, -n)[-n]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((ids[near], -score[near]))[:n]]
    return np.lexsort((ids, -score))[:n]


def positives(scan: Scan, vec_id: int, label: int, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the part's first ``n`` rows of the anchor's label but for the anchor."""
    start, stop = scan.label(label)
    own = int((scan.ids[start:stop] == vec_id).sum())

    def stays(score: np.ndarray, low: float, high: float) -> np.ndarray:
        # the anchor's own rows may be among the best
        if len(score) <= n + own:
            return np.ones(len(score), bool)
        return score + high >= np.partition(score, -(n + own))[-(n + own)] + low

    at, score = scan.read(anchor, start, stop, stays)
    other = scan.ids[at] != vec_id
    at, score = at[other], score[other]
    best = top(scan.ids[at], score, n)
    return scan.ids[at[best]], score[best]


def negatives(scan: Scan, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ids and scores of the part's first ``n`` rows of other labels in it."""
    def stays(score: np.ndarray, low: float, high: float) -> np.ndarray:
        out = np.zeros(len(score), bool)
        for least, most in windows:
            may = (score + high >= least) & (score + low <= most)
            sure = score[(score + low >= least) & (score + high <= most)]
            if len(sure) >= n:
                may &= score + high >= np.partition(sure, -n)[-n] + low
            out |= may
        return out

    at, score = scan.read(anchor, 0, len(scan.ids), stays, scan.label(label)) if windows else (np.zeros(0, int), np.zeros(0, np.int64))
    out = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        best = inside[top(scan.ids[at[inside]], score[inside], n)]
        out.append((scan.ids[at[best]], score[best]))
    return out


def met(rows: DataFrame, anchors: DataFrame, parts: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every part of ``rows`` with every part of ``anchors``."""
    p, q = parts
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # ids may repeat, so rows are dealt by their place in the files
    left = rows.withColumn("i", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(p)).cast("int")).withColumn("j", every(q))
    right = anchors.withColumn("j", F.pmod(F.xxhash64("key"), F.lit(q)).cast("int")).withColumn("i", every(p))
    return (left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
            .applyInArrow(lambda a, b: run(a, b), schema))


def first(rows: DataFrame, keys: list[str], score: str, vec_id: str, n: int, rank: str) -> DataFrame:
    """The first ``n`` of each key, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(vec_id))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def mine(rows: DataFrame, anchors_of: Column, n_positives: int = 5, n_negatives: int = 5, least: int = 80, label: Column | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``anchors_of`` holds; ``label`` may replace the label.
    For an anchor and each of its first ``n_positives`` other rows of its label, the first
    ``n_negatives`` rows of other labels whose score lies between ``least`` percent of the
    positive's and the positive's. Higher scores come first, then smaller ids.

    Rows without label or vector, or with a null or non-finite component, take no part. A
    null vec_id takes part and comes last in ties. Rows that share the anchor's vec_id are
    not its other rows; other repeated rows each count. Vectors may differ in length, short
    ones end in zeros; components beyond 2^15 count as that. An anchor without positives, or
    whose positives' scores are negative, gives no row, as does an empty table. Other
    columns are not read.
    """
    spark = rows.sparkSession
    rows = usable(rows, label)
    known = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    anchors = cut(rows.filter(anchors_of).withColumn("key", F.monotonically_increasing_id()).select("key", "vec_id", "label", "v"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    q = max(1, -(-anchors.count() // ANCHORS))
    p = max(1, -(-n // ROWS), -(-spark.sparkContext.defaultParallelism // q))

    def plus(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(a) and len(b):
            scan, vectors = Scan(a, dims), matrix(b["v"], dims).T.copy()
            for k, i, l, v in zip(b["key"].to_pylist(), b["vec_id"].to_pylist(), b["label"].to_pylist(), vectors):
                ids, score = positives(scan, i, l, v, n_positives)
                for column, x in zip(out, (np.full(len(ids), k), ids, score)):
                    column.append(x)
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in zip(("key", "positive_id", "positive_score"), out)})

    best = cut(first(met(known, anchors, (p, q), plus, "key long, positive_id long, positive_score long"),
                     ["key"], "positive_score", "positive_id", n_positives, "nth"))
    scored = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("best"))
    asking = anchors.join(scored.select("key", F.col("best.nth").alias("nth"), F.col("best.positive_score").alias("scores")), "key")

    def minus(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(a) and len(b):
            scan, vectors = Scan(a, dims), matrix(b["v"], dims).T.copy()
            for k, l, v, nth, scores in zip(b["key"].to_pylist(), b["label"].to_pylist(), vectors, b["nth"].to_pylist(), b["scores"].to_pylist()):
                wanted = [(m, (-(-least * s // 100), s)) for m, s in zip(nth, scores) if least * s <= 100 * s]
                for (m, _), (ids, score) in zip(wanted, negatives(scan, l, v, [w for _, w in wanted], n_negatives)):
                    for column, x in zip(out, (np.full(len(ids), k), np.full(len(ids), m), ids, score)):
                        column.append(x)
        kinds = (np.int64, np.int32, np.int64, np.int64)
        return pa.table({c: np.concatenate([np.zeros(0, kind), *x]).astype(kind) for c, kind, x in zip(("key", "nth", "negative_id", "negative_score"), kinds, out)})

    found = first(met(known, asking, (p, q), minus, "key long, nth int, negative_id long, negative_score long"),
                  ["key", "nth"], "negative_score", "negative_id", n_negatives, "rank")
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (found.join(best, ["key", "nth"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", name("positive_id"), "rank", name("negative_id"), "positive_score", "negative_score"))


def noisy_label(every: int = 7, labels: int = 10) -> Column:
    """The next label where ``every`` divides vec_id."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)
