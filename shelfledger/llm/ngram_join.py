"""Exact similarity join of shingle sets in the metric space of the Jaccard distance.

Documents are sets of shingles; the distance 1 - similarity is a metric. Equal sets are
one point. Pivots cut the space into Voronoi regions, and what may have a partner beyond a
region's border is also put there:

* First every shingle is a pivot, a set of one element. A point lies nearest to the pivots
  among its own shingles; the rarest of them is its home. A partner within the radius
  lacks at most the radius' share of the point's shingles, so the first that both have,
  rarest first, is among that many and one more. The point is replicated into these
  regions and no other; two linked points share a region. Unlike texts part here.
* The distance of two points is bounded from below by their sizes and by parity sketches of
  about a bit for each shingle, whose Hamming distance never exceeds the symmetric
  difference; where the bound is within the radius the distance is measured on the texts.
* A region of ``LEAF`` points at most is a leaf: a task compares its sketches. First it gives out
  no more pairs than would connect its points, which are measured; then, if several
  components are left, all pairs of different ones that were not measured yet.
* In a larger region points are pivots. Points within the radius of a pivot
  are its cell, and linked through it. By the triangle inequality a partner of a point x
  lies at most the radius further from a pivot p than x does; if all that may lie so near
  belong to x's component by then, x is done. Pivots are done too, and regions of one
  component. What is left is a region again, with more pivots, or a leaf.

So each region is joined exactly, and a group of thousands of near copies costs a few
distances for each of them, not one for each pair. Regions with the same points, as near copies make
many, are one region. Any order of shingles is right; rarity, taken from counts of 65,536
hash classes over all documents, only keeps regions small. Sets are never written; the
texts that are measured move, one for each different set.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, shared_folder

#: Words in a shingle, and the least percentage of the union that linked sets share.
WORDS, LEAST = 3, 90
#: Hash classes that shingles are counted by.
CLASSES = 1 << 16
#: Bits of the shortest and the longest sketch.
SKETCH = 1 << 6, 1 << 15
#: Buckets by which the texts that are needed again are told from others before they move.
BUCKETS = 1 << 20
#: Words whose hashes a worker keeps.
KNOWN = 1 << 18
#: Points of a region whose sketches are compared in a task.
LEAF = 1 << 14
#: Rows that are compared or given out at a time, and bytes of sketches that are.
ROWS, BLOCK = 1 << 14, 1 << 22
#: By how much the pivots of a region grow from round to round.
MORE = 16

KEY = ["k1", "k2"]


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Shingles:
    """Sets of hashed shingles of texts."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = [np.uint64(xxhash.xxh64_intdigest(b"%d" % k, 1) | 1) for k in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes in ascending order."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
        if len(found) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(found), 2)] if found else [], np.uint64)
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = len(h) - self.words + 1
        with np.errstate(over="ignore"):
            out = sum(h[k:k + n] * f for k, f in enumerate(self.factors))
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out ^ (out >> np.uint64(29)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of as many classes as there are hashes, to the next power of two."""
    low, high = SKETCH
    bits = min(max(low, 1 << max(len(hashes) - 1, 1).bit_length()), high)
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ, the longer sketch folded to the length of the other."""
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    m, n = len(a), len(b)
    while m > n:
        m //= 2
        x = (x >> 8 * m) ^ (x & (1 << 8 * m) - 1)
    while n > m:
        n //= 2
        y = (y >> 8 * n) ^ (y & (1 << 8 * n) - 1)
    return (x ^ y).bit_count()


def class_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Documents with a shingle of each hash class; as many numbers at any size of the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, count = Shingles(words), np.zeros(CLASSES, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                count += np.bincount((shingles(t) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count)), pa.array(count[count > 0])], ["class", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select("text").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def placed_rows(docs: DataFrame, words: int, least: int) -> DataFrame:
    """``(doc_id, tag, k1, k2, n, sketch, regions)`` of each row.

    ``tag`` is a hash of the text, ``k1`` and ``k2`` the key of the set in 128 bits, ``n`` its
    size. ``regions`` are the shingles that a linked set may have first in common with
    it, by rarity; sets so small that only an equal one links have none.
    """
    counts = class_counts(docs, words)

    def regions(h: np.ndarray) -> np.ndarray:
        n = len(h)
        if 100 * n < least * (n + 1):
            return h[:0].view(np.int64)
        lacks = n - -(-n * least // 100)
        rare = counts[(h % np.uint64(CLASSES)).astype(np.int64)]
        near = np.flatnonzero(rare <= np.partition(rare, lacks)[lacks])
        return h[near[np.lexsort((h[near], rare[near]))[:lacks + 1]]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([sketch(s) for s in sets], pa.binary()), pa.array([regions(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "tag", *KEY, "n", "sketch", "regions"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(
        run, f"doc_id {kind}, tag long, k1 long, k2 long, n long, sketch binary, regions array<long>")


def bounded(pairs: DataFrame, points: DataFrame, most: float) -> DataFrame:
    """``(id, pivot, n, p_n, bound)``: a lower bound of the distance of each pair ``(id, pivot)`` of points, where it is ``most`` at most.

    The symmetric difference is at least that of the sizes and the bits in which the
    sketches differ; greater differences make greater distances.
    """
    names = ["id", "pivot", "n", "p_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(c) for c in (*names, "sketch", "p_sketch")}
            bits = np.array([differing(x, y) for x, y in zip(at["sketch"].to_pylist(), at["p_sketch"].to_pylist())], np.int64)
            n, p = (at[c].to_numpy() for c in ("n", "p_n"))
            least = np.maximum(bits, np.abs(n - p))
            bound = 2 * least / (n + p + least)
            yield pa.RecordBatch.from_arrays([*(at[c] for c in names), pa.array(bound)], [*names, "bound"]).filter(pa.array(bound <= most))

    own = points.select("id", "n", "sketch")
    other = points.select(F.col("id").alias("pivot"), F.col("n").alias("p_n"), F.col("sketch").alias("p_sketch"))
    return pairs.join(own, "id").join(other, "pivot").mapInArrow(run, "id long, pivot long, n long, p_n long, bound double")


def measured(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``(id, pivot, both)``: the number of shingles that the points of each pair both have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            # the pairs of a pivot follow each other
            last, known, both = None, None, []
            for t, p in zip(b.column("text").to_pylist(), b.column("p_text").to_pylist()):
                if p != last:
                    last, known = p, shingles(p)
                both.append(len(np.intersect1d(shingles(t), known, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pivot"), pa.array(both, pa.int64())], ["id", "pivot", "both"])

    other = texts.select(F.col("id").alias("pivot"), F.col("text").alias("p_text"))
    return pairs.select("id", "pivot").join(texts, "id").join(other, "pivot").mapInArrow(run, "id long, pivot long, both long")


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their regions, some regions at a time and none cut."""
    held, n = [], 0
    for b in batches:
        r = b.column("region").to_numpy()
        starts = np.flatnonzero(np.append(not held or held[-1].column("region")[-1].as_py() != r[0], r[1:] != r[:-1])) if len(r) else []
        if len(starts) and n + starts[-1] >= ROWS:
            yield pa.concat_batches([*held, b.slice(0, starts[-1])])
            held, n, b = [], 0, b.slice(starts[-1])
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.concat_batches(held)


def near_rows(rows: pa.RecordBatch, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that :func:`leaf_pairs` asks for, among whole regions in the order of region and size."""
    region, roots, sizes, seen = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("region", "root", "n", "seen"))
    raw = rows.column("sketch").to_pylist()
    bits, count = np.array([8 * len(x) for x in raw]), len(raw)
    # sketches of each length, and those of like sizes that are longer, folded to it
    folded, place = {}, {}
    for wide in np.unique(bits):
        near = np.flatnonzero((bits >= wide) & (sizes * (1 - radius) <= sizes[bits == wide].max() + 1))
        folded[wide], place[wide] = np.empty((len(near), wide // 64), np.uint64), np.zeros(count, np.int64)
        place[wide][near] = np.arange(len(near))
        for v in np.unique(bits[near]):
            of = bits[near] == v
            long = np.frombuffer(b"".join(raw[k] for k in near[of]), np.uint64).reshape(-1, v // wide, wide // 64)
            folded[wide][of] = np.bitwise_xor.reduce(long, axis=1)

    def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, short = np.empty(len(a), np.int64), np.minimum(bits[a], bits[b])
        for wide in np.unique(short):
            of, step = np.flatnonzero(short == wide), max(1, BLOCK // (wide // 8))
            for k in range(0, len(of), step):
                x = of[k:k + step]
                both = folded[wide][place[wide][a[x]]] ^ folded[wide][place[wide][b[x]]]
                out[x] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out

    begins = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    lengths = np.diff(np.append(begins, count))
    end, nth = np.repeat(begins + lengths, lengths), np.repeat(np.arange(len(begins)), lengths)
    most = (sizes + 1) / (1 - radius) + 1
    # points of one component of a region have one label, the position of its first
    order = np.lexsort((roots, nth))
    fresh = np.append(True, (nth[order][1:] != nth[order][:-1]) | (roots[order][1:] != roots[order][:-1]))
    label = np.empty(count, np.int64)
    label[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    at, apart = np.arange(count), 0
    while len(at):
        # each point with the one so many places on; further ones of its region are larger still
        apart += 1
        at = at[at + apart < end[at]]
        at = at[sizes[at + apart] <= most[at]]
        a = at[label[at] != label[at + apart]]
        b = a + apart
        least = np.maximum(differing_bits(a, b), sizes[b] - sizes[a])
        bound = 2 * least / (sizes[a] + sizes[b] + least)
        hit = bound <= radius + 1e-9
        a, b, bound = a[hit], b[hit], bound[hit]
        yield a[seen[a]], b[seen[a]]
        a, b, bound = a[~seen[a]], b[~seen[a]], bound[~seen[a]]
        if len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            nearest = np.lexsort((bound, high, low))
            one = np.append(True, (low[nearest][1:] != low[nearest][:-1]) | (high[nearest][1:] != high[nearest][:-1]))
            a, b = a[nearest[one]], b[nearest[one]]
            yield a, b
        while (label[a] != label[b]).any():
            x, y = label[a], label[b]
            up = np.arange(count)
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up[up] != up).any():
                up = up[up]
            label = up[label]


def leaf_pairs(members: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """``(region, id, pivot, n, p_n)`` of pairs of points in one region and different components whose bound is within the radius.

    For regions ``(region, id, root, seen)`` of ``LEAF`` points at most: their sketches meet
    in one task. Of regions not ``seen`` yet only as many pairs come as connect their
    points, were all of them links, and few more, and a region without a pair here has
    none. Of the others all come, each from the least of the regions that both points are in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_regions(batches):
            found, n = [], 0
            region, others = rows.column("region").to_pylist(), [x and set(x) for x in rows.column("others").to_pylist()]
            for a, b in near_rows(rows, radius):
                here = [not others[x] or region[x] == min(others[x] & others[y]) for x, y in zip(a.tolist(), b.tolist())]
                a, b = a[np.array(here, bool)], b[np.array(here, bool)]
                found.append((a, b))
                n += len(a)
                if n >= ROWS:
                    yield paired(found, rows)
                    found, n = [], 0
            if n:
                yield paired(found, rows)

    def paired(found: list[tuple[np.ndarray, np.ndarray]], rows: pa.RecordBatch) -> pa.RecordBatch:
        region, ids, sizes = (rows.column(c).to_numpy() for c in ("region", "id", "n"))
        a, b = (np.concatenate(x) for x in zip(*found))
        a, b = np.where(ids[a] > ids[b], b, a), np.where(ids[a] > ids[b], a, b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (region[a], ids[a], ids[b], sizes[a], sizes[b])],
                                          ["region", "id", "pivot", "n", "p_n"])

    others = members.filter("seen").groupBy("id").agg(F.collect_list("region").alias("others"))
    rows = members.select("region", "id", "root", "seen").join(points.select("id", "n", "sketch"), "id").join(others, "id", "left")
    return (rows.repartition("region")
            .sortWithinPartitions("region", "n", "id").mapInArrow(run, "region long, id long, pivot long, n long, p_n long"))


def region_members(points: DataFrame) -> DataFrame:
    """``(region, id)`` of the regions with two points or more.

    Regions of the same points are one. A region is named by the number of its points and
    the sum of their hashes; should two names ever fall together, the two regions are joined as
    one, which is right as well.
    """
    # dealt by shingle once, for the count and for the join
    placed = points.select("id", F.explode("regions").alias("shingle")).filter("shingle is not null").repartition("shingle")
    named = (placed.groupBy("shingle").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x")).filter("m > 1")
             .select("shingle", F.xxhash64("m", "x").alias("region")))
    return placed.join(named, "shingle").select("region", "id").distinct()


def point_links(points: DataFrame, texts_of: Callable[[DataFrame, str], DataFrame], words: int, least: int, folder: str) -> DataFrame:
    """``(id, pivot)``: links that connect all linked points ``(id, n, sketch, regions)``.

    ``texts_of`` gives a text ``(id, text)`` for each of some points ``(id)``. Each round is
    written below ``folder``.
    """
    radius, slack = 1 - least / 100, 1e-9
    members = region_members(points.filter(F.size("regions") > 0)).withColumns({"root": F.col("id"), "seen": F.lit(False)})
    members = saved(members, f"{folder}/members-0")
    links = asked = points.select("id", F.col("id").alias("pivot")).limit(0)
    k = 0
    while members.take(1):
        here = f"{folder}/round-{k}"
        sized = members.join(members.groupBy("region").agg(F.count("*").alias("m")), "region")
        leaf = F.col("m") <= LEAF
        listed = saved(leaf_pairs(sized.filter(leaf), points, radius), f"{here}/listed")
        near = listed.select("id", "pivot", "n", "p_n").distinct().join(asked, ["id", "pivot"], "left_anti")
        close = near = saved(near, f"{here}/near")
        asked = asked.union(near.select("id", "pivot"))
        wide = sized.filter(~leaf).take(1)
        if wide:
            by = W.partitionBy("region").orderBy("id")
            # one pivot for a region takes most of its near copies together
            chosen = sized.filter(~leaf).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= MORE ** k)
            chosen = saved(chosen.select("region", F.col("id").alias("pivot"), F.col("root").alias("p_root")), f"{here}/pivots")
            pairs = saved(members.join(chosen, "region").filter("id <> pivot").select("region", "id", "pivot"), f"{here}/pairs")
            # a point of a cell has no partner further from the pivot than twice the radius
            bounds = saved(bounded(pairs.select("id", "pivot").distinct(), points, 2 * radius + slack), f"{here}/bounds")
            close = near.union(bounds.filter(F.col("bound") <= radius + slack).select(near.columns)).distinct()
        needed = close.select(F.explode(F.array("id", "pivot")).alias("id")).distinct()
        union = F.col("n") + F.col("p_n") - F.col("both")
        known = close.join(measured(close, texts_of(needed, here), words), ["id", "pivot"])
        known = saved(known.select("id", "pivot", (1 - F.col("both") / union).alias("distance"),
                                   (100 * F.col("both") >= least * union).alias("linked")), f"{here}/known")
        links = links.union(known.filter("linked").select("id", "pivot"))
        roots = saved(components(links, "id", "pivot"), f"{here}/roots")

        def rooted(df: DataFrame, c: str, root: str, roots: DataFrame = roots) -> DataFrame:
            met = df.drop(root).join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(c) == F.col("_node"), "left")
            return met.withColumn(root, F.coalesce("_root", c)).drop("_node", "_root")

        # a leaf is done when all its pairs were asked for, or it has none
        rest = sized.filter(leaf & ~F.col("seen")).join(listed.select("region").distinct(), "region", "left_semi")
        rest = rooted(rest.select("region", "id", F.lit(True).alias("seen")), "id", "root")
        if wide:
            is_pivot = chosen.select("region", F.col("pivot").alias("id"))
            others = rooted(sized.filter(~leaf).select("region", "id", "seen").join(is_pivot, ["region", "id"], "left_anti"), "id", "root")
            judged = bounds.join(known.drop("linked"), ["id", "pivot"], "left").select(
                "id", "pivot", F.coalesce("distance", "bound").alias("distance"), F.col("distance").isNotNull().alias("exact"))
            left = rooted(others.join(pairs, ["region", "id"]).join(judged, ["id", "pivot"]), "pivot", "p_root")
            # what lies nearest to a pivot, for all that is known, of the points of other components
            beyond = left.filter("root <> p_root").groupBy("region", "pivot").agg(F.min("distance").alias("beyond"))
            inside = left.filter("exact and root = p_root").join(beyond, ["region", "pivot"], "left")
            done = inside.filter(F.col("beyond").isNull() | (F.col("distance") + radius + slack < F.col("beyond"))).select("region", "id").distinct()
            rest = rest.unionByName(others.join(done, ["region", "id"], "left_anti"))
        several = rest.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("region")
        k += 1
        members = saved(rest.join(several, "region").select("region", "id", "root", "seen"), f"{folder}/members-{k}")
    return links


def joined(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Two documents link when their sets of ``words``-word shingles share ``least`` percent
    of their union or more, in whole numbers; component_id is the smallest doc_id reachable
    by links, the own one included. Words are runs without ASCII space, in lower case (A-Z
    only); fewer than ``words`` words are one shingle. Every link between different sets is
    found or implied by others; copies are linked as equal sets.

    Null, empty and blank texts have the empty set, link with nothing and keep their own
    doc_id. Rows with a null doc_id take part, and get the least id of their component,
    null if it has none; repeated rows stay. Other columns are not read. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    rows = saved(placed_rows(docs, words, least), f"{folder}/rows")
    # of equal sets one goes on, under a number of its own
    one = F.any_value(F.struct("n", "sketch", "regions")).alias("one")
    points = rows.filter("n > 0").groupBy(KEY).agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tag")).alias("row"), one)
    points = saved(points.select(F.monotonically_increasing_id().alias("id"), *KEY, "first", "row", "one.*"), f"{folder}/points")

    def texts_of(needed: DataFrame, here: str) -> DataFrame:
        bucket = lambda d, t: F.pmod(F.xxhash64(d, t), F.lit(BUCKETS)).cast("int").alias("bucket")
        wanted = saved(points.select("id", "row").join(needed, "id"), f"{here}/wanted")
        # at most BUCKETS rows: tells most texts that are not needed before any moves
        buckets = wanted.select(bucket("row.doc_id", "row.tag")).distinct()
        read = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
        read = read.withColumn("bucket", bucket("doc_id", "tag")).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
        same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("tag") == F.col("row.tag"))
        return saved(read.join(wanted, same).select("id", "text").dropDuplicates(["id"]), f"{here}/texts")

    links = point_links(points, texts_of, words, least, folder)
    root = components(links, "id", "pivot")
    joint = points.select("id", *KEY, "first").join(root, F.col("id") == F.col("node"))
    lowest = joint.groupBy("root").agg(F.min("first").alias("least"))
    moved = joint.join(lowest, "root").select("id", "least")
    classes = points.select("id", *KEY, "first").join(moved, "id", "left").select(*KEY, F.coalesce("least", "first").alias("component_id"))
    sized = rows.select("doc_id", F.col("n").alias("n_shingles"), *KEY)
    blank = sized.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return sized.filter("n_shingles > 0").join(classes, KEY).select("doc_id", "n_shingles", "component_id").union(blank)
