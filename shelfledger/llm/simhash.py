"""Near-duplicates by SimHash fingerprints that are compared bit-sliced.

Fingerprints filed together lie as lanes in vertical bit planes; the distances of 64
lanes are counted at a time by carry-save counters, and words whose lanes all exceed the
radius are given up early. Two ways of filing:

* ``blocks``: fingerprints within ``radius`` bits agree on all but ``radius`` of the
  blocks that the bits are cut into, so each is filed once for every choice of blocks
  that must agree. Every link is found.
* ``bands``: for a radius too wide for blocks. Texts that share the least shingles under
  several hash functions are filed together, as similar texts do for some of them.

Equal fingerprints are one node, whatever the number of documents. A file with many
fingerprints is dealt to several tasks by pairs of its parts. Each comparison returns
a spanning forest of its links, never all pairs.

For similar texts the distance only proposes links: each is verified by the exact Jaccard
similarity of the two shingle sets before it enters the forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, free_name

#: Shingles whose bits are counted at once.
SLAB = 1 << 15
#: Lanes gathered before they are compared.
LANES = 1 << 15
#: Fingerprints of one file that one task compares with each other or with another part.
PART = 1 << 13
#: Bytes of shingle sets of one file that one task holds of each part.
PART_BYTES = 1 << 24
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

#: For near-duplicates of similarity ``LIKE`` or more: bits and radius of the fingerprints of 5-word shingles, bands, and least shingles in a band.
BITS, RADIUS, BANDS, ROWS = 128, 48, 12, 2
LIKE = 0.8


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function on hashes; the first leaves them as they are."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, ASCII letters in lower case, in slabs; fewer words are one shingle."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    rows = zip(*(w[k:] for k in range(words))) if len(w) >= words else iter([w] if w else [])
    digest, join = xxhash.xxh64_intdigest, b" ".join
    while slab := [digest(join(r), 42) for r in islice(rows, SLAB)]:
        yield np.array(slab, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of the shingles, each once, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def sketch(slabs: Iterable[np.ndarray], bits: int = 64, bands: int = 0, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of shingle hashes in words of 64 bits, 0 without any, and a key for each band."""
    n, ones, least = 0, np.zeros(bits, np.int64), np.full(bands * rows, ALL)
    for h in slabs:
        n += len(h)
        for k in range(bits // 64):
            ones[64 * k:64 * k + 64] += np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        for k in range(bands * rows):
            least[k] = min(least[k], mixed(h, 1000 + k).min())
    keys = [xxhash.xxh64_intdigest(least[k * rows:(k + 1) * rows].tobytes(), k) for k in range(bands)] if n else []
    return np.packbits(2 * ones > n, bitorder="little").view("<u8"), np.array(keys, np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of 64 bits as a number."""
    return int(sketch(shingle_hashes(text, words))[0][0])


def raw(fp: np.ndarray) -> bytes:
    """A fingerprint's bits, highest first."""
    return fp[::-1].astype(">u8").tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, tag, fp, keys)`` of every row; fp holds the 64 bits, highest first, tag is a hash of the text, keys is empty. Null text is empty."""
    return _sketched(docs, lambda text: (raw(sketch(shingle_hashes(text, words))[0]), []))


def set_fingerprints(docs: DataFrame, words: int, bits: int, bands: int) -> DataFrame:
    """Like :func:`fingerprints`, of the set of shingles; the set's own hash follows the bits in fp, keys holds the bands' keys."""
    def one(text: str | None) -> tuple[bytes, np.ndarray]:
        known = shingle_set(text, words)
        fp, keys = sketch((known[k:k + SLAB] for k in range(0, len(known), SLAB)), bits, bands)
        return raw(fp) + xxhash.xxh64_digest(known.tobytes()), keys.view(np.int64)

    return _sketched(docs, one)


def _sketched(docs: DataFrame, one) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys = zip(*(one(t.as_py()) for t in b.column(2))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tag", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("tag long, fp binary, keys array<long>").fields]))


def numbers(fp: pa.Array, bits: int | None = None) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, lowest bits first; of ``bits`` bits where something follows them."""
    joined = b"".join(fp.to_pylist())
    words = np.frombuffer(joined, ">u8").reshape(len(fp), -1)[:, :bits and bits // 64] if len(fp) else np.zeros((0, 1), np.uint64)
    return np.ascontiguousarray(words[:, ::-1]).astype(np.uint64)


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes ``[bits, words]``: bit i of word w of plane p is bit p of fingerprint 64 w + i."""
    full = np.zeros((-(-len(fp) // 64) * 64, fp.shape[1]), np.uint64)
    full[:len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Carry-save counters of 64 lanes a word; ``over`` marks the lanes beyond the radius."""

    def __init__(self, over: np.ndarray, radius: int) -> None:
        # counters start so that they run over exactly at radius + 1
        size = max(1, int(radius).bit_length())
        start = (1 << size) - 1 - radius
        self.sums = [np.full(over.shape, ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
        self.over = over

    def add(self, x: np.ndarray) -> None:
        for k, s in enumerate(self.sums):
            carry = s & x
            self.sums[k] = s ^ x
            x = carry
        self.over |= x

    def keep(self, rows: np.ndarray) -> None:
        self.sums = [s[rows] for s in self.sums]
        self.over = self.over[rows]


class Forest:
    """Union-find that remembers the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent, self.links = np.arange(n), []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.roots(a), self.roots(b)
        new = np.flatnonzero(ra != rb)
        if not len(new):
            return
        lo, hi = np.minimum(ra[new], rb[new]), np.maximum(ra[new], rb[new])
        _, one = np.unique(lo * len(self.parent) + hi, return_index=True)
        for k in one:
            x, y = self.roots(np.array([lo[k], hi[k]]))
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a[new[k]], b[new[k]]))


class Sets:
    """The shingle sets of lanes, and which lanes are alike by their exact Jaccard similarity."""

    def __init__(self, sets: list[np.ndarray], least: float) -> None:
        self.sets, self.size, self.least = sets, np.array([len(x) for x in sets], np.int64), least

    def part(self, lanes: np.ndarray) -> Sets:
        return Sets([self.sets[k] for k in lanes], self.least)

    def enough(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common >= self.least * (self.size[a] + self.size[b] - common) - 1e-9

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of lanes whether they are alike."""
        out = self.enough(np.minimum(self.size[a], self.size[b]), a, b)
        for k in np.flatnonzero(out):
            x, y = self.sets[a[k]], self.sets[b[k]]
            common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            out[k] = self.enough(common, a[k], b[k])
        return out

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """All shingles in order, and the lane of each."""
        every = np.concatenate(self.sets)
        order = np.argsort(every)
        return every[order], np.repeat(np.arange(len(self.sets), dtype=np.int32), self.size)[order]

    def alike_one(self, one: int, lanes: np.ndarray) -> np.ndarray:
        """For each lane whether it is like ``one``; all lanes' common shingles are counted at once."""
        every, of = self.index
        lo = np.searchsorted(every, self.sets[one], side="left")
        many = np.searchsorted(every, self.sets[one], side="right") - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.enough(np.bincount(of[at], minlength=len(self.sets))[lanes], np.full(len(lanes), one), lanes)


def near_lanes(fp: np.ndarray, ends: np.ndarray, radius: int, forest: Forest, sets: Sets | None = None) -> None:
    """Link near lanes of the same run; ``ends`` holds for each lane where its run ends.

    Lane i meets lane i + s for each shift s up to the longest run, for all runs at once.
    """
    lane = np.arange(len(fp))
    p = np.pad(planes(fp), ((0, 0), (0, 2)))
    longest = int((ends - lane).max()) if len(fp) else 0
    for s in range(1, longest):
        live = np.zeros((p.shape[1] - 2) * 64, bool)
        live[:len(fp)] = lane + s < ends
        over = ~np.packbits(live, bitorder="little").view(np.uint64)
        at = np.flatnonzero(over != ALL)
        far, bit = at + s // 64, np.uint64(s % 64)
        c = Counter(over[at], radius)
        for k in range(len(p)):
            y = p[k, far] >> bit
            if bit:
                y |= p[k, far + 1] << (np.uint64(64) - bit)
            c.add(p[k, at] ^ y)
            if k % 8 == 7:
                rows = np.flatnonzero(c.over != ALL)
                if not len(rows):
                    break
                at, far = at[rows], far[rows]
                c.keep(rows)
        else:
            word, bits = np.nonzero(np.unpackbits((~c.over).view(np.uint8), bitorder="little").reshape(-1, 64))
            a, b = at[word] * 64 + bits, at[word] * 64 + bits + s
            if sets is not None:
                apart = np.flatnonzero(forest.roots(a) != forest.roots(b))
                a, b = (x[apart[sets.alike(a[apart], b[apart])]] for x in (a, b))
            forest.link(a, b)


def near_block(fp: np.ndarray, queries: np.ndarray, first: int, radius: int, forest: Forest, base: int, sets: Sets | None = None) -> None:
    """Link each query lane with the near lanes of a long run, 128 queries at a time.

    ``queries`` are lane numbers within the run; each meets the lanes from ``first`` on
    (or after itself where that is later). ``base`` is the run's first lane in the forest.
    """
    p = planes(fp)
    lane = np.arange(p.shape[1] * 64)
    for at in range(0, len(queries), 128):
        q = queries[at:at + 128]
        over = ~np.packbits((lane[None, :] >= np.maximum(first, q[:, None] + 1)) & (lane < len(fp))[None, :], axis=1, bitorder="little").view(np.uint64)
        c = Counter(over, radius)
        for k in range(len(p)):
            flip = np.where(fp[q, k // 64] >> np.uint64(k % 64) & np.uint64(1), ALL, np.uint64(0))
            c.add(p[k][None, :] ^ flip[:, None])
            if k % 8 == 7:
                rows = np.flatnonzero((c.over != ALL).any(axis=1))
                if not len(rows):
                    break
                if len(rows) < len(q):
                    q = q[rows]
                    c.keep(rows)
        else:
            for row, one in zip(~c.over, q):
                hit = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
                if sets is not None and len(hit):
                    hit = hit[forest.roots(base + hit) != forest.roots(np.array([base + one]))]
                    hit = hit[sets.alike_one(one, hit)] if len(hit) else hit
                if len(hit):
                    forest.link(np.full(len(hit), base + one), base + hit)
            roots = forest.roots(base + np.arange(len(fp)))
            if (roots == roots[0]).all():
                return  # one tree spans the run: no further link can join two


def near_links(fp: np.ndarray, run: np.ndarray, side: np.ndarray, radius: int, sets: Sets | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of the spanning links of near fingerprints within each run of equal ``run`` values.

    Where a run holds two sides, only links from one side to the other are wanted. With
    ``sets`` only lanes that are also alike are linked.
    """
    cuts = np.flatnonzero(np.diff(run)) + 1
    starts = np.concatenate([[0], cuts]).astype(int)
    stops = np.concatenate([cuts, [len(fp)]]).astype(int)
    forest = Forest(len(fp))
    ends = np.repeat(stops, stops - starts)
    long = np.flatnonzero(stops - starts > 64)
    short = np.ones(len(fp), bool)
    for r in long:
        a, b = starts[r], stops[r]
        short[a:b] = False
        split = int(side[a:b].sum()) and int(np.searchsorted(side[a:b], 1))
        near_block(fp[a:b], np.arange(split or b - a), split, radius, forest, a, sets and sets.part(np.arange(a, b)))
    if short.any():
        keep = np.flatnonzero(short)
        part = Forest(len(keep))
        back = np.cumsum(short) - 1
        near_lanes(fp[keep], back[ends[keep] - 1] + 1, radius, part, sets and sets.part(keep))
        for a, b in part.links:
            forest.links.append((keep[a], keep[b]))
    a, b = (np.array(x, int) for x in zip(*forest.links)) if forest.links else (np.zeros(0, int),) * 2
    return a, b


def block_files(nodes: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``(fp, file, key)`` of 64-bit fingerprints: a file for each choice of blocks that must agree, its key their bits.

    5 blocks file a fingerprint 10 times under 25 bits, 6 blocks 20 times under 32 bits.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below blocks")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = np.array([sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = numbers(b.column(0))[:, :1] & masks[None, :]
            file = np.broadcast_to(np.arange(len(masks), dtype=np.int32), key.shape)
            fp = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(masks))))
            yield pa.RecordBatch.from_arrays([fp, pa.array(file.ravel()), pa.array(key.ravel().view(np.int64))], ["fp", "file", "key"])

    return nodes.select("fp").mapInArrow(run, "fp binary, file int, key long")


def band_files(nodes: DataFrame) -> DataFrame:
    """``(fp, file, key)``: a file for each band, its key the least shingles there."""
    return nodes.select("fp", F.posexplode("keys").alias("file", "key"))


def near_pairs(filed: DataFrame, radius: int, bits: int | None = None, least: float | None = None) -> DataFrame:
    """``(file, key, a, b)``: links that connect all fingerprints of a file within ``radius`` bits of each other.

    With ``least``, ``filed`` has the column ``shingles``, and only fingerprints whose sets
    have that similarity are linked.
    """
    bulk = F.sum(F.length("shingles")) / PART_BYTES if least else F.lit(0)
    shared = filed.groupBy("file", "key").agg(F.count("*").alias("n"), bulk.alias("bulk")).filter("n > 1")
    rows = (filed.join(shared, ["file", "key"])
            .withColumn("parts", F.ceil(F.greatest(F.col("n") / PART, "bulk")).cast("int"))
            .withColumn("part", F.pmod(F.xxhash64("fp", "file"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("file", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                    (F.col("part") > F.col("other")).cast("int").alias("side"), "fp", *(["shingles"] if least else [])))
    keys = ["file", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> pa.RecordBatch:
            fp = rows.column("fp").combine_chunks()
            run = np.zeros(len(fp), int)
            if len(run):
                run[1:] = np.cumsum(np.any([(k := rows.column(n).to_numpy())[1:] != k[:-1] for n in keys], axis=0))
            sets = Sets([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")], least) if least else None
            a, b = near_links(numbers(fp, bits), run, rows.column("side").to_numpy(), radius, sets)
            return pa.RecordBatch.from_arrays([*(pa.array(rows.column(n).to_numpy()[a]) for n in ("file", "key")), fp.take(pa.array(a)), fp.take(pa.array(b))], ["file", "key", "a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held else table
            if len(held) < LANES and held.nbytes < 2 * PART_BYTES:
                continue
            # the last run may go on in the next batch
            last = np.all([(k := held.column(n).to_numpy()) == k[-1] for n in keys], axis=0)
            done = int(np.argmax(last))
            yield flush(held.slice(0, done))
            held = held.slice(done)
        if held:
            yield flush(held)

    return (rows.repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(compare, "file int, key long, a binary, b binary"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int, bits: int, bands: int) -> DataFrame:
    """``(fp, shingles)`` of the nodes ``(fp, one)``; ``one`` names a row of ``docs``, whose shingles are read again."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    wanted = nodes.select(F.col("one.doc_id").alias("d"), F.col("one.tag").alias("t"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [shingle_set(t.as_py(), words) for t in b.column(0)]
            fps = [raw(sketch((x[k:k + SLAB] for k in range(0, len(x), SLAB)), bits)[0]) + xxhash.xxh64_digest(x.tobytes()) for x in known]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([x.tobytes() for x in known], pa.binary())], ["fp", "shingles"])

    return rows.select("text").mapInArrow(run, "fp binary, shingles binary").dropDuplicates(["fp"])


def groups(fps: DataFrame, link, bits: int) -> DataFrame:
    """``(doc_id, tag, fp, component_id, root)`` of rows ``(doc_id, tag, fp, keys)``; ``link`` gives links ``(a, b)`` of the nodes ``(fp, first, one, keys)``."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tag")).alias("one"), F.min("keys").alias("keys")))
    root = components(link(nodes)).withColumnRenamed("node", "fp")
    placed = nodes.select("fp", "first").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "tag", F.substring("fp", 1, bits // 8).alias("fp"), "component_id", "root")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``(doc_id, tag, fp, component_id, root)`` of every row; component_id is the least doc_id reachable.

    ``tag`` is a hash of the text; ``root`` tells components apart, also two of the same least doc_id.

    Documents are linked where their fingerprints of 64 bits differ in ``radius`` bits or
    fewer; every link is found. Null and empty texts have fingerprint 0 and link like any
    other; rows with a null doc_id take part in links and get the least id of their
    component, null if it has none. Repeated rows stay. Other columns are not read.
    """
    return groups(cut(fingerprints(docs, words)), lambda nodes: near_pairs(block_files(nodes, radius, blocks), radius), 64)


def similar_groups(docs: DataFrame, words: int = 5, bits: int = BITS, radius: int = RADIUS, bands: int = BANDS, least: float = LIKE) -> DataFrame:
    """Like :func:`near_groups`, for a similarity of ``least`` or more of the sets of 5-word shingles.

    Bands propose pairs, the distance of the sets' fingerprints drops most of the unlike
    ones, and the exact similarity of the sets decides. At 0.8 a fifth of the bits differ
    at most on average, so the default radius loses less than one pair in a million; bands
    miss one in some hundred thousand. No pair below ``least`` is linked.
    """
    def link(nodes: DataFrame) -> DataFrame:
        near = cut(near_pairs(band_files(nodes), radius, bits))
        # a file's spanning links touch each of its fingerprints that has any link there
        filed = near.select("file", "key", F.explode(F.array("a", "b")).alias("fp")).distinct()
        sets = shingle_sets(docs, nodes.join(filed, "fp", "left_semi"), words, bits, bands)
        return near_pairs(filed.join(sets, "fp"), radius, bits, least)

    return groups(cut(set_fingerprints(docs, words, bits, bands)), link, bits)


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the least doc_id stays, once.

    ``grouped`` is what :func:`near_groups` or :func:`similar_groups` gives for them. Rows
    without a doc_id stay, as no group is named after them. Rows that share a doc_id but
    not a group stay each; of those of one group the text of the least hash stays. All
    columns stay as they are.
    """
    key, tag, n = (free_name(docs, c) for c in ("kept", "kept_tag", "n"))
    kept = grouped.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(key), "root").agg(F.min("tag").alias(tag)).drop("root")
    rows = docs.filter("doc_id is not null").withColumn(n, F.xxhash64("text")).join(kept, (F.col("doc_id") == F.col(key)) & (F.col(n) == F.col(tag)))
    # the join has dealt the rows by these two columns already
    first = rows.withColumn(n, F.row_number().over(W.partitionBy(key, tag).orderBy(tag))).filter(F.col(n) == 1)
    return first.select(docs.columns).union(docs.filter("doc_id is null"))
