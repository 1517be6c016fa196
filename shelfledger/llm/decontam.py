"""Benchmark passages in documents, also slightly edited ones.

Windows of an item's length are laid over a text wherever an item of that length could
stand within its edits: an item is cut into tiles of up to eight characters, an edit
harms one of them at most, so of n tiles n - k stand in the text unharmed, each at its
place but for a shift of k at most. Where that many stand on neighbouring diagonals,
windows are laid on these; nowhere else can the item be. The CGK walk embeds a window: it
copies the character under a pointer at every step and moves the pointer on or leaves it,
by a random bit for step and character. Walks that an edit has put apart fall into step
again, so few edits become few differing places. Repeated samples of places are the keys
under which windows meet items; what meets is verified by the exact edit distance of the
item to the best matching stretch of the text around the window.

The benchmark lies in the shared folder, in blocks of bounded size that tasks read; the
driver holds none of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, shared_folder

#: Edits for each character of an item that still count as a match.
EDITS = 0.1
#: Characters of the shortest item, and of a tile at most.
SHORTEST, TILE = 8, 8
#: Walks, samples of each walk, and places in a sample.
WALKS, SAMPLES, PLACES = 8, 24, 3
#: Share of a walk's sampled places that must agree, in the walk where most do.
AGREE = 0.25
#: Characters of the benchmark held at once, of texts whose windows are gathered, and of texts scanned at once.
ITEM_CHARS, SLAB, SCAN = 1 << 24, 1 << 23, 1 << 20
#: Windows embedded at once.
LANES = 1 << 12

_GAP = np.zeros(1, np.uint8)
_SPACE = re.compile(r"[^\S ]")

_FOLD = np.array([min(ord(chr(c).lower()[0]), 255) if not chr(c).isspace() else 32 for c in range(256)], np.uint8)
_FOLD[0] = 1  # 0 parts texts


def codes(text: str) -> np.ndarray:
    """One byte for each character of the folded text, letters beyond Latin-1 by a hash."""
    try:
        return _FOLD[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        wide = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(wide < 256, _FOLD[wide & 0xFF], 1 + (wide * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def grams(code: np.ndarray, size: int = TILE) -> np.ndarray:
    """Hash of the ``size`` characters from each place on."""
    if len(code) < size:
        return np.zeros(0, np.uint32)
    factor = 0x01000193
    parts = {1: code.astype(np.uint32)}
    done = 1
    while 2 * done <= size:
        h, times = parts[done], np.uint32(pow(factor, done, 1 << 32))
        parts[2 * done] = h[:-done] * times + h[done:]
        done *= 2
    out = parts[done]
    for k in sorted((k for k in parts if k & (size - done)), reverse=True):
        n = len(code) - done - k + 1
        out = out[:n] * np.uint32(pow(factor, k, 1 << 32)) + parts[k][done:done + n]
        done += k
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text``, and the first end of such a stretch.

    Myers' bit-parallel columns: one machine-independent integer holds a whole column.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        right_up = down | ~(diag | up) & full
        right_down = up & diag
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = right_up << 1 & full  # a match may start anywhere, so row 0 stays 0
        right_down = right_down << 1 & full
        up = right_down | ~(x | right_up) & full
        down = right_up & x
        if score < best:
            best, end = score, j
    return best, end


def match(pattern: str, text: str, most: int | None = None) -> tuple[int, int, int]:
    """``(distance, start, end)`` of the best stretch; the shortest one at its first end. Beyond ``most`` the stretch is not told."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    d, end = distance(pattern, text)
    if not end or most is not None and d > most:
        return d, 0, 0
    head = text[max(0, end - len(pattern) - d):end][::-1]
    return d, end - distance(pattern[::-1], head)[1], end


def folded(text: str) -> str:
    """The text that distances are taken of; as long as ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def tiling(size: int, edits: float = EDITS) -> tuple[int, int, int]:
    """``(characters of a tile, tiles, tiles that an item of that size keeps unharmed)``."""
    k = int(edits * size)
    tile = min(TILE, size // (k + 1))
    return tile, size // tile, size // tile - k


class Detector:
    """Finds the items in texts."""

    def __init__(self, items: Sequence[tuple[object, str]], edits: float = EDITS) -> None:
        self.items = [(i, folded(t)) for i, t in items if t and len(t) >= SHORTEST]
        self.edits = edits
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.shift = (edits * self.size).astype(np.int64)
        own = [codes(t) for _, t in self.items]
        laid = [tiling(len(c), edits) for c in own]
        self.need = np.array([n for _, _, n in laid], np.int64)
        # for each length of a tile: hashes in order, and the items and offsets where they stand
        self.tiles = []
        for t in sorted({t for t, _, _ in laid}):
            found = [(int(h), k, t * o) for k, (c, (own_t, n, _)) in enumerate(zip(own, laid)) if own_t == t for o, h in enumerate(grams(c, t)[:n * t:t])]
            table = np.array(found, np.int64).reshape(-1, 3)
            table = table[np.argsort(table[:, 0], kind="stable")]
            known, first, many = np.unique(table[:, 0], return_index=True, return_counts=True)
            near = np.zeros(1 << 22, bool)
            near[known >> 10] = True
            self.tiles.append((t, near, known, first, many, table[:, 1], table[:, 2]))
        rng = np.random.default_rng(8)
        longest = int(self.size.max(initial=1))
        self.steps = 2 * longest
        self.move = rng.integers(0, 2, (WALKS, self.steps, 256), dtype=np.uint8)
        self.move[:, :, 0] = 0
        self.place = rng.random((WALKS, SAMPLES * PLACES))
        start = np.cumsum([0, *(len(c) for c in own)])[:-1]
        code = np.concatenate([np.zeros(0, np.uint8), *own])
        self.own = self.embed(code, start, self.size)
        keys = self.keys(self.own)
        self.of = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.of, axis=0)

    def embed(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sampled places ``[window, walk, sample, place]`` of the windows ``code[start:start + size]``."""
        n, out = len(start), np.zeros((len(start), WALKS, SAMPLES, PLACES), np.uint8)
        for a in range(0, n, LANES):
            s, m = start[a:a + LANES], size[a:a + LANES]
            rows, width = len(s), int(m.max(initial=0)) + 1
            # the windows side by side; at the 0 behind a window's end the pointer stays
            flat = np.zeros((rows, width), np.uint8)
            inside = np.arange(width)[None, :] < m[:, None]
            flat[inside] = code[(s[:, None] + np.arange(width)[None, :])[inside]]
            flat = flat.ravel()
            for walk in range(WALKS):
                # it moves at half the steps, so a window is walked in about twice its length
                step = (self.place[walk][None, :] * (1.9 * m[:, None])).astype(np.int64)
                seen = np.zeros((int(step.max(initial=0)) + 1, rows), np.uint8)
                at = np.arange(rows) * width
                for j in range(len(seen)):
                    c = flat[at]
                    seen[j] = c
                    at += self.move[walk, j][c]
                out[a:a + rows, walk] = seen[step, np.arange(rows)[:, None]].reshape(rows, SAMPLES, PLACES)
        return out

    @staticmethod
    def keys(sampled: np.ndarray) -> np.ndarray:
        """One number for each sample: ``[window, walk x sample]``."""
        wide = sampled.reshape(len(sampled), WALKS * SAMPLES, PLACES).astype(np.uint64)
        return (wide << (np.uint64(8) * np.arange(PLACES, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)

    def meet(self, sampled: np.ndarray) -> np.ndarray:
        """``(window, item)`` pairs that share a key and agree in enough places."""
        keys, found = self.keys(sampled), [np.zeros((0, 2), np.int64)]
        for c in range(keys.shape[1]):
            lo = np.searchsorted(self.sorted[:, c], keys[:, c], side="left")
            many = np.searchsorted(self.sorted[:, c], keys[:, c], side="right") - lo
            w = np.repeat(np.arange(len(keys)), many)
            i = self.of[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum()), c]
            found.append(np.stack([w, i], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        kept = [pairs[:0]]
        for a in range(0, len(pairs), LANES):
            w, i = pairs[a:a + LANES].T
            agree = (sampled[w] == self.own[i]).mean(axis=(2, 3)).max(axis=1)
            kept.append(pairs[a:a + LANES][agree >= AGREE])
        return np.concatenate(kept)

    def windows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of every window in which an item may stand, starts may lie before 0; and the pairs ``(window, item)``."""
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, near, known, first, many, item, offset in self.tiles:
            g = grams(code, t)
            at = np.flatnonzero(near[g >> np.uint32(10)])
            k = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            at, k = (x[known[k] == g[at]] for x in (at, k))
            n = many[k]
            entry = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            items.append(item[entry])
            starts.append(np.repeat(at, n) - offset[entry])
        item, start = np.concatenate(items), np.concatenate(starts)
        if not len(item):
            return start, item, np.zeros((0, 2), np.int64)
        # enough tiles of an item on diagonals that its edits can have shifted apart
        wide = len(code) + 2 * self.steps
        place = item * wide + start + self.steps
        order = np.argsort(place, kind="stable")
        item, start, place = item[order], start[order], place[order]
        end = np.searchsorted(place, place + self.shift[item], side="right")
        enough = end - np.arange(len(place)) >= self.need[item]
        covered = np.zeros(len(place) + 1, np.int64)
        np.add.at(covered, np.flatnonzero(enough), 1)
        np.add.at(covered, end[enough], -1)
        held = np.cumsum(covered[:-1]) > 0
        pair, of = np.unique(np.stack([start[held], self.size[item[held]]], axis=1), axis=0, return_inverse=True)
        return pair[:, 0], pair[:, 1], np.unique(np.stack([of.ravel(), item[held]], axis=1), axis=0)

    def find(self, texts: Sequence[str]) -> list[list[tuple[object, int, int, int]]]:
        """For each text ``(item, start, end, distance)`` of every item it holds, the best place of each."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        own = [codes(t) for t in texts]
        length = np.array([len(c) for c in own], np.int64)
        begin = np.cumsum(length) - length
        laid: list[np.ndarray] = []  # (text, start, size) of the windows
        may = [np.zeros(0, np.int64)]  # which item may stand in which
        group: list[int] = []
        for k in range(len(texts)):
            group.append(k)
            if k + 1 == len(texts) or length[group].sum() >= SCAN:
                shift = np.cumsum([0, *(length[g] + 1 for g in group)])
                start, size, items = self.windows(np.concatenate([x for g in group for x in (own[g], _GAP)]))
                may.append((items[:, 0] + sum(map(len, laid))) * len(self.items) + items[:, 1])
                # a window may hang over the start of its text: its middle, then, or its end lies inside
                inside = np.clip(np.where(np.isin(start, shift), start, start + size // 2), 0, shift[-1] - 1)
                of = np.searchsorted(shift, inside, side="right") - 1
                laid.append(np.stack([np.array(group)[of], start - shift[of], size], axis=1))
                group = []
        t, start, size = np.concatenate(laid).T if laid else np.zeros((3, 0), np.int64)
        cut = np.clip(start, 0, length[t]) if len(t) else start
        stop = np.clip(start + size, cut, length[t]) if len(t) else start
        sampled = self.embed(np.concatenate([_GAP, *own])[1:], begin[t] + cut if len(t) else start, stop - cut)
        low: dict[int, str] = {}
        met = self.meet(sampled)
        met = met[np.isin(met[:, 0] * len(self.items) + met[:, 1], np.concatenate(may))]
        # windows of one item that overlap in a text are one stretch
        order = np.lexsort((start[met[:, 0]], met[:, 1], t[met[:, 0]]))
        spans: list[tuple[int, int, int, int]] = []
        for w, i in met[order].tolist():
            k, d = int(t[w]), int(self.shift[i])
            a, z = max(0, int(start[w]) - d), int(cut[w]) + int(self.size[i]) + 2 * d
            if spans and spans[-1][:2] == (k, i) and a <= spans[-1][2] + 3 * d:
                spans[-1] = (k, i, spans[-1][2], z)
            else:
                spans.append((k, i, a, z))
        for k, i, a, z in spans:
            held, d = out[k].get(i), int(self.shift[i])
            if held and held[2] == 0:
                continue
            if k not in low:
                low[k] = folded(texts[k])
            far, x, y = match(self.items[i][1], low[k][a:z], d)
            if far <= d and (held is None or far < held[2]):
                out[k][i] = (a + x, a + y, far)
        return [[(self.items[i][0], *m) for i, m in sorted(x.items())] for x in out]


def blocks(benchmark: DataFrame, limit: int = ITEM_CHARS) -> list[str]:
    """Folders of the benchmark's different texts ``(key, text)``, each of about ``limit`` characters; a pass over the documents is made for each."""
    spark = benchmark.sparkSession
    texts = benchmark.filter(F.length("text") >= SHORTEST).select(F.md5("text").alias("key"), "text").distinct()
    n = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // limit))
    folder = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return [f"{folder}/block={k}" for k in range(n)]


@lru_cache(maxsize=1)
def detector(block: str, edits: float) -> Detector:
    """A block's detector; a worker keeps it between tasks."""
    system, path = fs.FileSystem.from_uri(block)
    if system.get_file_info(path).type == fs.FileType.NotFound:  # no text fell into this block
        return Detector([], edits)
    found = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["key", "text"])
    return Detector(sorted(zip(found["key"].to_pylist(), found["text"].to_pylist())), edits)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """``(doc_id, item_id, start, end, distance)``: each item that a text holds, once, at its best place.

    An item is held where its edit distance to a stretch of the text, both in lower case
    and with white space as blanks, is at most ``edits`` of its length. Verbatim items are
    always found, edited ones with the recall that the tests measure. Items shorter than
    ``SHORTEST`` characters, null items and null or empty texts match nothing; equal items
    under several ids each have a row. Repeated documents have rows each, null ids too.
    """
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("key", T.StringType())]
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds), *T._parse_datatype_string("start int, end int, distance int").fields])

    def search(block: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            types = to_arrow_schema(schema)
            for b in gathered(batches, 1, SLAB):
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows = [(d, *m) for d, found in zip(b.column(0).to_pylist(), detector(block, edits).find(texts)) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema.names)
        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found, *more = map(search, blocks(benchmark))
    for p in more:
        found = found.union(p)
    names = benchmark.select(F.md5("text").alias("key"), "item_id").distinct()
    return found.join(names, "key").select("doc_id", "item_id", "start", "end", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns as they are; null texts stay."""
    place = docs.columns.index("text")

    def search(df: DataFrame, block: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches, place, SLAB):
                clean = [not found for found in detector(block, edits).find([t or "" for t in b.column(place).to_pylist()])]
                yield b.filter(pa.array(clean, pa.bool_()))
        return df.mapInArrow(run, docs.schema)

    for block in blocks(benchmark):
        docs = search(docs, block)
    return docs
