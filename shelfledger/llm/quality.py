"""Text quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by boosting: in turn, round after
round, each feature gets a shallow tree on what the others leave unexplained, and the
tree's leaves are added to its table. Then the pairs of features that explain most of
the rest get tables over their joint bins in the same way. A score is a sum of table
entries, so scoring is a vector addition per table.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows, drawn by a hash
of their id; features are taken of every text, whole, on the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Labelled rows the model is fitted on, at most.
SAMPLE = 20_000
#: Score from which a text is accepted.
ACCEPT = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 64, 16, 8, 150, 60, 0.1, 1.0

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "symbols", "spaces", "odd_letters",
    "distinct_words", "top_word", "repeated_next", "capitals", "no_letters", "symbol_ends", "stops", "distinct_lines", "log_line",
)

_CLASS = np.zeros((256, 6))  # letter, upper, digit, symbol, space, letter beyond ASCII
for _c in map(chr, range(256)):
    _CLASS[ord(_c)] = (_c.isalpha(), _c.isupper(), _c.isdigit(), not (_c.isalnum() or _c.isspace() or _c in ".,;:'-"), _c.isspace(), _c.isalpha() and not _c.isascii())


def features(text: str | None) -> np.ndarray:
    """The numbers a text is judged by; null counts as empty."""
    text = text or ""
    n = len(text)
    try:
        classes = np.bincount(np.frombuffer(text.encode("latin-1"), np.uint8), minlength=256) @ _CLASS
    except UnicodeEncodeError:
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = np.bincount(wide[wide < 256], minlength=256) @ _CLASS
        beyond = "".join(map(chr, wide[wide >= 256]))
        classes += [sum(map(f, beyond)) for f in (str.isalpha, str.isupper, str.isdigit, lambda c: not (c.isalnum() or c.isspace()), str.isspace, str.isalpha)]
    share = classes / max(n, 1)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = text.split("\n")
    ends = Counter(w[-1] for w in words)
    capitals = sum(map(str.isupper, (w[0] for w in words)))
    return np.array([
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, *share,
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, capitals / m,
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / m,
        sum(c for e, c in ends.items() if not (e.isalnum() or e in ".,;:'-")) / m,
        sum(ends[e] for e in ".?!") / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ])


@dataclass
class Model:
    """Additive tables over bins; ``edges`` part a feature's values into bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at the quantiles of ``x``, each once."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; place k parts bins before k from the others."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl)**2 / (h.sum() - hl + RIDGE) - g.sum()**2 / (h.sum() + RIDGE)
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value of each bin under a tree of up to ``leaves`` leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, (a, b) = max((*best_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best split of a grid into four quadrants."""
    def sums(x):
        c = x.cumsum(0).cumsum(1)
        tl, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([tl, top - tl, left - tl, c[-1, -1] - top - left + tl])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = sums(g), sums(h)
    gain = (gs**2 / (hs + RIDGE)).sum(0) - g.sum()**2 / (h.sum() + RIDGE)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = gs[:, i, j] / (hs[:, i, j] + RIDGE)
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables learned from rows of features and labels 0 and 1; without both labels the score is constant."""
    n, width = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges, pair_edges = ([edges_of(x[:, k], b) for k in range(width)] for b in (BINS, PAIR_BINS))
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if not 0 < y.sum() < n:
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(n, base)

    def rest():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = rest()
            step = RATE * shallow_tree(np.bincount(bins[k], g, len(t)), np.bincount(bins[k], h, len(t)))
            t += step
            total += step[bins[k]]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(pair_edges)]
    size = [len(e) + 1 for e in pair_edges]

    def grid(a, b, w):
        return np.bincount(coarse[a] * size[b] + coarse[b], w, size[a] * size[b]).reshape(size[a], size[b])

    g, h = rest()
    gains = sorted(((quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((size[a], size[b]))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in model.pairs:
            g, h = rest()
            step = RATE * quadrants(grid(a, b, g), grid(a, b, h))[1]
            t += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows the model never learns from: a fifth, by the crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def feature_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row: its features in an array of doubles."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([np.zeros(0), *(features(t.as_py()) for t in b.column(1))])
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def labelled(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(x, y)`` of ``sample`` labelled rows at most, those of the least hash of their id.

    The share that is wanted bounds the hash first, so tasks send little more than the
    sample, however many they are.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).select("doc_id", F.col("quality").alias("y"))
    met = rows.join(known, "doc_id").select("x", "y", F.xxhash64("doc_id").alias("h"), "doc_id")
    share = min(1.0, (sample + 5 * sample**0.5) / max(1, met.count()))
    near = met.filter(F.col("h") <= F.lit(min((1 << 63) - 1, int((1 << 64) * share) - (1 << 63))))
    return near.orderBy("h", "doc_id", "y", "x").limit(sample).select("x", "y")


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from feature rows and ``labels(doc_id, quality)``; held-out and null labels are left out."""
    drawn = labelled(rows, labels, sample).collect()
    return fit(np.array([r.x for r in drawn]).reshape(-1, len(FEATURES)), np.array([r.y for r in drawn], float))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of feature rows."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null and empty texts are scored like others; repeated rows and null ids have a row
    each. Without labels of both kinds every score is the same. Only ``doc_id`` and
    ``text`` are read, and of the labels ``doc_id`` and ``quality``.
    """
    rows = cut(feature_rows(docs))
    out = scored(rows, learn(rows, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, all columns as they are."""
    model = learn(cut(feature_rows(docs)), labels, sample)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(place)]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= accept))

    return docs.mapInArrow(run, docs.schema)
