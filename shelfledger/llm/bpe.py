"""Byte-level BPE over an index of pair occurrences.

The distinct pieces of a batch of texts lie in one array of symbols with links to the
next and the previous symbol. An index holds for each adjacent pair that the vocabulary
merges the places where it occurs. The lowest active rank is taken, all its places are
merged at once, and only the pairs beside them enter or leave the index. A merge only
makes pairs of higher rank, so one ascending pass gives every piece the merges that it
would get alone. Pieces are kept per worker up to a bound and then met again for free.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: Characters encoded at once, and pieces a worker keeps.
SLAB, KEPT = 1 << 20, 300_000

# Splitting rule of byte-level vocabularies (fixed value): contractions, letters, numbers, others, spaces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for the characters below 256, as the rule has them."""
    kinds = [regex.compile(p) for p in (r"\p{White_Space}", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, p in enumerate(kinds) if p.match(chr(c))), 3) for c in range(256)], np.uint8)


CLASS = _classes()
_TWO, _THREE = np.isin(np.arange(256), list(b"stmd")), (b"re", b"ve", b"ll")


def latin_starts(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that lie one after another, a byte for each character below 256.

    The rule in terms of runs of one class: a blank goes with the run behind it, the white
    space before that blank, or before any single last character, is a piece, and a lone
    apostrophe takes the letters of a contraction.
    """
    n = len(code)
    kind = CLASS[code]
    first = np.zeros(n + 1, bool)  # of a run
    first[1:n] = kind[1:] != kind[:-1]
    first[begins], first[n] = True, True
    text_start = np.zeros(n + 1, bool)
    text_start[begins], text_start[n] = True, True
    space, blank = kind == 0, code == 32
    start = first[:n].copy()
    # the last character of white space before another run: a blank starts that run's piece, others are a piece
    last = np.flatnonzero(space & first[1:] & ~text_start[1:])
    start[last] = True
    joined = last[blank[last]]
    start[joined + 1] = False
    # contractions: an apostrophe alone in its run, not behind a blank that it would belong to
    at = np.flatnonzero((code == 39) & first[:n] & first[1:])
    at = at[start[at] & (at + 1 < n)]
    at = at[(kind[at + 1] == 1) & ~text_start[at + 1]]
    c1, c2 = code[at + 1], code[np.minimum(at + 2, n - 1)]
    inside = ~first[at + 2]  # the second letter is of the same run
    size = np.where(_TWO[c1], 2, 0)
    for pair in _THREE:
        size[(c1 == pair[0]) & (c2 == pair[1]) & inside] = 3
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    behind = at + size
    behind = behind[behind < n]
    start[behind] = True
    return np.flatnonzero(start)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take their surroundings are not supported")
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.left, self.right = code // self.size, code % self.size
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes])
        self.at = np.cumsum(self.length) - self.length

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge joins it."""
        if not len(self.code):
            return np.full(len(a), -1)
        code = a * self.size + b
        k = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[k] == code, self.rank[k], -1)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.at[ids], self.length[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``flat[at:at + length]`` one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(at - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def merge_pieces(v: Vocabulary, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces one after another, and how many each has."""
    raw = [w.encode("utf-8") for w in words]
    size = np.array([len(r) for r in raw])
    stops = np.cumsum(size)
    sym = v.first[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[stops - 1] = -1
    before[stops - size] = -1

    index: dict[int, list[np.ndarray]] = {}  # rank -> places of its pair
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        r = v.ranks(sym[places], sym[after[places]])
        places, r = places[r >= 0], r[r >= 0]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        r, places = r[order], places[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(r)]):
            rank = int(r[start])
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(places[start:stop])

    enter(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, new = v.left[rank], v.right[rank], v.made[rank]
        to = after[at]
        good = (sym[at] == a) & (to >= 0) & (sym[to] == b)
        at, to = at[good], to[good]
        if a == b and len(at):  # in a run of equal symbols the pairs go from left to right
            at = np.sort(at)
            to = after[at]
            chained = np.zeros(len(at), bool)
            chained[1:] = to[:-1] == at[1:]
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            even = (np.arange(len(at)) - head) % 2 == 0
            at, to = at[even], to[even]
        if not len(at):
            continue
        beyond = after[to]
        sym[at], sym[to] = new, -1
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        left = before[at]
        enter(np.unique(np.concatenate([left[left >= 0], at[beyond >= 0]])))
    alive = sym >= 0
    total = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive], total[stops] - total[stops - size]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def piece_keys(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell pieces apart.

    Of pieces of eight characters or fewer they hold the characters and the length, so no two
    such pieces share a key; longer ones have a 128-bit hash of their characters.
    """
    padded = np.concatenate([code, np.zeros(8, np.uint8)])
    rest = np.lib.stride_tricks.as_strided(padded.view(), (len(code), 8), (1, 1))[start].copy().view("<u8").ravel()
    few = np.minimum(size, 8).astype(np.uint64)
    rest &= np.where(few == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * (few % np.uint64(8)))) - np.uint64(1))
    # for one length a bijection of the characters, for the same characters one of the length
    h = (rest ^ (rest >> np.uint64(32))) * _FACTOR + size.astype(np.uint64)
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size > 8)
    if len(long):
        raw = code.tobytes()
        hashes = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start[long].tolist(), (start + size)[long].tolist())])
        h[long], rest[long] = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
    return h, rest


class Coder:
    """Encodes texts piece by piece; the pieces used most are kept for later texts, up to a bound.

    Texts of characters below 256 are split and looked up without a Python object for each
    piece, in a table with open addressing. Other texts, and those with the string of a
    special token, are split by the pattern, and their distinct pieces encoded each time.
    """

    def __init__(self, v: Vocabulary, encode_pieces: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]] | None = None, kept: int | None = None) -> None:
        self.v, self.kept = v, KEPT if kept is None else kept
        self.encode_pieces = encode_pieces or (lambda words: merge_pieces(v, words))
        self.flat, self.length, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key = np.zeros((0, 2), np.uint64)
        self._rehash()

    def _rehash(self) -> None:
        """A table of twice the pieces at least, filled with the known ones."""
        self.slots = np.full(1 << max(16, int(4 * len(self.key)).bit_length()), -1, np.int32)
        self._place(np.arange(len(self.key)))

    def _place(self, number: np.ndarray) -> None:
        mask = np.uint64(len(self.slots) - 1)
        at = (self.key[number, 0] & mask).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.slots[at[won]] = number[won]
            rest = np.ones(len(number), bool)
            rest[won] = False
            number, at = number[rest], (at[rest] + 1) & int(mask)

    def _find(self, h: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those not kept."""
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[(self.key[out[open_], 0] != h[open_]) | (self.key[out[open_], 1] != rest[open_])]
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            out[open_] = k = self.slots[at[open_]]
            on = k >= 0
            on[on] = (self.key[k[on], 0] != h[open_[on]]) | (self.key[k[on], 1] != rest[open_[on]])
            open_ = open_[on]
        return out

    def forget(self, kept: int | None = None) -> None:
        """Keep the pieces used most, by default half of the bound."""
        half = self.kept // 2 if kept is None else kept
        if len(self.key) <= half:
            return
        keep = self.uses > np.partition(self.uses, -half)[-half] if half else np.zeros(len(self.uses), bool)
        self.flat = gather(self.flat, (np.cumsum(self.length) - self.length)[keep], self.length[keep])
        self.key, self.length, self.uses = self.key[keep], self.length[keep], self.uses[keep] // 2
        self._rehash()

    def _latin(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(texts), np.uint8)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        start = latin_starts(code, np.unique(np.concatenate([[0], ends[:-1]])[[len(t) > 0 for t in texts]]))
        size = np.diff(start, append=len(code))
        h, rest = piece_keys(code, start, size)
        if len(self.key) > self.kept:
            self.forget()
        which = self._find(h, rest)
        new = np.flatnonzero(which < 0)
        if len(new):
            pair = np.stack([h[new], rest[new]], axis=1).view([("h", "<u8"), ("rest", "<u8")]).ravel()
            _, one, back = np.unique(pair, return_index=True, return_inverse=True)
            raw = code.tobytes().decode("latin-1")
            flat, length = self.encode_pieces([raw[a:a + n] for a, n in zip(start[new[one]].tolist(), size[new[one]].tolist())])
            known = len(self.key)
            which[new] = known + back
            self.key = np.concatenate([self.key, np.stack([h[new[one]], rest[new[one]]], axis=1)])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.length = np.concatenate([self.length, length])
            self.uses = np.concatenate([self.uses, np.zeros(len(length), np.int64)])
            if 2 * len(self.key) > len(self.slots):
                self._rehash()
            else:
                self._place(np.arange(known, len(self.key)))
        self.uses += np.bincount(which, minlength=len(self.uses))
        length = self.length[which]
        total = np.concatenate([[0], np.cumsum(length)])
        per = np.diff(total[np.searchsorted(start, ends)], prepend=0)
        return gather(self.flat, (np.cumsum(self.length) - self.length)[which], length), per

    def _split(self, text: str) -> list[str]:
        if self.v.split is None:
            return PIECES.findall(text)
        return [w for k, part in enumerate(self.v.split.split(text)) for w in ([part] if k % 2 else PIECES.findall(part))]

    def _other(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self._split(t) for t in texts]
        special = self.v.special
        words = list(dict.fromkeys(w for s in split for w in s if w not in special))
        number = {w: k for k, w in enumerate([*words, *special])}
        flat, length = self.encode_pieces(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = np.concatenate([flat, np.array([*special.values()], np.int64)]).astype(np.uint32)
        length = np.concatenate([length, np.ones(len(special), np.int64)])
        which = np.array([number[w] for s in split for w in s], np.int64)
        total = np.concatenate([[0], np.cumsum(length[which])])
        per = np.diff(total[np.cumsum([len(s) for s in split])], prepend=0)
        return gather(flat, (np.cumsum(length) - length)[which], length[which]), per

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        plain, other = [], []
        for k, t in enumerate(texts):
            try:
                raw = t.encode("latin-1")
                (other if any(s in t for s in self.v.special) else plain).append((k, raw))
            except UnicodeEncodeError:
                other.append((k, None))
        ids, length = self._latin([raw for _, raw in plain])
        if not other:
            return ids, length
        more, n = self._other([texts[k] for k, _ in other])
        # back to the order of the texts
        order = np.argsort([k for k, _ in [*plain, *other]], kind="stable")
        length = np.concatenate([length, n])
        return gather(np.concatenate([ids, more]), (np.cumsum(length) - length)[order], length[order]), length[order]


def slabs(texts: Iterator[str | None], size: int = SLAB) -> Iterator[list[str]]:
    """Texts in groups of about ``size`` characters; null is empty. A long text is a group of its own."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's coder; its store of pieces outlives a task."""
    if path not in _coders:
        _coders[path] = Coder(vocabulary(path))
    return _coders[path]


def encoded(path: str, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    c = coder(path)
    for group in slabs(texts):
        ids, length = c.encode(group)
        yield from np.split(ids, np.cumsum(length)[:-1])


def _map(docs: DataFrame, columns: Sequence[str], fields: str, rows: Callable) -> DataFrame:
    """Arrow batches of ``columns`` to ``doc_id`` and ``fields``; rows gives the columns for a batch."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(fields).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *rows(b.column(1))], names)

    return docs.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each row's text, in an array of ints.

    Null and empty texts have no ids. Rows with equal or null ids are coded one by one;
    other columns are not read.
    """
    def rows(texts: pa.Array):
        ids = list(encoded(path, (t.as_py() for t in texts)))
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return _map(docs, ["doc_id", "text"], "ids array<int>", rows)


def decode(tokens: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give an empty text, special ids their string."""
    def rows(ids: pa.Array):
        v = vocabulary(path)
        return [pa.array([v.decode(np.array(x.as_py() or [], np.int64)) for x in ids], pa.string())]

    return _map(tokens, ["doc_id", "ids"], "text string", rows)


def round_trip(docs: DataFrame, ids: str = "ids", path: str = DEFAULT) -> DataFrame:
    """``docs`` with a column ``ids`` of token ids, and as text what these decode to; other columns as they are. Null text stays null."""
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            coded = list(encoded(path, (t.as_py() for t in b.column(place))))
            ends = np.cumsum([0, *map(len, coded)])
            flat = np.concatenate([np.zeros(0, np.uint32), *coded]).astype(np.int32)
            texts = [v.decode(x) if known else None for x, known in zip(coded, b.column(place).is_valid().to_pylist())]
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema.names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and its ids decoded again."""
    def rows(texts: pa.Array):
        v = vocabulary(path)
        n, a, b = [], [], []
        for ids in encoded(path, (t.as_py() for t in texts)):
            n.append(len(ids))
            a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(v.decode(ids).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _map(docs, ["doc_id", "text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
