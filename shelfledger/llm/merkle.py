"""Merkle manifest of a dataset, as a tree of SHA-256 midstates.

A row is a leaf. The leaves of a group (a source) ascend by their order column; every 16
consecutive nodes become their parent until one is left, the group's subroot, and the
subroots in order of their groups become the root in the same way.

A parent keeps a copy of its hash state before each child slot. When a child is replaced,
folding resumes the state of its slot with the replacement and the siblings to the right
only; what lies to the left is never hashed again.

Three levels at a time are worked on as a tile, at most 4,096 nodes of one group, so a hot
group is many tiles. Upwards a tile gives its top digest, downwards the path above it: for
each level what stands left and right of it. A tile with its path has all that proofs and
folding of its leaves need. Leaves and nodes are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder

FAN = 16
#: Levels of a tile.
DEPTH = 3
TILE = FAN ** DEPTH
#: Characters of a digest.
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


class Parent:
    """A run of children: its digest and a hash state before each child slot."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: Sequence[bytes]) -> None:
        state = hashlib.sha256()
        self.states = []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.children = b"".join(children)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with ``child`` in ``slot``."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.right(slot))
        return state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return self.children[:HEX * slot]

    def right(self, slot: int) -> bytes:
        return self.children[HEX * (slot + 1):]


class Tile:
    """Nodes of one group, up to three levels above them, and the path from their top to the root.

    ``path`` has two entries a level, what stands left and right of the node on the way.
    """

    def __init__(self, digests: list[bytes], levels: int, path: Sequence[bytes] = ()) -> None:
        self.levels: list[list[Parent]] = []
        nodes = digests
        for _ in range(levels):
            self.levels.append([Parent(nodes[k:k + FAN]) for k in range(0, len(nodes), FAN)])
            nodes = [p.digest for p in self.levels[-1]]
        self.top, = nodes
        self.above = [(hashlib.sha256(path[k]), path[k + 1]) for k in range(0, len(path), 2)]
        self.path = list(path)

    def way(self, k: int) -> list[bytes]:
        """What stands left and right of node ``k``, level by level."""
        out = []
        for parents in self.levels:
            k, slot = divmod(k, FAN)
            out += [parents[k].left(slot), parents[k].right(slot)]
        return out + self.path

    def fold(self, k: int, digest: bytes) -> bytes:
        """The root with ``digest`` in place of node ``k``."""
        for parents in self.levels:
            k, slot = divmod(k, FAN)
            digest = parents[k].fold(slot, digest)
        for before, right in self.above:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def leaf(columns: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the columns: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    def part(name: str) -> Column:
        value = (replaced or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(rows: DataFrame, group: str, order: Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` as (gid, pos, left, ...) and the groups as (gid, group, n, levels, rounds).

    Rows are dealt by ranges of (group, order), so a hot group lies in many parts; a row's
    position is its place in its part behind the group's rows in earlier parts. ``left`` is
    the number of levels above the row.
    """
    # the tie makes the order total, and parts an even share also of equal rows
    ranges = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    parts = saved(ranges.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), f"{folder}/parts")
    counts = saved(parts.groupBy("part", group).agg(F.count("*").alias("rows")), f"{folder}/counts")
    bits = F.length(F.bin(F.col("n") - 1))
    levels = F.when(F.col("n") <= 1, 0).otherwise(F.ceil(bits / 4).cast("int"))
    groups = saved(counts.groupBy(group).agg(F.sum("rows").alias("n")).withColumn("levels", levels)
                   .withColumn("rounds", F.greatest(F.ceil(F.col("levels") / DEPTH), F.lit(1)).cast("int"))
                   .withColumn("gid", F.monotonically_increasing_id()), f"{folder}/groups")
    g = groups.select("gid", F.col(group).alias("_g"), "levels")
    before = F.sum("rows").over(W.partitionBy("gid").orderBy("part")) - F.col("rows")
    starts = (counts.join(g, F.col(group).eqNullSafe(F.col("_g")))
              .select(F.col("part").alias("_part"), "gid", F.col("_g"), F.col("levels").alias("left"), before.alias("start")))
    placed = parts.withColumn("row", F.row_number().over(W.partitionBy("part", group).orderBy(*keys[1:])))
    out = placed.join(starts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    out = out.withColumn("pos", F.col("start") + F.col("row") - 1).drop("_part", "_g", "part", "row", "start", "tie")
    return saved(out, f"{folder}/nodes"), groups


def tiles(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("tile", F.floor(F.col("pos") / TILE))


def grown(nodes: DataFrame) -> DataFrame:
    """The nodes ``(gid, pos, digest, left)`` one round, three levels or fewer, above ``nodes``."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        left = rows["left"][0].as_py()
        top = Tile([d.encode() for d in rows["digest"].to_pylist()], min(left, DEPTH)).top
        return pa.table({"gid": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [top.decode()],
                         "left": pa.array([left - min(left, DEPTH)], pa.int32())})

    return (tiles(nodes.select("gid", "pos", "digest", "left")).groupBy("gid", "tile")
            .applyInArrow(run, "gid long, pos long, digest string, left int"))


def ways(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``(gid, pos, path)`` of ``nodes``, by the paths ``(gid, pos, path)`` of the round above."""
    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tile = Tile([d.encode() for d in rows["digest"].to_pylist()], min(rows["left"][0].as_py(), DEPTH), above["path"][0].as_py())
        return pa.table({"gid": rows["gid"], "pos": rows["pos"],
                         "path": pa.array([tile.way(k) for k in range(len(rows))], pa.list_(pa.binary()))})

    return (tiles(nodes.select("gid", "pos", "digest", "left")).groupBy("gid", "tile").cogroup(paths.groupBy("gid", "pos"))
            .applyInArrow(run, "gid long, pos long, path array<binary>"))


@dataclass
class Tree:
    """One tree for each group over the nodes ``(gid, pos, digest, left, ...)``; its rounds are tables in ``folder``."""

    nodes: DataFrame
    groups: DataFrame
    folder: str

    @cached_property
    def rounds(self) -> list[DataFrame]:
        """The nodes of each round; the first holds the leaves, each group's top is where ``left`` gets 0 or in the second."""
        n = self.groups.agg(F.max("rounds")).first()[0] or 1
        out = [self.nodes]
        for k in range(n):
            below = out[-1] if not k else out[-1].filter("left > 0")
            out.append(saved(grown(below), f"{self.folder}/round-{k + 1}"))
        return out

    @property
    def tops(self) -> DataFrame:
        """``(gid, digest)`` of each group's last node."""
        out = [r.filter("left = 0").select("gid", "digest") for r in self.rounds[1:]]
        while len(out) > 1:
            out = [*out[2:], out[0].union(out[1])]
        return out[0]

    def paths(self, above: DataFrame) -> DataFrame:
        """``(gid, pos, path)`` of the nodes above the leaves, by the tops' own paths ``(gid, path)``."""
        tops = self.groups.select("gid", "rounds").join(above, "gid")
        top = lambda k: tops.filter(F.col("rounds") == k).select("gid", F.lit(0).cast("long").alias("pos"), "path")
        out = top(len(self.rounds) - 1)
        for k in range(len(self.rounds) - 2, 0, -1):
            nodes = self.rounds[k].filter("left > 0")
            out = saved(ways(nodes, out).union(top(k)), f"{self.folder}/paths-{k}")
        return out


@dataclass
class Manifest:
    """The trees of the groups and the tree over their subroots, as tables in ``folder``."""

    leaves: Tree
    subroots: Tree
    order: str
    folder: str

    @cached_property
    def root(self) -> str | None:
        """The root; None for an empty table."""
        row = self.subroots.tops.first()
        return row and row.digest

    @cached_property
    def paths(self) -> DataFrame:
        """``(gid, pos, path, subroot)`` of every tile of leaves, its path going up to the root."""
        top = self.subroots.groups.select("gid", F.array().cast("array<binary>").alias("path"))
        over = ways(self.subroots.nodes, self.subroots.paths(top))
        subroots = self.subroots.nodes.select("gid", "pos", F.col("group_id").alias("g"), F.col("digest").alias("subroot"))
        over = saved(over.join(subroots, ["gid", "pos"]).select(F.col("g").alias("gid"), "path", "subroot"), f"{self.folder}/over")
        return self.leaves.paths(over.select("gid", "path")).join(over.select("gid", "subroot"), "gid")

    def proofs(self) -> DataFrame:
        """A row for each leaf: its order column, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

        ``folded_root`` is the root with the leaf's ``replacement``, where it has one, in its
        place; ``proof_sha256`` the digest of the siblings on the way up.
        """
        root, order = self.root, self.order
        nodes = self.leaves.nodes

        def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
            rows = rows.sort_by("pos")
            digests = [d.encode() for d in rows["digest"].to_pylist()]
            tile = Tile(digests, min(rows["left"][0].as_py(), DEPTH), above["path"][0].as_py())
            new = [d and d.encode() for d in rows["replacement"].to_pylist()]
            folded = [tile.fold(k, new[k] or d).decode() for k, d in enumerate(digests)]
            proof = [hashlib.sha256(b"".join(tile.way(k))).hexdigest() for k in range(len(rows))]
            return pa.table({order: rows["key"], "leaf": rows["digest"], "subroot": [above["subroot"][0].as_py()] * len(rows),
                             "root": [root] * len(rows), "proof_sha256": proof, "folded_root": folded,
                             "verified": [f == root for f in folded]})

        kind = dict(nodes.dtypes)["key"]
        return (tiles(nodes.select("gid", "pos", "digest", "left", "key", "replacement")).groupBy("gid", "tile")
                .cogroup(self.paths.groupBy("gid", "pos"))
                .applyInArrow(run, f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))


def build(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id",
          replaced: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of ``docs``, every row a leaf over ``columns``.

    ``replaced`` gives other values for some columns; a row for which ``where`` holds gets
    the leaf with these values as its replacement, for folding.

    Nulls in any column have a form of their own in the leaf; rows without a group are a
    group, the first; rows without an order value come first in theirs. Rows of equal order
    go by their leaves; repeated rows stay, each at a place of its own. Texts are read once
    and whole, in the JVM; only digests move. An empty table has no leaf and the root None.
    Columns that are not named, whatever their names, are not read.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    new = F.when(where, leaf(columns, replaced)) if replaced and where is not None else F.lit(None).cast("string")
    rows = saved(docs.select(F.col(group).alias("group"), F.col(order).alias("key"), leaf(columns).alias("digest"), new.alias("replacement")), f"{folder}/leaves")
    leaves = Tree(*ranked(rows, "group", ["key", "digest"], f"{folder}/tree"), f"{folder}/tree")
    subroots = leaves.tops.join(leaves.groups.select("gid", "group"), "gid")
    subroots = subroots.select(F.lit(0).alias("one"), F.col("group"), F.col("gid").alias("group_id"), "digest")
    over = Tree(*ranked(subroots, "one", ["group"], f"{folder}/over-tree"), f"{folder}/over-tree")
    return Manifest(leaves, over, order, folder)


def lower_cased(text: str = "text") -> Column:
    """A-Z in lower case, all else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def tampered_proofs(docs: DataFrame, every: int = 5) -> DataFrame:
    """Proofs of all documents; those whose doc_id's crc32 ``every`` divides are tampered with: their text is lower-cased."""
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return build(docs, replaced={"text": lower_cased()}, where=where).proofs()
