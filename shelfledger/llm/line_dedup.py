"""Repeated runs of lines by winnowing; DataFrame functions only.

A run is ``window`` or more consecutive lines that stand, line for line, earlier in the
table: in a document of a smaller doc_id or further up in the same one. In every window
of that many line hashes the least one (the last of equals) is selected. Two equal runs
select the same places, so a run can only repeat where a selected hash does; everything
else is left out early. Around a selected line, the windows that selected it extend the
match to the left and to the right; where consecutive windows repeat they join to one
run, which is deleted. On request a single line of enough words is a window too, so that
a long passage of one line counts like one of several.

Windows are compared by 96 bits of hash. Grouping keeps the first place of each window
only, so a line that a third of all documents share costs partial minima and a join
that can be split, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name


def text_key() -> list[Column]:
    """What tells rows apart besides doc_id: equal rows are one, others of the same id are ordered by hash."""
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("tag")]


def windows(docs: DataFrame, window: int) -> DataFrame:
    """One row for each window of lines: where it starts, the selected hash, its own key, and ``new`` where it selects another line than the window before."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g")))
    hashed = docs.filter("text is not null").select(*text_key(), lines.alias("l"))
    hashed = hashed.filter(F.size("l") >= window).select("doc_id", "tag", F.col("l.h").alias("h"), F.col("l.g").alias("g"))
    starts = F.sequence(F.lit(0), F.size("h") - window)

    def place(i: Column) -> Column:
        part = F.slice("h", i + 1, window)
        return i + window - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    placed = hashed.withColumn("at", F.transform(starts, place))

    def row(i: Column) -> Column:
        at = F.element_at("at", i + 1)
        return F.struct(i.alias("start"), F.element_at("h", at + 1).alias("picked"),
                        ((i == 0) | (at != F.element_at("at", F.greatest(i, F.lit(1))))).alias("new"),
                        F.xxhash64(F.slice("h", i + 1, window)).alias("k1"), F.hash(F.slice("g", i + 1, window)).alias("k2"))

    return placed.select("doc_id", "tag", F.explode(F.transform(starts, row)).alias("w")).select("doc_id", "tag", "w.*")


def long_lines(docs: DataFrame, words: int) -> DataFrame:
    """Like :func:`windows`, one row for each line of ``words`` or more words."""
    def row(x: Column, i: Column) -> Column:
        # so many words take at least twice as many characters less one
        long = F.when(F.length(x) >= 2 * words - 1, F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= words).otherwise(False)
        return F.struct(i.alias("start"), F.xxhash64(x).alias("picked"), F.lit(True).alias("new"), F.xxhash64(x).alias("k1"), F.hash(x).alias("k2"), long.alias("long"))

    lines = F.filter(F.transform(F.split("text", "\n"), row), lambda x: x["long"])
    return docs.filter("text is not null").select(*text_key(), F.explode(lines).alias("w")).select("doc_id", "tag", "w.*").drop("long")


def repeated_windows(docs: DataFrame, window: int = 2, words: int | None = None) -> DataFrame:
    """``(doc_id, tag, start, size, first_doc_id, first_start)`` of every window of lines that stands earlier in the table.

    With ``words``, lines of that many words are windows of size 1.
    """
    sized = windows(docs, window).withColumn("size", F.lit(window))
    if words:
        sized = sized.union(long_lines(docs, words).withColumn("size", F.lit(1)))
    all_windows = cut(sized.distinct())
    again = all_windows.filter("new").groupBy("picked").agg(F.count("*").alias("n")).filter("n > 1").select("picked")
    near = all_windows.join(again, "picked", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tag", "start")
    first = near.groupBy("size", "k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = near.join(first, ["size", "k1", "k2"]).filter(place > F.col("first"))
    return later.select("doc_id", "tag", "start", "size", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def repeated_runs(docs: DataFrame, window: int = 2, words: int | None = None) -> DataFrame:
    """``(doc_id, tag, heads, tails)``: where the repeated runs of a document start and end (exclusive), in order."""
    lines = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("size") - 1)))
    found = repeated_windows(docs, window, words).groupBy("doc_id", "tag").agg(F.sort_array(F.array_distinct(lines)).alias("s"))
    s = F.col("s")
    heads = F.filter(s, lambda x, j: (j == 0) | (x > F.element_at(s, F.greatest(j, F.lit(1))) + 1))
    tails = F.filter(s, lambda x, j: (j == F.size(s) - 1) | (F.element_at(s, F.least(j + 2, F.size(s))) > x + 1))
    return found.select("doc_id", "tag", heads.alias("heads"), F.transform(tails, lambda x: x + 1).alias("tails"))


def drop_repeated_runs(docs: DataFrame, window: int = 2, counts: tuple[str, str] | None = None, words: int | None = None) -> DataFrame:
    """``docs`` without the repeated runs of lines; every row stays, its text may become empty.

    Null texts stay null, a text of fewer than ``window`` lines stays whole, empty lines
    are lines like others. Rows equal in doc_id and text are one document and lose the
    same lines; rows that share only the doc_id are ordered by a hash of the text; rows
    without doc_id come last. ``n_chars``, where the table has it, follows the text.
    ``counts`` names two columns to add: lines before, and lines deleted. With ``words``, a
    line of that many words or more goes where it stands earlier, whatever is around it.
    """
    runs = repeated_runs(docs, window, words)
    names = {c: free_name(docs, c) for c in ("r_doc", "r_tag", "heads", "tails", "lines")}
    runs = runs.select(*[F.col(a).alias(names[b]) for a, b in (("doc_id", "r_doc"), ("tag", "r_tag"), ("heads", "heads"), ("tails", "tails"))])
    met = F.col("doc_id").eqNullSafe(F.col(names["r_doc"])) & (F.xxhash64("text") == F.col(names["r_tag"]))
    joined = docs.join(runs, met, "left").withColumn(names["lines"], F.split("text", "\n"))
    lines, heads, tails = (F.col(names[c]) for c in ("lines", "heads", "tails"))

    def kept(j: Column) -> Column:
        low = F.when(j == 0, 0).otherwise(F.element_at(tails, F.greatest(j, F.lit(1))))
        high = F.when(j == F.size(heads), F.size(lines)).otherwise(F.element_at(heads, F.least(j + 1, F.size(heads))))
        return F.slice(lines, low + 1, high - low)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(heads)), kept)), "\n")
    cleaned = {"text": F.when(heads.isNull(), F.col("text")).otherwise(text)}
    out = [cleaned.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    if counts:
        gone = F.aggregate(F.zip_with(heads, tails, lambda a, b: b - a), F.lit(0), lambda a, b: a + b)
        out += [F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]), F.coalesce(gone, F.lit(0)).cast("long").alias(counts[1])]
    done = joined.select(*out)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind))
    return done
