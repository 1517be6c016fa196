"""One query for each text operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunk_dedup, decontam, hard_negatives, line_dedup, merkle, minhash, ngram_join, quality, secrets, simhash, token_store
from .common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register under the function's name."""
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = call
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of two or more lines, and the lines of 50 or more words, that stand earlier in the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_runs(docs, counts=("n_lines", "n_deleted"), words=50)


#: Equal rows are one document ``d``; rows without text have no lines and stay as they are.
SQL["op2_line_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS d, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
lines AS (
  SELECT d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM docs WHERE text IS NOT NULL),
pairs AS (
  SELECT d, p, line, lead(line) OVER (PARTITION BY d ORDER BY p) AS line2 FROM lines),
ranked AS (
  SELECT d, p, 2 AS size, row_number() OVER (PARTITION BY line, line2 ORDER BY d, p) AS nth FROM pairs WHERE line2 IS NOT NULL
  UNION ALL
  SELECT d, p, 1, row_number() OVER (PARTITION BY line ORDER BY d, p)
  FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
dead AS (
  SELECT DISTINCT d, p + k AS p FROM ranked, (VALUES (0), (1)) AS v(k) WHERE nth > 1 AND k < size),
marked AS (
  SELECT lines.*, dead.p IS NOT NULL AS gone FROM lines LEFT JOIN dead ON lines.d = dead.d AND lines.p = dead.p),
cleaned AS (
  SELECT d, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted
  FROM marked GROUP BY d)
SELECT documents.doc_id, cleaned.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM documents
JOIN docs ON documents.doc_id IS NOT DISTINCT FROM docs.doc_id AND documents.text IS NOT DISTINCT FROM docs.text
LEFT JOIN cleaned USING (d)"""


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to shards and found again by its key."""
    docs = table(spark, sf_dir, "documents")
    store = token_store.write(docs)
    return token_store.checksums(store, token_store.all_keys(docs)).drop("copy")


@query
def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with passages that stand earlier in the table: what goes, where it stood first."""
    spans = chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    gone = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0), lambda a, b: a + b)
    return spans.select("doc_id", F.size("starts").alias("n_spans"), gone.alias("n_chars_deleted"), "starts", "ends", "sources")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the fixed patterns and the strings compression does not expect."""
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    rows = minhash.with_next(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, where, and with how many edits."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every conversation, its calls linked and validated, as canonical JSON."""
    return chat.format_chats(chat.with_tools(table(spark, sf_dir, "conversations")), chat.TOOLS)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it is accepted."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root folded from its tampered leaf."""
    return merkle.tampered_proofs(table(spark, sf_dir, "documents"))


#: crc32 of a text, a byte at a time and a bit at a time.
CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""
HASHED = "sha256(concat({}))"
FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def leaf_sql(text: str) -> str:
    return HASHED.format(", ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)))


#: One tree for each group ``g``: its nodes level by level, its tops, each node's siblings, folding along them.
SQL["op11_merkle"] = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source, {leaf_sql("text")} AS leaf,
         CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 5 = 0
              THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g
  FROM leaves),
nodes AS (
  SELECT g, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 16),
tops AS (SELECT g, lvl, digest FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS lvl, g AS pos, digest, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM over_nodes WHERE n > 1 GROUP BY lvl, pos // 16),
parted AS (
  SELECT g, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, lvl, pos // 16, list(digest ORDER BY pos) FROM over_nodes WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, g AS top_g, g, 0 AS lvl, pos, coalesce(tampered, leaf) AS folded, '' AS siblings, pos AS first_pos FROM placed
  UNION ALL
  SELECT doc_id, top_g, g, lvl + 1, pos // 16, sha256(array_to_string(ds[:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], '')),
         siblings || array_to_string(ds[:pos % 16], '') || array_to_string(ds[pos % 16 + 2:], ''), first_pos
  FROM walk JOIN parted USING (g, lvl) WHERE run = pos // 16),
below AS (SELECT doc_id, top_g, first_pos, folded, siblings FROM walk WHERE lvl = (SELECT lvl FROM tops WHERE tops.g = walk.top_g)),
over_walk AS (
  SELECT doc_id, top_g, first_pos, -1 AS g, 0 AS lvl, top_g AS pos, folded, siblings FROM below
  UNION ALL
  SELECT doc_id, top_g, first_pos, g, lvl + 1, pos // 16, sha256(array_to_string(ds[:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], '')),
         siblings || array_to_string(ds[:pos % 16], '') || array_to_string(ds[pos % 16 + 2:], '')
  FROM over_walk JOIN parted USING (g, lvl) WHERE run = pos // 16),
root AS (SELECT lvl, digest FROM over_nodes WHERE n = 1)
SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
FROM over_walk w JOIN root r ON w.lvl = r.lvl JOIN placed p ON p.g = w.top_g AND p.pos = w.first_pos JOIN tops t ON t.g = w.top_g"""


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the component of its links at a similarity of 0.9."""
    return ngram_join.joined(table(spark, sf_dir, "documents"))


SQL["op12_jaccard_join"] = r"""
WITH RECURSIVE
worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM worded),
shingles AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
both_have AS (
  SELECT a.r AS a, b.r AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.r, b.r),
links AS (SELECT a, b FROM both_have WHERE 100 * c >= 90 * (an + bn - c)),
reach AS (
  SELECT r AS a, r AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY s.r"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector for each of its positives."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=hard_negatives.noisy_label())


SQL["op13_hard_negatives"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth
  FROM scores WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.r = p.r AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5"""
