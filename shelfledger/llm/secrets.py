"""Secrets in texts: fixed patterns, and strings that compression does not expect.

Beside three patterns, every string of letters and digits that follows a sensitive word
is measured: zstandard, primed with common identifiers and with the text around the
string, compresses it alone. A word, path or name from the surroundings costs a few
bytes; one that costs nearly what a random string of its length and alphabet would is
reported as ``novel``.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run of one class is matched whole or not at all, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A sensitive word and up to ``REACH`` characters on, a string that may be a secret.
SENSITIVE = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private", "credential", "bearer", "authorization", "signature", "client_id", "session", "cookie")
SHORTEST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~-]{{{SHORTEST},}}")
REACH, AROUND = 60, 2000
#: Share that a candidate must cost of what a random string of its length and alphabet costs.
COST = 0.8
#: Alphabets of secrets, small ones first, and the length up to which a random string is compressed; above, its cost grows evenly.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (_DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER + "234567", _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/_=~-")
LONGEST = 4096

#: Names that code around credentials is full of.
IDENTIFIERS = " ".join("""
authorization authentication application configuration connection environment certificate credentials
access_key access_token api_key api_token aws_access_key_id aws_secret_access_key bearer client_id client_secret
database_url encryption_key private_key public_key refresh_token secret_key session_id session_token signing_key
username password passphrase passwd hostname localhost example default required optional undefined null true false
import export return function class public private static const string number boolean object default_value
github gitlab google amazon azure docker kubernetes postgres mysql mongodb redis https http www com org net
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_token_here xxxxxxxxxxxxxxxx
""".split()).encode()


def cost(candidate: str, around: str) -> int:
    """Bytes that ``candidate`` adds after the identifiers and the text around it."""
    known = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(c.compress(candidate.encode())) - len(c.compress(b""))


@lru_cache(None)
def _random_cost(alphabet: str, n: int) -> int:
    return cost("".join(random.Random(n).choices(alphabet, k=n)), "")


def random_cost(candidate: str) -> float:
    """Bytes that a random string of the candidate's length, over the least alphabet that holds it, adds."""
    alphabet, n = next(a for a in ALPHABETS if set(a).issuperset(candidate)), len(candidate)
    return _random_cost(alphabet, min(n, LONGEST)) * max(1, n / LONGEST)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and not overlapping within a kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Strings after sensitive words, outside the base spans, that cost nearly what random ones would."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    out, done = [], 0
    for word in _SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(word.end(), done), min(len(text), word.end() + REACH + SHORTEST - 1)):
            # the reach bounds where a string starts, not where it ends
            a, b = m.start(), CANDIDATE.match(text, m.start()).end()
            done = max(done, b)
            s = text[a:b].strip("=-_~")
            classes = any(map(str.isdigit, s)) + any(map(str.islower, s)) + any(map(str.isupper, s[1:]))  # a capital at the start is a sentence's
            if classes < 2 or any(x < b and a < y for x, y, _ in base):
                continue
            if cost(s, text[max(0, a - AROUND):a] + " " + text[b:b + AROUND]) >= COST * random_cost(s):
                out.append((a, b, "novel"))
    return out



def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every row; spans are ``(start, end, kind)`` in code points, by start, end exclusive.

    Null and empty texts have no spans; rows are scanned one by one, so repeated rows and
    null ids stay as they are. Other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T._parse_datatype_string("array<struct<start:int,end:int,kind:string>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                found = sorted(base + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"start": x, "end": y, "kind": k} for x, y, k in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mark``; other columns as they are, null stays null."""
    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            base, out, at = base_spans(text), [], 0
            for a, b, _ in sorted(base + novel_spans(text, base)):
                if b > at:
                    out += [text[at:a], mark] if a >= at else []
                    at = b
            return "".join(out) + text[at:]
        return texts.map(one, na_action=None)

    return docs.withColumn("text", clean("text"))
