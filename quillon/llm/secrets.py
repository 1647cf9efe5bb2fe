"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for assignments, access keys, hex strings and bare mixed tokens. The hash of each
candidate value is aggregated over the corpus by distinct repositories and owners: a value in several
repositories of several owners is a copied example; any other one, in however many repositories of one owner
or under however many owners of one repository, looks like a live credential. Base spans
(``assign access hex``) always stay and only get a verdict; the method adds spans of kind ``token``: bare
high-entropy strings outside base spans that are live-looking by ownership.

Defined cases: null and empty texts have no spans; null repositories and owners count as one value each; equal
rows have equal results; spans of equal start are listed in the order of the kinds; texts of any length are scanned
whole, in time that grows with their length and spans; offsets are code points, ends exclusive; an empty table gives
an empty result; columns besides those named, whatever their names, are ignored (``redact_secrets`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

BASE = ("assign", "access", "hex")
#: A value that so many owners and so many repositories carry is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 3
# The base patterns. The length limits stand in the pattern where a shorter match cannot hide a longer one.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
#: Bare tokens: length, digits and bits of entropy a character at least.
MIN_TOKEN, MIN_DIGITS, MIN_BITS = 20, 4, 3.0
DIGITS = re.compile(r"[0-9]+")
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")

SPAN = "struct<start:long,end:long,kind:string,hash:long>"


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, hash of the value) by start, then kind in the order BASE + token."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_ASSIGN:
            out.append((m.start(), m.end(), 0, value_hash(m[2])))
    out += [(m.start(), m.end(), 1, value_hash(m[0])) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, value_hash(m[0])) for m in HEX.finditer(text)]
    base, done = sorted(out), 0
    starts, furthest = [x[0] for x in base], list(accumulate((x[1] for x in base), max, initial=0))
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in TOKEN_CHARS:
            start -= 1
        while end < len(text) and text[end] in TOKEN_CHARS:
            end += 1
        done = end
        if end - start >= MIN_TOKEN:
            value = text[start:end]
            if sum(c in "0123456789" for c in value) >= MIN_DIGITS and any(c.isalpha() for c in value) and entropy(value) >= MIN_BITS and furthest[bisect_left(starts, end)] <= start:
                out.append((start, end, 3, value_hash(value)))
    return [(s, e, (*BASE, "token")[k], h) for s, e, k, h in sorted(out, key=lambda x: (x[0], x[2]))]


def _text_key(text: Column) -> Column:
    """What decides a document's spans: its text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row a document: doc_id, repo, owner, key (of the text), spans."""

    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.int64())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k, "hash": h} for s, e, k, h in candidates(t)] if t else [] for t in batch.column(4).to_pylist()]
            yield pa.record_batch([*batch.columns[:4], pa.array(found, kind)], names=["doc_id", "repo", "owner", "key", "spans"])

    kinds = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), _text_key(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kinds}, repo string, owner string, key string, spans array<{SPAN}>")


def ownership(scanned: DataFrame) -> DataFrame:
    """One row a value: hash, n_repos, n_owners, n_rows. Distinct counts in two steps, so that no value meets in one task."""
    each = scanned.select("repo", "owner", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    pairs = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_rows"))
    repos = pairs.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return repos.join(owners, "hash").select("hash", "n_repos", "n_owners", "n_rows")


def verdicts(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row a text with candidates: key, live (the hashes of its values that look live), n_same (documents with the text)."""
    values = common.stored(ownership(scanned), "values")
    texts = scanned.filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"), F.count("*").alias("n_same"))
    pairs = texts.select("key", "n_same", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    total = values.agg(F.sum("n_rows")).first()[0] or 0
    judged = common.skew_safe_join(pairs, values, "hash", "n_rows", total, "inner")
    return judged.groupBy("key").agg(F.first("n_same").alias("n_same"), F.collect_list(F.when((F.col("n_owners") < example_owners) | (F.col("n_repos") < example_repos), F.col("hash"))).alias("live"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row a document: doc_id, key, spans (start, end, kind, hash, live)."""
    scanned = common.stored(scan(docs, id_col, text_col, repo_col, owner_col), "secrets")
    judged = common.stored(verdicts(scanned, example_owners, example_repos), "verdicts")
    with_spans = scanned.filter(F.size("spans") > 0)
    joined = common.skew_safe_join(with_spans, judged, "key", "n_same", with_spans.count(), "left").select("doc_id", "key", "spans", "live")
    rows = scanned.filter(F.size("spans") == 0).select("doc_id", "key", "spans", F.array().cast("array<long>").alias("live")).unionByName(joined)
    marked = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.hash.alias("hash"), F.array_contains("live", s.hash).alias("live")))
    return rows.select("doc_id", "key", F.filter(marked, lambda s: (s.kind != "token") | s.live).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s.kind != "token")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"))


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with a mark in place of each of the spans, which are in order; those that overlap have one mark."""
    parts, at = [], 0
    for start, end in spans:
        if end > at:
            if start >= at:
                parts += (text[at:start], mark)
            at = end
    return "".join((*parts, text[at:]))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]", broadcast_rows: int = 100_000) -> DataFrame:
    """docs with every live-looking span replaced by mark; copied examples stay. All rows and columns are kept.

    Texts to redact are few; up to broadcast_rows of them, with ten times as many spans, their spans are broadcast and
    no text is shuffled; beyond that the texts are joined by their keys.
    """
    found = find_secrets(docs, id_col, text_col, id_col, owner_col)
    live = found.select("key", F.filter("spans", lambda s: s.live).alias("spans")).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"), F.count("*").alias("n_same"))
    key, spans = common.free_name(docs, "text_key"), common.free_name(docs, "live_spans")
    live = common.stored(live.select(F.col("key").alias(key), F.col("spans").alias(spans), "n_same").withColumnRenamed("n_same", common.free_name(docs, "n_same")), "live")
    size = common.free_name(docs, "n_same")
    rows = docs.withColumn(key, _text_key(F.col(text_col)))
    found = live.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("spans")).first()
    if found["rows"] <= broadcast_rows and found["spans"] <= 10 * broadcast_rows:
        joined = rows.join(F.broadcast(live.drop(size)), key, "left")
    else:
        joined = common.skew_safe_join(rows, live, key, size, docs.count(), "left")
    text = F.col(text_col)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, zip(a.tolist(), b.tolist(), strict=True), mark) for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    # other texts don't go to Python
    live_text = F.when(F.col(spans).isNotNull(), text)
    return joined.withColumn(text_col, F.coalesce(cleaned(live_text, F.col(f"{spans}.start"), F.col(f"{spans}.end")), text)).select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(common.table(spark, sf_dir, "documents")))


QUERIES = {"op3_secrets": op3_secrets}
