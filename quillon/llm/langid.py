"""Language identification by multilingual mixture inference.

Training counts hashed letter trigrams by language over a bounded sample of labelled documents. A document
is a mixture of languages: expectation-maximisation estimates the proportions from its trigram
likelihoods, languages are taken in order of proportion as long as the penalised likelihood rises, and the
largest proportion of the chosen set names the document.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as are all texts when nothing
can be learned; equal proportions go to the language that sorts first; equal rows have equal results; texts
of any length are read whole, SPAN characters at a time; an empty table gives an empty result; other columns,
whatever their names, are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: About so many documents a language are learned from, chosen by a hash of the id; all, if fewer.
SAMPLE_DOCS = 4000
#: A task holds the counts of so many languages before it sends them on.
HELD_LANGS = 64
BUCKETS = 1 << 16
#: Documents are chosen by shares of so many.
PLACES = 1 << 50
SMOOTHING = 0.1
ROUNDS, TOLERANCE = 12, 1e-3
#: Times half the logarithm of the trigrams that another language must add to the log likelihood.
PENALTY = 4.0
SPAN = 250_000


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if a letter, else 0."""
    return np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def _spans(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of the lowercased text, where each run of other characters is one blank, SPAN characters at a time."""
    table, tail = _letters(), np.zeros(1, np.uint32)
    for at in range(0, len(text), SPAN):
        points = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([tail, table[points], np.zeros(int(at + SPAN >= len(text)), np.uint32)])
        x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
        tail = x[-2:]
        if len(x) > 2:
            x = x.astype(np.uint64)
            h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
            yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram, in their order; empty without letters."""
    return np.concatenate([np.empty(0, np.int64), *_spans(text)])


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, ascending, and how often; a long text takes no more memory than SPAN characters."""
    if len(text) <= SPAN:
        return np.unique(trigrams(text), return_counts=True)
    sums = np.zeros(BUCKETS, np.int64)
    for span in _spans(text):
        sums += np.bincount(span, minlength=BUCKETS)
    at = sums.nonzero()[0]
    return at, sums[at]


class Likelihoods:
    """The probability of each trigram bucket in each language; only the counts that aren't 0 are held."""

    def __init__(self, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        order = np.lexsort((lang, bucket))
        self.shape = (BUCKETS, langs)
        self.edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.float64)
        self.total = SMOOTHING * BUCKETS + np.bincount(lang, n, minlength=langs)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The rows of some buckets."""
        first, size = self.edges[at], self.edges[at + 1] - self.edges[at]
        row = np.repeat(np.arange(len(at)), size)
        held = np.arange(len(row)) + np.repeat(first - (np.cumsum(size) - size), size)
        p = np.full((len(at), self.shape[1]), SMOOTHING)
        p[row, self.lang[held]] += self.n[held]
        return p / self.total


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> tuple[list[str], Likelihoods]:
    """All labelled languages, sorted, and the probability of each trigram bucket in each."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id")))
    counts = rows.filter(F.col("text").isNotNull()).groupBy("lang").count().collect()
    langs = sorted(x["lang"] for x in counts)
    if not langs:
        return [], Likelihoods(*(np.empty(0, np.int64) for _ in range(3)), 0)
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PLACES))
    shares = docs.sparkSession.createDataFrame([(x["lang"], max(1, int(min(1.0, sample / x["count"]) * PLACES))) for x in counts], "lang string, share long")
    chosen = rows.filter(F.col("text").isNotNull()).join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("lang", "text")

    def sent(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            at = own.nonzero()[0]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums and len(sums) == HELD_LANGS:
                    yield from sent(sums)
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at, n = trigram_counts(text)
                own[at] += n
        yield from sent(sums)
        common.release()

    summed = chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # at most BUCKETS numbers a language
    column = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    return langs, Likelihoods(found["bucket"].to_numpy(np.int64), column, found["n"].to_numpy(np.int64), len(langs))


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p (likelihoods of distinct trigrams, which occur n times) and the log likelihood."""
    total = n.sum()
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def identify(text: str, table: Likelihoods) -> list[tuple[int, float]]:
    """(column, proportion) of the chosen languages, the largest first; none without letters."""
    at, n = trigram_counts(text if table.shape[1] else "")
    if not len(at):
        return []
    p = table[at]
    order = np.argsort(-mixture(p, n)[0], kind="stable")
    chosen, shares = [order[0]], np.ones(1)
    best = float(n @ np.log(p[:, order[0]]))
    cost = PENALTY * 0.5 * np.log(n.sum() + 1.0)
    for k in order[1:]:
        new, likelihood = mixture(p[:, [*chosen, k]], n)
        if likelihood - best <= cost:
            break
        chosen, shares, best = [*chosen, k], new, likelihood
    found = sorted(zip(chosen, shares, strict=True), key=lambda x: (-x[1], x[0]))
    return [(int(k), float(s)) for k, s in found]


def _predict(rows: DataFrame, langs: list[str], table: Likelihoods, schema: str, keep: int) -> DataFrame:
    """rows has the text as its last column; the result has the first keep columns and lang_pred, score, langs."""
    model = rows.sparkSession.sparkContext.broadcast((langs, table))  # at most BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = model.value
        for batch in batches:
            found = [identify(t, p) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:keep], pa.array([names[f[0][0]] if f else "und" for f in found], pa.string()), pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()), pa.array([",".join(f"{names[k]}:{s:.3f}" for k, s in f) for f in found], pa.string())],
                names=[*batch.schema.names[:keep], "lang_pred", "score", "langs"],
            )

    return rows.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, langs (the chosen set and its proportions)."""
    langs, table = learn(docs, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), common.held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return _predict(rows, langs, table, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs string", 2)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language, however many others it has: all but those that are und."""
    langs, table = learn(docs, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and bool(identify(t, model.value[1])) for t in texts], dtype=bool)

    return docs.filter(identified(F.col(text_col)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_langid": op9_langid}
