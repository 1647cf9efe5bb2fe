"""Quality classifier: a sparse rule ensemble over text statistics.

Every document becomes a row of statistics. Small boosted trees are grown on labelled documents; each path
from a root is a conjunctive rule; a lasso logistic regression weighs the rules, most of them to zero; the
remaining ones are compiled into one Spark column expression that scores the statistics.

Defined cases: null and empty texts have statistics of 0 and are scored like any other; without labels of
both classes every score is the share of label 1 (0.5 without labels); several labels of one document all
count, as weights; labels with a null id or quality are ignored; equal rows have equal scores; texts of any length
are measured whole; equal gains go to the first statistic and the lowest bound; an empty table gives an empty
result; columns besides the id and the text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: About so many labelled rows are learned from, chosen by a hash of the id; all, if fewer.
SAMPLE_ROWS = 20_000
#: Labelled documents are chosen by shares of so many.
PLACES = 1 << 50
TREES, DEPTH, SHRINKAGE, BINS, MIN_LEAF = 24, 3, 0.3, 32, 10
LASSO, STEPS = 2e-3, 400
THRESHOLD = 0.7

STATISTICS = ("n_chars", "n_words", "word_length", "upper", "digits", "symbols", "bars", "exclaims", "non_ascii", "blanks", "distinct_words", "top_word", "top_pair", "lines", "repeated_lines", "stops", "longest_word", "sentence_length")


def _classes() -> np.ndarray:
    """For each byte its class: 0 other, 1 upper, 2 digit, 3 symbol, 4 bar, 5 exclamation, 6 not ASCII, 7 blank."""
    kind = np.zeros(256, np.int64)
    for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*+<=>@^_`{}~/\\[]", 3), (b"|", 4), (b"!", 5), (bytes(range(128, 256)), 6), (b" \t\n\r\x0b\x0c", 7)):
        kind[list(chars)] = k
    return kind


CLASSES = _classes()


def statistics(text: str) -> tuple[float, ...]:
    """The STATISTICS of a text; shares are of its bytes, words or lines."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * len(STATISTICS)
    n = len(raw)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(CLASSES, weights=by_byte, minlength=8)
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = int(by_byte[46] + by_byte[33] + by_byte[63])
    return (
        float(len(text)), float(len(words)), (n - by_class[7]) / w, by_class[1] / n, by_class[2] / n, by_class[3] / n, by_class[4] / n, by_class[5] / n, by_class[6] / n, by_class[7] / n,
        len(counts) / w, top / w, max(pairs.values(), default=0) / w, float(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), ends / w, float(max(map(len, counts), default=0)), w / (ends + 1),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and its STATISTICS."""

    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py() or "") for x in batch.column(1)], float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, bound


def grow_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """The paths of small boosted trees, from the root to each node."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin <= k: x <= cuts[k]
    share = np.average(y, weights=weight)
    score = np.full(len(y), np.log((share + 1e-6) / (1 - share + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        open_nodes: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            following = []
            for path, rows in open_nodes:
                best = None
                if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
                    base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, j]
                        gs, hs, ns = (np.bincount(b, weights=v, minlength=len(c) + 1).cumsum() for v in (g[rows], h[rows], np.ones(len(rows))))
                        gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                        gain = np.where((nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF), gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - base, -1)
                        k = int(gain.argmax())
                        if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k)
                if best is None:
                    score[rows] += SHRINKAGE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                _, j, k = best
                below = binned[rows, j] <= k
                for above, own in ((False, rows[below]), (True, rows[~below])):
                    rule = (*path, (j, above, float(cuts[j][k])))
                    rules[rule] = None
                    following.append((rule, own))
            open_nodes = following
    return list(rules)


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for j, above, bound in rule:
        held &= x[:, j] > bound if above else x[:, j] <= bound
    return held


def fit_lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, m = z.shape
    weight = np.ones(n) if weight is None else weight * n / weight.sum()
    w = v = np.zeros(m + 1)
    a = np.hstack([z, np.ones((n, 1))])
    u = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(20):
        u = a.T @ (weight * (a @ u))
        norm = np.linalg.norm(u)
        u /= norm
    step, t = 4 * n / norm, 1.0
    for _ in range(STEPS):
        new = v - step * (a.T @ (weight * (1 / (1 + np.exp(-(a @ v))) - y))) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * LASSO, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the weighted rules; weight: how often each row counts."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        share = min(max(float(y[0]) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    rules = grow_rules(x, y, weight)
    z = np.stack([applies(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = fit_lasso(z, y, weight)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as one column expression over the STATISTICS."""
    total = F.lit(intercept)
    for rule, weight in rules:
        held = F.lit(True)
        for j, above, bound in rule:
            held = held & (F.col(STATISTICS[j]) > bound if above else F.col(STATISTICS[j]) <= bound)
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    measured = common.stored(measure(docs, id_col, text_col), "statistics")
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("doc_id")))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(PLACES)) < max(1, int(share * PLACES)))
    weighed = chosen.groupBy("doc_id", (F.col("label") == 1).alias("label")).agg(F.count("*").alias("weight"))  # a document with many labels is two rows at most
    rows = measured.join(weighed, "doc_id").select(*STATISTICS, "label", "weight").toPandas().sort_values([*STATISTICS, "label", "weight"])
    x, y = rows[list(STATISTICS)].to_numpy(float), rows["label"].to_numpy(float)
    score = compile_rules(*fit(x, y, rows["weight"].to_numpy(float)))
    scored = measured.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
