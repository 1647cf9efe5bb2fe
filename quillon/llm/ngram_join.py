"""Similarity join on word n-grams with prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first n - ceil(t n) + 1 tokens
of each, under any one order of all tokens. The orders here put tokens of a single document first (they can
be shared with nobody), then order the others by document frequency, or by one of two mixed hashes.
Candidates share a token of their frequency prefixes, fit by length and position, and must also share
one in the prefixes of both other orders before their sets are compared.

Document frequencies are counted exactly and in bulk: a batch of documents sends each bucket of the token
space one packed row; a token that many documents of a batch have is sent once, with a count. Buckets return the
tokens with a frequency of 2 or more, which is all that frequency order, intersections and verification need.

Equal sets are one class. Within a token's group, documents are first compared with one leader of about their
length, round by round, and what turns out connected is contracted; then all pairs of a group that lie in
different components are compared, so no link between components is lost and a large group of near copies
costs a few comparisons a document instead of all pairs.

Defined cases: null texts and texts without words have no tokens and are linked with nothing; texts with fewer
words than an n-gram are one token; A-Z are lowercased, words are runs of characters other than
``[\\x20\\x09-\\x0D]``; a component is named by its smallest id (null only if it has no other); repeated rows
link like equal texts; an empty table gives an empty result; a text may be of any length and is hashed a part at a time; of the ids of a tie
the smallest names a component; other columns, whatever their names, are carried by ``drop_near_copies`` and
ignored by the others.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType

from quillon.llm import common
from quillon.llm.components import components

#: Text bytes and documents in a batch, at most (one document may be longer).
BATCH_BYTES, BATCH_DOCS = 4 << 20, 16_384
#: Tokens in a bucket, about; buckets at least.
BUCKET_TOKENS, MIN_BUCKETS = 1 << 20, 64
#: A token that so many documents of a batch have is sent once, with its count.
HOT = 32
KEY_BITS = 64
ROUNDS = 2
#: Up to so many rows, decisions are broadcast to the texts.
BROADCAST_ROWS = 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes are kept.
KNOWN_WORDS = 200_000
_CHUNK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word to 64 bits of its BLAKE2b digest, so that no words can be chosen to meet."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_hashes = _Hashes()


def _words(text: bytes) -> np.ndarray:
    """The hashes of a text's words, a part of the text at a time: lower() and split() of bytes know A-Z and ``[\\x20\\x09-\\x0D]`` only."""
    parts, at = [], 0
    while at < len(text):
        m = _BLANK.search(text, at + _CHUNK) if at + _CHUNK < len(text) else None
        end = m.start() if m else len(text)
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct n-grams of each text, by document, then hash."""
    hashed = [_words(t) for t in texts]
    n_words = np.array([len(x) for x in hashed], np.int64)
    w = np.concatenate([np.empty(0, np.uint64), *hashed])
    doc = np.repeat(np.arange(len(texts)), n_words)
    n = len(w)
    if n >= words:
        h = w[: n - words + 1]
        for j in range(1, words):
            h = _mix(h * _MULTIPLIER + w[j : n - words + 1 + j])
        ok = doc[: n - words + 1] == doc[words - 1 :]
        h, d = h[ok], doc[: n - words + 1][ok]
    else:
        h, d = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = ((n_words > 0) & (n_words < words)).nonzero()[0]
    if len(short):
        first = np.searchsorted(doc, short)
        hs = _mix(n_words[short].astype(np.uint64))
        for j in range(words - 1):
            has = n_words[short] > j
            hs[has] = _mix(hs[has] * _MULTIPLIER + w[first[has] + j])
        h, d = np.concatenate([h, hs]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    h = _mix(h)
    edges = np.searchsorted(d, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _pack(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and differences of as many bytes as the largest takes; the first byte tells."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(keys) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, packed[0])
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, : packed[0]] = steps
    return np.frombuffer(packed, np.uint64, 1, 1) + np.cumsum(wide.view("<u8").reshape(-1), dtype=np.uint64)


_SENT = "bucket int, batch long, info binary, keys binary, who binary, counts binary"
_HOT_MARK = 0xFFFF


def _facts_bucket(batch: int, buckets: int) -> int:
    """The bucket that a batch's facts pass through: numbers start over in each task, so they are mixed, or most tasks' facts would meet in one."""
    return int(_mix(np.array([batch], np.uint64))[0]) % buckets


def _send(words: int, buckets: int):
    """Documents (id, key, text) to packed rows: one a batch and bucket, and one of facts a batch."""
    shift = np.uint64(KEY_BITS - buckets.bit_length() + 1)

    def batch_rows(batch: int, ids: list, keys: list, texts: list[bytes]) -> pa.RecordBatch:
        doc, h = shingles(texts, words)
        n = np.bincount(doc, minlength=len(texts))
        edges = np.concatenate([[0], np.cumsum(n)])
        digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
        key = h >> np.uint64(64 - KEY_BITS)
        order = np.argsort(key, kind="stable")
        key, who = key[order], doc[order].astype(np.uint16)
        first = np.concatenate([[True], key[1:] != key[:-1]]).nonzero()[0] if len(key) else np.empty(0, np.int64)
        runs = np.diff(np.append(first, len(key)))
        hot = np.repeat(runs >= HOT, runs)
        info = pickle.dumps({"ids": ids, "keys": keys, "n": n.astype(np.uint32), "digests": digests, "hot_keys": key[first[runs >= HOT]], "hot_runs": runs[runs >= HOT].astype(np.uint32), "hot_who": who[hot]})
        single = ~hot
        single[first] = True
        marks = np.where(hot, np.uint16(_HOT_MARK), who)[single]
        counts = np.repeat(runs, runs)[single].astype(np.uint32)
        key = key[single]
        bucket = (key >> shift).astype(np.int64)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        used = (np.diff(at) > 0).nonzero()[0].tolist()
        parts = [(at[b], at[b + 1]) for b in used]
        return pa.record_batch(
            [
                pa.array([_facts_bucket(batch, buckets), *used], pa.int32()),
                pa.array([batch] * (len(used) + 1), pa.int64()),
                pa.array([info] + [None] * len(used), pa.binary()),
                pa.array([None] + [_pack(key[a:b]) for a, b in parts], pa.binary()),
                pa.array([None] + [marks[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([None] + [counts[a:b][marks[a:b] == _HOT_MARK].tobytes() for a, b in parts], pa.binary()),
            ],
            names=["bucket", "batch", "info", "keys", "who", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, keys, texts, size = [], [], [], 0
        for batch in batches:
            for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = t.as_py() or b""
                if texts and (size + len(raw) > BATCH_BYTES or len(texts) == BATCH_DOCS):
                    yield batch_rows(number, ids, keys, texts)
                    number, ids, keys, texts, size = number + 1, [], [], [], 0
                ids.append(i)
                keys.append(k)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield batch_rows(number, ids, keys, texts)
        _hashes.clear()  # other stages need the worker's memory
        common.release()

    return run


_RETURNED = "batch long, info binary, keys binary, who binary, freq binary"


def _count(rows: pa.Table) -> pa.Table:
    """A bucket's packed rows: to every batch its tokens that two or more documents have, with their frequency."""
    common.release()  # what the bucket before took
    batches, infos = rows["batch"].to_pylist(), rows["info"].to_pylist()
    packed = [(b, _unpack(k), np.frombuffer(w, np.uint16), np.frombuffer(c, np.uint32)) for b, k, w, c in zip(batches, rows["keys"].to_pylist(), rows["who"].to_pylist(), rows["counts"].to_pylist(), strict=True) if k is not None]
    out = {"batch": [b for b, i in zip(batches, infos, strict=True) if i is not None], "info": [i for i in infos if i is not None]}
    out |= {k: [None] * len(out["batch"]) for k in ("keys", "who", "freq")}
    if packed:
        keys = np.concatenate([p[1] for p in packed])
        weight = np.ones(len(keys), np.int64)
        who = np.concatenate([p[2] for p in packed])
        weight[who == _HOT_MARK] = np.concatenate([p[3] for p in packed])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        first = np.concatenate([[True], s[1:] != s[:-1]]).nonzero()[0]
        freq = np.empty(len(keys), np.int64)
        freq[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(s))))
        at = 0
        for b, k, w, _ in packed:
            f = freq[at : at + len(k)]
            at += len(k)
            kept = f > 1
            if kept.any():
                out["batch"].append(b)
                out["info"].append(None)
                out["keys"].append(_pack(k[kept]))
                out["who"].append(w[kept].tobytes())
                out["freq"].append(np.minimum(f[kept], 0xFFFF).astype(np.uint16).tobytes())
    return pa.table([pa.array(out["batch"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("info", "keys", "who", "freq"))], names=["batch", "info", "keys", "who", "freq"])


def needed(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked to."""
    return -(-num * n // den)


def _documents(num: int, den: int, id_type: pa.DataType):
    """A batch's returned rows to one row a document, with its prefix and the tokens to verify with if it can have a partner."""

    def run(rows: pa.Table) -> pa.Table:
        batch = rows["batch"][0].as_py()
        facts = pickle.loads(next(i for i in rows["info"].to_pylist() if i is not None))
        parts = [(_unpack(k), np.frombuffer(w, np.uint16), np.frombuffer(f, np.uint16)) for k, w, f in zip(rows["keys"].to_pylist(), rows["who"].to_pylist(), rows["freq"].to_pylist(), strict=True) if k is not None]
        empty = (np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.uint16))
        key, who, freq = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        hot = who == _HOT_MARK
        if hot.any():
            order = np.argsort(key[hot])
            runs = facts["hot_runs"]  # every hot token comes back: its frequency is at least HOT
            freq_hot = freq[hot][order]
            key, who, freq = (np.concatenate(x) for x in ((key[~hot], np.repeat(facts["hot_keys"], runs)), (who[~hot], facts["hot_who"]), (freq[~hot], np.repeat(freq_hot, runs))))
        order = np.lexsort((key, freq, who))
        key, who = key[order], who[order]
        n_docs = len(facts["n"])
        edges = np.searchsorted(who, np.arange(n_docs + 1))
        out: dict[str, list] = {k: [] for k in ("candidate", "alone", "prefix", "second", "third", "tokens")}
        for d in range(n_docs):
            n, own = int(facts["n"][d]), key[edges[d] : edges[d + 1]]
            alone = n - len(own)
            first = n - needed(n, num, den) + 1 - alone
            candidate = n > 0 and first > 0
            out["candidate"].append(candidate)
            out["alone"].append(alone)
            if candidate:
                out["prefix"].append(own[:first].astype(np.int64))
                for name, salt in (("second", 0x2545F4914F6CDD1D), ("third", 0x27220A95FE5DDF4B)):
                    mixed = _mix(own ^ np.uint64(salt)) >> np.uint64(32)
                    out[name].append(np.sort(mixed)[:first].astype(np.uint32).tobytes())
                out["tokens"].append(np.sort(own).tobytes())
            else:
                for name in ("prefix", "second", "third", "tokens"):
                    out[name].append(None)
        return pa.table(
            [
                pa.array([batch * 65536 + d for d in range(n_docs)], pa.int64()),
                pa.array(facts["ids"], id_type),
                pa.array(facts["keys"], pa.int64()),
                pa.array(facts["n"].astype(np.int64)),
                pa.array(facts["digests"], pa.binary()),
                pa.array(out["candidate"], pa.bool_()),
                pa.array(out["alone"], pa.int64()),
                pa.array(out["prefix"], pa.list_(pa.int64())),
                *(pa.array(out[k], pa.binary()) for k in ("second", "third", "tokens")),
            ],
            names=["rid", "doc_id", "text_key", "n", "digest", "candidate", "alone", "prefix", "second", "third", "tokens"],
        )

    return run


def analysed(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document, stored: rid, doc_id, text_key, n, digest, candidate, alone, prefix, second, third, tokens."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = MIN_BUCKETS
    while buckets * BUCKET_TOKENS * 6 < size:
        buckets *= 2
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    sent = rows.mapInArrow(_send(words, buckets), _SENT)
    returned = sent.groupBy("bucket").applyInArrow(_count, _RETURNED)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"rid long, doc_id {kind}, text_key long, n long, digest binary, candidate boolean, alone long, prefix array<long>, second binary, third binary, tokens binary"
    return common.stored(returned.groupBy("batch").applyInArrow(_documents(num, den, id_type), schema), "shingles")


def _shares(a, b) -> np.ndarray:
    return np.array([not set(np.frombuffer(x, np.uint32).tolist()).isdisjoint(np.frombuffer(y, np.uint32).tolist()) for x, y in zip(a, b, strict=True)], bool)


@F.pandas_udf(BooleanType())
def _share_prefixes(a2: pd.Series, b2: pd.Series, a3: pd.Series, b3: pd.Series) -> pd.Series:
    return pd.Series(_shares(a2, b2) & _shares(a3, b3))


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _linked(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches num / den."""
    side = lambda x, columns: members.select(F.col("rid").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    near = pairs
    for x in ("a", "b"):
        near = near.join(side(x, ("second", "third")), x)
    near = near.filter(_share_prefixes("a_second", "b_second", "a_third", "b_third")).select("a", "b")
    for x in ("a", "b"):
        near = near.join(side(x, ("n", "tokens")), x)
    near = near.withColumn("both", _common("a_tokens", "b_tokens"))
    return near.filter(den * F.col("both") >= num * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b")


def _fits(num: int, den: int):
    """Whether a pair can be linked, by the lengths and by where its first common token stands."""
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return (den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")) & ((den + num) * rest >= num * (F.col("a_n") + F.col("b_n")))


def _prefixes(members: DataFrame) -> tuple[DataFrame, int]:
    """A row for each token of the members' prefixes that several have: rid, n, alone, token, at, c (how many have it); the rows above which a token is hot."""
    spread = members.select("rid", "n", "alone", F.posexplode("prefix").alias("place", "token")).select("rid", "n", "alone", "token", (F.col("alone") + F.col("place")).alias("at"))
    tokens = common.stored(spread.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "tokens")
    total = tokens.agg(F.sum("c")).first()[0] or 0
    return common.stored(common.skew_safe_join(spread, tokens, "token", "c", total, "inner"), "prefixes"), max(total // common.HEAVY_KEYS, 1)


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """rows, each with its group's one row; both have c. Groups of hot tokens, HEAVY_KEYS tokens at most, are broadcast; no other token is large."""
    cold = rows.filter(F.col("c") <= hot).join(groups.filter(F.col("c") <= hot).drop("c"), keys)
    return rows.filter(F.col("c") > hot).join(F.broadcast(groups.filter(F.col("c") > hot).drop("c")), keys).unionByName(cold)


def class_roots(members: DataFrame, num: int, den: int) -> DataFrame:
    """members: one candidate a class. One row for each class that is linked with others and isn't the least of them: node, root (rids)."""
    spread, hot = _prefixes(members)
    spread = spread.withColumn("root", F.col("rid"))
    links = None
    width = float(np.log(den / num))

    def contracted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        named = rows.drop("root").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        several = named.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("c").alias("c")).filter("x < y").select("token", "c")
        return common.stored(_with_groups(named, several, ["token"], hot), "prefixes")

    for r in range(ROUNDS + 1):
        a = spread.select("token", "c", F.col("rid").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("root").alias("a_root"))
        b = spread.select("token", "c", F.col("rid").alias("b"), F.col("n").alias("b_n"), "alone", F.col("at").alias("b_at"), F.col("root").alias("b_root"))
        if r < ROUNDS:
            band = lambda n: F.floor(F.log(n) / width + 0.5 * (r % 2))  # noqa: E731, B023
            # of near copies the one with the fewest tokens of its own is closest to the others
            leader = F.min(F.struct("alone", F.xxhash64("b", F.lit(r)).alias("h"), "b", "b_n", "b_at", "b_root")).alias("l")
            leaders = b.groupBy("token", band("b_n").alias("band")).agg(leader, F.max("c").alias("c")).select("token", "band", "c", "l.b", "l.b_n", "l.b_at", "l.b_root")
            pairs = _with_groups(a.withColumn("band", band("a_n")), leaders, ["token", "band"], hot)
        else:
            pairs = a.join(b, "token").filter(F.col("a_root") < F.col("b_root"))
        pairs = pairs.filter((F.col("a_root") != F.col("b_root")) & _fits(num, den)).select("a", "b").distinct()
        found = common.stored(_linked(pairs, members, num, den), "links")
        new = found if links is None else links.unionByName(found)
        if links is not None and found.isEmpty():
            continue
        links = new
        roots = components(links)
        if r < ROUNDS:
            before, spread = spread, contracted(spread, roots)
            common.discard(before)
            if spread.isEmpty():
                break
    return roots


def class_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """members: one candidate a class. Every link between two classes: a, b (rids, a < b)."""
    spread, _ = _prefixes(members)
    a = spread.select("token", F.col("rid").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    b = spread.select("token", F.col("rid").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    return _linked(a.join(b, "token").filter(F.col("a") < F.col("b")).filter(_fits(num, den)).select("a", "b").distinct(), members, num, den)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents that can have a partner; their classes of equal sets (digest, rep, n_same); a member a class."""
    possible = rows.filter("candidate")
    classes = common.stored(possible.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("n_same")), "classes")
    members = common.stored(possible.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "alone", "prefix", "second", "third", "tokens"), "members")
    return possible, classes, members


def _analysed_groups(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and of those that can have a partner: rid, doc_id, text_key, n, root (a rid)."""
    with common.scratch() as keep:
        rows = keep(analysed(docs, words, num, den, id_col, text_col))
        possible, classes, members = _classes(rows)
        roots = class_roots(members, num, den)
        named = classes.join(roots, classes["rep"] == roots["node"], "left").select("digest", "n_same", F.coalesce("root", "rep").alias("root"))
        light = possible.select("rid", "doc_id", "text_key", "n", "digest")
        return rows, keep(common.stored(common.skew_safe_join(light, named, "digest", "n_same", light.count(), "inner").drop("digest", "n_same"), "rooted"))


def similarity_links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, as pairs of classes of equal sets (a, b), and the documents of the classes that can have links: doc_id, class.

    The documents of a class are linked with each other and with those of the classes it is paired with. Unlike
    groups, links are as many as they are: a large group of near copies that differ takes all its pairs.
    """
    possible, classes, members = _classes(analysed(docs, words, num, den, id_col, text_col))
    total = possible.count()
    light = possible.select("doc_id", "digest")
    return class_links(members, num, den), common.skew_safe_join(light, classes, "digest", "n_same", total, "inner").select("doc_id", F.col("rep").alias("class"))


def similarity_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id. Documents are linked if den * intersection >= num * union."""
    rows, rooted = _analysed_groups(docs, words, num, den, id_col, text_col)
    names = common.stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_same")), "names")
    grouped = common.skew_safe_join(rooted, names, "root", "n_same", rooted.count(), "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter(~F.col("candidate")).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(grouped)


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, without those linked to another one that stays: of each group the row with the smallest id."""
    _, rooted = _analysed_groups(docs, words, num, den, id_col, text_col)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rid")).alias("best"), F.count("*").alias("n_same")).filter("n_same > 1")
    best = common.stored(best, "best")
    key, stays, row = (common.free_name(docs, x) for x in ("text_key", "stays", "row"))
    judged = common.skew_safe_join(rooted, best, "root", "n_same", rooted.count(), "inner")
    # rows of one id and text are judged together; if one of them stays, exactly one does
    decided = judged.groupBy("doc_id", "text_key").agg(F.max(F.col("rid") == F.col("best.rid")).alias(stays)).select(F.col("doc_id").alias(row), F.col("text_key").alias(key), stays)
    decided = common.stored(decided, "decided")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    key_of = common.free_name(docs, "key_of")
    other = decided.withColumnRenamed(key, key_of)
    if decided.count() <= broadcast_rows:
        other = F.broadcast(other)
    joined = keyed.join(other, (F.col(key) == F.col(key_of)) & F.col(id_col).eqNullSafe(F.col(row)), "left")
    free = joined.filter(F.col(stays).isNull()).select(*docs.columns)
    chosen = joined.filter(stays).dropDuplicates([id_col, key]).select(*docs.columns)
    return free.unionByName(chosen)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(common.table(spark, sf_dir, "documents"), words=4, num=85, den=100)


QUERIES = {"op5_ngram_join": op5_ngram_join}

ORACLE_SQL = {
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a) c USING (doc_id)
""",
}
