"""The similarity join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ngram_join
from quillon.llm.components import components


def token_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    """(id, set size, component) of each row."""
    sets = [token_set(t, k) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holders[t].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for t in s for j in holders[t] if j > i)
        for j, both in shared.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        r = find(i)
        least[r] = min((v for v in (least.get(r), x) if v is not None), default=None)
    return sorted(((x, len(sets[i]), least[find(i)]) for i, (x, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("sf", "k", "num"), [("sf0.01", 4, 85), ("sf0.01", 2, 50)])
def test_corpus(spark, sf, k, num):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(ngram_join.similarity_groups(docs, k, num, 100)) == brute(rows, k, num, 100)


def families(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ABC"]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(own)))
    hot = rng.choices(words, k=80)
    for i in range(120):  # a large group of near copies
        own = list(hot)
        own[rng.randrange(80)] = f"x{i}"
        rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "null id text here now"), (1003, "null id text here now"), (None, None), *rows[:3], (1004, "a b"), (1005, "A B")]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_families(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_DOCS", 50)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("rid", F.lit("x"))
    for k, num in ((4, 85), (2, 60)):
        assert result(ngram_join.similarity_groups(df, k, num, 100)) == brute(rows, k, num, 100)


def test_drop_near_copies(spark):
    rows = families(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stays", F.lit(1)).withColumn("text_key", F.lit("x"))
    want = brute(rows, 5, 80, 100)
    for limit in (10**6, 0):
        kept = ngram_join.drop_near_copies(df, broadcast_rows=limit)
        assert kept.columns == df.columns
        ids = sorted((r.doc_id for r in kept.collect()), key=repr)
        n_alone_null = 1  # the null id without text is linked with nothing
        assert sorted((i for i in ids if i is not None), key=repr) == sorted({c for _, n, c in want if n and c is not None} | {i for i, n, _ in want if not n and i is not None}, key=repr)
        assert sum(i is None for i in ids) == n_alone_null


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similarity_groups(df).count() == 0 and ngram_join.drop_near_copies(df).count() == 0
    one = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert result(ngram_join.similarity_groups(one)) == [(1, 0, 1)] and ngram_join.drop_near_copies(one).count() == 1


def test_shingles_in_chunks(monkeypatch):
    texts = [t.encode() for _, t in families(3) if t]
    whole = ngram_join.shingles(texts, 4)
    monkeypatch.setattr(ngram_join, "_CHUNK", 64)
    parts = ngram_join.shingles(texts, 4)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert [len(token_set(t.decode(), 4)) for t in texts] == np.bincount(whole[0], minlength=len(texts)).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if find(x) != x}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_unlike_words_do_not_meet(spark):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2^64, whatever the base."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([*(f"w{i}" for i in range(9)), x, x])) for i, x in enumerate((word, other))]
    assert result(ngram_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)) == [(0, 8, 0), (1, 8, 1)]


def test_clashing_names(spark):
    rows = families(9)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("text_key", "text_key_of", "KEY_OF", "stays", "row", "rid", "_text_key"):
        df = df.withColumn(name, F.lit("x"))
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


@pytest.mark.parametrize("heavy", [None, 1])
def test_links(spark, monkeypatch, heavy):
    """Every link, copies by their class; also when nearly all tokens count as hot."""
    if heavy:
        monkeypatch.setattr(ngram_join.common, "HEAVY_KEYS", 10**6)
    rows = [(i, t) for i, (_, t) in enumerate(families(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = ngram_join.similarity_links(df, 3, 70, 100)
    of, own = {r.doc_id: r["class"] for r in members.collect()}, defaultdict(list)
    for i, c in of.items():
        own[c].append(i)
    got = {tuple(sorted((i, j))) for c in own.values() for i in c for j in c if i != j}
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(found) == len(set(found))
    got |= {tuple(sorted((i, j))) for a, b in found for i in own[a] for j in own[b]}
    sets = [token_set(t, 3) for _, t in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]) and sets[j]}
    assert got == want
    assert result(ngram_join.similarity_groups(df, 3, 70, 100)) == brute(rows, 3, 70, 100)


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1 << 60), (5, 1 << 56), (1000, 1 << 20), (2000, 1 << 56)):
        keys = np.sort(rng.integers(0, top, n).astype(np.uint64))
        assert np.array_equal(ngram_join._unpack(ngram_join._pack(keys)), keys)


def test_facts_of_many_tasks_are_spread():
    """A bucket gets about as many batches' facts as any other, however the batches are dealt over tasks."""
    for tasks, batches in ((6400, 1), (200, 32)):
        into = Counter(ngram_join._facts_bucket((t << 24) + b, 64) for t in range(tasks) for b in range(batches))
        assert len(into) == 64 and max(into.values()) < 160
