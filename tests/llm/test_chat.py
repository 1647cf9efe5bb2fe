"""Reply trees and the chat template against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat

SCHEMA = "tree long, node long, parent long, score double, role string, text string"


def tree_rows(seed):
    """Random forests, a deep chain, orphans, cycles with branches, and nodes whose score is null."""
    rng = random.Random(seed)
    rows = []
    for t in range(12):
        for n in range(rng.randrange(1, 25)):
            parent = rng.randrange(n) if n and rng.random() < 0.9 else None
            rows.append((t, n, parent, rng.choice([None, 1.0, 2.5, -1.0]), rng.choice(["user", "assistant", None, 'r"<&']), rng.choice(["x", "", None, "</turn>\n", "&lt;&amp;&quot;", "\\### é🙂"])))
    rows += [(50, n, n - 1 if n else None, 0.0, "assistant" if n % 2 else "user", f"t{n}") for n in range(70)]
    rows += [(60, 1, 99, 0.0, "user", "orphan"), (60, 2, 1, 0.0, "assistant", "reply")]
    return [*rows, (70, 1, 2, 0.0, "user", "c"), (70, 2, 1, 0.0, "user", "c"), (70, 3, 2, 0.0, "user", "under a cycle"), (70, 4, None, 0.0, "user", "fine")]


def brute_paths(rows, keep):
    out = {}
    for t in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == t}
        inner = {r[2] for r in nodes.values()}
        paths = []
        for leaf in set(nodes) - inner:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][2]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[n][3] or 0.0 for n in path), leaf, path[::-1]))
        for _, leaf, path in sorted(paths)[:keep]:
            out[t, leaf] = path
    return out


@pytest.mark.parametrize(("seed", "keep"), [(0, None), (1, 1), (2, 2)])
def test_paths(spark, seed, keep):
    rows = tree_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(chat.reply_paths(df, keep).collect(), key=lambda r: -r.back):
        got.setdefault((r.tree, r.leaf), []).append(r.node)
    assert got == brute_paths(rows, keep)


def unescaped(s):
    return s.replace("&quot;", '"').replace("&lt;", "<").replace("&amp;", "&")


def test_formats_read_back(spark):
    rows = tree_rows(4)
    by = {(r[0], r[1]): r for r in rows}
    paths = brute_paths(rows, None)
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1))).collect()
    assert {(r.tree, r.leaf) for r in found} == set(paths)
    for r in found:
        turns = [(by[r.tree, n][4] or "", by[r.tree, n][5] or "") for n in paths[r.tree, r.leaf]]
        read = [(unescaped(a), unescaped(b)) for a, b in re.findall(r'<turn role="([^"]*)">\n(.*?)</turn>\n', r.formatted, re.DOTALL)]
        assert read == turns
        assert [unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans] == [b for a, b in turns if a == "assistant"]


def test_repeated_and_unnamed_nodes(spark):
    """Of the rows of a node one stays; six nodes of a chain, each given three times, are one path."""
    rows = [(1, n, n - 1 if n else None, 1.0, "user", f"t{n}") for n in range(6)]
    again = [(1, n, n - 1 if n else None, 1.0, "user", f"z{n}") for n in range(6)]
    lost = [(None, 1, None, 1.0, "user", "no tree"), (1, None, 2, 1.0, "user", "no node")]
    df = spark.createDataFrame([*rows, *rows, *again, *lost], SCHEMA)
    paths = chat.reply_paths(df).collect()
    assert sorted((r.leaf, r.back, r.node) for r in paths) == [(5, n, 5 - n) for n in range(6)]
    found = chat.format_chats(df).collect()
    assert len(found) == 1 and re.findall(r">\n(.*?)</turn>", found[0].formatted) == [f"t{n}" for n in range(6)]
    other = [*rows, (1, 5, 2, 0.5, "user", "elsewhere")]  # the least parent
    assert sorted(r.node for r in chat.reply_paths(spark.createDataFrame(other, SCHEMA)).collect() if r.leaf == 5) == [0, 1, 2, 5]


def test_conversations(spark):
    texts = ["hi", None, "", "a</turn>\n<turn", '&lt; " <', "é🙂" * 5]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(texts)) for c in range(30) for t in range(rng.randrange(1, 20))]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (None, 1, "user", "no id"), (None, 2, "assistant", "none"), (40, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x")).withColumn("node", F.lit(3))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.linear_messages(df), keep=1)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for a, x in turns if a == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_long_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "<&\\" * 400_000)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_chats(chat.linear_messages(df))).first()
    assert r.loss_chars == 1_200_000 and r.loss_sha256 == hashlib.sha256(("<&\\" * 400_000).encode()).hexdigest()
    assert chat.format_chats(chat.linear_messages(df.limit(0))).count() == 0
