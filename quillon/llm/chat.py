"""Chat formatting of reply trees, with DataFrame functions only.

``reply_paths`` enumerates root-to-leaf paths by self-joins on ids: jump tables of 1, 2, 4, ... replies
double until no node has an ancestor so far away, then every leaf collects its ancestors by the same
jumps, so a tree of depth d takes about 2 log2(d) joins and no join carries text. Branches are ranked by
the sum of their scores; ``format_paths`` writes each chosen path as one conversation.

The template writes a turn as ``<turn role="R">\\nTEXT</turn>\\n``. Inside roles and texts ``&`` becomes
``&amp;`` and ``<`` becomes ``&lt;`` (and, in roles, ``"`` becomes ``&quot;``), so no control string can occur
there, splitting at the closing mark is exact, and unescaping is a plain replacement.

Defined cases: null text or role counts as empty; a reply whose parent is missing is a root; nodes on or
under a cycle have no root and form no path; rows without a tree or a node are left out, and of several rows of one
node the one of the least parent, score, role and text (nulls first) stays; paths of equal score are taken by
leaf. Of conversations, rows of equal turn are ordered by role, then text, and all are kept, repeated rows too;
rows with a null conv_id form one conversation. Texts of any length are formatted whole; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

CLOSE = "</turn>\n"
#: The fixed extra conversation of the query.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def single_nodes(messages: DataFrame) -> DataFrame:
    """One row a (tree, node): the least of its parents, scores, roles and texts, as far as there are such columns."""
    rest = [c for c in ("parent", "score", "role", "text") if c in messages.columns]
    known = messages.filter(F.col("tree").isNotNull() & F.col("node").isNotNull())
    return known.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("row")).select("tree", "node", *(F.col("row")[c].alias(c) for c in rest))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """nodes: tree, node, parent. The tables (tree, node, up) for 1, 2, 4, ... replies upwards, only where such an ancestor exists."""
    ids = nodes.select("tree", "node")
    up = ids.withColumnRenamed("node", "up")
    step = common.stored(nodes.filter(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up")).join(up, ["tree", "up"]).select("tree", "node", "up"), "jump")
    tables, most = [], nodes.count().bit_length()
    while len(tables) <= most and not step.isEmpty():
        tables.append(step)
        above = step.select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        step = common.stored(step.join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up")), "jump")
    return tables


def reply_paths(messages: DataFrame, keep: int | None = None, single: bool = False) -> DataFrame:
    """messages: tree, node, parent, score. One row for each node of each chosen path: tree, leaf, back (replies above the leaf), node.

    keep: at most so many paths a tree, those of the highest summed score, ties to the smaller leaf; None: all.
    single: no (tree, node) comes twice or is null, so nothing needs to be sorted out.
    """
    nodes = (messages if single else common.stored(single_nodes(messages), "nodes")).select("tree", "node", "parent", "score")
    tables = _jumps(nodes)
    inner = nodes.select("tree", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    paths = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    if len(tables) > nodes.count().bit_length():  # a node that is never at its root lies on or under a cycle
        cyclic = tables[-1].select("tree", F.col("node").alias("leaf")).distinct()
        paths, tables = paths.join(cyclic, ["tree", "leaf"], "left_anti"), tables[:-1]
    for k in reversed(range(len(tables))):
        further = paths.join(tables[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = paths.unionByName(further)
        if k:
            paths = common.stored(paths, "paths")
    if keep is not None:
        scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf"))
        chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= keep).select("tree", "leaf")
        paths = paths.join(chosen, ["tree", "leaf"])
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a path: tree, leaf, formatted, loss_spans (start and end, in code points of formatted, of each assistant text)."""
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.col("text")).alias("body"))
    head = F.concat(F.lit('<turn role="'), F.replace(escape(F.col("role")), F.lit('"'), F.lit("&quot;")), F.lit('">\n'))
    turns = paths.join(texts, ["tree", "node"]).select("tree", "leaf", F.struct((-F.col("back")).alias("at"), head.alias("head"), "body", (F.col("role") == "assistant").alias("loss")).alias("turn"))
    grouped = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "")
    size = lambda t: F.char_length(t.head) + F.char_length(t.body) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            (s.at + size(t)).alias("at"),
            F.when(t.loss, F.concat(s.spans, F.array(F.struct((s.at + F.char_length(t.head)).alias("start"), (s.at + F.char_length(t.head) + F.char_length(t.body)).alias("end"))))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    return grouped.select("tree", "leaf", formatted.alias("formatted"), spans.alias("loss_spans"))


def linear_messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as reply trees without branches: every row replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("id"))
    return numbered.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns, read from the formatted texts and their loss masks."""
    turn_texts = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    role_of = lambda t: unescape(F.substring_index(F.substring(t, F.lit(len('<turn role="') + 1), F.char_length(t)), '">\n', 1))
    text_of = lambda t: unescape(F.substring(t, F.instr(t, '">\n') + 3, F.char_length(t)))
    parsed = formatted.withColumn("turn_texts", turn_texts)
    under_mask = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start))), "")
    all_turns = F.array_join(F.transform("turn_texts", lambda t: F.concat(role_of(t), F.lit("\n"), text_of(t), F.lit("\n"))), "")
    return parsed.withColumn("loss", under_mask).select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"),
        F.size("turn_texts").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_chats(messages: DataFrame, keep: int | None = None, single: bool = False) -> DataFrame:
    """messages: tree, node, parent, score, role, text. See reply_paths for keep and single, format_paths for the result."""
    messages = common.stored(messages if single else single_nodes(messages), "messages")
    return format_paths(messages, reply_paths(messages, keep, single=True))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return read_back(format_chats(linear_messages(rows.unionByName(probe)), keep=1, single=True))


QUERIES = {"op2_chat_format": op2_chat_format}

ORACLE_SQL = {
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS text_len,
         length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS role_len
  FROM c)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(text_len + role_len + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
