"""The driver's entry points, with or without the corpus operators."""

import ast
import importlib.util
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "nation_n_name" and df.count() > 0


def test_catalogue_is_complete():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    if importlib.util.find_spec("quillon.llm") and (ROOT / "quillon/llm/registry.py").exists():
        assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries


def test_the_library_does_not_need_the_corpus_operators():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith(("quillon.llm", "corpus_pipeline")) for n in names), path
