"""The driver's three functions, and the main library without the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__

TOP = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    for path in (TOP / "ledgerspark").rglob("*.py"):
        if "llm" in path.relative_to(TOP).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
