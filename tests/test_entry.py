import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
    if Path("/root/testdata/sf0.001").is_dir():
        assert e.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "tallyspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), p
