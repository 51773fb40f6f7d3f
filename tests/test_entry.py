import importlib

import __spark_entry__


def test_entry_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "quality_status", "confidence_mean", "confidence_min", "review_count", "line_count"] and out.count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


def test_the_rest_stands_without_the_operators(monkeypatch):
    """With the training-data operators gone, the entry imports and has all other queries."""
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert alone.llm_queries is None and set(alone.queries()) == set(alone.plans.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_nothing_else_imports_the_operators():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    others = [p for p in root.glob("folioscope/**/*.py") if "llm" not in p.parts]
    assert others and not [p for p in others if "folioscope.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text()]
