import sys

import __spark_entry__ as entry
from basalt import suite


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(suite.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_the_pipeline_or_the_subpackage(monkeypatch):
    """None in sys.modules is a module that can't be found."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = set(entry.queries())
    assert set(suite.QUERIES) <= left and "pipeline" not in left
    for name in [m for m in sys.modules if m == "basalt.llm" or m.startswith("basalt.llm.")]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "basalt.llm", None)
    assert set(entry.queries()) == set(suite.QUERIES)
