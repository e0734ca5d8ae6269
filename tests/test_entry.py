"""The driver's contract, with and without the training-data subpackage."""

import importlib
import sys

from folioscope import registry


def test_entry_has_every_query(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("folioscope.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "folioscope.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries())
    sys.modules.pop("__spark_entry__")
