"""The driver entry with and without the training-data subpackage."""

import sys

import pytest

import __spark_entry__


@pytest.mark.parametrize("missing", [["spoorline.llm"], ["corpus_pipeline"], ["spoorline.llm.registry", "corpus_pipeline"]])
def test_entry_without_the_subpackage(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith(("spoorline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    if "spoorline" in sys.modules and hasattr(sys.modules["spoorline"], "llm"):
        monkeypatch.delattr(sys.modules["spoorline"], "llm")
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    found = __spark_entry__.queries()
    assert "bm25_metrics" in found and not any(n.startswith("op") and n[2].isdigit() for n in found) and "pipeline" not in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
