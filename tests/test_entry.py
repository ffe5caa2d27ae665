"""The entry points without the training-data subpackage."""

import sys

import __spark_entry__ as entry


def test_queries_stay_where_the_subpackage_cannot_be_imported(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm.queries", None)
    names = entry.queries()
    assert "log2_fold_changes" in names and "p4_found" in names and set(entry.oracle_sql()) <= set(names)
    assert "p3_found" not in names
