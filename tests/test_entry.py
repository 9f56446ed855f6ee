"""The entry module must work without the optional subpackage."""

import sys


def test_without_subpackage(spark, monkeypatch):
    for name in [n for n in sys.modules if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("tabdrift.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tabdrift.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "keyed_diff_ops" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")
