from __future__ import annotations


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["source_id", "field_id", "match_id", "score"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
