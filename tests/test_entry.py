"""The driver's contract."""

import __spark_entry__


def test_names():
    queries, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(twins) <= set(queries) and "freq_default" in queries


def test_optional_part_is_not_imported_elsewhere():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for path in (root / "strandframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "strandframe.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
