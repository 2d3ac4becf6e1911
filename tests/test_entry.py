import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {"p3_found", "p7_found", "tfidf_top10", "rrf", "m_map"} <= set(q)


def test_core_does_not_need_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "rankspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
