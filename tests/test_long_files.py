"""Chunks of long files: work in proportion to their length."""

import ast

import pytest

from strataline.operators.chunkers import code as K

TEXTS = {"ts": "export function f_%d(a) {\n  return a\n}\n\n", "py": "def f_%d(a):\n    return a\n\n\n", "rb": "def f_%d(a)\n  a\nend\n\n"}


@pytest.mark.parametrize("extension", sorted(TEXTS))
def test_a_files_imports_are_read_once(spark, extension):
    registry, n = K.default_registry(), 200
    plugin = registry.plugin_for(f"a.{extension}")
    head = {"ts": "import a from 'a'\n", "py": "import a\n", "rb": "require 'a'\n"}[extension]
    content = head + "\n\n\n" + "".join(TEXTS[extension] % i for i in range(n))

    class Counting(type(plugin)):
        seen = 0

        def imports(self, content):
            Counting.seen += 1
            if Counting.seen > 1:
                raise AssertionError("read again")
            return super().imports(content)

    registry.register(Counting())
    rows = K.chunk_files(spark.createDataFrame([(f"a.{extension}", content)], "path string, content string"), registry=registry).orderBy("line_start").collect()
    assert [r["name"] for r in rows] == [f"f_{i}" for i in range(n)] and [r["line_start"] for r in rows] == [5 + 4 * i for i in range(n)]
    assert all(head.strip() in r["content"] for r in rows)


def test_null_paths_and_texts_give_nothing_and_empty_ones_a_chunk(spark):
    rows = K.chunk_files(spark.createDataFrame([("a.ts", ""), (None, "x"), ("b.py", None), ("c.txt", "x")], "path string, content string")).collect()
    assert [(r["file_path"], r["line_end"]) for r in rows] == [("a.ts", 1)]


def test_python_too_nested_for_the_parser_is_one_chunk(spark):
    content = "\n" * 60 + "x = " + "-" * 20_000 + "1\n"
    with pytest.raises(MemoryError):
        ast.parse(content)
    (row,) = K.chunk_files(spark.createDataFrame([("a.py", content)], "path string, content string")).collect()
    assert row["chunk_type"] == "other" and row["line_end"] == 62 and row["content"].endswith(content)


def test_statistics_count_files_too_nested_for_the_parser(spark):
    from strataline.sources.store import code_stats

    content = "\n" * 60 + "x = " + "-" * 20_000 + "1\n"
    files = spark.createDataFrame([("a.py", content), ("b.py", "x = 1\n")], "path string, content string")
    assert tuple(code_stats(K.chunk_files(files)).first()) == (2, 2)


def test_code_queries_take_odd_documents_as_sql_does(spark, tmp_path):
    import duckdb

    from strataline.plans import catalog

    ids = [-(2**63), -5, -4, -3, -2, -1, None, 0, 1, 2, 3, 2**63 - 1]
    texts = [None, "", "x", "a b\n" * 70, "\n" * 60 + "x = " + "-" * 20_000 + "1"]
    rows = [(i, t, s) for i in ids for t in texts for s in ("src1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("stats_code", "code_chunks", "package_names"):
        want = con.sql(catalog.ORACLES[name]).fetchall()
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name


def test_a_lack_of_memory_is_not_hidden(monkeypatch):
    def full(_):
        raise MemoryError

    monkeypatch.setattr(K.ast, "parse", full)
    with pytest.raises(MemoryError):
        K.PythonPlugin().chunks("a.py", "\n" * 60)
