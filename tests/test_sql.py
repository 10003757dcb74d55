"""Queries against their SQL on texts in which engines differ: word boundaries and white space."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Letters beyond ASCII and other word characters next to hits, and a vertical tab inside one."""
    top = tmp_path_factory.mktemp("sql")
    ends = ["", "é", "ñ", "_", "9", "́", "-", "中"]
    hits = ["the faster", "a big red dogs", "is ready to go", "and the running", "the\tfaster", "the\x0bfaster", "a\x0bbig red dogs"]
    rows = [(k, f"{x}{h}{y} end", "web") for k, (x, h, y) in enumerate((x, h, y) for x in ends for h in hits for y in ends[:2] + ends[3:5])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{top}/documents.parquet")
    return str(top)


def differing(spark, sf, name):
    """Rows that only the SQL has, and only the query."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    want = [tuple(r) for r in con.execute(entry.oracle_sql()[name]).fetchall()]
    got = [tuple(r) for r in entry.queries()[name](spark, sf).collect()]
    assert want
    return [r for r in want if r not in got], [r for r in got if r not in want], len(want) - len(got)


@pytest.mark.parametrize("name", ["find_positives", "keep_positives", "audit_json", "expected_count"])
def test_boundaries_are_those_of_sql(spark, sf, name):
    assert differing(spark, sf, name) == ([], [], 0)
