"""Benchmark items without an id are leaks too."""

import duckdb
from helpers import sha

from setwright.llm import queries, wumanber


def test_items_without_id_equal_sql(spark, tmp_path):
    docs = [(1, "x one two y"), (2, "three only"), (3, "one two, then three"), (4, "nothing here"), (5, None)]
    items = [(None, "One two"), (None, "three"), (7, "three"), (8, "then three"), (None, None), (None, "...")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, wumanber.contamination(docs, benchmark).collect()))
    assert got[0] == (1, 4, 2, 1, sha(""), True) and got[2] == (3, 4, 4, 3, sha("7,8"), True)
    assert [r.doc_id for r in wumanber.decontaminated(docs, benchmark).orderBy("doc_id").collect()] == [4, 5]
    for name, frame in (("documents", docs), ("benchmark", benchmark)):
        frame.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(con.execute(queries.OP6_SQL).fetchall()) == got
