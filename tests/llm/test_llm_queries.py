"""The registered queries: fixed columns, distinct rows, and SQL where there is any."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from scriptorium.llm.queries import QUERIES  # noqa: E402
from scriptorium.llm.sql import SQL  # noqa: E402
from scriptorium.llm.tokens import VOCABULARY  # noqa: E402

COLUMNS = {
    "p1_found": ["first_sample_id", "sample_id"], "p2_found": ["field", "sample_id"], "p5_found": ["group_id"], "p6_found": ["sample_id_a", "sample_id_b"], "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "language"],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    if name == "p7_ids" and not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    assert entry.queries()[name] is QUERIES[name]
    got = QUERIES[name](spark, data)
    assert got.columns == COLUMNS.get(name, got.columns)
    rows = got.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
        assert sorted(map(tuple, rows)) == sorted(con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall())


def test_forms_agree_with_found(spark, data):
    """A value is found exactly if its form had to be made by one of the listed changes."""
    forms = QUERIES["p2_forms"](spark, data).collect()
    found = {tuple(r) for r in QUERIES["p2_found"](spark, data).collect()}
    assert found == {("canonical_target", r["sample_id"]) for r in forms if r["target_kinds"]} | {("source_id", r["sample_id"]) for r in forms if r["source_kinds"]}
