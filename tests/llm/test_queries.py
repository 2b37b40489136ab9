import pytest

from quillstream.llm.queries import oracle_sql, queries

COLUMNS = {
    "p1_found": ["vector_id_a", "vector_id_b"],
    "p2_found": ["kept_record_id", "copy_record_id"],
    "p4_found": ["item_kind", "item_id"],
    "p5_found": ["paper_id", "cand_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_found_queries_give_distinct_rows_of_their_columns(spark, small, name):
    rows = queries()[name](spark, small)
    assert rows.columns == COLUMNS[name]
    got = rows.collect()
    assert got and len(got) == len(set(got))


def test_copies_add_up_to_all_records(spark, small):
    from quillstream.llm.queries import _paper_records

    total = queries()["p2_collapsed"](spark, small).agg({"copies": "sum"}).first()[0]
    assert total == _paper_records(spark, small).count()


def test_containers_and_mix(spark, small):
    fill = queries()["p6_fill"](spark, small).first()
    assert fill["over"] == 0 and fill["fill"] > 0.8
    shares = queries()["p7_shares"](spark, small).collect()
    assert len(shares) == 11 and abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
