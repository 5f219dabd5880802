"""What a Python worker holds at once."""

from __future__ import annotations

import pyarrow as pa

from tallywork.llm.tables import ARROW, PIECE, cut, mapped, record, small_batches


def test_all_text_columns_count(spark):
    batch = record(a=pa.array(range(40)), text=pa.array(["a b"] * 40), text_b=pa.array(["x" * (PIECE // 4)] * 40))
    pieces = list(cut(batch))
    assert max(p.column("text_b").nbytes for p in pieces) <= PIECE + 1000
    assert [x for p in pieces for x in p.column("a").to_pylist()] == list(range(40))


def test_rows_reach_workers_in_small_batches(spark):
    docs = spark.range(0, 240, 1, 1).selectExpr("id as doc_id", "repeat('ab ', 40000) as text")

    def make():
        return lambda batch: record(doc_id=batch.column("doc_id"), held=pa.array(
            [batch.get_total_buffer_size()] * batch.num_rows, pa.int64()))

    rows = mapped(docs, make, "doc_id long, held long").collect()
    assert sorted(r.doc_id for r in rows) == list(range(240))
    assert max(r.held for r in rows) < 12_000_000  # all texts together have 29 MB


def test_a_bound_of_the_session_stays(spark):
    small_batches(spark)
    kept = spark.conf.get(ARROW)
    spark.conf.set(ARROW, "1m")
    small_batches(spark)
    assert spark.conf.get(ARROW) == "1m"
    spark.conf.set(ARROW, kept)
