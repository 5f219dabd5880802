from __future__ import annotations

from conftest import d, m, rows
from pyspark.sql import functions as F

from tallywork.plans import views
from tallywork.streaming import balances as stream

CHANGES = ("client_id long, session_date date, charge decimal(8,2), client_paid decimal(8,2), "
           "insurance_paid decimal(8,2), op int")


def changes(spark, *items):
    return spark.createDataFrame([(c, d(day), m(ch), m(pd), None if ins is None else m(ins), op)
                                  for c, day, ch, pd, ins, op in items], CHANGES)


def test_insert_delete_and_replay(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def run():
        job = stream.keep_balances(spark.readStream.schema(CHANGES).parquet(src), out, state,
                                   available_now=True)
        job.awaitTermination()

    def kept():
        return rows(stream.read_balances(spark, out))

    assert kept() == []
    changes(spark, (1, "2001-01-01", 50, 10, None, 1), (1, "2001-02-01", 60, 0, 5, 1),
            (2, "2001-01-01", 70, 0, 0, 1)).write.mode("append").parquet(src)
    run()
    assert kept() == [
        (1, d("2001-01-01"), d("2001-02-01"), m(110), m(10), m(5), m(95)),
        (2, d("2001-01-01"), d("2001-01-01"), m(70), m(0), m(0), m(70))]
    # the last visit of client 1 goes, and the only one of client 2
    changes(spark, (1, "2001-02-01", 60, 0, 5, -1), (2, "2001-01-01", 70, 0, 0, -1)
            ).write.mode("append").parquet(src)
    run()  # a new start: goes on after what is already done
    left = [(1, d("2001-01-01"), d("2001-01-01"), m(50), m(10), m(0), m(40))]
    assert kept() == left
    # a finished batch run once more changes nothing
    before = stream.current_version(spark, out)
    stream.merge_batch(changes(spark, (1, "2001-02-01", 60, 0, 5, -1)), before.batch_id, out)
    assert kept() == left and stream.current_version(spark, out) == before


def test_an_unfinished_batch_is_not_seen_and_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    first = changes(spark, (1, "2001-01-01", 50, 10, None, 1))
    stream.merge_batch(first, 0, out)
    # the batch got as far as its cells and was lost before its pointer
    second = changes(spark, (1, "2001-03-01", 20, 0, 0, 1))
    stream.cells(second).write.parquet(f"{out}/cells/batch_id=1")
    assert rows(stream.read_balances(spark, out))[0][2] == d("2001-01-01")
    stream.merge_batch(second, 1, out)
    assert rows(stream.read_balances(spark, out)) == [
        (1, d("2001-01-01"), d("2001-03-01"), m(70), m(10), m(0), m(60))]


def test_folded_parts_and_edits_give_the_batch_view(spark, tiny, tmp_path):
    """Visits entered one batch each, some edited, some deleted: as the batch view over what is left."""
    visits = tiny.visit.join(tiny.session.selectExpr("id as session_id", "session_date"), "session_id")
    ids = sorted(r.id for r in tiny.visit.collect())
    gone, edited = set(ids[::3]), set(ids[1::3])
    out = str(tmp_path / "out")
    columns = ["client_id", "session_date", "charge", "client_paid", "insurance_paid"]
    one = F.lit(1)
    later = visits.where(F.col("id").isin(*edited)).withColumn(
        "charge", (F.col("charge") + 1).cast("decimal(8,2)"))
    parts = [visits.where(F.col("id") == i).select(*columns, one.alias("op")) for i in ids[:6]]
    parts.append(visits.where(~F.col("id").isin(*ids[:6])).select(*columns, one.alias("op")))
    parts.append(visits.where(F.col("id").isin(*gone, *edited)).select(*columns, F.lit(-1).alias("op"))
                 .unionByName(later.select(*columns, one.alias("op"))))
    for k, part in enumerate(parts):
        stream.merge_batch(part, k, out, tiny.client, fold_after=3)
    version = stream.current_version(spark, out)
    assert version.batch_id == len(parts) - 1 and len(version.cells) <= 3
    left = tiny.visit.where(~F.col("id").isin(*gone)).withColumn("charge", F.when(
        F.col("id").isin(*edited), F.col("charge") + 1).otherwise(F.col("charge")).cast("decimal(8,2)"))
    expected = rows(views.client_balances(tiny.replaced(visit=left)))
    assert rows(stream.read_balances(spark, out)) == expected


def test_streamed_balances_equal_the_batch_view(spark, tiny):
    v = tiny.visit.join(tiny.session.selectExpr("id as session_id", "session_date"), "session_id")
    cells = stream.cells(v.selectExpr("client_id", "session_date", "charge", "client_paid",
                                      "insurance_paid", "1 as op"))
    assert rows(stream.balances(cells, tiny.client)) == rows(views.client_balances(tiny))
