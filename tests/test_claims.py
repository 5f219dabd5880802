from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from conftest import ROWS, d, m, rows, table
from tallywork.plans import claims
from tallywork.sources import files, pages, print_layout

AS_OF = datetime.date(2001, 11, 15)


def many_lines(spark, tiny, n: int = 15):
    """Client 1 with ``n`` open visits on few days."""
    visits = [dict(id=f"x{k:02}", client_id=1, session_id=10 + k % 4, attend_n=1, charge=m(50),
                   client_paid=m(5), insurance_paid=m(0), cpt="90853",
                   claim_uid=f"c{k // 8}") for k in range(n)]
    return tiny.replaced(visit=table(spark, "visit", *visits))


def expected_pages(n: int):
    ordered = sorted(((10 + k % 4, f"x{k:02}") for k in range(n)))
    return {v: (i // 6 + 1, i % 6 + 1) for i, (_, v) in enumerate(ordered)}


def test_pages_of_six_in_any_number_of_ranges(spark, tiny):
    db = many_lines(spark, tiny)
    for ranges in (1, 3, 40):
        got = claims.paged_lines(db, None, ranges)
        assert {r.visit_id: (r.page, r.slot) for r in got.collect()} == expected_pages(15)


def test_every_line_is_on_one_page(case):
    lines = claims.claim_lines(case.raw, None).count()
    sizes = claims.claim_pages(case.raw, None).select(F.size("items").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == lines
    assert sizes.agg(F.max("n")).first()[0] <= 6


def test_two_providers_double_the_lines(spark, tiny):
    db = many_lines(spark, tiny, 2).replaced(therapist=table(
        spark, "therapist", *[{**t, "tax_id": f"t{t['id']}"} for t in ROWS["therapist"]]))
    assert claims.claim_lines(db, None).count() == 4
    page = claims.claim_file(db, None, AS_OF).first()
    assert [page[f"24.{s}.j-ProvNPI"] for s in range(1, 6)] == [
        "0000000001", "0000000002", "0000000001", "0000000002", None]
    assert page["28-TotalCharge"] == "320.00"


def test_only_selected_open_visits_of_insured_clients(spark, tiny):
    chosen = spark.createDataFrame([("v0",), ("v1",), ("v2",)], "id string")
    # v1 has no code; v2 is client 3's; v0 client 1's
    assert rows(claims.claim_visits(tiny, chosen).select("visit_id")) == [("v0",), ("v2",)]


def test_claim_file_has_its_columns(spark, tiny):
    df = claims.claim_file(many_lines(spark, tiny), None, AS_OF)
    assert len(df.columns) == 162 and df.columns[0] == "Insurance Company Name"
    first = df.where(F.col("`24.6.a-DOSFrom`").isNotNull()).first()
    assert first["4-InsuredName"] == "Doe, Ann" and first["26-PatientAcctNo"] == "DOE.ANN.1"
    assert first["12-Date"] == "11/15/2001" and first["28-TotalCharge"] == "480.00"


def test_csv_is_quoted_throughout(spark, tiny, tmp_path):
    files.write_claims_csv(claims.claim_file(many_lines(spark, tiny, 1), None, AS_OF),
                           str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    head, line = part
    assert head.startswith('"Insurance Company Name","Insurance Company Name 2",')
    assert line.startswith('"Carrier X","","PO 1",') and line.count('"') == 2 * 162


def test_status_rows(spark):
    cells = ['1', "<a href='view?trace_no=77'\n target='_new'>77</a>", "2001", "ACCEPTED",
             "&nbsp;ROE", "&nbsp;BOB", "&nbsp;ROE.BOB.3", "&nbsp;9", "&nbsp;M",
             "&nbsp;11/10/2011", "&nbsp;120.00", "&nbsp;", "&nbsp;", "&nbsp;X", "&nbsp;Y",
             "&nbsp;12/2/2011"]
    row = "<tr bgcolor=ddf7f7 >" + "\n".join(f'<td class="g">{c}</td>' for c in cells) + "</tr>"
    html = f"<table align='Center'><tr><td>No</td></tr>\n{row}\n{row.replace('77', '78')}</table>"
    df = spark.createDataFrame([(5, html)], "page_id int, html string")
    got = pages.extract_claim_rows(df, ["page_id"]).orderBy("pos").collect()
    assert tuple(got[0]) == (5, 1, 77, "view?trace_no=77", 2001, "ACCEPTED", "ROE", "BOB",
                             "ROE.BOB.3", d("2011-11-10"), d("2011-12-02"))
    assert [r.trace_no for r in got] == [77, 78]
    flat = pages.flatten_claims(spark.createDataFrame([(2001,)], "batch_no long"),
                                pages.extract_claim_rows(df, ["page_id"]))
    assert rows(flat.select("client_id").distinct()) == [("3",)] and len(flat.columns) == 9


def test_batch_link(spark):
    html = '<td nowrap="nowrap">&nbsp;<a href="View?batch_no=42">42</a></td>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(pages.extract_links(df)) == [(1, 0, "42", "View?batch_no=42")]


def test_pairing_stops_with_the_shorter_list(spark):
    sent = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"]), (2, 1, ["d"])],
                                 "upload_no long, position long, visit_ids array<string>")
    results = spark.createDataFrame([(1, 1, 3, 70, 9), (2, 1, 1, 71, 9), (2, 1, 2, 72, 9)],
                                    "upload_no long, page_no long, pos int, trace_no long, batch long")
    assert rows(claims.stamps(sent, results)) == [("a", "70,9"), ("b", "70,9"), ("d", "71,9")]


def test_answers_come_back_to_their_claims(case):
    """Over few ranges or many, each claim gets the answer made from it."""
    plain = claims.sent_claims(case.raw, None)
    cut = claims.sent_claims(case.raw, None, 25)
    columns = ["client_id", "page", "upload_no", "position"]
    assert rows(plain.select(*columns)) == rows(cut.select(*columns))
    pairs = claims.paired(plain, case.results)
    assert pairs.count() == plain.count()
    wrong = pairs.where("trace_no != position * 1000000 + upload_no or "
                        "element_at(split(acc_no, '[.]'), -1) != cast(client_id as string)")
    assert wrong.count() == 0


def test_printed_claim(spark, tiny):
    db = many_lines(spark, tiny, 10)  # claims c0 with 8 lines, c1 with 2
    df = claims.printed_claims(db, AS_OF)
    by = {(r.claim_uid, r.line_no): r.text for r in df.collect()}
    head, foot = len(print_layout.HEADING), len(print_layout.FOOTER)
    for uid, n in (("c0", 8), ("c1", 2)):
        last = head + 2 * n + 2 * max(6 - n, 0) + foot
        assert sorted(k[1] for k in by if k[0] == uid) == list(range(1, last + 1))
        assert by[uid, last] == "\f"
    assert by["c0", 1][45:].rstrip() == "Carrier X"
    assert by["c0", 8][0] == "X" and by["c0", 8][49:51] == "N1"
    assert by["c0", 10].startswith("Doe, Ann") and by["c0", 10][30:40] == "02 03 1980"
    service = by["c1", head + 2]
    assert service[24:29] == "90853" and service[49:57].strip() == "50.00"
    total = by["c1", head + 12 + 2]
    assert total[50:59].strip() == "100.00" and total[70:78].strip() == "90.00"
