from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from tallywork.plans import form_import, upkeep
from tallywork.sources import files, form_cells

SPEC = '''LINE,FIELD,LITERAL,"FIELD TYPE",BYTES,COLUMNS,
1,,"Left block",M,3,01-03,
3,1a,"An ID, whole",A/N,29,50-78,
5,10b,"Two
 lines",N,4,8-11,
5,3,Box,M,1,42
6,17,"No place",A,5,,
'''


def test_form_spec(spark, tmp_path):
    (tmp_path / "spec.csv").write_text(SPEC)
    got = {r.label: r for r in files.read_form_spec(spark, str(tmp_path / "spec.csv")).collect()}
    assert set(got) == {"Left block", "An ID, whole", "Two\n lines", "Box"}
    assert tuple(got["An ID, whole"]) == (3, 1, "1a", "An ID, whole", "A/N", 29, [50, 78])
    assert got["Box"].columns == [42] and got["Left block"].field_no is None
    assert got["Two\n lines"].field_no == 10


def form(form_id, **values):
    base = {"patient_name": "Solo, Cy", "payer_name": "carrier x", "x_medicare": "x",
            "id_number": "7", "x_male": "X", "x_self": "x", "dx1": "305", "dx1_detail": "00"}
    at = {name: (row, col) for name, _, _, row, col in form_cells.CELLS}
    return [(form_id, *at[n], v) for n, v in {**base, **values}.items()] + [(form_id, 1, 1, "junk")]


def records(spark, *forms):
    cells = [c for f in forms for c in f]
    df = spark.createDataFrame(cells, "form_id long, row int, col int, value string")
    return form_cells.read_forms(df)


def test_outcomes(spark, tiny):
    got = form_import.outcomes(tiny, form_import.policies_on_forms(records(
        spark, form(1, dx1=""), form(2), form(3), form(4, patient_name="roe, bob"),
        form(5, patient_name="Nobody"), form(6, patient_name="Doe, Ann"), form(7, dx1=""))))
    assert {r.form_id: r.outcome for r in got.collect()} == {
        1: "insert failed", 2: "added", 3: "already recorded", 4: "already recorded",
        5: "no such client", 6: "ambiguous client", 7: "already recorded"}


def test_import(spark, tiny):
    new = form_import.import_forms(tiny, records(spark, form(
        9, payer_name="New One", payer_address="PO 9", payer_city_st_zip="Z", dx2="300",
        dx2_detail="02", dob_y="87.0", dob_m="7.0", dob_d="31.0", patient_address="1 Elm",
        patient_zip="66012.0", patient_acode="816.0", patient_no="5550100.0")))
    assert rows(new.carrier.select("id", "name", "address")) == [(1, "Carrier X", "PO 1"), (2, "New One", "PO 9")]
    assert rows(new.diagnosis.select("icd9")) == [("300.02",), ("305.00",)]
    policy = new.insurance.where("client_id = 4").first()
    assert (policy.id, policy.carrier_id, policy.payer_type, policy.patient_sex, policy.dx2) == (
        4, 2, "Medicare", "M", "300.02")
    client = new.client.where("id = 4").first()
    assert (str(client.dob), client.address, client.zip, client.phone) == (
        "1987-07-31", "1 Elm", "66012", "816 5550100")
    assert new.client.where("id = 3").first().address is None


def test_known_carrier_in_other_case_is_not_added(spark, tiny):
    new = form_import.import_forms(tiny, records(spark, form(9)))
    assert new.carrier.count() == 1
    assert new.insurance.where("client_id = 4").first().carrier_id == 1


def test_first_marked_box_counts(spark, tiny):
    got = form_import.policies_on_forms(records(spark, form(1, x_spouse="X", x_medicare="", x_group="y")))
    assert (got.first().patient_rel, got.first().payer_type) == ("Self", None)


def test_insert_absent_compares_as_text_here(spark):
    old = spark.createDataFrame([("A",)], "icd9 string")
    new = spark.createDataFrame([("a ",), ("b",)], "icd9 string")
    assert rows(upkeep.insert_absent(old, "icd9", new)) == [("A",), ("b",)]


def test_new_ids_follow_the_largest(spark):
    old = spark.createDataFrame([(7, "x")], "id long, name string")
    got = upkeep.with_new_ids(old, spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), "name")
    assert {r.name: r.id for r in got.collect()} == {"a": 8, "b": 9, "c": 10}
    empty = upkeep.with_new_ids(old.where(F.lit(False)), got.select("name"), "name")
    assert rows(empty.select("id")) == [(1,), (2,), (3,)]
