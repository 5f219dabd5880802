"""Insurance forms that arrive as spreadsheet cells: (form_id, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.practice import Practice

_STATUS = "Patient Status"
_REL = "Patient Relationship to Insured"
_DX = "Diagnosis or Nature of Illness or Injury (Code)"

# --- fixed values: cells of the form (name, field, label, row, column from 0) ----
CELLS = [
    ("payer_name", "", "Payer Name", 5, 168),
    ("payer_address", "", "Payer Address", 9, 168),
    ("payer_city_st_zip", "", "Payer City", 13, 168),
    ("x_medicare", "1", "Medicare", 31, 3),
    ("x_medicaid", "1", "Medicaid", 31, 23),
    ("x_champus", "1", "Tricare Champus", 31, 44),
    ("x_champva", "1", "Champva", 31, 71),
    ("x_group", "1", "Group Health Plan", 31, 93),
    ("x_feca", "1", "FECA Blk Lung", 31, 117),
    ("x_payer_other", "1", "Other", 31, 134),
    ("id_number", "1a", "Insured's ID Number", 31, 151),
    ("patient_name", "2", "Patient's Name (Last, First, MI)", 39, 4),
    ("dob_m", "3", "Patient's Birth Date (Month)", 40, 92),
    ("dob_d", "3", "Patient's Birth Date (Day)", 40, 102),
    ("dob_y", "3", "Patient's Birth (Year)", 40, 111),
    ("x_male", "3", "Sex-Male", 39, 126),
    ("x_female", "3", "Sex-Female", 39, 141),
    ("insured_name", "4", "Insured Name (Last, First, MI)", 39, 151),
    ("patient_address", "5", "Patient's Address", 47, 4),
    ("patient_city", "5", "Patient's City", 55, 4),
    ("patient_state", "5", "Patient's State", 55, 79),
    ("patient_zip", "5", "Patient's ZIP Code", 64, 4),
    ("patient_acode", "5", "Patient's Area Code", 64, 45),
    ("patient_no", "5", "Patient's Phone Number", 64, 59),
    ("x_self", "6", f"{_REL} (Self)", 47, 99),
    ("x_spouse", "6", f"{_REL} (Spouse)", 47, 114),
    ("x_child", "6", f"{_REL} (Child)", 47, 126),
    ("x_rel_other", "6", f"{_REL} (Other)", 47, 141),
    ("insured_address", "7", "Insured's Address", 47, 151),
    ("insured_city", "7", "Insured's City", 56, 151),
    ("insured_state", "7", "Insured's State", 56, 221),
    ("insured_zip", "7", "Insured's ZIP Code", 64, 151),
    ("insured_acode", "7", "Insured's Area Code", 64, 195),
    ("insured_no", "7", "Insured's Phone Number", 64, 209),
    ("x_single", "8", f"{_STATUS} (Single)", 55, 105),
    ("x_married", "8", f"{_STATUS} (Married)", 55, 123),
    ("x_status_other", "8", f"{_STATUS} (Other)", 55, 141),
    ("x_employed", "8", f"{_STATUS} (Employed)", 65, 105),
    ("x_full_time", "8", f"{_STATUS} (Full Time Student)", 65, 123),
    ("x_part_time", "8", f"{_STATUS} (Part Time Student)", 65, 141),
    ("insured_policy", "11", "Insured's Policy, Group or FECA Number", 73, 151),
    ("insured_dob_m", "11a", "Insured's Date of Birth (Month)", 82, 159),
    ("insured_dob_d", "11a", "Insured's Date of Birth (Day)", 82, 167),
    ("insured_dob_y", "11a", "Insured's Date of Birth (Year)", 82, 177),
    ("x_insured_male", "11a", "Sex-Male", 82, 203),
    ("x_insured_female", "11a", "Sex-Female", 82, 225),
    ("dx1", "21.1", _DX, 156, 8),
    ("dx1_detail", "21.1", _DX, 156, 21),
    ("dx2", "21.2", _DX, 164, 8),
    ("dx2_detail", "21.2", _DX, 164, 21),
]
NAMES = [c[0] for c in CELLS]


def cell_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CELLS, "name string, field string, label string, row int, col int")


def read_forms(cells: DataFrame) -> DataFrame:
    """One row per form with a column per known cell. Unknown cells are ignored; the
    fixed list of names spares a pass over the data to find them.

    A form's cells come together before anything is sorted: aggregated first, a task would sort all cells of
    its share of the input, and gain nothing, since a form has each cell once."""
    spec = cell_table(cells.sparkSession).select("name", "row", "col")
    known = cells.join(spec, ["row", "col"]).select("form_id", "name", "value").repartition("form_id")
    return known.groupBy("form_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in NAMES])


# ---- forms made from the practice's own clients --------------------------------------

def _box(test: Column) -> Column:
    return F.when(test, F.when(F.col("id") % 2 == 0, "X").otherwise("x")).otherwise("")


def _number(value: Column) -> Column:
    return value.cast("double").cast("string")


def cells_from_clients(db: Practice) -> DataFrame:
    """Forms for every client without a policy and every tenth with one. One in ten gives
    an unknown name; every fourth client sends the form twice."""
    i = F.col("id")
    insured = db.insurance.select(F.col("client_id").alias("_insured"))
    c = (db.client.select("id", "name").join(insured, i == F.col("_insured"), "left")
         .where(F.col("_insured").isNull() | (i % 10 == 0)))
    copies = F.explode(F.when(i % 4 == 0, F.array(i, i + 1000000000)).otherwise(F.array(i)))
    text = i.cast("string")
    empty = F.lit("")

    values = {
        "payer_name": F.when(i % 4 == 1, F.concat(F.lit("New Carrier "), (i % 7).cast("string")))
                       .otherwise("Carrier BUILDING"),
        "payer_address": F.lit("PO Box 7"), "payer_city_st_zip": F.lit("Topeka, KS 66600"),
        "x_medicare": _box(i % 4 == 0), "x_medicaid": _box(i % 4 == 1),
        "x_champus": empty, "x_champva": empty, "x_group": _box(i % 4 == 2), "x_feca": empty,
        "x_payer_other": _box((i % 4 == 3) & (i % 11 != 0)),
        "id_number": F.concat(F.lit("N"), text),
        "patient_name": F.when(i % 10 == 3, F.concat(F.lit("Nobody "), text)).otherwise(F.col("name")),
        "dob_m": _number(i % 12 + 1), "dob_d": _number(i % 31 + 1), "dob_y": _number(i % 100),
        "x_male": _box(i % 2 == 0), "x_female": _box(i % 2 == 1),
        "insured_name": F.concat(F.lit("Ins "), text),
        "patient_address": F.concat(text, F.lit(" New St")), "patient_city": F.lit("Newtown"),
        "patient_state": F.lit("MO"), "patient_zip": _number(64000 + i % 100),
        "patient_acode": F.when(i % 3 == 0, "").otherwise("816.0"),
        "patient_no": F.when(i % 5 == 0, "555-0100").otherwise(_number(5550000 + i % 1000)),
        "x_self": _box(i % 4 == 0), "x_spouse": _box(i % 4 == 1), "x_child": _box(i % 4 == 2),
        "x_rel_other": _box(i % 4 == 3), "insured_address": F.lit("9 Far Rd"),
        "insured_city": F.lit("Topeka"), "insured_state": F.lit("KS"),
        "insured_zip": F.when(i % 5 == 0, "").otherwise("66600.0"),
        "insured_acode": F.when(i % 3 == 1, "").otherwise("785.0"),
        "insured_no": _number(5551000 + i % 1000),
        "x_single": _box(i % 3 == 0), "x_married": _box(i % 3 == 1),
        "x_status_other": _box(i % 3 == 2), "x_employed": _box(i % 4 == 0),
        "x_full_time": _box(i % 4 == 1), "x_part_time": _box(i % 4 == 2),
        "insured_policy": F.when(i % 2 == 0, F.concat(F.lit("P"), text)).otherwise(""),
        "insured_dob_m": F.when(i % 6 == 0, "").otherwise("2.0"),
        "insured_dob_d": _number(i % 30 + 1), "insured_dob_y": _number(40 + i % 20),
        "x_insured_male": _box(i % 3 == 0), "x_insured_female": _box(i % 3 == 1),
        "dx1": F.when(i % 7 == 0, "").when(i % 7 == 1, "999").otherwise("305"),
        "dx1_detail": F.when(i % 7 == 1, (i % 3).cast("string")).otherwise("00"),
        "dx2": F.when(i % 5 == 0, "300").otherwise(""),
        "dx2_detail": F.when(i % 5 == 0, "02").otherwise(""),
    }
    at = {name: (row, col) for name, _, _, row, col in CELLS}
    cells = F.explode(F.array(*[
        F.struct(F.lit(at[n][0]).alias("row"), F.lit(at[n][1]).alias("col"), v.alias("value"))
        for n, v in values.items()])).alias("cell")
    return (c.select(copies.alias("form_id"), cells)
            .select("form_id", "cell.row", "cell.col", "cell.value"))
