"""Fixed-width lines from rows, and the layout of the printed claim form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Piece:
    start: int  # print column, from 1
    width: int
    field: str
    align: str = "left"  # left | right | center
    amount: bool = False  # a number: never shortened


Line = Sequence[Piece]


def _digits(p: Piece) -> Column:
    return F.replace(F.col(p.field).cast("string"), F.lit(","), F.lit(""))


def piece_text(p: Piece) -> Column:
    """Text is cut to the width. An amount that does not fit goes without commas, and if that does
    not fit either, a row of asterisks says so; ``wide_amounts`` lists those."""
    whole = F.coalesce(F.col(p.field).cast("string"), F.lit(""))
    cut = F.substring(whole, 1, p.width)
    if p.amount:
        cut = (F.when(F.length(whole) <= p.width, whole)
               .when(F.length(_digits(p)) <= p.width, _digits(p))
               .otherwise("*" * p.width))
    if p.align == "center":
        left = F.floor((p.width - F.length(cut)) / 2).cast("int")
        cut = F.concat(F.repeat(F.lit(" "), left), cut)
    return F.lpad(cut, p.width, " ") if p.align == "right" else F.rpad(cut, p.width, " ")


def line_text(line: Line) -> Column:
    parts: list[Column] = []
    at = 1
    for p in line:
        if p.start > at:
            parts.append(F.lit(" " * (p.start - at)))
        parts.append(piece_text(p))
        at = p.start + p.width
    return F.concat(*parts) if parts else F.lit("")


def lines(df: DataFrame, keep: Sequence[str], layout: Sequence[Line],
          first_line: Column) -> DataFrame:
    """Each row as the lines of ``layout``, numbered from ``first_line`` on."""
    texts = F.array(*[line_text(x) for x in layout])
    return (df.select(*keep, first_line.alias("_at"), F.posexplode(texts).alias("_pos", "text"))
            .select(*keep, (F.col("_at") + F.col("_pos")).cast("bigint").alias("line_no"), "text"))


def wide_amounts(df: DataFrame, keep: Sequence[str], layout: Sequence[Line]) -> DataFrame:
    """(*keep, field, amount): the amounts of each row that no line of ``layout`` has room for."""
    found = F.array(*[F.when(F.length(_digits(p)) > p.width,
                             F.struct(F.lit(p.field).alias("field"),
                                      F.col(p.field).cast("string").alias("amount")))
                      for line in layout for p in line if p.amount])
    return (df.select(*keep, F.explode(F.array_compact(found)).alias("_wide"))
            .select(*keep, "_wide.field", "_wide.amount"))


def write_lines(df: DataFrame, order: Sequence[str], path: str) -> None:
    """Text files which, read in name order, give the lines in ``order``."""
    df.orderBy(*order).select("text").write.mode("errorifexists").text(path)


def _x(start: int, field: str) -> Piece:
    return Piece(start, 1, field)


def _right(start: int, width: int, field: str) -> Piece:
    return Piece(start, width, field, "right")


def _amount(start: int, width: int, field: str) -> Piece:
    return Piece(start, width, field, "right", amount=True)


# --- fixed values: the printed claim form, line by line --------------------------
HEADING: list[Line] = [
    [Piece(46, 32, "carrier_name")],
    [Piece(46, 32, "carrier_address")],
    [Piece(46, 32, "carrier_city_st_zip")],
    [], [], [], [],
    # line 3 of the form
    [_x(1, "x_medicare"), _x(8, "x_medicaid"), _x(15, "x_champus"), _x(24, "x_champva"),
     _x(31, "x_group"), _x(39, "x_feca"), _x(45, "x_payer_other"), Piece(50, 29, "id_number")],
    [],
    # 5
    [Piece(1, 28, "patient_name"), _right(31, 2, "dob_m"), _right(34, 2, "dob_d"),
     _right(37, 4, "dob_y"), _x(42, "x_male"), _x(47, "x_female"), Piece(50, 29, "insured_name")],
    [],
    # 7
    [Piece(1, 28, "patient_address"), _x(33, "x_self"), _x(38, "x_spouse"), _x(42, "x_child"),
     _x(47, "x_rel_other"), Piece(50, 29, "insured_address")],
    [],
    # 9
    [Piece(1, 24, "patient_city"), Piece(26, 3, "patient_state"), _x(35, "x_single"),
     _x(41, "x_married"), _x(47, "x_status_other"), Piece(50, 23, "insured_city"),
     Piece(74, 4, "insured_state")],
    [],
    # 11
    [_right(1, 12, "patient_zip"), _right(15, 3, "patient_acode"), _right(19, 10, "patient_no"),
     _x(35, "x_employed"), _x(41, "x_full_time"), _x(47, "x_part_time"),
     _right(50, 12, "insured_zip"), _right(65, 3, "insured_acode"), _right(69, 10, "insured_no")],
    [],
    # 13
    [Piece(50, 29, "insured_policy")],
    [],
    # 15
    [_x(41, "x"), _right(53, 2, "insured_dob_m"), _right(56, 2, "insured_dob_d"),
     _right(59, 4, "insured_dob_y"), _x(68, "x_insured_male"), _x(75, "x_insured_female")],
    [],
    # 17
    [_x(41, "x")],
    [],
    # 19
    [_x(41, "x")],
    [],
    # 21
    [_x(57, "x")],
    [], [], [],
    # 25
    [Piece(1, 30, "signed", "center"), Piece(31, 20, "today", "center"),
     Piece(51, 30, "signed", "center")],
    [], [], [], [], [],
    # 31
    [_x(57, "x"), _right(62, 17, "no_charge")],
    [],
    # 33
    [Piece(3, 8, "dx1"), Piece(30, 8, "dx2")],
    [],
    # 35
    [Piece(50, 29, "approval")],
    [], [],
]
SERVICE: list[Line] = [
    [],
    # 39
    [_right(1, 2, "served_m"), _right(4, 2, "served_d"), _right(7, 2, "served_y"),
     Piece(19, 2, "place"), Piece(25, 6, "cpt"), _right(45, 4, "pointer"),
     _amount(50, 8, "charge"), _right(59, 3, "units"), Piece(68, 11, "provider_npi")],
]
FOOTER: list[Line] = [
    [],
    # 51
    [Piece(1, 15, "tax_id"), _x(17, "x"), Piece(23, 14, "account_no"), _x(38, "x"),
     _amount(51, 9, "charge_sum"), _amount(62, 8, "paid_sum"), _amount(71, 8, "balance_sum")],
    [],
    [Piece(50, 29, "provider_name")],
    [Piece(50, 29, "provider_address")],
    [Piece(1, 22, "provider_name"), Piece(50, 29, "provider_city_st_zip")],
    # 56
    [_right(1, 22, "today"), _right(51, 10, "provider_npi")],
    [Piece(1, 1, "page_break")],
]
