"""Column expressions for money, billing state and people on a claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: billing states, in the order they are decided ---------------
PAID, BILLED, NO_POLICY, NO_CPT, ABSENT, BILLABLE = (
    "paid", "billed", "no ins", "no CPT", "did not attend", "billable")


def zero_if_null(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0).cast("decimal(8,2)"))


def due(charge: Column, client_paid: Column, insurance_paid: Column) -> Column:
    """What is still owed; an insurance payment not entered yet counts as 0."""
    return (charge - client_paid - zero_if_null(insurance_paid)).cast("decimal(10,2)")


def total(amount: Column) -> Column:
    return F.sum(amount).cast("decimal(18,2)")


def billing_status(check_date: Column, bill_date: Column, policy_id: Column,
                   priced_cpt: Column, attend_n: Column) -> Column:
    return (F.when(check_date.isNotNull(), PAID)
             .when(bill_date.isNotNull(), BILLED)
             .when(policy_id.isNull(), NO_POLICY)
             .when(priced_cpt.isNull(), NO_CPT)
             .when(attend_n == 0, ABSENT)
             .otherwise(BILLABLE))


def insured(relation: Column, own: Column, other: Column) -> Column:
    """The patient's own value when the patient is the insured party."""
    return F.when(F.upper(relation) == "SELF", own).otherwise(other)


def account_no(name: Column, client_id: Column) -> Column:
    """``AAA.BBB.id``: first letters of both parts of ``Last, First``, and the id."""
    last = F.upper(F.substring(name, 1, 3))
    first = F.upper(F.substring(name, F.instr(name, ",") + F.lit(2), F.lit(3)))
    return F.concat(last, F.lit("."), first, F.lit("."), client_id.cast("string"))


def account_client(acc_no: Column) -> Column:
    return F.element_at(F.split(acc_no, r"\."), -1)


def trace_and_batch(claim_uid: Column) -> tuple[Column, Column]:
    parts = F.split(claim_uid, ",")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def joined_uid(trace_no: Column, batch_no: Column) -> Column:
    return F.concat(trace_no.cast("string"), F.lit(","), batch_no.cast("string"))


def mark_if(value: Column, option: str) -> Column:
    """A check box."""
    return F.when(value == option, "X").otherwise(" ")


def money_commas(amount: Column) -> Column:
    return F.format_number(amount, 2)


def money_plain(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def money_dollar(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def both_names(first: Column, second: Column) -> Column:
    """``first/second``, or only the first. Null when the first is missing."""
    return F.when(second.isNull(), first).otherwise(F.concat(first, F.lit("/"), second))


def starred(details: Column, note: Column) -> Column:
    return F.coalesce(details, F.concat(F.lit("*"), note))


def has_text(text: Column) -> Column:
    """Blanks alone are no text."""
    return F.rtrim(text) > ""


def same_text(a: Column, b: Column) -> Column:
    """Equal regardless of case and trailing blanks, as the practice's names compare."""
    return text_key(a) == text_key(b)


def text_key(text: Column) -> Column:
    return F.lower(F.rtrim(text))
