"""Import of insurance forms: all forms of a run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import billing, dates, forms
from tallywork.plans.upkeep import insert_absent, update_from, with_new_ids
from tallywork.practice import Practice

# --- fixed values: outcomes of a form ------------------------------------------
UNKNOWN, AMBIGUOUS, RECORDED, FAILED, ADDED = (
    "no such client", "ambiguous client", "already recorded", "insert failed", "added")

# --- fixed values: what each marked box says ------------------------------------
PAYERS = {"Medicare": "x_medicare", "Medicaid": "x_medicaid", "Tricare Champus": "x_champus",
          "Champva": "x_champva", "Group Health Plan": "x_group", "FECA Blk Lung": "x_feca",
          "Other": "x_payer_other"}
SEXES = {"M": "x_male", "F": "x_female"}
INSURED_SEXES = {"M": "x_insured_male", "F": "x_insured_female"}
RELATIONS = {"Self": "x_self", "Spouse": "x_spouse", "Child": "x_child", "Other": "x_rel_other"}
STATUSES = {"Single": "x_single", "Married": "x_married", "Other": "x_status_other"}
OCCUPATIONS = {"Employed": "x_employed", "Full Time Student": "x_full_time",
               "Part Time Student": "x_part_time"}

REQUIRED = ["payer_type", "id_number", "patient_sex", "patient_rel", "dx1"]


def _choice(boxes: dict[str, str]) -> Column:
    return forms.first_checked({value: F.col(box) for value, box in boxes.items()})


def policies_on_forms(records: DataFrame) -> DataFrame:
    """What each form says, typed: one row per form."""
    return records.select(
        "form_id", "patient_name", "payer_name", "payer_address", "payer_city_st_zip",
        _choice(PAYERS).alias("payer_type"), "id_number",
        _choice(SEXES).alias("patient_sex"), "insured_name",
        _choice(RELATIONS).alias("patient_rel"), "insured_address", "insured_city",
        "insured_state", forms.zip_text(F.col("insured_zip")).alias("insured_zip"),
        forms.phone_text(F.col("insured_acode"), F.col("insured_no")).alias("insured_phone"),
        _choice(STATUSES).alias("patient_status"), _choice(OCCUPATIONS).alias("patient_status2"),
        forms.filled(F.col("insured_policy")).alias("insured_policy"),
        dates.two_digit_year_date(F.col("insured_dob_y"), F.col("insured_dob_m"),
                                  F.col("insured_dob_d")).alias("insured_dob"),
        _choice(INSURED_SEXES).alias("insured_sex"),
        forms.diagnosis_code(F.col("dx1"), F.col("dx1_detail")).alias("dx1"),
        forms.diagnosis_code(F.col("dx2"), F.col("dx2_detail")).alias("dx2"),
        dates.two_digit_year_date(F.col("dob_y"), F.col("dob_m"), F.col("dob_d")).alias("dob"),
        "patient_address", "patient_city", "patient_state",
        forms.zip_text(F.col("patient_zip")).alias("patient_zip"),
        forms.phone_text(F.col("patient_acode"), F.col("patient_no")).alias("patient_phone"))


def outcomes(db: Practice, policies: DataFrame) -> DataFrame:
    """Each form with ``client_id`` and ``outcome``.

    Forms count as read in the order of their ids: of several for one client the first
    valid one is added, and those after it find a policy.
    """
    names = (db.client.groupBy(billing.text_key(F.col("name")).alias("_name"))
             .agg(F.min("id").alias("client_id"), F.count(F.lit(1)).alias("_clients")))
    insured = db.insurance.select(F.col("client_id").alias("_insured"))
    known = (policies.withColumn("_name", billing.text_key(F.col("patient_name")))
             .join(names, "_name", "left").drop("_name")
             .join(insured, F.col("client_id") == F.col("_insured"), "left"))
    valid = F.lit(True)
    for column in REQUIRED:
        valid = valid & F.col(column).isNotNull()
    open_form = (F.col("_clients") == 1) & F.col("_insured").isNull()
    marked = known.withColumn("_ok", open_form & valid)
    # the first valid form of each client: an aggregate, so that no client's forms need
    # to be in one place
    first = (marked.where("_ok").groupBy("client_id").agg(F.min("form_id").alias("_first"))
             .withColumnRenamed("client_id", "_c"))
    outcome = (F.when(F.col("_clients").isNull(), UNKNOWN)
               .when(F.col("_clients") > 1, AMBIGUOUS)
               .when(F.col("_insured").isNotNull() | (F.col("form_id") > F.col("_first")), RECORDED)
               .when(F.col("form_id") == F.col("_first"), ADDED)
               .otherwise(FAILED))
    return (marked.join(first, F.col("client_id") == F.col("_c"), "left")
            .withColumn("outcome", outcome)
            .withColumn("client_id", F.when(F.col("_clients") == 1, F.col("client_id")))
            .select(*policies.columns, "client_id", "outcome"))


def accepted(db: Practice, policies: DataFrame) -> DataFrame:
    return outcomes(db, policies).where(F.col("outcome") == ADDED)


def add_carriers(db: Practice, added: DataFrame) -> DataFrame:
    """Carriers, those named on accepted forms included. The first form that names a new
    one says how it is spelt and where it is."""
    key = billing.text_key(F.col("payer_name"))
    named = (added.groupBy(key.alias("_key"))
             .agg(F.min_by(F.struct(F.col("payer_name").alias("name"),
                                    F.col("payer_address").alias("address"),
                                    F.col("payer_city_st_zip").alias("city_st_zip")),
                           F.col("form_id")).alias("p"))
             .select("p.*"))
    have = db.carrier.select(billing.text_key(F.col("name")).alias("_have"))
    fresh = named.join(have, billing.text_key(F.col("name")) == F.col("_have"), "left_anti")
    return db.carrier.unionByName(with_new_ids(db.carrier, fresh, "name"))


def add_diagnoses(db: Practice, added: DataFrame) -> DataFrame:
    codes = (added.select(F.explode(F.array("dx1", "dx2")).alias("icd9"))
             .where(billing.has_text(F.col("icd9"))).distinct())
    return insert_absent(db.diagnosis, "icd9", codes)


def add_policies(db: Practice, added: DataFrame, carriers: DataFrame) -> DataFrame:
    """Policies, those of accepted forms included."""
    ca = carriers.select(F.col("id").alias("carrier_id"),
                         billing.text_key(F.col("name")).alias("_carrier"))
    rows = (added.withColumn("_carrier", billing.text_key(F.col("payer_name")))
            .join(ca, "_carrier"))
    wanted = [c for c in db.insurance.columns if c in rows.columns]
    return db.insurance.unionByName(
        with_new_ids(db.insurance, rows, "form_id").select("id", *wanted),
        allowMissingColumns=True)


def update_clients(db: Practice, added: DataFrame) -> DataFrame:
    """Birth date, address and phone as accepted forms give them."""
    fresh = added.select(
        F.col("client_id").alias("id"), "dob", F.col("patient_address").alias("address"),
        F.col("patient_city").alias("city"), F.col("patient_state").alias("state"),
        F.col("patient_zip").alias("zip"), F.col("patient_phone").alias("phone"))
    return update_from(db.client, "id", fresh, ["dob", "address", "city", "state", "zip", "phone"])


def import_forms(db: Practice, records: DataFrame) -> Practice:
    added = accepted(db, policies_on_forms(records))
    carriers = add_carriers(db, added)
    return db.replaced(carrier=carriers, diagnosis=add_diagnoses(db, added),
                       insurance=add_policies(db, added, carriers),
                       client=update_clients(db, added))
