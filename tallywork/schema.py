"""Declared schemas, keys, references and value rules of the practice's tables.

Text lengths, allowed sets and 0/1 flags are quality rules (see plans/quality.py),
not types: a table with a bad value can still be read, and the bad rows listed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: column types of the practice's tables -----------------------
COLUMNS = {
    "visit": "id string, client_id bigint, session_id bigint, attend_n int, "
             "charge decimal(8,2), client_paid decimal(8,2), insurance_paid decimal(8,2), "
             "note string, cpt string, claim_uid string, bill_date date, check_date date, "
             "discharge_status string",
    "session": "id bigint, session_date date, time string, group_id bigint, therapist_id bigint",
    "client": "id bigint, name string, reduced_fee string, note string, address string, "
              "city string, state string, zip string, phone string, dob date, "
              "officer_id bigint, officer2_id bigint, lawyer_id bigint, court_id bigint, "
              "insurance string, invoice_note string, voucher int, voucher_note string, "
              "id_zoho string, id_dabble string, billing_cutoff date, recent date, "
              "charges decimal(18,2), client_paid decimal(18,2), insurance_paid decimal(18,2), "
              "balance decimal(18,2), balance_cached timestamp",
    "group": "id bigint, name string, rate decimal(8,2), evaluation int, cpt string",
    "therapist": "id bigint, name string, weight int, npi string, tax_id string, "
                 "address string, city_st_zip string",
    "insurance": "id bigint, client_id bigint, carrier_id bigint, details string, "
                 "deductible string, copay decimal(8,2), deductible_met int, payer_type string, "
                 "id_number string, patient_sex string, patient_rel string, insured_name string, "
                 "insured_address string, insured_city string, insured_state string, "
                 "insured_zip string, insured_phone string, patient_status string, "
                 "patient_status2 string, insured_policy string, insured_dob date, "
                 "insured_sex string, dx1 string, dx2 string, approval string",
    "carrier": "id bigint, name string, address string, city_st_zip string",
    "procedure": "cpt string, name string, price decimal(8,2)",
    "diagnosis": "icd9 string, name string",
    "officer": "id bigint, name string, email string, office_id bigint",
    "office": "id bigint, name string, address string, fax string",
    "batch": "name string, cutoff date, invoice_threshold decimal(12,2)",
}

# --- fixed values: one key per table -------------------------------------------
KEYS = {
    "visit": "id", "session": "id", "client": "id", "group": "id", "therapist": "id",
    "insurance": "id", "carrier": "id", "procedure": "cpt", "diagnosis": "icd9",
    "officer": "id", "office": "id", "batch": "name",
}

# --- fixed values: further unique columns --------------------------------------
UNIQUE = {"therapist": ["name"], "carrier": ["name"], "insurance": ["client_id"]}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    on_delete: str  # cascade | set null | restrict


# --- fixed values: references and what a delete of the parent does -------------
REFERENCES = [
    Reference("group", "cpt", "procedure", "restrict"),
    Reference("officer", "office_id", "office", "set null"),
    Reference("client", "officer_id", "officer", "set null"),
    Reference("client", "officer2_id", "officer", "set null"),
    Reference("client", "lawyer_id", "officer", "set null"),
    Reference("client", "court_id", "office", "set null"),
    Reference("session", "group_id", "group", "cascade"),
    Reference("session", "therapist_id", "therapist", "set null"),
    Reference("visit", "cpt", "procedure", "restrict"),
    Reference("visit", "client_id", "client", "cascade"),
    Reference("visit", "session_id", "session", "cascade"),
    Reference("insurance", "carrier_id", "carrier", "cascade"),
    Reference("insurance", "client_id", "client", "cascade"),
    Reference("insurance", "dx1", "diagnosis", "restrict"),
    Reference("insurance", "dx2", "diagnosis", "restrict"),
]

# --- fixed values: required columns --------------------------------------------
REQUIRED = {
    "visit": ["charge", "client_paid", "insurance_paid", "client_id", "session_id"],
    "session": ["session_date", "group_id"],
    "client": ["name"],
    "group": ["name", "rate"],
    "therapist": ["name"],
    "insurance": ["carrier_id", "payer_type", "id_number", "client_id", "patient_sex",
                  "patient_rel", "dx1"],
    "carrier": ["name", "address", "city_st_zip"],
    "procedure": ["price"],
    "officer": ["name", "email"],
    "office": ["name"],
}

# --- fixed values: allowed texts -----------------------------------------------
ALLOWED = {
    "visit": {"discharge_status": ["U", "S"]},
    "insurance": {
        "payer_type": ["Medicare", "Medicaid", "Group Health Plan", "Other"],
        "patient_sex": ["M", "F"],
        "patient_rel": ["Self", "Spouse", "Child", "Other"],
        "patient_status": ["Single", "Married", "Other"],
        "patient_status2": ["Employed", "Full Time Student", "Part Time Student"],
        "insured_sex": ["M", "F"],
    },
}

# --- fixed values: flags that are 0 or 1 ---------------------------------------
FLAGS = {
    "visit": ["attend_n"], "group": ["evaluation"], "client": ["voucher"],
    "insurance": ["deductible_met"],
}

# --- fixed values: longest text a column may hold ------------------------------
LENGTHS = {
    "visit": {"cpt": 6, "claim_uid": 40},
    "session": {"time": 40},
    "client": {"name": 120, "reduced_fee": 20, "address": 120, "city": 24, "state": 3,
               "zip": 12, "phone": 15, "voucher_note": 120},
    "group": {"name": 120, "cpt": 6},
    "therapist": {"name": 120, "npi": 10, "tax_id": 15, "address": 29, "city_st_zip": 29},
    "insurance": {"deductible": 120, "id_number": 30, "insured_name": 30,
                  "insured_address": 30, "insured_city": 24, "insured_state": 3,
                  "insured_zip": 12, "insured_phone": 15, "insured_policy": 30,
                  "dx1": 8, "dx2": 8},
    "carrier": {"name": 50, "address": 50, "city_st_zip": 50},
    "procedure": {"cpt": 6, "name": 120},
    "diagnosis": {"icd9": 8, "name": 120},
    "officer": {"name": 120, "email": 120},
    "office": {"name": 120, "address": 120, "fax": 120},
}

# --- fixed values: columns that record who changed a row and when --------------
AUDIT = {"added_time": "timestamp", "added_user": "string",
         "modified_time": "timestamp", "modified_user": "string"}

# --- fixed values: order of a table's list when none is asked for --------------
DEFAULT_ORDER = {"session": ("session_date", "desc"), "client": ("name", "asc")}


def types(table: str) -> dict[str, str]:
    """Column name -> type."""
    return dict(re.findall(r"(\w+) (\w+(?:\(\d+,\d+\))?)", COLUMNS[table]))


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(COLUMNS[table])
