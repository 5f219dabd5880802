"""Insurance claims: priced lines, pages of six, the claim file's columns, and what the
portal answers.

Money and keys travel light: lines are numbered and paged as (client, visit, date, code,
price, provider); names and policies are joined to finished pages.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import billing, dates
from tallywork.operators.joins import join_every, only_keys
from tallywork.operators.numbering import numbered
from tallywork.plans.upkeep import stamp_claims
from tallywork.practice import Practice

LINES_PER_PAGE = 6
US_DATE = "%m/%d/%Y"

# --- fixed values: what is the same on every claim ------------------------------
SIGNED = "Signature on file"
PLACE_OF_SERVICE, DIAGNOSIS_POINTER, UNITS = "11", 1, 1

# --- fixed values: claim file columns before, in and after the service lines ----
HEAD_COLUMNS = [
    "Insurance Company Name", "Insurance Company Name 2", "Insurance Company Address 1",
    "Insurance Company Address 2", "1-InsuredPlanName", "1a-InsuredIDNo", "2-PatientName",
    "3-PatientDOB", "3-PatientGender", "4-InsuredName", "5-PatientAddress", "5-PatientCity",
    "5-PatientState", "5-PatientZip", "5-PatientPhone", "6-PatientRel", "7-InsuredAddr",
    "7-InsAddCity", "7-InsAddState", "7-InsAddZip", "7-InsAddPhone", "8-MaritalStatus",
    "8-Employed?", "9-InsuredName2", "9a-InsuredGroupNo2", "9b-Insureds2DOB",
    "9b-Insureds2Gender", "9c-EmployerName", "9d-InsuredPlanName2", "10a-CondEmployment",
    "10b-CondAutoAccident", "10c-CondOtherAccident", "10b2-AccidentState", "10d-LocalUse",
    "11-InsuredGroupNo", "11a-InsuredsDOB", "11a-InsuredsGender", "11b-EmployerName",
    "11c-InsuredPlanName", "11d-OtherHealthPlan", "12-PatientSign", "12-Date", "13-AuthSign",
    "14-DateOfCondition", "15-FirstDateOfCondition", "16-DateFromNoWork", "16-DateToNoWork",
    "17-ReferringPhysician", "17a-PhysicianNo", "17b-ReferNPI", "18-DateFromHosp",
    "18-DateToHosp", "19-LocalUse", "20-OutsideLab", "20-Charges", "21.1-Diagnosis",
    "21.2-Diagnosis", "21.3-Diagnosis", "21.4-Diagnosis", "22-MedicaidResubmissionCode",
    "22-MedicaidResubmissionRefNo", "23-PriorAuth",
]
LINE_COLUMNS = [
    "a-DOSFrom", "a-DOSTo", "b-Place", "c-EMG", "d-CPT", "d-Modifier", "e-Code", "f-Charges",
    "g-Units", "h-Epsot", "i-Qualifier", "j-ProvLegacyNo", "j-ProvNPI",
]
TAIL_COLUMNS = [
    "25-TaxID", "25-SSN/EIN", "26-PatientAcctNo", "27-AcceptAssign", "28-TotalCharge",
    "29-AmountPaid", "30-BalanceDue", "31-PhysicianSignature", "31-Date", "32-FacilityName",
    "32-FacilityAddressLine1", "32-FacilityAddressLine2", "32-FacilityCityStateZip",
    "32-FacilityNPI", "33-ClinicName", "33-ClinicAddressLine1", "33-ClinicAddressLine2",
    "33-ClinicCityStateZip", "33-PIN#", "33-GRP#", "33-a-NPI", "33-b-GrpLegacyNo",
]


def slot_column(slot: int, field: str) -> str:
    return f"24.{slot}.{field}"


CLAIM_COLUMNS = (HEAD_COLUMNS
                 + [slot_column(s, f) for s in range(1, LINES_PER_PAGE + 1) for f in LINE_COLUMNS]
                 + TAIL_COLUMNS)


# ---- lines and pages -----------------------------------------------------------------

def billing_providers(db: Practice) -> DataFrame:
    return db.therapist.where(F.col("tax_id").isNotNull()).select(
        F.col("id").alias("provider_id"), F.col("npi").alias("provider_npi"), "tax_id",
        F.col("name").alias("provider_name"), F.col("address").alias("provider_address"),
        F.col("city_st_zip").alias("provider_city_st_zip"))


def claim_visits(db: Practice, selected: DataFrame | None) -> DataFrame:
    """Selected visits that are neither billed nor paid (all of them when ``selected`` is
    None), of insured clients, priced by procedure; once per billing provider."""
    open_visits = db.visit.where("bill_date is null and check_date is null")
    if selected is not None:
        open_visits = only_keys(open_visits, "id", selected)
    v = open_visits.select(F.col("id").alias("visit_id"), "client_id", "session_id", "cpt")
    s = db.session.select(F.col("id").alias("session_id"), "session_date")
    p = db.procedure.select("cpt", "price")
    carriers = db.carrier.select(F.col("id").alias("carrier_id"))
    i = (db.insurance.select("client_id", "carrier_id")
         .join(carriers, "carrier_id", "left_semi").select("client_id"))
    priced = v.join(p, "cpt").join(s, "session_id").join(i, "client_id")
    providers = billing_providers(db).select("provider_id", "provider_npi")
    return (join_every(priced, providers, "visit_id")
            .select("client_id", "visit_id", "session_date", "cpt", "price", "provider_id",
                    "provider_npi"))


def paged_lines(db: Practice, selected: DataFrame | None,
                ranges: int | None = None) -> DataFrame:
    """Claim lines with their page and their slot (1 to 6) on it, per client by date."""
    lines = numbered(
        claim_visits(db, selected), ["client_id"],
        [F.col("session_date"), F.col("visit_id"), F.col("provider_id")], "line_no", ranges)
    at = F.col("line_no") - 1
    return lines.withColumns({
        "page": (F.floor(at / LINES_PER_PAGE) + 1).cast("bigint"),
        "slot": (at % LINES_PER_PAGE + 1).cast("int")}).drop("line_no")


def claim_pages(db: Practice, selected: DataFrame | None) -> DataFrame:
    """One row per page: its (at most six) lines in slot order, and their total."""
    line = F.struct("slot", "visit_id", "session_date", "cpt", "price", "provider_id",
                    "provider_npi")
    return (paged_lines(db, selected).groupBy("client_id", "page")
            .agg(F.sort_array(F.collect_list(line)).alias("items"),
                 billing.total(F.col("price")).alias("total"))
            .withColumn("visit_ids", F.transform("items", lambda x: x["visit_id"])))


def claim_parties(db: Practice) -> DataFrame:
    """Per insured client: who is treated, who is insured, and by whom."""
    c = db.client.alias("c")
    i, co = db.insurance.alias("i"), db.carrier.alias("co")
    rel = F.col("i.patient_rel")

    def party(own: str, other: str) -> Column:
        return billing.insured(rel, F.col(own), F.col(other))

    return (i.join(c, F.col("i.client_id") == F.col("c.id"))
            .join(co, F.col("i.carrier_id") == F.col("co.id"))
            .select(
                F.col("c.id").alias("client_id"), F.col("c.name").alias("patient_name"),
                F.col("co.name").alias("carrier_name"), F.col("co.address").alias("carrier_address"),
                F.col("co.city_st_zip").alias("carrier_city_st_zip"),
                "i.payer_type", "i.id_number",
                dates.formatted(F.col("c.dob"), US_DATE).alias("patient_dob"),
                "i.patient_sex", party("c.name", "i.insured_name").alias("insured_name"),
                F.col("c.address").alias("patient_address"), F.col("c.city").alias("patient_city"),
                F.col("c.state").alias("patient_state"), F.col("c.zip").alias("patient_zip"),
                F.col("c.phone").alias("patient_phone"), F.upper(rel).alias("patient_rel"),
                party("c.address", "i.insured_address").alias("insured_address"),
                party("c.city", "i.insured_city").alias("insured_city"),
                party("c.state", "i.insured_state").alias("insured_state"),
                party("c.zip", "i.insured_zip").alias("insured_zip"),
                party("c.phone", "i.insured_phone").alias("insured_phone"),
                "i.patient_status", "i.patient_status2", "i.insured_policy",
                dates.formatted(party("c.dob", "i.insured_dob"), US_DATE).alias("insured_dob"),
                party("i.patient_sex", "i.insured_sex").alias("insured_sex"),
                "i.dx1", "i.dx2", "i.approval",
                billing.account_no(F.col("c.name"), F.col("c.id")).alias("account_no")))


def claim_lines(db: Practice, selected: DataFrame | None) -> DataFrame:
    """Every claim line with all that its claim says, one row per line."""
    return (claim_visits(db, selected).drop("provider_npi")
            .join(claim_parties(db), "client_id").join(billing_providers(db), "provider_id"))


def claims(db: Practice, selected: DataFrame | None) -> DataFrame:
    """Claim pages with the parties' fields; the first line's provider signs the page."""
    pages = claim_pages(db, selected).withColumn("provider_id", F.col("items")[0]["provider_id"])
    return (pages.join(claim_parties(db), "client_id")
            .join(billing_providers(db), "provider_id"))


def _shared_fields(as_of: datetime.date) -> dict[str, Column]:
    today = dates.formatted(dates.day(as_of), US_DATE)
    names = {
        "Insurance Company Name": "carrier_name", "Insurance Company Address 1": "carrier_address",
        "Insurance Company Address 2": "carrier_city_st_zip", "1-InsuredPlanName": "payer_type",
        "1a-InsuredIDNo": "id_number", "2-PatientName": "patient_name",
        "3-PatientDOB": "patient_dob", "3-PatientGender": "patient_sex",
        "4-InsuredName": "insured_name", "5-PatientAddress": "patient_address",
        "5-PatientCity": "patient_city", "5-PatientState": "patient_state",
        "5-PatientZip": "patient_zip", "5-PatientPhone": "patient_phone",
        "6-PatientRel": "patient_rel", "7-InsuredAddr": "insured_address",
        "7-InsAddCity": "insured_city", "7-InsAddState": "insured_state",
        "7-InsAddZip": "insured_zip", "7-InsAddPhone": "insured_phone",
        "8-MaritalStatus": "patient_status", "8-Employed?": "patient_status2",
        "11-InsuredGroupNo": "insured_policy", "11a-InsuredsDOB": "insured_dob",
        "11a-InsuredsGender": "insured_sex", "21.1-Diagnosis": "dx1", "21.2-Diagnosis": "dx2",
        "23-PriorAuth": "approval", "25-TaxID": "tax_id", "26-PatientAcctNo": "account_no",
        "28-TotalCharge": "total", "30-BalanceDue": "total",
        "31-PhysicianSignature": "provider_name", "33-ClinicName": "provider_name",
        "33-ClinicAddressLine1": "provider_address",
        "33-ClinicCityStateZip": "provider_city_st_zip", "33-a-NPI": "provider_npi",
    }
    fixed = {
        "10a-CondEmployment": "NO", "10b-CondAutoAccident": "NO", "10c-CondOtherAccident": "NO",
        "12-PatientSign": SIGNED, "13-AuthSign": SIGNED, "20-OutsideLab": "NO",
        "20-Charges": "0.00", "25-SSN/EIN": "SSN", "27-AcceptAssign": "Y", "29-AmountPaid": "0",
    }
    return {**{k: F.col(v).cast("string") for k, v in names.items()},
            **{k: F.lit(v) for k, v in fixed.items()}, "12-Date": today, "31-Date": today}


def claim_file(db: Practice, selected: DataFrame | None, as_of: datetime.date) -> DataFrame:
    """The claim file: 162 text columns. Names with dots need back-ticks."""
    shared = _shared_fields(as_of)
    out: dict[str, Column] = {}
    for name in CLAIM_COLUMNS:
        out[name] = shared.get(name, F.lit(None).cast("string"))
    for slot in range(1, LINES_PER_PAGE + 1):
        item = F.get(F.col("items"), F.lit(slot - 1))
        used = item.isNotNull()
        day = dates.formatted(item["session_date"], US_DATE)
        out.update({
            slot_column(slot, "a-DOSFrom"): day,
            slot_column(slot, "a-DOSTo"): day,
            slot_column(slot, "b-Place"): F.when(used, PLACE_OF_SERVICE),
            slot_column(slot, "d-CPT"): item["cpt"],
            slot_column(slot, "e-Code"): F.when(used, str(DIAGNOSIS_POINTER)),
            slot_column(slot, "f-Charges"): item["price"].cast("string"),
            slot_column(slot, "g-Units"): F.when(used, str(UNITS)),
            slot_column(slot, "j-ProvNPI"): item["provider_npi"],
        })
    return claims(db, selected).select(*[c.alias(n) for n, c in out.items()])


def claim_review(db: Practice, selected: DataFrame | None) -> DataFrame:
    """What the user looks over before sending: one row per page, its lines as text."""
    line = lambda x: F.concat(F.lit("on "), F.date_format(x["session_date"], "MM/dd/yyyy"),
                              F.lit(" CPT: "), x["cpt"], F.lit(" $"), x["price"].cast("string"))
    return claims(db, selected).select(
        "client_id", "page", "carrier_name", "patient_name", "total", "dx1",
        F.coalesce("dx2", F.lit("")).alias("dx2"),
        F.array_join(F.transform("items", line), "; ").alias("lines"))


# ---- printed claims ------------------------------------------------------------------

def printed_claim_lines(db: Practice) -> DataFrame:
    """Open visits that carry a claim id, at what was charged; once per billing provider."""
    v = (db.visit.where("bill_date is null and check_date is null "
                        "and cpt is not null and claim_uid is not null")
         .select(F.col("id").alias("visit_id"), "client_id", "session_id", "cpt", "claim_uid",
                 "charge", "client_paid"))
    s = db.session.select(F.col("id").alias("session_id"), "session_date")
    insured = db.insurance.select("client_id")
    base = v.join(s, "session_id").join(insured, "client_id", "left_semi")
    providers = billing_providers(db).select("provider_id", "provider_npi")
    return join_every(base, providers, "visit_id").drop("session_id")


def printed_claim_totals(db: Practice) -> DataFrame:
    return (printed_claim_lines(db).groupBy("client_id", "claim_uid")
            .agg(billing.total(F.col("charge")).alias("charges"),
                 billing.total(F.col("client_paid")).alias("client_paid"),
                 billing.total(F.col("charge") - F.col("client_paid")).alias("balance"),
                 F.count(F.lit(1)).alias("service_lines"),
                 F.min("provider_id").alias("provider_id")))


def _date_parts(name: str, date: Column, year: str = "%Y") -> dict[str, Column]:
    return {f"{name}_m": dates.formatted(date, "%m"), f"{name}_d": dates.formatted(date, "%d"),
            f"{name}_y": dates.formatted(date, year)}


def _phone_parts(name: str, phone: Column) -> dict[str, Column]:
    """Area code and number of ``913 5550100``, divided at the first blank; without one all of it
    is the number."""
    both = F.instr(phone, " ") > 0
    rest = phone.substr(F.instr(phone, " ") + 1, F.length(phone))
    return {f"{name}_acode": F.when(both, F.substring_index(phone, " ", 1)),
            f"{name}_no": F.when(both, rest).otherwise(phone)}


# --- fixed values: check boxes of the printed form -------------------------------
CHECK_BOXES = {
    "payer_type": {"x_medicare": "Medicare", "x_medicaid": "Medicaid", "x_champus": "Champus",
                   "x_champva": "ChampVA", "x_group": "Group Health Plan", "x_feca": "FECA",
                   "x_payer_other": "Other"},
    "patient_sex": {"x_male": "M", "x_female": "F"},
    "patient_rel": {"x_self": "SELF", "x_spouse": "SPOUSE", "x_child": "CHILD",
                    "x_rel_other": "OTHER"},
    "patient_status": {"x_single": "Single", "x_married": "Married", "x_status_other": "Other"},
    "patient_status2": {"x_employed": "Employed", "x_full_time": "Full Time Student",
                        "x_part_time": "Part Time Student"},
    "insured_sex": {"x_insured_male": "M", "x_insured_female": "F"},
}


def check_boxes(df: DataFrame) -> DataFrame:
    return df.withColumns({box: billing.mark_if(F.col(field), option)
                           for field, boxes in CHECK_BOXES.items()
                           for box, option in boxes.items()})


def _printed_sums(db: Practice) -> DataFrame:
    """Totals of printed claims as text."""
    totals = printed_claim_totals(db)
    return totals.withColumns({text: billing.money_commas(F.col(c)) for text, c in (
        ("charge_sum", "charges"), ("paid_sum", "client_paid"), ("balance_sum", "balance"))}).drop(
            "charges", "client_paid", "balance")


def unprintable_amounts(db: Practice) -> DataFrame:
    """(client_id, claim_uid, field, amount): amounts too long for the form, which show as asterisks."""
    from tallywork.sources import print_layout as layout

    key = ["client_id", "claim_uid"]
    totals = _printed_sums(db).join(claim_parties(db).select("client_id"), "client_id", "left_semi")
    return layout.wide_amounts(totals, key, layout.FOOTER).unionByName(
        layout.wide_amounts(printed_claim_lines(db), key, layout.SERVICE))


def printed_claims(db: Practice, as_of: datetime.date) -> DataFrame:
    """Claims as fixed-width lines: (client_id, claim_uid, line_no, text).

    A claim has its heading, two lines per service, blank lines up to six services, and
    its footer. Services stay rows of their own: a claim may have any number.
    """
    from tallywork.sources import print_layout as layout

    today = dates.formatted(dates.day(as_of), US_DATE)
    dob, insured_dob = (dates.parsed(F.col(c), US_DATE) for c in ("patient_dob", "insured_dob"))
    whole = (check_boxes(_printed_sums(db).join(claim_parties(db), "client_id")
                         .join(billing_providers(db), "provider_id"))
             .withColumns({
                 "today": today, "signed": F.lit(SIGNED), "x": F.lit("X"),
                 "no_charge": F.lit("0 00"), "page_break": F.lit("\f"),
                 **_date_parts("dob", dob), **_date_parts("insured_dob", insured_dob),
                 **_phone_parts("patient", F.col("patient_phone")),
                 **_phone_parts("insured", F.col("insured_phone"))}))
    n = F.col("service_lines")
    key = ["client_id", "claim_uid"]
    head = layout.lines(whole, key, layout.HEADING, first_line=F.lit(1))
    pad = F.greatest(F.lit(LINES_PER_PAGE) - n, F.lit(0)) * 2
    foot_at = len(layout.HEADING) + 2 * n + pad + 1
    foot = layout.lines(whole, key, layout.FOOTER, first_line=foot_at)
    blank = (whole.where(pad > 0)
             .select(*key, F.explode(F.sequence(len(layout.HEADING) + 2 * n + 1, foot_at - 1))
                     .alias("line_no"), F.lit("").alias("text")))
    services = (numbered(printed_claim_lines(db), key,
                         [F.col("session_date"), F.col("visit_id"), F.col("provider_id")],
                         "service_no")
                .withColumns({**_date_parts("served", F.col("session_date"), "%y"),
                              "place": F.lit(PLACE_OF_SERVICE),
                              "pointer": F.lit(str(DIAGNOSIS_POINTER)),
                              "units": F.lit(str(UNITS)),
                              "charge": F.col("charge").cast("string")}))
    body = layout.lines(services, key, layout.SERVICE,
                        first_line=len(layout.HEADING) + 2 * F.col("service_no") - 1)
    return head.unionByName(body).unionByName(blank).unionByName(foot)


# ---- the portal's answer -------------------------------------------------------------

def _month(date: str | Column) -> Column:
    return F.date_format(date, "yyyyMM").cast("bigint")


def sent_claims(db: Practice, selected: DataFrame | None,
                ranges: int | None = None) -> DataFrame:
    """Claim pages as they are sent: one upload per month of the first service, and in it
    the pages in the file's order (client name, client, page)."""
    names = db.client.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    pages = claim_pages(db, selected).join(names, "client_id").withColumn(
        "upload_no", _month(F.col("items")[0]["session_date"]))
    return numbered(pages, ["upload_no"],
                    [F.col("client_name"), F.col("client_id"), F.col("page")], "position", ranges)


def positions(results: DataFrame) -> DataFrame:
    """Result rows (upload_no, page_no, pos, ...) with their place in the whole upload."""
    return numbered(results, ["upload_no"], [F.col("page_no"), F.col("pos")], "position")


def paired(sent: DataFrame, results: DataFrame) -> DataFrame:
    """The i-th claim sent with the i-th result, per upload; the shorter list ends it."""
    return sent.join(positions(results), ["upload_no", "position"])


def stamps(sent: DataFrame, results: DataFrame) -> DataFrame:
    """(visit_id, claim_uid) for every visit of a claim that was answered. A visit sent
    twice (two providers) keeps its last answer, as repeated updates would."""
    pairs = paired(sent, results).select(
        "upload_no", "position", F.explode("visit_ids").alias("visit_id"),
        billing.joined_uid(F.col("trace_no"), F.col("batch")).alias("claim_uid"))
    return pairs.groupBy("visit_id").agg(
        F.max_by("claim_uid", F.struct("upload_no", "position")).alias("claim_uid"))


def stamped_visits(db: Practice, sent: DataFrame, results: DataFrame) -> DataFrame:
    return stamp_claims(db.visit, stamps(sent, results))
