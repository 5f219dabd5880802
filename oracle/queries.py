"""DuckDB SQL per registered query. Column lists: see ``base.cols``."""

from __future__ import annotations

from oracle.base import AS_OF, CTES, DORMANT, DUE, FORM_RAW, pick, query, runs

SQL: dict[str, str] = {}

ATT = ("id group_id group_name m:group_rate client_id client_name d:billing_cutoff d:recent "
       "i:voucher voucher_note insurance policy_id dx1 dx2 carrier_id carrier_name officer_name "
       "session_id therapist_id d:session_date i:attend_n m:charge m:client_paid claim_uid "
       "m:insurance_paid d:bill_date d:check_date note m:due cpt ins_status")
BAL = ("client_id d:oldest_session_date d:recent m:charges m:client_paid m:insurance_paid "
       "m:balance")
CLIENT = ("id d:recent d:billing_cutoff m:charges m:client_paid m:insurance_paid m:balance "
          "d:balance_cached")


def add(name: str, spec: str, source: str) -> None:
    SQL[name] = pick(spec, source)


# ---- sources and sinks ---------------------------------------------------------------
add("s01_read_table",
    "id client_id session_id i:attend_n m:charge m:client_paid m:insurance_paid note cpt "
    "claim_uid d:bill_date d:check_date discharge_status", "select * from p_visit")
add("s02_view_query", "batch_name clients m:balance",
    "select b.batch_name, count(*) clients, sum(x.balance) balance from batch_clients b "
    "join bal x on x.client_id = b.client_id group by 1")
REDUCED = ("select name client_name, reduced_fee, balance, id client_id from client where recent >= "
           "(select cutoff from p_batch where name='current') and reduced_fee > ''")
add("s03_report_lookup", "client_name reduced_fee m:balance client_id", REDUCED)
add("s06_form_records", "form_id " + " ".join(FORM_RAW), "select * from form_raw")
_A = r"""(?s)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
_A_SQL = _A.replace("'", "''")
add("s07_extract_links", "page_id i:pos link_text href", f"""
select page_id, u.i - 1 as pos, hrefs[u.i] href,
  trim(regexp_replace(regexp_replace(texts[u.i], '<[^>]*>', '', 'g'), '&nbsp;|\\s+', ' ', 'g')) link_text
from (select page_id, regexp_extract_all(html, '{_A_SQL}', 1) hrefs,
             regexp_extract_all(html, '{_A_SQL}', 2) texts from pages) p,
  lateral (select unnest(generate_series(1, len(hrefs))) i) u""")
add("s08_claim_rows",
    "upload_no trace_no href batch status last first acc_no d:service_date d:date_received",
    "select * from answer")
add("s07_batch_list", "year i:pos batch_no href", """
select upload_no // 100 as year, row_number() over (partition by upload_no // 100 order by upload_no desc) pos,
  upload_no batch_no, concat('claims?batch_no=', cast(upload_no as varchar)) href
from (select distinct upload_no from answer)""")
add("s09_flatten_claims",
    "batch_no trace_no status last first acc_no client_id d:service_date d:date_received",
    "select batch batch_no, *exclude(client_id), cast(client_id as varchar) client_id from answer")
add("s10_fixed_width_lines", "text", """
select concat(rpad(substr(name,1,20),20,' '), '  ',
  lpad(substr(coalesce(format('{:,.2f}', cast(balance as double)),''),1,14),14,' '), '   ',
  case when voucher=1 then '  voucher   ' else '            ' end) as text from client""")
add("s11_lookup_lines", "text",
    "select concat(name, ' ', coalesce(note,''), '|', cast(id as varchar)) as text from p_client")
add("s12_lookups", "list id label", """
select 'officers' list, cast(id as varchar) id, name label from p_officer
union all select 'offices', cast(id as varchar), name from p_office
union all select 'clients', cast(id as varchar), name from p_client
union all select 'carriers', cast(id as varchar), name from p_carrier
union all select 'diagnoses', icd9, icd9 from p_diagnosis
union all select 'procedures', cpt, cpt from p_procedure
union all select 'therapists', cast(id as varchar), name from p_therapist
union all select 'groups', cast(id as varchar), concat(name, ' ', '$', cast(rate as varchar)) from p_group
union all select 'sessions', cast(s.id as varchar), concat_ws(': ', g.name, strftime(s.session_date, '%m/%d/%Y'))
  from p_session s join p_group g on s.group_id = g.id""")

# ---- the claim file ------------------------------------------------------------------
_SHARED = {
    "Insurance Company Name": "carrier_name", "Insurance Company Address 1": "carrier_address",
    "Insurance Company Address 2": "carrier_city_st_zip", "1-InsuredPlanName": "payer_type",
    "1a-InsuredIDNo": "id_number", "2-PatientName": "patient_name", "3-PatientDOB": "patient_dob",
    "3-PatientGender": "patient_sex", "4-InsuredName": "insured_name",
    "5-PatientAddress": "patient_address", "5-PatientCity": "patient_city",
    "5-PatientState": "patient_state", "5-PatientZip": "patient_zip",
    "5-PatientPhone": "patient_phone", "6-PatientRel": "patient_rel",
    "7-InsuredAddr": "insured_address", "7-InsAddCity": "insured_city",
    "7-InsAddState": "insured_state", "7-InsAddZip": "insured_zip",
    "7-InsAddPhone": "insured_phone", "8-MaritalStatus": "patient_status",
    "8-Employed?": "patient_status2", "10a-CondEmployment": "'NO'",
    "10b-CondAutoAccident": "'NO'", "10c-CondOtherAccident": "'NO'",
    "11-InsuredGroupNo": "insured_policy", "11a-InsuredsDOB": "insured_dob",
    "11a-InsuredsGender": "insured_sex", "12-PatientSign": "'Signature on file'",
    "12-Date": "'11/15/2001'", "13-AuthSign": "'Signature on file'", "20-OutsideLab": "'NO'",
    "20-Charges": "'0.00'", "21.1-Diagnosis": "dx1", "21.2-Diagnosis": "dx2",
    "23-PriorAuth": "approval", "25-TaxID": "tax_id", "25-SSN/EIN": "'SSN'",
    "26-PatientAcctNo": "account_no", "27-AcceptAssign": "'Y'", "29-AmountPaid": "'0'",
    "31-PhysicianSignature": "provider_name", "31-Date": "'11/15/2001'",
    "33-ClinicName": "provider_name", "33-ClinicAddressLine1": "provider_address",
    "33-ClinicCityStateZip": "provider_city_st_zip", "33-a-NPI": "provider_npi",
}
_LINE = {"a-DOSFrom": "strftime(session_date, '%m/%d/%Y')",
         "a-DOSTo": "strftime(session_date, '%m/%d/%Y')", "b-Place": "'11'", "d-CPT": "cpt",
         "e-Code": "'1'", "f-Charges": "cast(price as varchar)", "g-Units": "'1'",
         "j-ProvNPI": "provider_npi"}


def claim_file() -> str:
    from tallywork.catalog import safe_name
    from tallywork.plans.claims import CLAIM_COLUMNS
    parts = []
    for name in CLAIM_COLUMNS:
        head, _, field = name.rpartition(".")
        if name in _SHARED:
            sql = f"max(case when slot=1 then {_SHARED[name]} end)"
        elif name in ("28-TotalCharge", "30-BalanceDue"):
            sql = "cast(cast(sum(price) as decimal(18,2)) as varchar)"
        elif head.startswith("24.") and field in _LINE:
            sql = f"max(case when slot={head[3:]} then {_LINE[field]} end)"
        else:
            sql = "cast(null as varchar)"
        parts.append(f'{sql} as "{safe_name(name)}"')
    return query(f"select {', '.join(parts)} from claim_slot group by client_id, page")


SQL["s04_claims_csv"] = SQL["c03_claim_slots"] = claim_file()

# ---- projections and filters ---------------------------------------------------------
add("p01_projection", "id m:charge client place i:units",
    "select id, charge, client_id as client, '11' place, 1 units from p_visit")
add("p02_first_wins", "id name insured_name dx1 payer_type",
    "select c.id, c.name, i.insured_name, i.dx1, i.payer_type from client c "
    "left join p_insurance i on i.client_id = c.id")
add("p03_lower_names", "client_id client_name",
    "select id client_id, name client_name from p_client")
add("p04_due", "id m:due", f"select id, {DUE} due from p_visit v")
add("p05_billing_status", "ins_status n", "select ins_status, count(*) n from att_all group by 1")
add("p06_insured_party",
    "client_id patient_rel insured_name insured_address insured_city insured_state insured_zip "
    "insured_phone insured_dob insured_sex", """
select c.id client_id, upper(i.patient_rel) patient_rel,
  case i.patient_rel when 'Self' then c.name else i.insured_name end insured_name,
  case i.patient_rel when 'Self' then c.address else i.insured_address end insured_address,
  case i.patient_rel when 'Self' then c.city else i.insured_city end insured_city,
  case i.patient_rel when 'Self' then c.state else i.insured_state end insured_state,
  case i.patient_rel when 'Self' then c.zip else i.insured_zip end insured_zip,
  case i.patient_rel when 'Self' then c.phone else i.insured_phone end insured_phone,
  strftime(case i.patient_rel when 'Self' then c.dob else i.insured_dob end, '%m/%d/%Y') insured_dob,
  case i.patient_rel when 'Self' then i.patient_sex else i.insured_sex end insured_sex
from p_insurance i join p_client c on i.client_id = c.id join p_carrier k on k.id = i.carrier_id""")
add("p07_default_when_null", "id time",
    "select id, case when time is null then 'time?' else time end as time from p_session")
add("p08_both_names", "id officer_names", """
select c.id, case when b.name is null then a.name when a.name is null then null
  else concat(a.name, '/', b.name) end officer_names
from p_client c left join p_officer a on a.id = c.officer_id
left join p_officer b on b.id = c.officer2_id""")
add("p09_printed_columns", "id charge bill_date note", """
select substr(id,1,18) id, substr(cast(charge as varchar),1,6) charge,
  coalesce(strftime(bill_date,'%m/%d/%Y'),'') bill_date, substr(coalesce(note,''),1,3) note from p_visit""")
add("f01_since_cutoff", "id d:session_date d:billing_cutoff",
    "select * from att_all where session_date >= billing_cutoff")
add("f02_scalar_bound", "id d:recent",
    "select * from client where recent >= (select cutoff from p_batch where name='current')")
add("f03_last_days", "id d:session_date time group_id therapist_id",
    f"select * from p_session where session_date > {AS_OF} - 30")
add("f04_days_old", "id i:ten_days i:four_years", f"""
select id, date_diff('day', session_date, {AS_OF}) <= 10 ten_days,
  date_diff('day', session_date, {AS_OF}) < 1460 four_years from p_session""")
add("f05_any_case_like", "id i:monitoring i:no_course i:cwip", """
select id, lower(name) like '%monitoring%' monitoring, lower(name) not like 'substance abuse ed%' no_course,
  lower(name) like 'cwip%' cwip from p_group""")
add("f06_null_tests", "id claim_uid",
    "select * from p_visit where bill_date is null and claim_uid is not null")
add("f07_has_text", "id reduced_fee",
    "select * from p_client where reduced_fee is not null and reduced_fee <> ''")
add("f08_id_in_list", "id client_id",
    "select * from p_visit where id in (select id from p_visit where bill_date is null and check_date is null)")
add("f09_flags", "id i:voucher",
    "select id, voucher from p_client where voucher > 0 union all select id, evaluation from p_group where evaluation = 1")
add("f10_facets", "value n facet", """
select carrier_name as value, count(*) n, 'carrier' facet from att_all group by 1
union all select b.batch_name, count(*), 'batch' from client c left join batch_clients b on b.client_id = c.id group by 1
union all select group_name, count(*), 'group of no CPT' from att_all where ins_status = 'no CPT' group by 1""")
add("f11_other_tables_threshold", "client_id m:balance", "select * from bulk")
add("f12_either", "id insurance carrier_name",
    "select * from att_all where insurance > '' or carrier_name > ''")

# ---- joins ---------------------------------------------------------------------------
add("j01_inner_chain", "id group_name client_name d:session_date", "select * from smoke")
add("j02_left_chain", "id officer_name policy_id carrier_name", "select * from att_all")
add("j03_role_dimension", "id officer officer2 lawyer court", """
select c.id, o.name officer, o2.name officer2, l.name lawyer, f.name court from p_client c
left join p_officer o on o.id = c.officer_id left join p_officer o2 on o2.id = c.officer2_id
left join p_officer l on l.id = c.lawyer_id left join p_office f on f.id = c.court_id""")
add("j04_since_cutoff", "batch_name m:invoice_threshold client_id", "select * from batch_clients")
add("j05_every_provider", "id provider_id tax_id",
    "select v.id, t.id provider_id, t.tax_id from p_visit v join p_therapist t on t.tax_id is not null")
add("j06_derived_table", "id name weight", """
select s.id, t.name, w.weight from p_session s join p_therapist t on t.id = s.therapist_id
join (select therapist_id, count(*) weight from p_session group by 1) w on w.therapist_id = t.id""")
add("j07_two_keys", "id d:discharge_date status", """
select v.id, d.discharge_date, d.discharge_status status from smoke v
left join disch d on d.client_id = v.client_id and d.group_id = v.group_id""")
PERIODS = """
select y.year, m.month, cast(ceil(m.month/3.0) as int) as "quarter", cast(ceil(m.month/6.0) as int) as "half",
  make_date(cast(y.year as int), cast(m.month as int), 1) as "first"
from (select unnest(generate_series((select min(year(session_date)) from p_session),
                                    (select max(year(session_date)) from p_session))) as year) y,
     (select unnest(generate_series(1,12)) as month) m"""
add("j08_calendar", "i:year i:month i:quarter i:half d:first", PERIODS)
add("j09_never_absent", "id name",
    "select id, name from p_client where id not in (select client_id from p_visit where attend_n = 0)")
add("j10_only_invoiced", "id m:balance",
    "select id, balance from client where id in (select client_id from bulk)")
add("j11_clients_of_batches", "batch_name d:cutoff id name", """
select b.batch_name, x.cutoff, c.id, c.name from batch_clients b join p_batch x on x.name = b.batch_name
join client c on c.id = b.client_id""")
_REL = {
    "attendance.visit": ("att", "id", "id", "p_visit", "id"),
    "attendance.client": ("att", "id", "client_id", "client", "id"),
    "attendance.group": ("att", "id", "group_id", "p_group", "id"),
    "attendance.session": ("att", "id", "session_id", "p_session", "id"),
    "bulk_invoices.client": ("bulk", "client_id", "client_id", "client", "id"),
    "carrier.policies": ("p_carrier", "id", "id", "p_insurance", "carrier_id"),
    "client.insurance": ("client", "id", "id", "p_insurance", "client_id"),
    "client.visits": ("client", "id", "id", "att", "client_id"),
    "client.visits_all": ("client", "id", "id", "p_visit", "client_id"),
    "client.officer": ("client", "id", "officer_id", "p_officer", "id"),
    "client.lawyer": ("client", "id", "lawyer_id", "p_officer", "id"),
    "client.court": ("client", "id", "court_id", "p_office", "id"),
    "client_balances.client": ("bal", "client_id", "client_id", "client", "id"),
    "client_balances.visits": ("bal", "client_id", "client_id", "p_visit", "client_id"),
    "group.sessions": ("p_group", "id", "id", "p_session", "group_id"),
    "group.attendance_trend": ("p_group", "id", "id", "trend", "group_id"),
    "group.procedure": ("p_group", "id", "cpt", "p_procedure", "cpt"),
    "insurance.client": ("p_insurance", "id", "client_id", "client", "id"),
    "insurance.carrier": ("p_insurance", "id", "carrier_id", "p_carrier", "id"),
    "officer.clients": ("p_officer", "id", "id", "client", "officer_id"),
    "officer.office": ("p_officer", "id", "office_id", "p_office", "id"),
    "session.group": ("p_session", "id", "group_id", "p_group", "id"),
    "session.visits": ("p_session", "id", "id", "p_visit", "session_id"),
    "session.therapist": ("p_session", "id", "therapist_id", "p_therapist", "id"),
    "therapist.sessions": ("p_therapist", "id", "id", "p_session", "therapist_id"),
    "visit.client": ("p_visit", "id", "client_id", "client", "id"),
    "visit.session": ("p_visit", "id", "session_id", "p_session", "id"),
}
add("j12_related_rows", "relation from_key n", "\nunion all ".join(
    f"select '{k}' relation, cast(a.{key} as varchar) from_key, count(*) n from {a} a "
    f"join {b} b on a.{x} = b.{y} group by 2" for k, (a, key, x, b, y) in _REL.items()))
add("j13_paired_by_position", "upload_no position client_id page trace_no", "select * from answer")
add("j14_cells_to_fields", "name field i:cells i:filled", "\nunion all ".join(
    f"select '{k}' as name, '{f}' field, count(*) cells, sum(case when {k} <> '' then 1 else 0 end) filled from form_raw"
    for k, f in {
        **{k: "" for k in ("payer_name", "payer_address", "payer_city_st_zip")},
        **{k: "1" for k in ("x_medicare", "x_medicaid", "x_champus", "x_champva", "x_group",
                            "x_feca", "x_payer_other")},
        "id_number": "1a", "patient_name": "2",
        **{k: "3" for k in ("dob_m", "dob_d", "dob_y", "x_male", "x_female")},
        "insured_name": "4",
        **{k: "5" for k in ("patient_address", "patient_city", "patient_state", "patient_zip",
                            "patient_acode", "patient_no")},
        **{k: "6" for k in ("x_self", "x_spouse", "x_child", "x_rel_other")},
        **{k: "7" for k in ("insured_address", "insured_city", "insured_state", "insured_zip",
                            "insured_acode", "insured_no")},
        **{k: "8" for k in ("x_single", "x_married", "x_status_other", "x_employed",
                            "x_full_time", "x_part_time")},
        "insured_policy": "11",
        **{k: "11a" for k in ("insured_dob_m", "insured_dob_d", "insured_dob_y",
                              "x_insured_male", "x_insured_female")},
        "dx1": "21.1", "dx1_detail": "21.1", "dx2": "21.2", "dx2_detail": "21.2"}.items()))

# ---- control breaks ------------------------------------------------------------------
C, G = ("client", ["client_id"]), ("group", ["group_id"])
BY_CLIENT = runs("select * from by_client", [C, G], ["client_name"],
                 "group_name, session_date, id, discharge_date nulls first, discharge_status nulls first")
BY_GROUP = runs("select * from att", [G, C], ["group_name"], "client_name, session_date, id")
INSURED = "select * from att where insurance > '' or carrier_name > ''"
BY_INSURED = runs(INSURED, [C], ["client_name", "client_id"],
                  "session_date desc, group_name, group_id, id")
CWIP = """select a.*, f.name court_name, l.name lawyer_name from att_all a join p_client c on c.id = a.client_id
left join p_office f on f.id = c.court_id left join p_officer l on l.id = c.lawyer_id
where lower(group_name) like '%cwip%'"""
BY_CWIP = runs(CWIP, [C], ["client_name", "client_id"], "session_date, id")
DUPS = """select a.*, c.id_dabble, c.id_zoho, cast(null as varchar) added_user from att_all a
join (select lower(name) n from p_client group by 1 having count(*) > 1) d on d.n = lower(a.client_name)
join p_client c on c.id = a.client_id"""
BY_DUPS = runs(DUPS, [C, G], ["client_name", "client_id"], "group_name, session_date desc, id")
EVAL = f"""select a.group_id, a.group_name, s.session_date, s.time, a.client_name, t.name therapist_name,
  a.charge, a.client_paid, a.insurance_paid, a.due, a.note, a.id
from att_all a join p_group g on g.id = a.group_id join p_session s on s.id = a.session_id
join p_therapist t on t.id = s.therapist_id where g.evaluation = 1 and s.session_date > {AS_OF} - 30"""
BY_EVAL = runs(EVAL, [G], ["group_name"], "session_date desc, client_name, id")
INCOME = """select year(s.session_date) sn_year, month(s.session_date) sn_month, monthname(s.session_date) sn_month_name,
  s.id, strftime(s.session_date, '%b %d') short_date, s.session_date, g.name gp_name, t.id th_id, t.name th_name,
  count(v.id) attend_n, cast(sum(v.charge) as decimal(18,2)) charge,
  cast(sum(v.insurance_paid) as decimal(18,2)) ins_pd, cast(sum(v.client_paid) as decimal(18,2)) client_pd
from p_visit v join p_session s on v.session_id = s.id join p_group g on s.group_id = g.id
join p_therapist t on s.therapist_id = t.id
where s.session_date >= (select cutoff from p_batch where name = 'income')
group by s.session_date, s.id, g.name, t.id, t.name"""
BY_INCOME = runs(INCOME, [("therapist", ["sn_month", "sn_year", "th_id"])],
                 ["sn_year", "sn_month", "th_name"], "gp_name, session_date, id")
RECENT = f"""select a.*, s.time, t.name therapist_name from att_all a join p_session s on s.id = a.session_id
left join p_therapist t on t.id = a.therapist_id where s.session_date > {AS_OF} - 30"""
BY_RECENT = runs(RECENT, [("session", ["session_id"])], ["session_date", "group_id"],
                 "client_name, client_id, id")
VOUCHER = "select * from att where voucher > 0"
BY_VOUCHER = runs(VOUCHER, [C, G], ["client_name"], "group_name, session_date, id")
WEEKLY = f"""select strftime(s.session_date, '%A, %B %d, %Y') session_day, s.session_date, g.name group_name,
  coalesce(s.time, 'time?') as time, s.time session_time, th.name therapist_name, v.charge, v.client_paid, v.note,
  c.name client_name, s.id session_id, g.id group_id, v.id
from p_session s join p_therapist th on th.id = s.therapist_id join p_group g on g.id = s.group_id
join p_visit v on v.session_id = s.id join p_client c on c.id = v.client_id
where date_diff('day', s.session_date, {AS_OF}) <= 10"""
BY_WEEKLY = runs(WEEKLY, [("day", ["session_date"]), G, ("session", ["session_id"])],
                 ["session_date"], "group_name, session_time nulls first, client_name, id")

MONEY = "attend_n charge client_paid insurance_paid due".split()


def footer(spec: str, source: str, by: str, sums: list[str] = MONEY) -> str:
    agg = ", ".join(f"sum({s}) {s}_sum" for s in sums)
    return pick(spec, f"select {by}, count(*) n_rows, {agg} from ({source}) group by {by}")


SUMS = "i:attend_n_sum m:charge_sum m:client_paid_sum m:insurance_paid_sum m:due_sum"
add("a01_client_balances", BAL, "select * from bal")
add("a02_attendance_trend", "i:year i:quarter group_id group_name visits", "select * from trend")
add("a03_income", "i:sn_year th_name sessions i:attend_n m:charge",
    f"select sn_year, th_name, count(*) sessions, sum(attend_n) attend_n, sum(charge) charge from ({INCOME}) group by 1,2")
TOTALS = """select group_id, client_id, group_name, client_name, strftime(min(session_date), '%b %d ''%y') start_day,
  strftime(max(session_date), '%b %d ''%y') end_day, sum(attend_n) attend_n, cast(sum(charge) as decimal(18,2)) charges,
  cast(sum(client_paid) as decimal(18,2)) client_paid, cast(sum(coalesce(insurance_paid,0)) as decimal(18,2)) insurance_paid,
  cast(sum(due) as decimal(18,2)) due from smoke group by 1,2,3,4"""
TOTAL_COLS = "i:attend_n m:charges m:client_paid m:insurance_paid m:due"
add("a04_group_client_totals",
    f"group_id client_id group_name client_name start_day end_day {TOTAL_COLS}", TOTALS)
AMOUNT = """select client_id, min(session_date) earliest, max(session_date) latest, client_name client,
  sum(charge) charges, sum(client_paid) client_pd, sum(insurance_paid) ins_pd, sum(due) due from smoke group by 1,4"""
AMOUNT_COLS = "client_id d:earliest d:latest client m:charges m:client_pd m:ins_pd m:due"
add("a05_amount_due", AMOUNT_COLS, AMOUNT)
WEIGHT = """select t.id, t.name, count(s.id) weight from p_therapist t join p_session s on s.therapist_id = t.id
group by 1,2"""
add("a06_therapist_weight", "id name weight", WEIGHT)
add("a07_duplicate_names", "name n",
    "select min(name) as name, count(*) n from p_client group by lower(name) having count(*) > 1")
TREATED = f"""select distinct a.group_id, a.group_name, a.client_id, a.client_name
from att a join p_group g on g.id = a.group_id where a.session_date > {AS_OF} - 30 and g.evaluation = 0
and g.name not ilike '%Education%' and g.name not ilike 'Substance Abuse Ed%'
and g.name not ilike 'Financial Crimes Ed%' and g.name not ilike 'CWIP%'"""
add("a08_grouped_distinct", "group_id group_name client_id client_name", TREATED)
add("a09_distinct", "group_id carrier_name ins_status",
    "select distinct group_id, carrier_name, ins_status from att_all")
RATIO = """select visits, sessions, round(cast(visits as double)/sessions, 4) ratio
from (select count(*) visits from p_visit), (select count(*) sessions from p_session)"""
add("a10_scalars", "visits sessions ratio", RATIO)
SQL["a11_break_sums_any"] = footer(
    f"client_name i:run_group client_id group_id n_rows {SUMS}", BY_CLIENT,
    "client_name, run_group, client_id, group_id")
SQL["a12_break_sums_level"] = footer(
    f"client_name i:run_client client_id n_rows {SUMS}", BY_CLIENT,
    "client_name, run_client, client_id")
add("a13_claim_totals", "client_id page i:n m:total", "select * from claim_page")
add("a14_printed_totals", "client_id claim_uid m:charges m:client_paid m:balance service_lines",
    "select * from print_total")
ROLLUP = """select group_id, client_id, grouping(group_id, client_id) as grouping, count(*) visits, sum(attend_n) attend_n,
  sum(charge) charges, sum(due) due from smoke group by rollup(group_id, client_id)"""
add("a15_rollup", "group_id client_id i:grouping visits i:attend_n m:charges m:due", ROLLUP)
add("a16_null_as_zero", "cpt m:insurance_paid entered",
    "select cpt, sum(coalesce(insurance_paid,0)) insurance_paid, count(insurance_paid) entered from p_visit group by 1")
add("a17_check_sum", "id name m:balance m:recomputed m:delta", """
select c.id, c.name, c.balance + 1 as balance, b.balance recomputed, c.balance + 1 - b.balance delta
from client c left join bal b on b.client_id = c.id where c.id % 50 = 0 and c.balance is not null""")

add("w01_break_runs", "id i:run_group i:run_client i:start_level i:is_end", BY_GROUP)
add("w02_start_levels", "i:start_level i:is_end n",
    f"select start_level, is_end, count(*) n from ({BY_WEEKLY}) group by 1,2")
add("w03_group_ends", "id", f"select id from ({BY_INSURED}) where is_end = 1")
add("w04_pages_of_six", "client_id visit_id i:page i:slot", "select * from claim_slot")
add("w05_parity", "id i:parity", f"""select id, (row_number() over (order by client_name, client_id,
  session_date desc, group_name, group_id, id) - 1) % 2 parity from ({INSURED})""")
add("w06_newest_batch", "batch_no kind", """
select max(batch) batch_no, 'newest' kind from answer
union all select distinct batch, 'newer' from answer where batch > 200010""")

add("o01_mixed_order", "id i:sn_year i:sn_month th_name", INCOME)
add("o02_by_aggregate", "i:year i:quarter visits", "select * from trend order by 1 desc, 2 desc")
add("o03_order_at_the_sink", "client_id m:balance", "select * from bulk order by balance desc")
add("o04_frequent_first", "id label",
    "select cast(id as varchar) id, name as label from p_therapist")
add("o05_default_order", "id d:session_date", "select * from p_session order by session_date desc")
add("o06_first_match", "name_key id matches",
    "select lower(name) name_key, min(id) id, count(*) matches from p_client group by 1")
DUE_ALL = """select *, name as client_name from client
where recent >= (select cutoff from p_batch where name = 'current')"""
add("o07_order_with_key", "id client_name", DUE_ALL)
add("u01_union_of_months", "i:year i:half", f"""
select year, half from ({PERIODS}) union all select distinct year(session_date), 0 from p_session""")
NO_VISITS = "select id, name from p_client where id not in (select client_id from p_visit)"
add("u02_difference", "id name", NO_VISITS)
add("u03_insert_absent", "name address",
    "select name, address from p_carrier union all select name, address from new_carrier")

# ---- scalar functions ----------------------------------------------------------------
add("x01_date_parts", "id i:y i:m name",
    "select id, year(session_date) y, month(session_date) m, monthname(session_date) as name from p_session")
add("x02_sunday_week", "id i:week", "select id, strftime(session_date, '%U') as week from p_session")
add("x03_quarter_block", "id i:block",
    "select id, cast(round(cast(strftime(session_date,'%U') as int)/13) as int) block from p_session")
add("x04_day_arithmetic", "id i:age d:before",
    f"select id, date_diff('day', session_date, {AS_OF}) age, session_date - 30 as before from p_session")
add("x05_date_format", "id a b c d", """select id, strftime(session_date, '%b %d ''%y') a,
  strftime(session_date, '%m/%d/%Y') b, strftime(session_date, '%b %d') c,
  strftime(session_date, '%A, %B %d, %Y') d from p_session""")
add("x06_parse_date", "id client d:day", """select o_orderkey id, o_custkey client,
  try_cast(concat('2001-', lpad(cast(o_orderkey%14 as varchar),2,'0'), '-', lpad(cast(o_custkey%31 as varchar),2,'0')) as date) as day
from orders""")
add("x07_report_dates", "id a b c", """select id,
  concat(lpad(strftime(bill_date,'%-d'),2,' '), strftime(bill_date,' %b %Y')) || case when bill_date is null then null else '' end a,
  concat(lpad(strftime(bill_date,'%-d'),2,' '), strftime(bill_date,' %b%y')) || case when bill_date is null then null else '' end b,
  strftime(bill_date,'%m/%d/%y') c from p_visit""")
add("x08_concat", "id strict lenient", """select id, time || '-' || cast(therapist_id as varchar) strict,
  concat_ws(': ', time, cast(therapist_id as varchar)) lenient from p_session""")
add("x09_account_no", "id account_no without_comma", """select id,
  concat(upper(substr(name,1,3)), '.', upper(substr(name, instr(name,',')+2, 3)), '.', cast(id as varchar)) account_no,
  concat(upper(substr(city,1,3)), '.', upper(substr(city, 2, 3)), '.', cast(id as varchar)) without_comma from p_client""")
add("x10_form_feed", "id page", "select id, concat(name, chr(12)) page from p_office")
add("x11_greatest", "id d:last", """select id, case when bill_date is not null and check_date is not null
  then greatest(bill_date, check_date) end as "last" from p_visit""")
add("x12_cases", "id met", """select c.id, case i.deductible_met when 1 then '[Y]' when 0 then '[n]' else '' end met
from p_client c left join p_insurance i on i.client_id = c.id""")
add("x13_money", "id commas plain dollar", """select id, format('{:,.2f}', cast(balance as double)) commas,
  cast(balance as varchar) plain, '$' || format('{:,.2f}', cast(balance as double)) dollar from client""")
add("x14_trace_and_batch", "id trace_no batch_no", """select id, split_part(claim_uid, ',', 1) trace_no,
  case when attend_n <> 0 then split_part(claim_uid, ',', 2) end batch_no from p_visit where claim_uid is not null""")
add("x15_two_digit_year", "form_id d:dob", "select * from form")
add("x16_zip", "form_id zip", "select form_id, insured_zip as zip from form")
add("x17_phone", "form_id phone", "select form_id, patient_phone phone from form")
add("x18_diagnosis", "form_id dx1", "select * from form")
add("x19_checked_option", "form_id payer_type patient_sex patient_rel patient_status patient_status2",
    "select * from form")
add("x20_field_number", "i:number cells", """
select n.number, n.fields * f.forms cells from (select count(*) forms from form_raw) f,
(values (cast(null as int), 3), (1, 8), (2, 1), (3, 5), (4, 1), (5, 6), (6, 4), (7, 6), (8, 6), (11, 6), (21, 4)) n(number, fields)""")
add("x21_cell_position", "i:row i:col n", """select l_linenumber*4+20 as row, (l_suppkey%79+1)*3+1 as col, count(*) n
from lineitem group by 1,2""")
add("x22_id_or_empty", "id dabble zoho",
    "select id, coalesce(id_dabble,'') dabble, coalesce(id_zoho,'') zoho from p_client")
add("x23_session_title", "id title", """select s.id, concat_ws(' ', g.name, strftime(s.session_date,'%m/%d/%Y'), s.time) title
from p_session s join p_group g on g.id = s.group_id""")

# ---- upkeep --------------------------------------------------------------------------
add("m01_group_cpt", "id cpt", """select v.id, case when g.cpt > '' then g.cpt else 'old' end cpt
from p_visit v join p_session s on s.id = v.session_id join p_group g on g.id = s.group_id""")
_NULL = ", ".join(f"cast(null as decimal(18,2)) {c}" for c in
                  ("charges", "client_paid", "insurance_paid", "balance"))
add("m02_reset_balances", CLIENT, f"""select id, cast(null as date) recent,
  (select min(session_date) from p_session) billing_cutoff, {_NULL}, cast(null as timestamp) balance_cached from p_client""")
add("m03_mark_dormant", CLIENT, f"""select id, recent, billing_cutoff, {_NULL},
  cast(null as timestamp) balance_cached from client""")
add("m04a_refresh_with_visits", CLIENT, "select * from client")
add("m04b_refresh_everybody", CLIENT, """select c.id, b.recent, c.billing_cutoff, b.charges, b.client_paid,
  b.insurance_paid, b.balance, timestamp '2001-11-15 00:00:00' balance_cached
from client c left join bal b on b.client_id = c.id""")
add("m05_therapist_weight", "id name i:weight", """select t.id, t.name, n.weight from p_therapist t
left join (select therapist_id, count(*) weight from p_session group by 1) n on n.therapist_id = t.id""")
add("m06_merge_clients", "client_id visits m:charges", """select coalesce(m.keep, v.client_id) client_id,
  count(*) visits, sum(v.charge) charges from p_visit v left join merged m on m.id = v.client_id group by 1""")
add("m06_merged_tables", "table_name n last_key", """
select 'client' table_name, count(*) n, max(cast(id as varchar)) last_key from p_client
  where id not in (select id from merged where id <> keep)
union all select 'insurance', count(*), max(cast(id as varchar)) from p_insurance
  where client_id not in (select id from merged where id <> keep)
union all select 'visit', count(*), max(id) from p_visit""")
STAMPED = """select l.visit_id, concat(cast(a.trace_no as varchar), ',', cast(a.batch as varchar)) claim_uid
from claim_slot l join answer a on a.client_id = l.client_id and a.page = l.page"""
add("m07_stamp_claims", "id claim_uid", f"""select v.id, coalesce(s.claim_uid, v.claim_uid) claim_uid
from p_visit v left join ({STAMPED}) s on s.visit_id = v.id""")
add("m08_visits_entered", "id d:recent d:billing_cutoff", """select c.id,
  case when n.b is null then c.recent when c.recent is not null then greatest(c.recent, n.b) end recent,
  coalesce(c.billing_cutoff, n.a) billing_cutoff
from client c left join (select o_custkey, cast(min(o_orderdate) as date) a, cast(max(o_orderdate) as date) b
  from orders group by 1) n on n.o_custkey = c.id""")
add("m09_set_batch", "batch_name m:invoice_threshold clients", """
select b.name batch_name, b.t invoice_threshold, count(*) clients from
 (values ('current', DATE '2001-09-01', 1800000.00), ('income', DATE '2001-01-01', null)) b(name, cutoff, t)
join client c on c.recent >= b.cutoff group by 1,2""")
add("m10_add_carriers", "id name address city_st_zip", "select * from all_carrier")
add("m11_add_diagnoses", "icd9 name", """select icd9, name from p_diagnosis union all
select distinct x.code, cast(null as varchar) from (select dx1 code from form_added union all
 select dx2 from form_added) x where x.code is not null and x.code not in (select icd9 from p_diagnosis)""")
FORM = ("form_id patient_name payer_name payer_address payer_city_st_zip payer_type id_number "
        "patient_sex insured_name patient_rel insured_address insured_city insured_state "
        "insured_zip insured_phone patient_status patient_status2 insured_policy d:insured_dob "
        "insured_sex dx1 dx2 d:dob patient_address patient_city patient_state patient_zip "
        "patient_phone client_id outcome")
add("m12_form_outcomes", FORM, "select * from form_out")
add("m12_add_policies", "id client_id carrier_id payer_type id_number d:insured_dob dx1 dx2", """
select id, client_id, carrier_id, payer_type, id_number, insured_dob, dx1, dx2 from p_insurance
union all select (select max(id) from p_insurance) + row_number() over (order by f.form_id), f.client_id, k.id,
  f.payer_type, f.id_number, f.insured_dob, f.dx1, f.dx2
from form_added f join all_carrier k on lower(k.name) = lower(f.payer_name)""")
add("m13_update_clients", "id name d:dob address city state zip phone", """select c.id, c.name,
  case when f.form_id is null then c.dob else f.dob end dob,
  case when f.form_id is null then c.address else f.patient_address end address,
  case when f.form_id is null then c.city else f.patient_city end city,
  case when f.form_id is null then c.state else f.patient_state end state,
  case when f.form_id is null then c.zip else f.patient_zip end zip,
  case when f.form_id is null then c.phone else f.patient_phone end phone
from p_client c left join form_added f on f.client_id = c.id""")
add("m14_visit_defaults", "id i:attend_n m:charge cpt", """select v.id, case when v.attend_n = 0 then 0 else 1 end attend_n,
  case when v.charge > 50000 then v.charge else g.rate end charge,
  case when v.note is not null then '90801' else g.cpt end cpt
from p_visit v join p_session s on s.id = v.session_id join p_group g on g.id = s.group_id""")
add("m15_audit_columns", "id name email office_id d:added_time added_user d:modified_time modified_user", """
select id, name, email, office_id, timestamp '2001-11-15 00:00:00' added_time, 'ann' added_user,
  case when email is null then timestamp '2001-11-16 00:00:00' else timestamp '2001-11-15 00:00:00' end modified_time,
  case when email is null then 'bob' else 'ann' end modified_user from p_officer""")
add("m16_cascading_delete", "id session_id", """select v.id, v.session_id from p_visit v join p_session s on s.id = v.session_id
join p_group g on g.id = s.group_id where g.evaluation <> 1""")
add("m16_remaining_rows", "table_name n last_key", """
select 'office' table_name, count(*) n, max(cast(id as varchar)) last_key from p_office where fax is not null
union all select 'officer', count(*), max(cast(id as varchar)) from p_officer
union all select 'client', count(*), max(cast(id as varchar)) from p_client
union all select 'group', count(*), max(cast(id as varchar)) from p_group where evaluation <> 1
union all select 'session', count(*), max(cast(s.id as varchar)) from p_session s join p_group g on g.id = s.group_id
  where g.evaluation <> 1""")
add("m16_set_null", "id therapist_id",
    "select id, case when therapist_id % 3 <> 0 then therapist_id end therapist_id from p_session")
_USED = """(select cpt, 'visit' by_table from p_visit union all select cpt, 'group' from p_group)"""
add("m16_refused", "row_key by_table by_column uses", f"""
select p.cpt row_key, u.by_table, 'cpt' by_column, count(*) uses from p_procedure p join {_USED} u on u.cpt = p.cpt
group by 1, 2""")
add("m16_after_refusals", "table_name n last_key", f"""
select 'procedure' table_name, count(*) n, max(cpt) last_key from p_procedure
  where cpt in (select cpt from {_USED} u where cpt is not null)
union all select 'visit', count(*), max(cast(id as varchar)) from p_visit
union all select 'group', count(*), max(cast(id as varchar)) from p_group""")
add("m17_violations", "table_name row_key rule", """
select 'visit' table_name, id row_key, 'insurance_paid required' rule from p_visit where insurance_paid is null
union all select 'officer', cast(id as varchar), 'email required' from p_officer where email is null
union all select 'client', cast(id as varchar), 'phone length' from p_client where length(phone) > 15
union all select 'visit', id, 'cpt in procedure' from p_visit where cpt is not null and cpt not in (select cpt from p_procedure)
union all select 'group', cast(id as varchar), 'cpt in procedure' from p_group where cpt is not null and cpt not in (select cpt from p_procedure)
union all select 'visit', concat(cast(client_id as varchar), ',', cast(group_id as varchar)), 'one discharge per group'
  from disch group by client_id, group_id having count(*) > 1""")
add("m18_charge_not_rate", "id m:charge m:group_rate",
    "select * from att where attend_n <> 0 and charge <> group_rate")
add("m19_add_columns", "id name file d:opened",
    "select id, name, cast(null as varchar) file, cast(null as date) opened from p_client")
add("m20_old_clients", "id name d:recent d:cutoff i:is_old", """select c.id, c.name, c.recent, b.cutoff,
  case when c.recent is null or c.recent < b.cutoff then 1 else 0 end is_old
from client c, (select cutoff from p_batch where name = 'current') b""")

# ---- reports -------------------------------------------------------------------------
add("r01_attendance_all", ATT, "select * from att_all")
add("r02_attendance", ATT, "select * from att")
SQL["r03_client_balances"] = SQL["a01_client_balances"]
SQL["r04_group_attendance_trend"] = SQL["a02_attendance_trend"]
SQL["r05_batch_clients"] = SQL["j04_since_cutoff"]
add("r05_client_with_batch", "id name d:recent batch_name",
    "select c.id, c.name, c.recent, b.batch_name from client c left join batch_clients b on b.client_id = c.id")
add("r06_bulk_invoices", "client_id name m:balance d:recent", "select * from bulk")
_DUE = "id name d:recent m:charges m:client_paid m:insurance_paid m:balance client_name"
add("r07_amount_due", _DUE, DUE_ALL)
add("r07_amount_due_by_name", _DUE, DUE_ALL)
_RUNS2 = "i:run_client i:run_group i:start_level i:is_end"
_PAID = "i:attend_n m:charge m:client_paid m:insurance_paid m:due note"
add("r08_attendance_by_client",
    f"id client_id client_name group_id group_name d:session_date {_PAID} m:copay deductible "
    f"i:deductible_met patient_rel officer_name d:discharge_date discharge_status {_RUNS2}", BY_CLIENT)
add("r09_attendance_by_group", f"id group_name client_name d:session_date {_PAID} {_RUNS2}", BY_GROUP)
SQL["r09_group_footers"] = footer(f"group_name i:run_client group_id client_id n_rows {SUMS}", BY_GROUP,
                                  "group_name, run_client, group_id, client_id")
_RUN1 = "i:run_client i:start_level i:is_end"
add("r10_billing_insurance",
    "id client_id client_name carrier_name insurance d:session_date group_name i:attend_n m:charge "
    f"m:client_paid d:bill_date d:check_date m:insurance_paid m:due note {_RUN1}", BY_INSURED)
SQL["r10_client_footers"] = footer(f"client_name client_id i:run_client n_rows {SUMS}", BY_INSURED,
                                   "client_name, client_id, run_client")
add("r11_cwip", "id client_id client_name lawyer_name court_name d:session_date m:charge "
    f"m:client_paid m:due note {_RUN1}", BY_CWIP)
add("r12_dup_clients", "id client_id client_name id_dabble id_zoho added_user officer_name "
    f"group_name d:session_date m:due {_RUNS2}", BY_DUPS)
_RUNG = "i:run_group i:start_level i:is_end"
add("r13_evaluations", "id group_name d:session_date time client_name therapist_name m:charge "
    f"m:client_paid m:insurance_paid m:due note {_RUNG}", BY_EVAL)
add("r14_income_by_therapist", "i:sn_year i:sn_month sn_month_name id short_date d:session_date "
    "gp_name th_id th_name attend_n m:charge m:ins_pd m:client_pd", INCOME)
SQL["r14_therapist_footers"] = footer(
    "i:sn_year i:sn_month th_name i:run_therapist th_id n_rows i:attend_n_sum m:charge_sum "
    "m:ins_pd_sum m:client_pd_sum", BY_INCOME, "sn_year, sn_month, th_name, run_therapist, th_id",
    ["attend_n", "charge", "ins_pd", "client_pd"])
add("r15_ins_summary", "client_name carrier_name details client_id", """
select c.name client_name, k.name carrier_name, case when i.details is null then '*' || c.note else i.details end details,
  c.id client_id from p_insurance i join client c on c.id = i.client_id join p_carrier k on k.id = i.carrier_id
where c.recent >= (select cutoff from p_batch where name = 'current')""")
_SUMS4 = "d:recent m:charges m:client_paid m:insurance_paid m:balance"
add("r16_last_30", f"group_id group_name client_id client_name {_SUMS4} officer_names d:discharge_date discharge_status", f"""
select t.*, c.recent, c.charges, c.client_paid, c.insurance_paid, c.balance,
  case when o2.name is null then o.name else o.name || '/' || o2.name end officer_names,
  d.discharge_date, d.discharge_status
from ({TREATED}) t join client c on c.id = t.client_id left join p_officer o on o.id = c.officer_id
left join p_officer o2 on o2.id = c.officer2_id
left join (select * from disch where discharge_date > {AS_OF} - 30) d on d.group_id = t.group_id and d.client_id = t.client_id""")
add("r16_last_30_blank", f"group_id group_name client_id client_name {_SUMS4} officer_name", f"""
select t.*, c.recent, c.charges, c.client_paid, c.insurance_paid, c.balance, o.name officer_name
from ({TREATED}) t join client c on c.id = t.client_id left join p_officer o on o.id = c.officer_id""")
add("r17_monitoring", "client_name client_id group_name d:session_date i:attend_n m:charge m:client_paid m:due note id", """
select * from att_all where lower(group_name) like '%monitoring%'
and recent >= (select cutoff from p_batch where name = 'current')""")
add("r18_recent_sessions", "id session_id d:session_date m:group_rate group_name time therapist_name "
    "client_name i:attend_n m:charge m:client_paid note i:run_session i:start_level i:is_end", BY_RECENT)
SQL["r18_session_footers"] = footer(
    "d:session_date group_id i:run_session session_id n_rows i:attend_n_sum m:charge_sum m:client_paid_sum",
    BY_RECENT, "session_date, group_id, run_session, session_id", ["attend_n", "charge", "client_paid"])
SQL["r19_reduced_balances"] = SQL["s03_report_lookup"]
add("r20_voucher_clients", "id client_name group_name d:session_date voucher_note i:attend_n m:charge m:due "
    f"{_RUNS2}", BY_VOUCHER)
add("r21_weekly_groups", "id session_day group_name time therapist_name client_name m:charge m:client_paid note "
    "i:run_day i:run_group i:run_session i:start_level i:is_end", BY_WEEKLY)
_FMT = ", ".join(f"format('{{:,.2f}}', cast({c} as double)) {c}" for c in
                 ("charges", "client_paid", "insurance_paid", "balance"))
add("r22_invoice_summary", "client_id name charges client_paid insurance_paid balance d:invoice_date invoice_note",
    f"select id client_id, name, {_FMT}, {AS_OF} invoice_date, invoice_note from client")
_LINES = "d:session_date group_name i:attend_n m:charge m:client_paid m:insurance_paid m:due"
add("r22_invoice_lines", f"client_id id {_LINES}", "select * from att where attend_n <> 0")
add("r23_invoice_batch", "client_id name m:total_charges m:total_client_paid m:total_insurance_paid m:balance "
    f"d:invoice_date invoice_note id {_LINES}", f"""
select c.id client_id, c.name, c.charges total_charges, c.client_paid total_client_paid,
  c.insurance_paid total_insurance_paid, c.balance, {AS_OF} invoice_date, c.invoice_note, a.id, a.session_date,
  a.group_name, a.attend_n, a.charge, a.client_paid, a.insurance_paid, a.due
from client c join bulk b on b.client_id = c.id
left join (select * from att where attend_n <> 0) a on a.client_id = c.id""")
add("r24_visit_list", "d:session_date group_id group_name carrier_name ins_status m:due id client_id session_id "
    "i:attend_n m:charge m:client_paid m:insurance_paid note cpt claim_uid d:bill_date d:check_date discharge_status", """
select a.session_date, a.group_id, a.group_name, a.carrier_name, a.ins_status, a.due, v.*
from p_visit v join att_all a on a.id = v.id""")
add("r25_smoke_detail", "id group_name client_name session i:attend_n m:charge m:client_paid m:insurance_paid m:due m:delta", """
select id, group_name, client_name, strftime(session_date, '%b %d ''%y') as session, attend_n, charge, client_paid,
  insurance_paid, due, due - (charge - client_paid - coalesce(insurance_paid, 0)) delta from smoke""")
SQL["r25_smoke_totals"] = SQL["a04_group_client_totals"]
add("r25_smoke_totals_undated", f"group_id group_name client_id client_name {TOTAL_COLS}", TOTALS)
SQL["r25_smoke_amount_due"] = SQL["a05_amount_due"]
SQL["r26_therapist_sessions"] = SQL["a06_therapist_weight"]
SQL["r26_clients_without_visits"] = SQL["u02_difference"]
add("r26_charge_not_rate", ATT, "select * from att where attend_n <> 0 and charge <> group_rate")
SQL["r26_visits_per_session"] = SQL["a10_scalars"]
SQL["r26_periods"] = SQL["j08_calendar"]
add("r27_three_levels", "i:level group_id group_name client_id client_name visit_id session i:attend_n m:charge "
    "m:client_paid m:insurance_paid m:due", f"""
select 1 as level, id group_id, name group_name, null client_id, null client_name, null visit_id, null as session,
  null attend_n, null charge, null client_paid, null insurance_paid, null due from p_group
union all select 2, group_id, group_name, client_id, client_name, null, null, attend_n, charges, client_paid,
  insurance_paid, due from ({TOTALS})
union all select 3, group_id, group_name, client_id, client_name, id, strftime(session_date, '%b %d ''%y'), attend_n,
  charge, client_paid, insurance_paid, due from smoke""")

# ---- claims, streaming, report fields ------------------------------------------------
add("c01_claim_lines",
    "client_id visit_id d:session_date cpt m:price provider_id patient_name carrier_name carrier_address "
    "carrier_city_st_zip payer_type id_number patient_dob patient_sex insured_name patient_address patient_city "
    "patient_state patient_zip patient_phone patient_rel insured_address insured_city insured_state insured_zip "
    "insured_phone patient_status patient_status2 insured_policy insured_dob insured_sex dx1 dx2 approval account_no "
    "provider_npi tax_id provider_name provider_address provider_city_st_zip", "select * from claim_line")
add("c02_claim_pages", "client_id i:page lines a_visit",
    "select client_id, page, count(*) lines, min(visit_id) a_visit from claim_slot group by 1,2")
add("c04_claim_review", "client_id i:page carrier_name patient_name m:total dx1 dx2 lines", """
select client_id, page, min(carrier_name) carrier_name, min(patient_name) patient_name, sum(price) total,
  min(dx1) dx1, coalesce(min(dx2), '') dx2,
  string_agg(concat('on ', strftime(session_date, '%m/%d/%Y'), ' CPT: ', cpt, ' $', cast(price as varchar)), '; ' order by slot) lines
from claim_slot group by 1,2""")


#: Room for the amounts on the printed claim.
_ROOM = {"charge": 8, "charge_sum": 9, "paid_sum": 8, "balance_sum": 8}


def _line_sql(line) -> str:
    parts, at = [], 1
    for p in line:
        if p.start > at:
            parts.append("'" + " " * (p.start - at) + "'")
        cut = f"substr(coalesce(cast({p.field} as varchar), ''), 1, {p.width})"
        if p.field in _ROOM:
            text, room = f"cast({p.field} as varchar)", _ROOM[p.field]
            cut = (f"case when length({text}) <= {room} then {text} when length(replace({text}, ',', '')) <= {room} "
                   f"then replace({text}, ',', '') else repeat('*', {room}) end")
        if p.align == "center":
            cut = f"repeat(' ', cast(floor(({p.width} - length({cut})) / 2) as int)) || {cut}"
        parts.append(f"{'lpad' if p.align == 'right' else 'rpad'}({cut}, {p.width}, ' ')")
        at = p.start + p.width
    return " || ".join(parts) if parts else "''"


_BOXES = {
    "payer_type": {"x_medicare": "Medicare", "x_medicaid": "Medicaid", "x_champus": "Champus",
                   "x_champva": "ChampVA", "x_group": "Group Health Plan", "x_feca": "FECA",
                   "x_payer_other": "Other"},
    "patient_sex": {"x_male": "M", "x_female": "F"},
    "patient_rel": {"x_self": "SELF", "x_spouse": "SPOUSE", "x_child": "CHILD", "x_rel_other": "OTHER"},
    "patient_status": {"x_single": "Single", "x_married": "Married", "x_status_other": "Other"},
    "patient_status2": {"x_employed": "Employed", "x_full_time": "Full Time Student",
                        "x_part_time": "Part Time Student"},
    "insured_sex": {"x_insured_male": "M", "x_insured_female": "F"},
}
_BOX_SQL = ", ".join(f"case when {f} = '{o}' then 'X' else ' ' end {b}"
                     for f, boxes in _BOXES.items() for b, o in boxes.items())
_PARTY = """
select c.id client_id, c.name patient_name, k.name carrier_name, k.address carrier_address, k.city_st_zip carrier_city_st_zip,
  i.payer_type, i.id_number, c.dob, i.patient_sex, c.address patient_address, c.city patient_city, c.state patient_state,
  c.zip patient_zip, c.phone patient_phone, upper(i.patient_rel) patient_rel,
  case when i.patient_rel='Self' then c.name else i.insured_name end insured_name,
  case when i.patient_rel='Self' then c.address else i.insured_address end insured_address,
  case when i.patient_rel='Self' then c.city else i.insured_city end insured_city,
  case when i.patient_rel='Self' then c.state else i.insured_state end insured_state,
  case when i.patient_rel='Self' then c.zip else i.insured_zip end insured_zip,
  case when i.patient_rel='Self' then c.phone else i.insured_phone end insured_phone,
  case when i.patient_rel='Self' then c.dob else i.insured_dob end insured_dob,
  case when i.patient_rel='Self' then i.patient_sex else i.insured_sex end insured_sex,
  i.patient_status, i.patient_status2, i.insured_policy, i.dx1, i.dx2, i.approval,
  concat(upper(substr(c.name,1,3)), '.', upper(substr(c.name, instr(c.name,',')+2, 3)), '.', cast(c.id as varchar)) account_no
from p_insurance i join p_client c on c.id = i.client_id join p_carrier k on k.id = i.carrier_id"""


def printed_claims() -> str:
    from tallywork.sources.print_layout import FOOTER, HEADING, SERVICE
    h = len(HEADING)
    whole = f"""
select t.client_id, t.claim_uid, t.service_lines n, p.*exclude(client_id), {_BOX_SQL}, '11/15/2001' today,
  'Signature on file' signed, 'X' x, '0 00' no_charge, chr(12) page_break,
  format('{{:,.2f}}', cast(t.charges as double)) charge_sum, format('{{:,.2f}}', cast(t.client_paid as double)) paid_sum,
  format('{{:,.2f}}', cast(t.balance as double)) balance_sum,
  strftime(dob,'%m') dob_m, strftime(dob,'%d') dob_d, strftime(dob,'%Y') dob_y,
  strftime(insured_dob,'%m') insured_dob_m, strftime(insured_dob,'%d') insured_dob_d, strftime(insured_dob,'%Y') insured_dob_y,
  case when instr(patient_phone,' ')>0 then split_part(patient_phone,' ',1) end patient_acode,
  case when instr(patient_phone,' ')>0 then substr(patient_phone, instr(patient_phone,' ')+1) else patient_phone end patient_no,
  case when instr(insured_phone,' ')>0 then split_part(insured_phone,' ',1) end insured_acode,
  case when instr(insured_phone,' ')>0 then substr(insured_phone, instr(insured_phone,' ')+1) else insured_phone end insured_no,
  b.npi provider_npi, b.tax_id, b.name provider_name, b.address provider_address, b.city_st_zip provider_city_st_zip
from print_total t join ({_PARTY}) p on p.client_id = t.client_id
join p_therapist b on b.tax_id is not null"""
    service = """
select *, row_number() over (partition by client_id, claim_uid order by session_date, visit_id, provider_id) k,
  strftime(session_date,'%m') served_m, strftime(session_date,'%d') served_d, strftime(session_date,'%y') served_y,
  '11' place, '1' pointer, '1' units from print_line"""
    parts = [f"select client_id, claim_uid, {i} line_no, {_line_sql(x)} as text from whole"
             for i, x in enumerate(HEADING, 1)]
    parts += [f"select client_id, claim_uid, {h} + 2*k - {1 - i}, {_line_sql(x)} from service"
              for i, x in enumerate(SERVICE)]
    parts += [f"select client_id, claim_uid, {h} + 2*n + {i}, '' from whole where 2*(6-n) >= {i}"
              for i in range(1, 11)]
    parts += [f"select client_id, claim_uid, {h} + 2*n + 2*greatest(6-n, 0) + {i}, {_line_sql(x)} from whole"
              for i, x in enumerate(FOOTER, 1)]
    CTES["whole"], CTES["service"] = whole, service
    return pick("client_id claim_uid i:line_no text", "\nunion all ".join(parts))


SQL["c05_printed_claims"] = printed_claims()
add("c05_unprintable_amounts", "client_id claim_uid field amount", "\nunion all ".join(
    f"select client_id, claim_uid, '{f}' field, cast({f} as varchar) amount "
    f"from {'service' if f == 'charge' else 'whole'} where length(replace(cast({f} as varchar), ',', '')) > {room}"
    for f, room in _ROOM.items()))
add("c06_check_boxes", "client_id " + " ".join(b for boxes in _BOXES.values() for b in boxes),
    f"select client_id, {_BOX_SQL} from ({_PARTY})")
add("c07_stamped_claims", "visit_id claim_uid", STAMPED)
add("e01_report_fields", "id d:today billed m:charge own_text", f"""
select id, {AS_OF} today, case when bill_date is not null then strftime(bill_date, '%m/%d/%y') else '' end billed,
  charge, 'no_such_field' own_text from p_visit""")
SQL["e02_report_variables"] = footer("client_name client_id i:run_client n_rows m:due_sum", BY_CWIP,
                                     "client_name, client_id, run_client", ["due"])
add("t01_streamed_balances", BAL, """
select e.user_id client_id, min(cast(e.ts as date)) oldest_session_date, max(cast(e.ts as date)) recent,
  sum(cast(e.value as decimal(8,2))) charges,
  sum(case when e.event_type = 'purchase' then cast(e.value as decimal(8,2)) else 0 end) client_paid,
  0.00 insurance_paid,
  sum(case when e.event_type = 'purchase' then 0 else cast(e.value as decimal(8,2)) end) balance
from events e
where e.event_type <> 'error' and e.user_id % 13 <> 0
  and cast(e.ts as date) >= date '2024-01-01' + cast(e.user_id % 20 as integer)
  and not exists (select 1 from events d where d.event_type = 'error' and d.event_id = e.event_id + 1)
group by 1""")
