"""The practice's tables derived from a star schema of orders.

Each expression is plain SQL that any engine reads the same way, so a check can
derive the same tables on its own side (see oracle/).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork import schema
from tallywork.practice import Practice

STAR_TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem"]

_SAME_NAME = "(case when c_custkey%20=19 then c_custkey-1 else c_custkey end)"
_CARRIER = ("case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 "
            "when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 else 5 end")
_CHARGE = "cast(l_extendedprice as decimal(8,2))"
_OTHER = "c_custkey%4<>0"

# table -> (from, {column: expression}); the column types are those of the schema
MAPPING: dict[str, tuple[str, dict[str, str]]] = {
    "group": ("{nation}", {
        "id": "n_nationkey",
        "name": "case n_nationkey when 0 then 'CWIP Monday' when 1 then 'Drug Education' "
                "when 2 then 'Substance Abuse Ed I' when 3 then 'Monitoring' "
                "when 4 then 'Financial Crimes Ed' else concat('Group ', n_name) end",
        "rate": "20+5*(n_nationkey%10)",
        "evaluation": "case when n_nationkey%8=5 then 1 else 0 end",
        "cpt": "case n_nationkey%5 when 4 then null when 3 then '99999' when 2 then '' "
               "when 1 then '90806' else '90853' end",
    }),
    "visit": ("{lineitem} join {orders} on l_orderkey=o_orderkey "
              "join {supplier} on l_suppkey=s_suppkey join {group} g on g.id=s_nationkey", {
        "id": "concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string), "
              "cast(l_suppkey as string), cast(l_linenumber as string), "
              "cast(cast(l_shipdate as date) as string))",
        "client_id": "o_custkey",
        "session_id": "cast(l_suppkey as bigint)*100000+year(l_shipdate)*12+month(l_shipdate)-1",
        "attend_n": "case when l_quantity<=5 then 0 else 1 end",
        "charge": _CHARGE,
        "client_paid": f"{_CHARGE}*cast(l_discount as decimal(4,2))",
        "insurance_paid": "case l_returnflag when 'R' then "
                          f"cast({_CHARGE}*cast(0.5 as decimal(2,1)) as decimal(8,2)) "
                          "when 'A' then cast(0 as decimal(8,2)) end",
        "note": "case when l_tax>=0.075 then 'late' end",
        "cpt": "g.cpt",
        "claim_uid": "case when l_linestatus='F' and l_returnflag='N' then "
                     "concat(cast(l_orderkey as string), ',', cast(l_orderkey%97 as string)) end",
        "bill_date": "case when l_returnflag in ('R','A') then cast(l_shipdate as date) + 14 end",
        "check_date": "case when l_returnflag='R' then cast(l_shipdate as date) + 45 end",
        "discharge_status": "case when l_linenumber=7 and l_quantity>48 then 'S' "
                            "when l_linenumber=7 and l_quantity<2 then 'U' end",
    }),
    "session": ("(select distinct year(l_shipdate) y, month(l_shipdate) m, l_suppkey, s_nationkey "
                "from {lineitem} join {supplier} on l_suppkey=s_suppkey) x", {
        "id": "cast(l_suppkey as bigint)*100000+y*12+m-1",
        "session_date": "make_date(cast(y as int), cast(m as int), cast(1+l_suppkey%28 as int))",
        "time": "case l_suppkey%3 when 0 then null else "
                "concat(lpad(cast(8+l_suppkey%10 as string), 2, '0'), ':00') end",
        "group_id": "s_nationkey",
        "therapist_id": "case when l_suppkey%10=9 then null else l_suppkey end",
    }),
    "client": ("{customer}", {
        "id": "c_custkey",
        "name": f"concat('Last', cast({_SAME_NAME} as string), ', First', "
                f"cast({_SAME_NAME}%40 as string))",
        "reduced_fee": "case c_custkey%7 when 0 then '$60 ind/$90 group' when 1 then '' end",
        "note": "case when c_custkey%9=0 then concat('note ', cast(c_custkey as string)) end",
        "address": "concat(cast(c_custkey as string), ' Elm St')",
        "city": "'Springfield'",
        "state": "'KS'",
        "zip": "cast(66000+c_custkey%100 as string)",
        "phone": "concat('913 555', lpad(cast(c_custkey%10000 as string), 4, '0'))",
        "dob": "date '1950-01-01' + cast(c_custkey*7%15000 as int)",
        "officer_id": "case when c_custkey%10=9 then null else c_nationkey end",
        "officer2_id": "case when c_custkey%4=0 then (c_nationkey+7)%25 end",
        "lawyer_id": "case when c_custkey%5=0 then (c_nationkey+3)%25 end",
        "court_id": "case when c_custkey%6=0 then c_nationkey%5 end",
        "insurance": "case c_custkey%13 when 0 then 'old text' when 1 then '' end",
        "invoice_note": "case when c_custkey%8=0 then 'Thank you' end",
        "voucher": "case when c_custkey%11=0 then 1 when c_custkey%11=1 then 0 end",
        "voucher_note": "case when c_custkey%11=0 then 'voucher on file' end",
        "id_zoho": "case when c_custkey%3=0 then concat('z', cast(c_custkey as string)) end",
        "id_dabble": "case when c_custkey%3=1 then concat('d', cast(c_custkey as string)) end",
        "billing_cutoff": "null", "recent": "null", "charges": "null", "client_paid": "null",
        "insurance_paid": "null", "balance": "null", "balance_cached": "null",
    }),
    "therapist": ("{supplier}", {
        "id": "s_suppkey",
        "name": "s_name",
        "weight": "null",
        "npi": "lpad(cast(s_suppkey as string), 10, '0')",
        "tax_id": "case when s_suppkey=0 then '123-00-6789' end",
        "address": "concat(cast(s_suppkey as string), ' Oak Ave')",
        "city_st_zip": "'Springfield, KS 66000'",
    }),
    "insurance": ("(select * from {customer} where c_acctbal>=0) x", {
        "id": "c_custkey",
        "client_id": "c_custkey",
        "carrier_id": _CARRIER,
        "details": "case when c_custkey%3=0 then null else "
                   "concat('details ', cast(c_custkey as string)) end",
        "deductible": "case when c_custkey%2=0 then '500' end",
        "copay": "c_custkey%5*10",
        "deductible_met": "case c_custkey%3 when 0 then 1 when 1 then 0 end",
        "payer_type": "case c_custkey%6 when 0 then 'Medicare' when 1 then 'Medicaid' "
                      "when 2 then 'Other' else 'Group Health Plan' end",
        "id_number": "concat('ID', cast(c_custkey as string))",
        "patient_sex": "case when c_custkey%2=0 then 'M' else 'F' end",
        "patient_rel": "case c_custkey%4 when 0 then 'Self' when 1 then 'Spouse' "
                       "when 2 then 'Child' else 'Other' end",
        "insured_name": f"case when {_OTHER} then "
                        "concat('Insured', cast(c_custkey as string), ', Pat') end",
        "insured_address": f"case when {_OTHER} then '9 Far Rd' end",
        "insured_city": f"case when {_OTHER} then 'Topeka' end",
        "insured_state": f"case when {_OTHER} then 'KS' end",
        "insured_zip": f"case when {_OTHER} then '66600' end",
        "insured_phone": "case when c_custkey%4=1 then '785 5550100' end",
        "patient_status": "case c_custkey%3 when 0 then 'Single' when 1 then 'Married' "
                          "else 'Other' end",
        "patient_status2": "case c_custkey%4 when 0 then 'Employed' when 1 then "
                           "'Full Time Student' when 2 then 'Part Time Student' end",
        "insured_policy": "case when c_custkey%5=0 then concat('P', cast(c_custkey as string)) end",
        "insured_dob": f"case when {_OTHER} then date '1945-01-01' + cast(c_custkey%9000 as int) end",
        "insured_sex": f"case when {_OTHER} then 'F' end",
        "dx1": "case when c_custkey%2=0 then '305.00' else '309.28' end",
        "dx2": "case when c_custkey%5=0 then '300.02' end",
        "approval": "case when c_custkey%10=0 then 'A1' end",
    }),
    "carrier": ("(select distinct c_mktsegment from {customer}) x", {
        "id": _CARRIER,
        "name": "concat('Carrier ', c_mktsegment)",
        "address": "concat('PO Box ', cast(length(c_mktsegment) as string))",
        "city_st_zip": "'Springfield, KS 66000'",
    }),
    "procedure": ("(select 1 k union all select 2 union all select 3) x", {
        "cpt": "case k when 1 then '90806' when 2 then '90853' else '90801' end",
        "name": "case k when 1 then 'Individual' when 2 then 'Group' else 'Evaluation' end",
        "price": "case k when 1 then 120.00 when 2 then 80.00 else 200.00 end",
    }),
    "diagnosis": ("(select 1 k union all select 2 union all select 3) x", {
        "icd9": "case k when 1 then '305.00' when 2 then '309.28' else '300.02' end",
        "name": "case k when 3 then null else concat('Dx ', cast(k as string)) end",
    }),
    "officer": ("{nation}", {
        "id": "n_nationkey",
        "name": "concat('Officer ', n_name)",
        "email": "case when n_nationkey%10=9 then null else "
                 "concat('o', cast(n_nationkey as string), '@example.org') end",
        "office_id": "n_regionkey",
    }),
    "office": ("{region}", {
        "id": "r_regionkey",
        "name": "concat('Office ', r_name)",
        "address": "concat(cast(100+r_regionkey as string), ' Main St')",
        "fax": "case when r_regionkey=4 then null else "
               "concat('555-010', cast(r_regionkey as string)) end",
    }),
    "batch": ("(select 1 k union all select 2) x", {
        "name": "case k when 1 then 'current' else 'income' end",
        "cutoff": "case k when 1 then date '2001-06-01' else date '2001-01-01' end",
        "invoice_threshold": "case k when 1 then cast(1700000 as decimal(12,2)) end",
    }),
}


def derivation(table: str) -> str:
    """``select`` text of one practice table; ``{name}`` stands for each table it reads."""
    source, columns = MAPPING[table]
    types = schema.types(table)
    picked = ",\n  ".join(f"cast({e} as {types[c]}) as {c}" for c, e in columns.items())
    return f"select {picked}\nfrom {source}"


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_star(spark: SparkSession, folder: str) -> Practice:
    """The practice over a folder of star-schema Parquet files. Lazy: nothing runs."""
    inputs = {name: star_table(spark, folder, name) for name in STAR_TABLES}
    # only its day is read, which takes fewer bytes in a shuffle than the time
    inputs["lineitem"] = inputs["lineitem"].withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    tables: dict[str, DataFrame] = {}
    for name in MAPPING:  # in order: a table comes after those it is built on
        text = derivation(name)
        used = {t: df for t, df in {**inputs, **tables}.items() if f"{{{t}}}" in text}
        tables[name] = spark.sql(text, **used)
    return Practice(tables)


def visits_of(events: DataFrame) -> DataFrame:
    """Events seen as visits: all but those of type ``error``, which take a visit back."""
    charge = F.col("value").cast("decimal(8,2)")
    none = F.lit(0).cast("decimal(8,2)")
    return events.where("event_type <> 'error'").select(
        F.col("event_id").alias("visit_id"),
        F.col("user_id").alias("client_id"),
        F.to_date("ts").alias("session_date"),
        charge.alias("charge"),
        F.when(F.col("event_type") == "purchase", charge).otherwise(none).alias("client_paid"),
        none.alias("insurance_paid"))


def change_rows(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Events as changes: visits being entered (``op`` +1), and for each event of type ``error`` the visit of
    the event before it being deleted (-1), with that visit's client, day and money from ``visits``.
    Where the event before is no visit, nothing is deleted."""
    gone = events.where("event_type = 'error'").select((F.col("event_id") - 1).alias("visit_id"))
    return (visits_of(events).withColumn("op", F.lit(1))
            .unionByName(gone.join(visits, "visit_id").withColumn("op", F.lit(-1)))
            .drop("visit_id"))
