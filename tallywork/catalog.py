"""Every operator as a named query over a folder of star-schema tables."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork import schema
from tallywork.functions import billing, dates, forms, report_fields
from tallywork.operators import breaks
from tallywork.operators.joins import join_every, left_first_wins, lower_names, only_keys, without_keys
from tallywork.plans import claims, form_import, lookups, quality, reports, upkeep, views
from tallywork.practice import Practice
from tallywork.session import shared_dir, tune
from tallywork.sources import files, form_cells, pages, print_layout, star, tables
from tallywork.streaming import balances as stream

AS_OF = datetime.date(2001, 11, 15)
DORMANT_BEFORE = datetime.date(2001, 3, 1)
AT = datetime.datetime(2001, 11, 15)


class Case:
    """What a query may use: the practice over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    @cached_property
    def raw(self) -> Practice:
        """Tables as entered: no balances cached yet."""
        return star.from_star(self.spark, self.folder)

    @cached_property
    def db(self) -> Practice:
        return upkeep.with_balances(self.raw, DORMANT_BEFORE, AT)

    def table(self, name: str) -> DataFrame:
        return star.star_table(self.spark, self.folder, name)

    def scratch(self, name: str) -> str:
        """A new folder in shared storage."""
        return f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    @cached_property
    def attendance_all(self) -> DataFrame:
        return views.attendance_all(self.db)

    @cached_property
    def records(self) -> DataFrame:
        return form_cells.read_forms(form_cells.cells_from_clients(self.raw))

    @cached_property
    def policies(self) -> DataFrame:
        return form_import.policies_on_forms(self.records)

    @cached_property
    def accepted(self) -> DataFrame:
        return form_import.accepted(self.raw, self.policies)

    @cached_property
    def open_visits(self) -> DataFrame:
        return self.raw.visit.where("bill_date is null and check_date is null").select("id")

    @cached_property
    def sent(self) -> DataFrame:
        return claims.sent_claims(self.raw, None)

    @cached_property
    def result_pages(self) -> DataFrame:
        names = claims.claim_parties(self.raw).select("client_id", "account_no")
        return pages.render_results(self.sent, names)

    @cached_property
    def batches(self) -> DataFrame:
        return pages.extract_batches(pages.render_batches(self.sent), ["year"])

    @cached_property
    def results(self) -> DataFrame:
        return pages.extract_claim_rows(self.result_pages, ["upload_no", "page_no"])


def plain(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: amounts as double, numbers as bigint, dates and
    times as text."""
    def cast(f: T.StructField) -> F.Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[cast(f) for f in df.schema.fields])


QUERIES: dict[str, Callable[[Case], DataFrame]] = {}


def query(name: str):
    def keep(build: Callable[[Case], DataFrame]):
        QUERIES[name] = build
        return build
    return keep


def _add(**builders: Callable[[Case], DataFrame]) -> None:
    QUERIES.update(builders)


def _report(name: str) -> Callable[[Case], DataFrame]:
    return lambda c: reports.report(c.db, name, AS_OF)


def _broken(name: str, *keep: str, raw: bool = False) -> Callable[[Case], DataFrame]:
    """A report's rows with its control breaks. ``raw``: nothing in it depends on balances, so none are made."""
    return lambda c: reports.report_with_breaks(
        c.raw if raw else c.db, name, AS_OF, keep=keep or None)


# ---- sources and sinks ---------------------------------------------------------------

_add(
    s01_read_table=lambda c: c.raw.visit,
    s02_view_query=lambda c: c.spark.sql(
        "select b.batch_name, count(*) as clients, cast(sum(cb.balance) as decimal(18,2)) as balance "
        "from {batch_clients} b join {client_balances} cb on cb.client_id = b.client_id "
        "group by b.batch_name",
        batch_clients=views.view(c.db, "batch_clients", AS_OF),
        client_balances=views.view(c.db, "client_balances", AS_OF)),
    s03_report_lookup=_report("reduced_balances"),
    s06_form_records=lambda c: c.records,
    s07_extract_links=lambda c: pages.extract_links(c.table("pages")),
    s08_claim_rows=lambda c: c.results.drop("page_no", "pos"),
    s07_batch_list=lambda c: c.batches,
    s11_lookup_lines=lambda c: files.lookup_lines(
        c.raw.client, F.col("name"), F.col("note"), F.col("id")),
)


def safe_name(column: str) -> str:
    return "f_" + re.sub(r"\W+", "_", column)


@query("s04_claims_csv")
def _claims_csv(c: Case) -> DataFrame:
    out = c.scratch("claims-csv")
    files.write_claims_csv(claims.claim_file(c.raw, c.open_visits, AS_OF), out)
    fields = T.StructType([T.StructField(n, T.StringType()) for n in claims.CLAIM_COLUMNS])
    back = c.spark.read.schema(fields).csv(out, header=True, nullValue="", emptyValue="")
    return back.toDF(*[safe_name(n) for n in back.columns])


@query("s09_flatten_claims")
def _flat_claims(c: Case) -> DataFrame:
    flat = pages.flatten_claims(pages.newer_batches(c.batches, F.lit(0)), c.results)
    out = c.scratch("flat-claims")
    files.write_flat_claims(flat, out)
    return c.spark.read.schema(flat.schema).csv(out, header=True, nullValue="", emptyValue="")


@query("s10_fixed_width_lines")
def _balance_lines(c: Case) -> DataFrame:
    P = print_layout.Piece
    layout = [[P(1, 20, "name"), P(23, 14, "balance", "right", amount=True), P(40, 12, "state", "center")]]
    df = c.db.client.select("id", "name", billing.money_commas(F.col("balance")).alias("balance"),
                            F.when(F.col("voucher") == 1, "voucher").alias("state"))
    out = c.scratch("lines")
    print_layout.write_lines(print_layout.lines(df, ["id"], layout, F.lit(1)),
                             ["id", "line_no"], out)
    return c.spark.read.text(out).select(F.col("value").alias("text"))


@query("s12_lookups")
def _lookups(c: Case) -> DataFrame:
    db = c.db.replaced(therapist=upkeep.set_therapist_weight(c.db))
    all_lists = None
    for name in lookups.LOOKUPS:
        one = lookups.LOOKUPS[name][0](db).select(F.lit(name).alias("list"), "id", "label")
        all_lists = one if all_lists is None else all_lists.unionByName(one)
    return all_lists


# ---- projections and filters ---------------------------------------------------------

_add(
    p01_projection=lambda c: c.raw.visit.select(
        "id", "charge", F.col("client_id").alias("client"), F.lit("11").alias("place"),
        F.lit(1).alias("units")),
    p02_first_wins=lambda c: left_first_wins(
        c.db.client, c.db.insurance, "id", "client_id").select(
        "id", "name", "insured_name", "dx1", "payer_type"),
    p03_lower_names=lambda c: lower_names(c.raw.client.select(
        F.col("id").alias("Client_ID"), F.col("name").alias("Client_Name"))),
    p04_due=lambda c: c.raw.visit.select("id", billing.due(
        F.col("charge"), F.col("client_paid"), F.col("insurance_paid")).alias("due")),
    p05_billing_status=lambda c: c.attendance_all.groupBy("ins_status").agg(
        F.count(F.lit(1)).alias("n")),
    p06_insured_party=lambda c: claims.claim_parties(c.raw).select(
        "client_id", "patient_rel", "insured_name", "insured_address", "insured_city",
        "insured_state", "insured_zip", "insured_phone", "insured_dob", "insured_sex"),
    p07_default_when_null=lambda c: c.raw.session.select(
        "id", F.coalesce("time", F.lit("time?")).alias("time")),
    p08_both_names=lambda c: _officer_pairs(c.raw),
    p09_printed_columns=lambda c: report_fields.printed_columns(
        c.raw.visit, [("id", 18), ("charge", 6), ("bill_date", 10), ("note", 3)]),
    f01_since_cutoff=lambda c: c.attendance_all.where("session_date >= billing_cutoff").select(
        "id", "session_date", "billing_cutoff"),
    f02_scalar_bound=lambda c: c.db.client.where(
        F.col("recent") >= views.batch_value(c.db, "current")).select("id", "recent"),
    f03_last_days=lambda c: c.raw.session.where(
        dates.within_days(F.col("session_date"), AS_OF, 30)),
    f04_days_old=lambda c: c.raw.session.select(
        "id", dates.at_most_days_old(F.col("session_date"), AS_OF, 10).alias("ten_days"),
        dates.younger_than_days(F.col("session_date"), AS_OF, 4 * 365).alias("four_years")),
    f05_any_case_like=lambda c: c.raw.group.select(
        "id", F.col("name").ilike("%monitoring%").alias("monitoring"),
        (~F.col("name").ilike("substance abuse ED%")).alias("no_course"),
        F.col("name").ilike("cwip%").alias("cwip")),
    f06_null_tests=lambda c: c.raw.visit.where(
        F.col("bill_date").isNull() & F.col("claim_uid").isNotNull()).select("id", "claim_uid"),
    f07_has_text=lambda c: c.raw.client.where(
        billing.has_text(F.col("reduced_fee"))).select("id", "reduced_fee"),
    f08_id_in_list=lambda c: only_keys(c.raw.visit, "id", c.open_visits).select("id", "client_id"),
    f09_flags=lambda c: c.raw.client.where("voucher > 0").select("id", "voucher").unionByName(
        c.raw.group.where("evaluation = 1").select("id", F.col("evaluation").alias("voucher"))),
    f10_facets=lambda c: lookups.facet_values(
        reports.visit_list(c.db, AS_OF), "carrier_name").withColumn("facet", F.lit("carrier"))
        .unionByName(lookups.facet_values(views.client_with_batch(c.db), "batch_name")
                     .withColumn("facet", F.lit("batch")))
        .unionByName(lookups.facet_values(
            lookups.facet(reports.visit_list(c.db, AS_OF), "ins_status", "no CPT"), "group_name")
            .withColumn("facet", F.lit("group of no CPT"))),
    f11_other_tables_threshold=lambda c: views.bulk_invoices(c.db).select("client_id", "balance"),
    f12_either=lambda c: c.attendance_all.where(
        billing.has_text(F.col("insurance")) | billing.has_text(F.col("carrier_name"))).select(
        "id", "insurance", "carrier_name"),
)


def _officer_pairs(db: Practice) -> DataFrame:
    o = db.officer.select(F.col("id").alias("officer_id"), F.col("name").alias("one"))
    o2 = db.officer.select(F.col("id").alias("officer2_id"), F.col("name").alias("two"))
    return (db.client.join(o, "officer_id", "left").join(o2, "officer2_id", "left")
            .select("id", billing.both_names(F.col("one"), F.col("two")).alias("officer_names")))


# ---- joins ---------------------------------------------------------------------------

@query("j03_role_dimension")
def _roles(c: Case) -> DataFrame:
    db = c.raw
    df = db.client.select("id", "officer_id", "officer2_id", "lawyer_id", "court_id")
    for role, key in (("officer", "officer_id"), ("officer2", "officer2_id"),
                      ("lawyer", "lawyer_id")):
        df = df.join(db.officer.select(F.col("id").alias(key), F.col("name").alias(role)),
                     key, "left")
    court = db.office.select(F.col("id").alias("court_id"), F.col("name").alias("court"))
    return df.join(court, "court_id", "left").select("id", "officer", "officer2", "lawyer", "court")


@query("j12_related_rows")
def _related(c: Case) -> DataFrame:
    """How many related rows each record has, for every declared relation. Visits, sessions and clients with
    their balances are written once, so no relation derives them anew."""
    def kept(df: DataFrame, name: str) -> DataFrame:
        place = c.scratch(f"related-{name}")
        df.write.option("compression", "zstd").parquet(place)
        return c.spark.read.schema(df.schema).parquet(place)

    raw = c.raw.replaced(**{t: kept(c.raw[t], t) for t in ("visit", "session")})
    client = kept(upkeep.with_balances(raw, DORMANT_BEFORE, AT).client, "client")
    return lookups.related_counts(raw.replaced(client=client), AS_OF, kept)


_add(
    j01_inner_chain=lambda c: reports._smoke(c.db).select(
        "id", "group_name", "client_name", "session_date"),
    j02_left_chain=lambda c: c.attendance_all.select(
        "id", "officer_name", "policy_id", "carrier_name"),
    j04_since_cutoff=lambda c: views.batch_clients(c.db),
    j05_every_provider=lambda c: join_every(
        c.raw.visit.select("id"), claims.billing_providers(c.raw), "id").select(
        "id", "provider_id", "tax_id"),
    j06_derived_table=lambda c: c.raw.session.join(
        upkeep.therapist_sessions(c.raw).withColumnRenamed("id", "therapist_id"),
        "therapist_id").select("id", "name", "weight"),
    j07_two_keys=lambda c: reports._smoke(c.db).select("id", "group_id", "client_id").join(
        reports.discharges(c.db), ["group_id", "client_id"], "left").select(
        "id", "discharge_date", F.col("discharge_status").alias("status")),
    j08_calendar=lambda c: reports.periods(c.raw, AS_OF),
    j09_never_absent=lambda c: without_keys(c.raw.client, "id", c.raw.visit.where(
        "attend_n = 0").select("client_id")).select("id", "name"),
    j10_only_invoiced=lambda c: only_keys(
        c.db.client, "id", views.bulk_invoices(c.db).select("client_id")).select("id", "balance"),
    j11_clients_of_batches=lambda c: lookups.clients_of_batches(c.db),
    j13_paired_by_position=lambda c: claims.paired(c.sent, c.results).select(
        "upload_no", "position", "client_id", "page", "trace_no"),
    j14_cells_to_fields=lambda c: form_cells.cells_from_clients(c.raw).join(
        form_cells.cell_table(c.spark), ["row", "col"]).groupBy("name", "field").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum((F.col("value") != "").cast("int")).alias("filled")),
)


# ---- aggregations --------------------------------------------------------------------

def _footer(name: str, level: str, scope: str, *keep: str) -> Callable[[Case], DataFrame]:
    def build(c: Case) -> DataFrame:
        df = reports.report_footers(c.db, name, AS_OF, level, scope)
        return df.select(*keep) if keep else df
    return build


_add(
    a01_client_balances=lambda c: views.client_balances(c.db),
    a02_attendance_trend=lambda c: views.group_attendance_trend(c.db, AS_OF),
    a03_income=lambda c: reports.income_by_therapist(c.raw, AS_OF).groupBy("sn_year", "th_name").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("attend_n").alias("attend_n"),
        billing.total(F.col("charge")).alias("charge")),
    a04_group_client_totals=_report("smoke_totals"),
    a05_amount_due=_report("smoke_amount_due"),
    a06_therapist_weight=lambda c: upkeep.therapist_sessions(c.raw),
    a07_duplicate_names=lambda c: upkeep.duplicate_names(c.raw),
    a08_grouped_distinct=lambda c: reports._treated_lately(c.db, AS_OF),
    a09_distinct=lambda c: c.attendance_all.select("group_id", "carrier_name", "ins_status").distinct(),
    a10_scalars=_report("visits_per_session"),
    a11_break_sums_any=_footer("attendance_by_client", "client", "any"),
    a12_break_sums_level=_footer("attendance_by_client", "client", "level"),
    a13_claim_totals=lambda c: claims.claim_pages(c.raw, None).select(
        "client_id", "page", F.size("items").alias("n"), "total"),
    a14_printed_totals=lambda c: claims.printed_claim_totals(c.raw).drop("provider_id"),
    a15_rollup=_report("group_client_rollup"),
    a16_null_as_zero=lambda c: c.raw.visit.groupBy("cpt").agg(
        billing.total(billing.zero_if_null(F.col("insurance_paid"))).alias("insurance_paid"),
        F.count("insurance_paid").alias("entered")),
    a17_check_sum=lambda c: reports.stored_due_differences(c.db.replaced(
        client=c.db.client.withColumn("balance", F.when(
            F.col("id") % 50 == 0, F.col("balance") + 1).otherwise(F.col("balance")))), AS_OF),
)

# ---- control breaks, order -----------------------------------------------------------

_add(
    w01_break_runs=_broken("attendance_by_group", "id"),
    w02_start_levels=lambda c: _broken("weekly_groups", "id")(c).groupBy(
        "start_level", "is_end").agg(F.count(F.lit(1)).alias("n")),
    w03_group_ends=lambda c: _broken("billing_insurance", "id")(c).where("is_end").select("id"),
    w04_pages_of_six=lambda c: claims.paged_lines(c.raw, None).select(
        "client_id", "visit_id", "page", "slot"),
    w05_parity=lambda c: breaks.with_parity(
        reports.report(c.db, "billing_insurance", AS_OF), reports.BREAKS["billing_insurance"], keep=["id"]),
    w06_newest_batch=lambda c: pages.newest_batch(
        c.results.select(F.col("batch").alias("batch_no"))).withColumn("kind", F.lit("newest"))
        .unionByName(pages.newer_batches(
            c.results.select(F.col("batch").alias("batch_no")).distinct(), F.lit(200010))
            .withColumn("kind", F.lit("newer"))),
    o01_mixed_order=lambda c: reports.printed_report(c.db, "income_by_therapist", AS_OF).select(
        "id", "sn_year", "sn_month", "th_name"),
    o02_by_aggregate=lambda c: views.group_attendance_trend(c.db, AS_OF).orderBy(
        F.desc("year"), F.desc("quarter"), "group_id").select("year", "quarter", "visits"),
    o03_order_at_the_sink=lambda c: views.bulk_invoices(c.db).orderBy(
        F.desc("balance"), "client_id").select("client_id", "balance"),
    o04_frequent_first=lambda c: lookups.lookup(
        c.raw.replaced(therapist=upkeep.set_therapist_weight(c.raw)), "therapists"),
    o05_default_order=lambda c: lookups.default_order("session", c.raw.session).select(
        "id", "session_date"),
    o06_first_match=lambda c: c.raw.client.groupBy(
        billing.text_key(F.col("name")).alias("name_key")).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("matches")),
    o07_order_with_key=lambda c: reports.printed_report(c.db, "amount_due_by_name", AS_OF).select(
        "id", "client_name"),
    u01_union_of_months=lambda c: reports.periods(c.raw, AS_OF).select("year", "half").unionByName(
        c.raw.session.select(F.year("session_date").alias("year"),
                             F.lit(0).alias("half")).distinct()),
    u02_difference=_report("clients_without_visits"),
    u03_insert_absent=lambda c: upkeep.insert_absent(
        c.raw.carrier.select("name", "address"), "name",
        c.accepted.select(F.col("payer_name").alias("name"),
                          F.col("payer_address").alias("address")).distinct()),
)

# ---- scalar functions ----------------------------------------------------------------

_add(
    x01_date_parts=lambda c: c.raw.session.select(
        "id", F.year(F.col("session_date")).alias("y"), F.month(F.col("session_date")).alias("m"), dates.month_name(F.col("session_date")).alias("name")),
    x02_sunday_week=lambda c: c.raw.session.select("id", dates.sunday_week(F.col("session_date")).alias("week")),
    x03_quarter_block=lambda c: c.raw.session.select("id", dates.quarter_block(F.col("session_date")).alias("block")),
    x04_day_arithmetic=lambda c: c.raw.session.select(
        "id", F.datediff(dates.day(AS_OF), F.col("session_date")).alias("age"),
        F.date_sub(F.col("session_date"), 30).alias("before")),
    x05_date_format=lambda c: c.raw.session.select(
        "id", *[dates.formatted(F.col("session_date"), p).alias(n) for n, p in
                (("a", "%b %d '%y"), ("b", "%m/%d/%Y"), ("c", "%b %d"), ("d", "%W, %M %d, %Y"))]),
    x06_parse_date=lambda c: c.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client"),
        dates.parsed(F.concat_ws("/", (F.col("o_orderkey") % 14).cast("string"),
                                 (F.col("o_custkey") % 31).cast("string"), F.lit("2001")),
                     "%m/%d/%Y").alias("day")),
    x07_report_dates=lambda c: c.raw.visit.select(
        "id", *[report_fields.report_functions(AS_OF)["format"](
            report_fields.as_date(F.col("bill_date")), p).alias(n) for n, p in
            (("a", "!@%e %b %Y"), ("b", "!@%e %b%y"), ("c", "!@%m/%d/%y"))]),
    x08_concat=lambda c: c.raw.session.select(
        "id", F.concat("time", F.lit("-"), F.col("therapist_id").cast("string")).alias("strict"),
        F.concat_ws(": ", "time", F.col("therapist_id").cast("string")).alias("lenient")),
    x09_account_no=lambda c: c.raw.client.select(
        "id", billing.account_no(F.col("name"), F.col("id")).alias("account_no"),
        billing.account_no(F.col("city"), F.col("id")).alias("without_comma")),
    x10_form_feed=lambda c: c.raw.office.select("id", F.concat("name", F.lit("\f")).alias("page")),
    x11_greatest=lambda c: c.raw.visit.select(
        "id", dates.greatest_or_null(F.col("bill_date"), F.col("check_date")).alias("last")),
    x12_cases=lambda c: left_first_wins(c.raw.client, c.raw.insurance, "id", "client_id").select(
        "id", _met(F.col("deductible_met")).alias("met")),
    x13_money=lambda c: c.db.client.select(
        "id", billing.money_commas(F.col("balance")).alias("commas"),
        billing.money_plain(F.col("balance")).alias("plain"),
        billing.money_dollar(F.col("balance")).alias("dollar")),
    x14_trace_and_batch=lambda c: c.raw.visit.where("claim_uid is not null").select(
        "id", *[x.alias(n) for x, n in zip(billing.trace_and_batch(
            F.when(F.col("attend_n") == 0, F.split("claim_uid", ",")[0])
             .otherwise(F.col("claim_uid"))), ("trace_no", "batch_no"))]),
    x15_two_digit_year=lambda c: c.records.select(
        "form_id", dates.two_digit_year_date(F.col("dob_y"), F.col("dob_m"), F.col("dob_d")).alias("dob")),
    x16_zip=lambda c: c.records.select("form_id", forms.zip_text(F.col("insured_zip")).alias("zip")),
    x17_phone=lambda c: c.records.select("form_id", forms.phone_text(
        F.col("patient_acode"), F.col("patient_no")).alias("phone")),
    x18_diagnosis=lambda c: c.records.select("form_id", forms.diagnosis_code(
        F.col("dx1"), F.col("dx1_detail")).alias("dx1")),
    x19_checked_option=lambda c: c.policies.select(
        "form_id", "payer_type", "patient_sex", "patient_rel", "patient_status", "patient_status2"),
    x20_field_number=lambda c: form_cells.cells_from_clients(c.raw).join(
        form_cells.cell_table(c.spark), ["row", "col"]).groupBy(
        forms.field_number(F.col("field")).alias("number")).agg(F.count(F.lit(1)).alias("cells")),
    x21_cell_position=lambda c: c.table("lineitem").select(
        "l_linenumber", "l_suppkey",
        *[x.alias(n) for x, n in zip(forms.cell_position(
            F.col("l_linenumber"), F.col("l_suppkey") % 79 + 1), ("row", "col"))]).groupBy(
        "row", "col").agg(F.count(F.lit(1)).alias("n")),
    x22_id_or_empty=lambda c: c.raw.client.select(
        "id", F.coalesce("id_dabble", F.lit("")).alias("dabble"),
        F.coalesce("id_zoho", F.lit("")).alias("zoho")),
    x23_session_title=lambda c: c.raw.session.join(
        c.raw.group.select(F.col("id").alias("group_id"), F.col("name").alias("g")), "group_id").select(
        "id", dates.session_title(F.col("g"), F.col("session_date"), F.col("time")).alias("title")),
)


def _met(flag: F.Column) -> F.Column:
    iif = report_fields.report_functions(AS_OF)["iif"]
    return iif(flag == 1, F.lit("[Y]"), iif(flag == 0, F.lit("[n]"), F.lit("")))


# ---- upkeep --------------------------------------------------------------------------

_CLIENT = ["id", "recent", "billing_cutoff", "charges", "client_paid", "insurance_paid",
           "balance", "balance_cached"]


def _reset(c: Case) -> Practice:
    return c.raw.replaced(client=upkeep.reset_balances(c.raw))


def _marked(c: Case) -> Practice:
    db = _reset(c)
    return db.replaced(client=upkeep.mark_dormant(db, DORMANT_BEFORE))


def _entered(c: Case) -> DataFrame:
    """Orders seen as further visits, one per order."""
    return c.table("orders").select(F.col("o_custkey").alias("client_id"),
                                    F.to_date("o_orderdate").alias("session_date"))


def _given(c: Case) -> DataFrame:
    return c.raw.visit.withColumns({
        "attend_n": F.when(F.col("attend_n") == 0, 0).cast("int"),
        "charge": F.when(F.col("charge") > 50000, F.col("charge")),
        "cpt": F.when(F.col("note").isNotNull(), F.lit("90801"))})


def _duplicates(c: Case) -> Practice:
    names = upkeep.duplicate_names(c.db).select(billing.text_key(F.col("name")).alias("_n"))
    chosen = c.db.client.join(names, billing.text_key(F.col("name")) == F.col("_n"),
                              "left_semi").select("id")
    return upkeep.merge_clients(c.db, chosen)


def _sizes(db: Practice, *names: str) -> DataFrame:
    parts = None
    for n in names:
        key = F.max(F.col(schema.KEYS[n]).cast("string")).alias("last_key")
        one = db[n].agg(F.count(F.lit(1)).alias("n"), key).select(
            F.lit(n).alias("table_name"), "n", "last_key")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _procedures(c: Case) -> tuple[Practice, str, DataFrame]:
    """All procedures are to go, among them some that nothing uses."""
    unused = c.raw.procedure.limit(0).unionByName(c.spark.createDataFrame(
        [("00000",), ("00001",)], "cpt string"), allowMissingColumns=True).select(*[
            F.col(f.name).cast(f.dataType) for f in c.raw.procedure.schema.fields])
    db = c.raw.replaced(procedure=c.raw.procedure.unionByName(unused))
    return db, "procedure", db.procedure.select("cpt")


def _old_groups(c: Case) -> Practice:
    gone = c.raw.group.where("evaluation = 1").select("id")
    return upkeep.delete_rows(c.raw, "group", gone)


_add(
    m01_group_cpt=lambda c: upkeep.set_group_cpt(c.raw.replaced(
        visit=c.raw.visit.withColumn("cpt", F.lit("old")))).select("id", "cpt"),
    m02_reset_balances=lambda c: _reset(c).client.select(*_CLIENT),
    m03_mark_dormant=lambda c: _marked(c).client.select(*_CLIENT),
    m04a_refresh_with_visits=lambda c: upkeep.refresh_balances(_marked(c), AT, False).select(*_CLIENT),
    m04b_refresh_everybody=lambda c: upkeep.refresh_balances(c.db, AT, True).select(*_CLIENT),
    m05_therapist_weight=lambda c: upkeep.set_therapist_weight(c.raw).select("id", "name", "weight"),
    m06_merge_clients=lambda c: _duplicates(c).visit.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("visits"), billing.total(F.col("charge")).alias("charges")),
    m06_merged_tables=lambda c: _sizes(_duplicates(c), "client", "insurance", "visit"),
    m07_stamp_claims=lambda c: claims.stamped_visits(c.raw, c.sent, c.results).select(
        "id", "claim_uid"),
    m08_visits_entered=lambda c: upkeep.visits_entered(c.db, _entered(c)).select(
        "id", "recent", "billing_cutoff"),
    m09_set_batch=lambda c: views.batch_clients(c.db.replaced(batch=upkeep.set_batch(
        c.db.batch, "current", datetime.date(2001, 9, 1), "1800000"))).groupBy(
        "batch_name", "invoice_threshold").agg(F.count(F.lit(1)).alias("clients")),
    m10_add_carriers=lambda c: form_import.add_carriers(c.raw, c.accepted),
    m11_add_diagnoses=lambda c: form_import.add_diagnoses(c.raw, c.accepted),
    m12_form_outcomes=lambda c: form_import.outcomes(c.raw, c.policies),
    m12_add_policies=lambda c: form_import.add_policies(
        c.raw, c.accepted, form_import.add_carriers(c.raw, c.accepted)).select(
        "id", "client_id", "carrier_id", "payer_type", "id_number", "insured_dob", "dx1", "dx2"),
    m13_update_clients=lambda c: form_import.update_clients(c.raw, c.accepted).select(
        "id", "name", "dob", "address", "city", "state", "zip", "phone"),
    m14_visit_defaults=lambda c: upkeep.new_visit_defaults(_given(c), c.raw).select(
        "id", "attend_n", "charge", "cpt"),
    m15_audit_columns=lambda c: upkeep.stamp_updated(
        upkeep.stamp_inserted(c.raw.officer, "ann", AT), F.col("email").isNull(), "bob",
        datetime.datetime(2001, 11, 16)),
    m16_cascading_delete=lambda c: _old_groups(c).visit.select("id", "session_id"),
    m16_remaining_rows=lambda c: _sizes(
        upkeep.delete_rows(c.raw, "office", c.raw.office.where("fax is null").select("id")),
        "office", "officer", "client").unionByName(_sizes(_old_groups(c), "group", "session")),
    m16_set_null=lambda c: upkeep.delete_rows(
        c.raw, "therapist", c.raw.therapist.where("id % 3 = 0").select("id")).session.select(
        "id", "therapist_id"),
    m16_refused=lambda c: upkeep.refused_deletes(*_procedures(c)),
    m16_after_refusals=lambda c: _sizes(upkeep.delete_rows(*_procedures(c)), "procedure", "visit", "group"),
    m17_violations=lambda c: quality.violations(c.raw),
    m18_charge_not_rate=lambda c: reports.charge_not_rate(c.db, AS_OF).select(
        "id", "charge", "group_rate"),
    m19_add_columns=lambda c: upkeep.add_columns(
        c.raw.client.select("id", "name"), {"name": "string", "file": "string", "opened": "date"}),
    m20_old_clients=lambda c: upkeep.before_current_cutoff(c.db),
)

# ---- reports -------------------------------------------------------------------------

_CLIENT_COLUMNS = ["id", "name", "recent", "charges", "client_paid", "insurance_paid",
                   "balance", "client_name"]

_add(
    r01_attendance_all=lambda c: c.attendance_all,
    r02_attendance=lambda c: views.attendance(c.db),
    r03_client_balances=lambda c: views.client_balances(c.db),
    r04_group_attendance_trend=_report("group_attendance_trend"),
    r05_batch_clients=lambda c: views.batch_clients(c.db),
    r05_client_with_batch=lambda c: views.client_with_batch(c.db).select(
        "id", "name", "recent", "batch_name"),
    r06_bulk_invoices=lambda c: views.bulk_invoices(c.db),
    r07_amount_due=lambda c: reports.printed_report(c.db, "amount_due", AS_OF).select(*_CLIENT_COLUMNS),
    r07_amount_due_by_name=lambda c: reports.printed_report(
        c.db, "amount_due_by_name", AS_OF).select(*_CLIENT_COLUMNS),
    r08_attendance_by_client=_broken(
        "attendance_by_client", "id", "client_id", "client_name", "group_id", "group_name",
        "session_date", "attend_n", "charge", "client_paid", "insurance_paid", "due", "note",
        "copay", "deductible", "deductible_met", "patient_rel", "officer_name",
        "discharge_date", "discharge_status"),
    r09_attendance_by_group=_broken(
        "attendance_by_group", "id", "group_name", "client_name", "session_date", "attend_n",
        "charge", "client_paid", "insurance_paid", "due", "note"),
    r09_group_footers=_footer("attendance_by_group", "client", "any"),
    r10_billing_insurance=_broken(
        "billing_insurance", "id", "client_id", "client_name", "carrier_name", "insurance",
        "session_date", "group_name", "attend_n", "charge", "client_paid", "bill_date",
        "check_date", "insurance_paid", "due", "note"),
    r10_client_footers=_footer("billing_insurance", "client", "level"),
    r11_cwip=_broken("cwip", "id", "client_id", "client_name", "lawyer_name", "court_name",
                     "session_date", "charge", "client_paid", "due", "note"),
    r12_dup_clients=_broken("dup_clients", "id", "client_id", "client_name", "id_dabble",
                            "id_zoho", "added_user", "officer_name", "group_name",
                            "session_date", "due"),
    r13_evaluations=_broken("evaluations", "id", "group_name", "session_date", "time",
                            "client_name", "therapist_name", "charge", "client_paid",
                            "insurance_paid", "due", "note", raw=True),
    r14_income_by_therapist=_report("income_by_therapist"),
    r14_therapist_footers=_footer("income_by_therapist", "therapist", "level"),
    r15_ins_summary=_report("ins_summary"),
    r16_last_30=_report("last_30"),
    r16_last_30_blank=_report("last_30_blank"),
    r17_monitoring=_report("monitoring"),
    r18_recent_sessions=_broken("recent_sessions", "id", "session_id", "session_date",
                                "group_rate", "group_name", "time", "therapist_name",
                                "client_name", "attend_n", "charge", "client_paid", "note"),
    r18_session_footers=_footer("recent_sessions", "session", "level"),
    r19_reduced_balances=_report("reduced_balances"),
    r20_voucher_clients=_broken("voucher_clients", "id", "client_name", "group_name",
                                "session_date", "voucher_note", "attend_n", "charge", "due"),
    r21_weekly_groups=_broken("weekly_groups", "id", "session_day", "group_name", "time",
                              "therapist_name", "client_name", "charge", "client_paid", "note"),
    r22_invoice_summary=lambda c: reports.invoice_summary(c.db, AS_OF),
    r22_invoice_lines=lambda c: reports.invoice_lines(c.db),
    r23_invoice_batch=_report("invoice_batch"),
    r24_visit_list=_report("visit_list"),
    r25_smoke_detail=_report("smoke_detail"),
    r25_smoke_totals=_report("smoke_totals"),
    r25_smoke_totals_undated=_report("smoke_totals_undated"),
    r25_smoke_amount_due=_report("smoke_amount_due"),
    r26_therapist_sessions=_report("therapist_sessions"),
    r26_clients_without_visits=_report("clients_without_visits"),
    r26_charge_not_rate=_report("charge_not_rate"),
    r26_visits_per_session=_report("visits_per_session"),
    r26_periods=_report("periods"),
    r27_three_levels=_report("three_levels"),
)


# ---- claims, streaming, report fields ------------------------------------------------

_add(
    c01_claim_lines=lambda c: claims.claim_lines(c.raw, c.open_visits),
    c02_claim_pages=lambda c: claims.paged_lines(c.raw, c.open_visits).groupBy(
        "client_id", "page").agg(F.count(F.lit(1)).alias("lines"),
                                 F.min("visit_id").alias("a_visit")),
    c03_claim_slots=lambda c: _safe(claims.claim_file(c.raw, None, AS_OF)),
    c04_claim_review=lambda c: claims.claim_review(c.raw, None),
    c05_printed_claims=lambda c: claims.printed_claims(c.raw, AS_OF),
    c05_unprintable_amounts=lambda c: claims.unprintable_amounts(c.raw),
    c06_check_boxes=lambda c: claims.check_boxes(claims.claim_parties(c.raw)).select(
        "client_id", *[b for boxes in claims.CHECK_BOXES.values() for b in boxes]),
    c07_stamped_claims=lambda c: claims.stamps(c.sent, c.results),
    e01_report_fields=lambda c: _field_functions(c.db),
    e02_report_variables=_footer("cwip", "client", "level"),
)


def _safe(df: DataFrame) -> DataFrame:
    return df.toDF(*[safe_name(n) for n in df.columns])


def _field_functions(db: Practice) -> DataFrame:
    fn = report_fields.report_functions(AS_OF)
    v = db.visit
    billed = report_fields.field(v, "Bill_Date")
    return v.select(
        "id", fn["date"]().alias("today"),
        fn["iif"](billed.isNotNull(), fn["format"](fn["stod"](billed), "!@%m/%d/%y"),
                  F.lit("")).alias("billed"),
        fn["val"](report_fields.field(v, "CHARGE")).alias("charge"),
        report_fields.field(v, "no_such_field").alias("own_text"))


#: The stream's clients and their billing cutoffs: a day of January 2024 each, none for every 13th.
STREAM_CUTOFF = "if(id % 13 = 0, null, date_add(date'2024-01-01', cast(id % 20 as int)))"


@query("t01_streamed_balances")
def _streamed(c: Case) -> DataFrame:
    """Balances kept by the stream job over the events, which arrive in several batches; one type of
    event deletes the visit before it."""
    events = c.table("events")
    arriving = c.scratch("events")
    events.repartitionByRange(5, "event_id").write.parquet(arriving)
    rows = c.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    clients = events.select(F.col("user_id").alias("id")).distinct().withColumn(
        "billing_cutoff", F.expr(STREAM_CUTOFF))
    out = c.scratch("balances")
    job = stream.keep_balances(star.change_rows(rows, star.visits_of(events)), out, c.scratch("stream"),
                               clients, fold_after=3, available_now=True)
    job.awaitTermination()
    return stream.read_balances(c.spark, out)
