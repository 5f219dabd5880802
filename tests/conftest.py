from __future__ import annotations

import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallywork import schema  # noqa: E402
from tallywork.catalog import AT, DORMANT_BEFORE, Case  # noqa: E402
from tallywork.plans import upkeep  # noqa: E402
from tallywork.practice import Practice  # noqa: E402
from tallywork.session import build_session  # noqa: E402
from tallywork.sources import tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def case(spark, tmp_path_factory):
    """The small tables, derived and stored once, as a practice would keep them."""
    folder = str(tmp_path_factory.mktemp("practice"))
    derived = Case(spark, SMALL)
    tables.write_practice(derived.raw, folder, 2)
    raw = tables.read_practice(spark, folder)
    kept = upkeep.with_balances(raw, DORMANT_BEFORE, AT).client
    tables.write_table(kept, f"{folder}/kept", "client", 1)
    stored = Case(spark, SMALL)
    stored.__dict__.update(
        raw=raw, db=raw.replaced(client=tables.read_table(spark, f"{folder}/kept", "client")))
    return stored


def d(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def m(text: str | int) -> Decimal:
    return Decimal(str(text)).quantize(Decimal("0.01"))


def table(spark, name: str, *rows: dict):
    kinds = schema.struct(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kinds.fields) for r in rows], kinds)


# a practice small enough to work out by hand
ROWS = {
    "office": [dict(id=1, name="Court A"), dict(id=2, name="Court B", fax="1")],
    "officer": [dict(id=1, name="Olsen", email="o@example.org", office_id=1),
                dict(id=2, name="Perez", office_id=2)],
    "group": [dict(id=1, name="CWIP Monday", rate=m(20), evaluation=0, cpt="90853"),
              dict(id=2, name="Talk", rate=m(30), evaluation=0, cpt="")],
    "therapist": [dict(id=1, name="Dr One", npi="0000000001", tax_id="11-1"),
                  dict(id=2, name="Dr Two", npi="0000000002")],
    "procedure": [dict(cpt="90853", name="Group", price=m(80))],
    "diagnosis": [dict(icd9="305.00")],
    "carrier": [dict(id=1, name="Carrier X", address="PO 1", city_st_zip="T")],
    "client": [
        dict(id=1, name="Doe, Ann", officer_id=1, officer2_id=2, court_id=1,
             dob=d("1980-02-03"), billing_cutoff=d("2001-01-01"), phone="913 5550100"),
        dict(id=2, name="Doe, Ann", officer_id=2, billing_cutoff=d("2001-02-01")),
        dict(id=3, name="Roe, Bob"), dict(id=4, name="Solo, Cy", billing_cutoff=d("2001-01-01"))],
    "insurance": [dict(id=1, client_id=1, carrier_id=1, payer_type="Medicare", id_number="N1",
                       patient_sex="F", patient_rel="Self", dx1="305.00"),
                  dict(id=3, client_id=3, carrier_id=1, payer_type="Other", id_number="N3",
                       patient_sex="M", patient_rel="Child", insured_name="Roe, Pat",
                       dx1="305.00")],
    "session": [dict(id=10 + k, session_date=d(f"2001-0{1 + k}-05"), time=None if k else "09:00",
                     group_id=1 + k % 2, therapist_id=1 if k < 3 else None) for k in range(4)],
    "visit": [
        dict(id=f"v{k}", client_id=1 + k % 3, session_id=10 + k % 4, attend_n=int(k != 5),
             charge=m(50 + k), client_paid=m(k), insurance_paid=None if k % 2 else m(10),
             cpt="90853" if k % 2 == 0 else None) for k in range(12)],
    "batch": [dict(name="current", cutoff=d("2001-03-01"), invoice_threshold=m(10)),
              dict(name="income", cutoff=d("2001-02-01"))],
}


@pytest.fixture(scope="session")
def tiny(spark) -> Practice:
    return Practice({name: table(spark, name, *rows) for name, rows in ROWS.items()})


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
