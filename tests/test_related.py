"""Related rows counted at once are those that each relation gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from tallywork.catalog import AS_OF
from tallywork.plans import lookups


@pytest.fixture(scope="module")
def odd(tiny):
    """The tiny practice with keys that repeat and keys that are null."""
    client = tiny.client.withColumn("recent", F.lit(d("2001-04-05")))
    twice = {t: df.union(df.limit(1)) for t, df in tiny.replaced(client=client).items()
             if t in ("client", "visit", "officer", "session", "insurance")}
    none = tiny.visit.limit(1).withColumn("id", F.lit(None).cast("string"))
    return tiny.replaced(**{**twice, "visit": twice["visit"].union(none)})


def test_counts_of_all_relations(odd):
    expected = [(f"{t}.{r}", x.from_key, x.n) for t, r in lookups.RELATIONS for x in
                lookups.related(odd, t, r, AS_OF).groupBy(F.col("from_key").cast("string").alias("from_key"))
                .agg(F.count(F.lit(1)).alias("n")).collect()]
    assert rows(lookups.related_counts(odd, AS_OF)) == sorted(expected, key=repr)
    assert any(k is None for _, k, _ in expected) and len({r for r, _, _ in expected}) > 20


def test_views_are_made_once(odd):
    made = []
    lookups.related_counts(odd, AS_OF, lambda df, name: made.append(name) or df)
    assert sorted(x for x in made if "-" not in x) == ["attendance", "bulk_invoices", "client_balances", "group_attendance_trend"]
