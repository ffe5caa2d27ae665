"""Queries do the whole job of the reference, not a part of it."""

import __spark_entry__ as entry
from tessera.operators.counts import OUTCOME
from tessera.plans import facts


def test_fold_changes_of_every_outcome(spark, small):
    cnt = facts.counts(spark, small)
    outcomes, guides = cnt.select(*OUTCOME).distinct().count(), facts.guides(spark, small).count()
    rows = entry.queries()["log2_fold_changes"](spark, small)
    assert outcomes > facts.FREQUENT_OUTCOMES and rows.count() == outcomes * guides
    # every record is in one row
    assert rows.agg({"n": "sum"}).first()[0] == cnt.agg({"n": "sum"}).first()[0]


def test_most_frequent_outcomes_are_a_thousand(spark, small):
    controls = facts.counts(spark, small).filter("is_nt").select(*OUTCOME).distinct().count()
    assert controls > facts.FREQUENT_OUTCOMES
    assert entry.queries()["most_frequent_outcomes"](spark, small).count() == min(1000, controls)
