"""Positions along the whole target, none cut off."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import intervals
from tessera.plans import facts


def test_coverage_holds_every_deleted_base(spark, small):
    removed = intervals.deletion_intervals(facts.counts(spark, small))
    outside = removed.filter("start < 90 or stop > 150").count()
    got = entry.queries()["coverage_profile"](spark, small).agg(F.sum("covered")).first()[0]
    assert outside and got == removed.agg(F.sum(F.col("n") * F.col("length"))).first()[0]
    places = entry.queries()["fraction_removed_log2_fc"](spark, small).agg(F.min("position"), F.max("position")).first()
    assert places[0] == 0 and places[1] >= removed.agg(F.max("stop")).first()[0]


def test_changes_from_100_before_to_99_behind(spark, small):
    got = entry.queries()["mismatch_rates_densified"](spark, small).agg(F.min("offset"), F.max("offset"), F.sum(F.when(F.abs("offset") > 15, F.col("rate")))).first()
    assert (got[0], got[1]) == (-100, 99) and got[2] > 0
