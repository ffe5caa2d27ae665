"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.folding import fold_dna
from tessera.llm.clusters import clusters_of_groups, similar_pairs, typical_members
from tessera.llm.heavy_items import exact_counts, frequent_items
from tessera.llm.leakage import leaked_items
from tessera.llm.near_duplicates import group_pairs, molecule_groups
from tessera.llm.neighbours import nearest_vectors
from tessera.llm.packing import fill_report, pack_texts, rule_tokens, vocabulary_tokens, whole_report
from tessera.llm.residue import template_residue
from tessera.llm.survivors import surviving_reads
from tessera.session import materialize
from tessera.sources.tables import table


PROFILE_PLACES = 64
VECTOR_PLACES = 96
NEIGHBOURS = 5
LEAST_COSINE = 0.75
CAPACITY = 1024
#: File of the public tokenizer, the same on every executor.
TOKENIZER = os.environ.get("TESSERA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _, _ = similar_pairs(table(spark, folder, "guide_profiles"), "profile_id", "log2_fold_changes", PROFILE_PLACES)
    return pairs.select(F.col("a").alias("profile_id_a"), F.col("b").alias("profile_id_b"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size and its most typical profiles."""
    pairs, vectors, model = similar_pairs(table(spark, folder, "guide_profiles"), "profile_id", "log2_fold_changes", PROFILE_PLACES)
    if model is None:
        return vectors.select(F.col("id").alias("cluster_id"), F.lit(0).cast("long").alias("size"), F.array("id").alias("typical")).limit(0)
    return typical_members(clusters_of_groups(pairs, vectors, model, PROFILE_PLACES), vectors, model, PROFILE_PLACES)


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest_vectors(table(spark, folder, "guide_vectors"), "vec_id", "all_guide_correlations", VECTOR_PLACES, NEIGHBOURS)
    return near.select("id", "other", F.round("cosine", 6).alias("cosine"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest_vectors(table(spark, folder, "guide_vectors"), "vec_id", "all_guide_correlations", VECTOR_PLACES, NEIGHBOURS)
    return near.filter(F.col("cosine") >= LEAST_COSINE).select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents"), "doc_id", rule_tokens(F.col("text")), CAPACITY)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_containers(spark, folder).filter("piece = 1").select("doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_containers(spark, folder), CAPACITY)


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the containers hold every text whole, and none too much."""
    return whole_report(materialize(p8_containers(spark, folder), "packed"), CAPACITY)


def p8_fill_vocabulary(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The same with the tokens of a public tokenizer."""
    return fill_report(pack_texts(table(spark, folder, "documents"), "doc_id", vocabulary_tokens(F.col("text"), tokenizer), CAPACITY), CAPACITY)


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).filter("edits = 0").select("item_id", "doc_id")


def p10_residue(spark: SparkSession, folder: str) -> DataFrame:
    return template_residue(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_residue(spark, folder).select("doc_id").distinct()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return molecule_groups(table(spark, folder, "umi_reads"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_pairs(p3_groups(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "umi_reads")
    return surviving_reads(reads, materialize(molecule_groups(reads), "groups"))


FREQUENT_SHARE = 0.01


def _frequent(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    records = table(spark, folder, "collapsed_umis")
    outcome = F.concat("category", F.lit("|"), "subcategory", F.lit("|"), "details")
    items = {"seq": fold_dna("seq"), "outcome": outcome}
    candidates, distinct, total = frequent_items(records, "record_id", items, FREQUENT_SHARE, materialize)
    return exact_counts(candidates, distinct, records, items), total


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    counts, total = _frequent(spark, folder)
    return counts.filter(F.col("n_records") >= F.lit(total * FREQUENT_SHARE)).select("field", "item")


def p6_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent items with exact counts, and whether the bounds of the sketch hold."""
    counts, total = _frequent(spark, folder)
    holds = (F.col("lower") <= F.col("n_records")) & (F.col("n_records") <= F.col("upper"))
    return counts.filter(F.col("n_records") >= F.lit(total * FREQUENT_SHARE)).select("field", "item", "n_records", holds.alias("within_bounds"))


QUERIES = {
    "p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_whole": p8_whole,
    "p8_fill_vocabulary": p8_fill_vocabulary, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_residue": p10_residue, "p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_bounds": p6_bounds, "p7_found": p7_found}

_ITEMS = """
with recs as (
  select record_id, max(upper(seq)) as seq, max(category || '|' || subcategory || '|' || details) as outcome
  from collapsed_umis group by record_id),
items as (
  select 'seq' as field, seq as item from recs where seq is not null
  union all select 'outcome', outcome from recs where outcome is not null),
counts as (select field, item, count(*) as n_records from items group by field, item having count(*) * 100 >= (select count(*) from recs))
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"

# reads of one molecule by brute force: candidates agree in all places of the barcode but one
_GROUPS = """
with recursive r as (
  select read_id, coalesce(min(upper(trim(quartet_name))), '') as q, min(upper(umi)) as u, min(upper(seq)) as s, min(qual) as qual, min(sequenced_at) as seen_at
  from umi_reads where read_id is not null and umi is not null and seq is not null group by read_id),
k as (select read_id, q, u, list_distinct(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8))) as g from r where length(s) >= 8),
w as (select read_id, q, substr(u, 1, p - 1) || '_' || substr(u, p + 1) as pattern from k, unnest(range(1, length(u) + 1)) as t(p)),
c as (select distinct a.read_id as a, b.read_id as b from w a join w b on a.q = b.q and a.pattern = b.pattern and a.read_id < b.read_id),
l as (select c.a, c.b from c join k x on x.read_id = c.a join k y on y.read_id = c.b where 3 * len(list_intersect(x.g, y.g)) >= len(x.g) + len(y.g)),
e as (select a, b from l union all select b, a from l),
reach as (select a as id, b as other from e union select reach.id, e.b from reach join e on e.a = reach.other),
grp as (select id as read_id, least(id, min(other)) as group_id from reach group by id)
"""

ORACLE: dict[str, str] = {
    "p3_groups": _GROUPS + "select read_id, group_id from grp",
    "p3_found": _GROUPS + "select a.read_id as read_id_a, b.read_id as read_id_b from grp a join grp b on a.group_id = b.group_id and a.read_id < b.read_id",
    "p7_found": _GROUPS + """, f as (select grp.group_id, r.read_id, length(regexp_replace(s, '[^ACGT]', '', 'g')) as called, list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) as phred, length(regexp_replace(u, '[^N]', '', 'g')) as uncalled, seen_at from grp join r on r.read_id = grp.read_id),
o as (select *, row_number() over (partition by group_id order by called desc, phred desc nulls last, seen_at desc nulls last, read_id) as i, row_number() over (partition by group_id order by uncalled, seen_at desc nulls last, read_id) as j from f)
select group_id as group_read_id, min(read_id) filter (i = 1) as seq_read_id, min(read_id) filter (j = 1) as umi_read_id from o group by group_id""",
    "p8_found": r"select doc_id from documents where len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ \t\r\n]')) > 1024",
    "p8_whole": r"""with t as (select doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ \t\r\n]')), 0) as n from documents)
select count(*) as texts, cast(sum(n) as bigint) as tokens, count(*) filter (n > 1024) as texts_over, 0 as cut_in_vain, 0 as with_gaps, 0 as overfull from t""",
    "p9_found": f"""
with i as (select item_id, {_WORDS} as w from eval_items), d as (select doc_id, {_WORDS} as w from documents),
ig as (select distinct item_id, array_to_string(w[k:k+11], ' ') as g from i, unnest(range(1, len(w) - 10)) as t(k)),
dg as (select distinct doc_id, array_to_string(w[k:k+11], ' ') as g from d, unnest(range(1, len(w) - 10)) as t(k))
select distinct item_id, doc_id from ig join dg using (g)""",
    "p6_found": _ITEMS + "select field, item from counts",
    "p6_bounds": _ITEMS + "select field, item, n_records, true as within_bounds from counts",
}
