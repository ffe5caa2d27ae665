"""Categories of sequences from their alignments.

A read has an array of alignments: structs (ref, q_start, q_end, r_start, r_end,
strand, edits, indels: array of (kind, start, length)), positions from 0 and
ends inclusive.  Features are column expressions on that array; the decision is
one chain of tests, of which the first that holds wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dna import count_letter, longest_run, quality_fraction
from tessera.operators.intervals import covered_length

ALIGNMENT = "struct<ref:string,q_start:int,q_end:int,r_start:int,r_end:int,strand:string,edits:int,indels:array<struct<kind:string,start:int,length:int>>>"


@dataclass(frozen=True)
class Target:
    """What is known of the target of a screen."""

    name: str = "target"
    donor: str = "donor"
    control: str = "phiX"
    supplemental: tuple[str, ...] = ("hg19", "bosTau7", "e_coli")
    read_start: int = 0
    read_end: int = 200
    cut: int = 100
    primers: tuple[tuple[int, int], ...] = ((0, 19), (181, 200))
    primer_length: int = 40
    donor_changes: tuple[tuple[int, str], ...] = field(default_factory=tuple)


def mapped(alignments: Column) -> Column:
    return F.filter(alignments, lambda a: a["ref"].isNotNull() & a["r_start"].isNotNull())


def on_reference(alignments: Column, *names: str) -> Column:
    return F.filter(mapped(alignments), lambda a: a["ref"].isin(*names))


def supplemental(alignments: Column, names: tuple[str, ...], most: float = 0.2) -> Column:
    """Alignments to other genomes with less than ``most`` edits a base."""
    return F.filter(on_reference(alignments, *names), lambda a: a["edits"] < (a["q_end"] - a["q_start"] + 1) * most)


def query_cover(alignments: Column) -> Column:
    """Bases of the read that the alignments cover, overlaps once."""
    return covered_length(F.transform(alignments, lambda a: F.struct(a["q_start"].alias("start"), a["q_end"].alias("stop"))))


def covers_whole_read(alignment: Column, length: Column, ends: int = 2) -> Column:
    """One alignment that misses at most ``ends`` bases on either side."""
    return (alignment["q_start"] <= ends) & (alignment["q_end"] >= length - 1 - ends)


def indels_near(alignment: Column, cut: int, reach: int = 5) -> Column:
    """Indels of an alignment that come within ``reach`` of the cut."""
    return F.filter(alignment["indels"], lambda i: (i["start"] <= cut + reach) & (F.when(i["kind"] == "D", i["start"] + i["length"] - 1).otherwise(i["start"]) >= cut - reach))


def indels_outside(indels: Column, features: tuple[tuple[int, int], ...]) -> Column:
    """Without those that lie entirely inside a feature, such as a primer."""
    last = lambda i: F.when(i["kind"] == "D", i["start"] + i["length"] - 1).otherwise(i["start"])

    def outside(i: Column) -> Column:
        out = F.lit(True)
        for low, high in features:
            out = out & ~((i["start"] >= low) & (last(i) <= high))
        return out

    return F.filter(indels, outside)


def longest(alignments: Column) -> Column:
    """The alignment over most of the read, ties by its start."""
    keyed = F.transform(alignments, lambda a: F.struct((a["q_end"] - a["q_start"]).alias("n"), (-a["q_start"]).alias("s"), a.alias("a")))
    return F.array_max(F.transform(keyed, lambda k: F.struct(k["n"], k["s"])))


def edge_alignment(alignments: Column, left: bool, length: Column, within: int = 2) -> Column:
    """The longest alignment that reaches an end of the read within ``within`` bases; null for none."""
    near = F.filter(alignments, lambda a: (a["q_start"] <= within) if left else (a["q_end"] >= length - 1 - within))
    ordered = F.sort_array(F.transform(near, lambda a: F.struct((a["q_start"] - a["q_end"]).alias("n"), a["q_start"].alias("s"), a["q_end"].alias("e"), a["r_start"].alias("rs"), a["r_end"].alias("re"), a["strand"].alias("strand"))))
    return F.get(ordered, F.lit(0))


def inferred_length(alignments: Column, length: Column) -> Column:
    """Length of the amplicon from the edge alignments; -1 if there are none."""
    a, b = edge_alignment(alignments, True, length), edge_alignment(alignments, False, length)
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(b["e"] - a["s"] + 1)


def junctions(alignments: Column) -> Column:
    """Distinct places where one alignment ends and the next one starts further back: (end, start)."""
    ordered = F.array_sort(F.transform(alignments, lambda a: F.struct(a["q_start"].alias("q"), a["r_start"].alias("rs"), a["r_end"].alias("re"))))
    steps = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda x, y: F.struct(x["re"].alias("end"), y["rs"].alias("start")))
    return F.array_distinct(F.filter(steps, lambda j: j["start"] <= j["end"]))


def duplication_kind(alignments: Column) -> Column:
    """simple, iterated or complex by the junctions; null without any."""
    n, parts = F.size(junctions(alignments)), F.size(alignments)
    return F.when(n == 0, F.lit(None).cast("string")).when((n == 1) & (parts == 2), "simple").when(n == 1, "iterated").otherwise("complex")


def change_summary(seq: Column, alignment: Column, changes: tuple[tuple[int, str], ...], reference: str) -> Column:
    """One letter per donor change: ``_`` reference base, the base itself, ``-`` where the read does not reach."""
    letters = []
    for place, base in changes:
        at = alignment["q_start"] + (F.lit(place) - alignment["r_start"]) + 1
        got = F.substring(seq, at, F.lit(1))
        letters.append(F.when((F.lit(place) < alignment["r_start"]) | (F.lit(place) > alignment["r_end"]), "-").when(got == reference[place], "_").otherwise(got))
    return F.concat(*letters) if letters else F.lit("")


def templated_candidates(df: DataFrame, read: str) -> DataFrame:
    """The best candidate of every read: least edits and gaps, then gap, edits, gap before, gap after, source.

    Candidates with a gap above 5, more than 5 edits, under 5 bases, 0.1 edits a
    base or more, or 25 bases or less from another genome are left out first.
    """
    from pyspark.sql import Window

    gap = F.col("gap_before") + F.col("gap_after")
    rows = df.filter((gap <= 5) & (F.col("edits") <= 5) & (F.col("length") >= 5) & (F.col("edits") < F.col("length") * 0.1) & ~((F.col("source") == "genome") & (F.col("length") <= 25)))
    order = [F.col("edits") + gap, gap, F.col("edits"), F.col("gap_before"), F.col("gap_after"), F.col("source")]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(read).orderBy(*order))).filter("_r = 1").drop("_r")


def features(reads: DataFrame, target: Target) -> DataFrame:
    """What the decision needs, from columns seq, qual, alignments."""
    length = F.length("seq")
    on_target, on_donor = on_reference(F.col("alignments"), target.name), on_reference(F.col("alignments"), target.donor)
    rows = reads.withColumns({"_t": on_target, "_d": on_donor, "_o": supplemental(F.col("alignments"), target.supplemental), "_x": on_reference(F.col("alignments"), target.control)})
    whole = F.filter("_t", lambda a: covers_whole_read(a, length))
    rows = rows.withColumn("_w", F.get(whole, F.lit(0)))
    return rows.withColumns(
        {
            "length": length,
            "n_mapped": F.size(mapped(F.col("alignments"))),
            "is_single": F.col("_w").isNotNull(),
            "n_indels": F.coalesce(F.size(F.col("_w.indels")), F.lit(0)),
            "indel_kind": F.get(F.col("_w.indels"), F.lit(0))["kind"],
            "indel_start": F.get(F.col("_w.indels"), F.lit(0))["start"],
            "indel_length": F.get(F.col("_w.indels"), F.lit(0))["length"],
            "is_joined": F.coalesce((F.size(F.col("_w.indels")) == 2) & (F.get(F.col("_w.indels"), F.lit(0))["kind"] == "D") & (F.get(F.col("_w.indels"), F.lit(1))["kind"] == "I") & (F.get(F.col("_w.indels"), F.lit(0))["start"] == F.get(F.col("_w.indels"), F.lit(1))["start"]), F.lit(False)),
            "inserted_length": F.get(F.col("_w.indels"), F.lit(1))["length"],
            "n_near": F.coalesce(F.size(indels_outside(indels_near(F.col("_w"), target.cut), target.primers)), F.lit(0)),
            "n_mismatches": F.coalesce(F.col("_w.edits"), F.lit(0)),
            "starts_as_expected": F.coalesce(F.abs(F.col("_w.r_start") - F.lit(target.read_start)) <= 2, F.lit(False)),
            "has_donor": F.size("_d") > 0,
            "has_genome": F.size("_o") > 0,
            "has_control": F.size("_x") > 0,
            "duplication": F.when(F.size("_t") > 1, duplication_kind(F.col("_t"))),
            "not_covered": length - query_cover(F.concat("_t", "_d")),
            "n_uncalled": count_letter(F.col("seq"), "N"),
            "sure": quality_fraction(F.col("qual")),
            "sure_late": quality_fraction(F.col("qual"), second_half=True),
            "longest_g": longest_run(F.col("seq"), "G"),
            "inferred_amplicon_length": inferred_length(F.col("_t"), length),
        }
    ).drop("_t", "_d", "_o", "_x", "_w")


def decide(target: Target) -> list[tuple[Column, str, str, Column]]:
    """The tests in order: condition, category, subcategory, details."""
    c, none = F.col, F.lit("n/a")
    single, n, mism = c("is_single"), c("n_indels"), c("n_mismatches")
    deletion = F.format_string("D:%d,%d", c("indel_start"), c("indel_length"))
    insertion = F.format_string("I:%d,%d", c("indel_start"), c("indel_length"))
    one = single & (n == 1)
    return [
        (c("n_mapped") == 0, "bad sequence", "no alignments detected", none),
        (c("length") <= target.primer_length + 10, "nonspecific amplification", "unknown", none),
        (single & (n == 0) & c("has_donor") & (mism > 0), "donor", "clean", none),
        (single & (n == 0) & (mism == 0) & c("starts_as_expected"), "wild type", "clean", none),
        (single & (n == 0) & (mism == 0), "truncation", "clean", none),
        (single & (n == 0) & c("starts_as_expected"), "mismatches", "mismatches", none),
        (single & (n == 0), "uncategorized", "uncategorized", none),
        (one & (c("n_near") == 0) & (c("indel_length") <= 3), "wild type", "short indel far from cut", none),
        (one & (c("n_near") == 0), "uncategorized", "indel far from cut", none),
        (one & c("has_donor"), "donor + deletion", "clean", deletion),
        (one & (c("indel_kind") == "D") & (mism == 0), "deletion", "clean", deletion),
        (one & (c("indel_kind") == "D"), "deletion", "mismatches", deletion),
        (one & (c("indel_kind") == "I") & (mism == 0), "insertion", "clean", insertion),
        (one & (c("indel_kind") == "I"), "insertion", "mismatches", insertion),
        (single & c("is_joined") & (c("n_near") > 0), "deletion + insertion", "clean", F.format_string("D:%d,%d;I:%d,%d", c("indel_start"), c("indel_length"), c("indel_start"), c("inserted_length"))),
        (single & c("has_donor"), "donor", "synthesis errors", none),
        (single, "multiple indels", "multiple indels", none),
        (c("has_donor"), "donor misintegration", "complex", none),
        (c("has_genome") & (c("not_covered") >= 25), "genomic insertion", "clean", F.format_string("G:%d", c("not_covered"))),
        (c("duplication").isNotNull() & (n == 0), "duplication", "simple", c("duplication")),
        (c("has_control"), "phiX", "phiX", none),
        ((c("n_uncalled") > 10) | (c("sure") < 0.5) | (c("sure_late") < 0.5) | (c("longest_g") >= 20), "bad sequence", "low quality", none),
    ]


def categorise(reads: DataFrame, target: Target) -> DataFrame:
    """Adds category, subcategory, details and the inferred amplicon length; what no test takes is uncategorized."""
    rows = features(reads, target)
    pick = None
    for condition, category, subcategory, details in decide(target):
        value = F.struct(F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), details.alias("details"))
        pick = F.when(condition, value) if pick is None else pick.when(condition, value)
    pick = pick.otherwise(F.struct(F.lit("uncategorized").alias("category"), F.lit("uncategorized").alias("subcategory"), F.lit("n/a").alias("details")))
    kept = [x for x in reads.columns if x not in ("category", "subcategory", "details")]
    return rows.withColumn("_p", pick).select(*kept, "_p.*", "inferred_amplicon_length")


#: Categorisers by name; a screen names the one it needs.
CATEGORISERS: dict[str, Callable[[DataFrame, Target], DataFrame]] = {"pooled": categorise}


def register(name: str, f: Callable[[DataFrame, Target], DataFrame]) -> None:
    CATEGORISERS[name] = f


def details_at_least(n: int, base: str) -> Callable[[Column], Column]:
    """A test for details with at least ``n`` changes to ``base``, to be applied to a details column."""
    return lambda details: F.size(F.regexp_extract_all(details, F.lit(rf"(?:^|;)S:\d+{base}"), 0)) >= n


def details_exactly(n: int, base: str) -> Callable[[Column], Column]:
    return lambda details: F.size(F.regexp_extract_all(details, F.lit(rf"(?:^|;)S:\d+{base}"), 0)) == n
