"""Reads and records of one molecule: consensus, outcome by vote, correction of barcodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.counts import OUTCOME, ranked_over_all
from tessera.session import materialize, release

HIGH, LOW, UNSURE = 31, 10, 2
COUNTED_QUALITY, SEED_QUALITY = 30, 20
#: Larger groups are clustered round by round over all tasks until so many reads are left, so that no task holds an unbounded group.
GROUP_READS = 10_000


def relevant(records: DataFrame) -> DataFrame:
    """Drops bad sequences and records without indel that are ambiguous."""
    return records.filter(~((F.col("category") == "bad sequence") | ((F.col("category") == "no indel") & (F.col("subcategory") == "other") & (F.col("details") == "ambiguous"))))


def number_clusters(records: DataFrame, by: list[str], reads: str, tie: list[str]) -> DataFrame:
    """Numbers the clusters of a molecule from 0 by falling number of reads."""
    return records.withColumn("cluster_number", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(reads), *tie)) - 1)


def cluster_sizes(records: DataFrame, by: list[str], reads: str) -> DataFrame:
    """The sizes of the clusters of every molecule, largest first; a molecule has few clusters."""
    return records.groupBy(*by).agg(F.reverse(F.sort_array(F.collect_list(reads))).alias("sizes"))


def votes(records: DataFrame, by: list[str], reads: str, record: str) -> DataFrame:
    """Reads per molecule and outcome, and the record with the most reads as representative."""
    key = F.struct(F.col(reads).alias("r"), (-F.col(record)).alias("i"))
    return records.groupBy(*by, *OUTCOME).agg(F.sum(reads).alias("reads"), (-F.max(key)["i"]).alias("representative"))


def winners(voted: DataFrame, by: list[str]) -> DataFrame:
    """The outcome with the most reads of every molecule; a molecule with a tie is dropped."""
    w = Window.partitionBy(*by).orderBy(F.desc("reads"))
    rows = voted.withColumn("_r", F.rank().over(w)).filter("_r = 1").withColumn("_ties", F.count("*").over(Window.partitionBy(*by)))
    return rows.filter("_ties = 1").drop("_r", "_ties")


def common_sequences(reads: DataFrame, seq: str, least: int = 2) -> DataFrame:
    """``seq, n, rank`` of the sequences that occur at least ``least`` times, most frequent first."""
    counts = reads.filter(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return ranked_over_all(counts, [F.desc("n"), F.asc("seq")]).withColumn("rank", F.col("rank") - 1)


def once_per_sequence(reads: DataFrame, seq: str, apply, key: str = "seq") -> DataFrame:
    """Apply an expensive function to distinct sequences and join the result back."""
    return reads.join(apply(reads.select(F.col(seq).alias(key)).distinct()), F.col(seq).eqNullSafe(F.col(key)), "left")


def reads_per_umi(records: DataFrame, reads: str) -> DataFrame:
    """Histograms of reads per molecule: of all, of every subcategory and of every outcome, by grouping sets."""
    return records.groupingSets([[F.col(reads)], [F.col(reads), F.col("category"), F.col("subcategory")], [F.col(reads), F.col("category"), F.col("subcategory"), F.col("details")]], F.col(reads), F.col("category"), F.col("subcategory"), F.col("details")).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def correct_barcodes(records: DataFrame, by: list[str], barcode: str, reads: str, max_rounds: int = 40) -> DataFrame:
    """``*by, barcode, corrected``: barcodes drawn to the most abundant one within one mismatch, along chains.

    Two barcodes are within one mismatch if they agree without one of their
    places, so neighbours meet on the key (place, rest): the best neighbour is an
    aggregate over these keys, not a comparison of pairs.  Abundance ties go by
    barcode.  Chains are followed by pointer jumping.
    """
    counts = records.filter(F.col(barcode).isNotNull()).groupBy(*by, F.col(barcode).alias("barcode")).agg(F.sum(reads).alias("reads"))
    standing = F.struct((-F.col("reads")).alias("r"), F.col("barcode").alias("b"))
    keyed = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.length("barcode"), F.lit(1))))).withColumn("rest", F.concat_ws("*", F.substring(F.col("barcode"), F.lit(1), F.col("i") - 1), F.substring(F.col("barcode"), F.col("i") + 1, F.length("barcode"))))
    best = keyed.groupBy(*by, "i", "rest").agg(F.min(standing).alias("best"))
    step = keyed.select(*by, "barcode", "i", "rest").join(best, [*by, "i", "rest"]).groupBy(*by, "barcode").agg(F.min("best")["b"].alias("corrected"))
    links = materialize(step, "corrections")
    for _ in range(max_rounds):
        target = links.select(*by, F.col("barcode").alias("corrected"), F.col("corrected").alias("further"))
        nxt = materialize(links.join(target, [*by, "corrected"]).select(*by, "barcode", F.col("further").alias("corrected"), (F.col("further") != F.col("corrected")).alias("moved")), "corrections")
        release(links)
        links = nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            break
        links._tessera_path = nxt._tessera_path
    return links.select(*by, "barcode", "corrected")


# -- consensus of reads ---------------------------------------------------


def call_consensus(seqs: list[str], quals: list[str]) -> tuple[str, str]:
    """Base by base the one with the most sure votes, then votes, then mean quality; an exact tie is N."""
    width = max(map(len, seqs))
    base, score = np.zeros((len(seqs), width), np.uint8), np.full((len(seqs), width), -1, np.int64)
    for i, (s, q) in enumerate(zip(seqs, quals)):
        base[i, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
        score[i, : len(q)] = np.frombuffer(q.encode("ascii", "replace"), np.uint8).astype(np.int64) - 33
    have = score >= 0
    letters = np.unique(base[have])
    if len(letters) == 0:
        return "", ""
    votes = np.stack([have & (base == b) for b in letters])
    count = votes.sum(1)
    sure = (votes & (score >= COUNTED_QUALITY)).sum(1)
    mean = np.where(count > 0, np.where(votes, score, 0).sum(1) / np.maximum(count, 1), -1.0)
    # candidates drop out criterion by criterion; more than one left is a tie
    left = count > 0
    for value in (sure, count, mean):
        best = np.where(left, value, -2).max(0)
        left &= value == best
    tie, pick, at = left.sum(0) > 1, left.argmax(0), np.arange(width)
    strong = (sure[pick, at] >= 1) & (count[pick, at] * 2 > have.sum(0))
    out = np.where(tie, np.uint8(ord("N")), letters[pick]).astype(np.uint8)
    quality = np.where(tie, UNSURE, np.where(strong, HIGH, LOW)) + 33
    return out.tobytes().decode("ascii"), quality.astype(np.uint8).tobytes().decode("ascii")


def cluster_reads(seqs: list[str], quals: list[str], allowed: int = 0) -> list[tuple[str, str, int]]:
    """Clusters of the reads of one barcode: consensus, its quality and the number of reads.

    The most frequent sequence (ties by text) seeds a cluster, or the consensus
    of all if no sequence occurs twice; reads with at most ``allowed`` sure
    mismatches to the seed belong to it; the rest goes on.  A rest without
    progress becomes clusters of one read.
    """
    left = list(range(len(seqs)))
    out = []
    while left:
        counts: dict[str, int] = {}
        for i in left:
            counts[seqs[i]] = counts.get(seqs[i], 0) + 1
        seed, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n == 1 and len(left) > 1:
            seed, _ = call_consensus([seqs[i] for i in left], [quals[i] for i in left])
        near = [i for i in left if seqs[i] == seed or sum(1 for a, b, q in zip(seed, seqs[i], quals[i]) if a != b and ord(q) - 33 >= SEED_QUALITY) <= allowed]
        if not near:
            out += [(seqs[i], quals[i], 1) for i in left]
            break
        out.append((*call_consensus([seqs[i] for i in near], [quals[i] for i in near]), len(near)))
        near_set = set(near)
        left = [i for i in left if i not in near_set]
    return out


def _mismatches(allowed: int):
    """Whether a read belongs to a seed, as in ``cluster_reads``."""

    def near(seed: pd.Series, seqs: pd.Series, quals: pd.Series) -> pd.Series:
        return pd.Series([s == r or sum(1 for a, b, q in zip(s, r, qs) if a != b and ord(q) - 33 >= SEED_QUALITY) <= allowed for s, r, qs in zip(seed, seqs, quals)], dtype=bool)

    return F.pandas_udf(near, "boolean")


def consensus_of_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """``*by, num_reads, seq, qual``: ``call_consensus`` of every group by aggregates, for groups of any size."""
    # integers as in call_consensus: a mean is compared as the quotient of the same two sums
    base = rows.select(*by, F.posexplode(F.split("seq", "")).alias("at", "base"), "qual").filter("base <> ''")
    base = base.withColumn("base", F.when(F.ascii("base") > 127, "?").otherwise(F.col("base"))).withColumn("q", F.ascii(F.substring(F.col("qual"), F.col("at") + 1, F.lit(1))) - 33).filter("q >= 0")
    votes = base.groupBy(*by, "at", "base").agg(F.count("*").alias("n"), F.sum((F.col("q") >= COUNTED_QUALITY).cast("long")).alias("sure"), F.sum("q").alias("q"))
    standing = F.struct("sure", "n", (F.col("q") / F.col("n")).alias("mean"))
    best = votes.groupBy(*by, "at").agg(F.max(standing).alias("best"), F.collect_list(F.struct(standing.alias("s"), "base")).alias("all"), F.sum("n").alias("have"))
    picked = best.withColumn("top", F.filter("all", lambda x: x["s"] == F.col("best")))
    quality = F.when(F.size("top") > 1, UNSURE).when((F.col("best.sure") >= 1) & (F.col("best.n") * 2 > F.col("have")), HIGH).otherwise(LOW)
    called = picked.select(*by, "at", F.when(F.size("top") > 1, "N").otherwise(F.col("top")[0]["base"]).alias("b"), F.char(quality + 33).alias("q"))
    joined = called.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "b", "q"))).alias("x"))
    text = lambda c: F.array_join(F.transform("x", lambda y: y[c]), "")
    return rows.groupBy(*by).agg(F.count("*").alias("num_reads")).join(joined.select(*by, text("b").alias("seq"), text("q").alias("qual")), by)


def cluster_large(rows: DataFrame, by: list[str], allowed: int, group_reads: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Clusters of groups too large for a task, and the reads left when so few are that one task can go on.

    Every round takes the next cluster of each group by the rule of
    ``cluster_reads``; a round needs what is left only, so the result is the
    same as in one task.
    """
    done = rest = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    left = materialize(rows.select(*by, "read_id", "seq", "qual"), "reads-left")
    while True:
        sizes = left.groupBy(*by).agg(F.count("*").alias("_size"))
        if not sizes.filter(F.col("_size") > group_reads).limit(1).count():
            return done, add(rest, left)
        sized = left.join(sizes, by)
        rest = add(rest, sized.filter(F.col("_size") <= group_reads).drop("_size"))
        large = sized.filter(F.col("_size") > group_reads).drop("_size")
        counts = large.groupBy(*by, F.col("seq").alias("seed")).agg(F.count("*").alias("n"))
        first = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "seed")).alias("m"))
        twice = first.filter("m.n < -1").select(*by, F.col("m.seed").alias("seed"))
        once = large.join(first.filter("m.n = -1"), by, "left_semi")
        seeds = twice.unionByName(consensus_of_groups(once, by).select(*by, F.col("seq").alias("seed")))
        marked = materialize(large.join(seeds, by).withColumn("near", _mismatches(allowed)("seed", "seq", "qual")).drop("seed"), "reads-near")
        near = marked.filter("near").drop("near")
        done = add(done, materialize(consensus_of_groups(near, by).select(*by, "num_reads", "seq", "qual"), "clusters"))
        far = marked.filter("not near").drop("near")
        moved = near.select(*by).distinct()
        stuck = far.join(moved, by, "left_anti").select(*by, F.lit(1).cast("long").alias("num_reads"), "seq", "qual")
        done = add(done, stuck)
        left = materialize(far.join(moved, by, "left_semi"), "reads-left")


def collapse_reads(reads: DataFrame, by: list[str], read_id: str, seq: str, qual: str, allowed: int = 0, group_reads: int = GROUP_READS) -> DataFrame:
    """``*by, cluster_id, num_reads, seq, qual``: consensus clusters of every molecule.

    Reads without barcode, sequence or quality are left out.  A molecule of one
    read passes through without leaving the JVM.
    """
    rows = reads.select(*by, F.col(read_id).alias("read_id"), F.upper(F.col(seq)).alias("seq"), F.col(qual).alias("qual")).dropna().filter("length(seq) = length(qual)").dropDuplicates(["read_id"])
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    sized = rows.join(sizes, by)
    single = sized.filter("_n = 1").select(*by, F.lit(0).alias("cluster_id"), F.lit(1).cast("long").alias("num_reads"), "seq", "qual")
    types = dict(reads.select(*by).dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in by) + ", num_reads long, seq string, qual string"
    # a fixed number of partitions: the work in Python is out of proportion to the bytes that adaptive planning sees
    number = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = sized.filter((F.col("_n") > 1) & (F.col("_n") <= group_reads)).select(*by, "read_id", "seq", "qual")
    large, ended = sized.filter(F.col("_n") > group_reads), None
    if sizes.filter(F.col("_n") > group_reads).limit(1).count():
        ended, rest = cluster_large(large, by, allowed, group_reads)
        small = small.unionByName(rest)
    many = small.repartition(number, *by).sortWithinPartitions(*by, "read_id").select(*by, "seq", "qual")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seqs, quals = None, [], []

        def finish(rows: list) -> None:
            if key is not None:
                rows += [(*key[: len(by)], n, s, q) for s, q, n in cluster_reads(seqs, quals, allowed)]

        columns = [*by, "num_reads", "seq", "qual"]
        for part in parts:
            rows: list = []
            for r in part.itertuples(index=False, name=None):
                if r[:-2] != key:
                    finish(rows)
                    key, seqs, quals = r[:-2], [], []
                seqs.append(r[-2])
                quals.append(r[-1])
            yield pd.DataFrame(rows, columns=columns)
        rows = []
        finish(rows)
        yield pd.DataFrame(rows, columns=columns)

    clusters = many.mapInPandas(work, ddl)
    if ended is not None:
        clusters = clusters.unionByName(ended)
    numbered = clusters.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("num_reads"), "seq", "qual")) - 1)
    return single.unionByName(numbered.select(*by, "cluster_id", "num_reads", "seq", "qual"))
