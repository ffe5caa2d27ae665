"""Texts of varying length in containers of fixed capacity.

Sizes are tokens.  A text above the capacity is cut into full pieces and a
rest; all else stays whole.  The rows are numbered, written and spread by a hash
of their number into groups of bounded size, so that rows with one id are spread
like all others, and each group is packed by itself: items above one third of the
capacity are matched greedily, at most two to a container, the largest one with
the largest partner that still fits; the smaller ones then go, in order of size,
to the container with the smallest gap that holds them.  Groups share no
container, so at most about one container per group is left part-empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

CAPACITY = 1024
GROUP_ROWS = 50_000
#: A run of ASCII letters and digits, or any other character except space, tab, CR and LF.
TOKEN = r"[A-Za-z0-9]+|[^ \t\r\n]"


def rule_tokens(text: Column) -> Column:
    """Number of tokens by the rule ``TOKEN``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def vocabulary_tokens(text: Column, path: str) -> Column:
    """Number of tokens by the public tokenizer whose JSON file is at ``path`` on every executor."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], dtype="int64")

    return count(text)


def fill_containers(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of every item; no item is larger than ``capacity``."""
    where = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] * 3 > capacity].tolist()
    small = order[sizes[order] * 3 <= capacity].tolist()
    size = sizes.tolist()
    gaps: dict[int, list[int]] = {}
    mask, n = 0, 0
    # items by size, so that the largest partner that fits is one look-up: a bit for every size in stock
    stock: dict[int, list[int]] = {}
    have = 0
    for i in reversed(large):
        stock.setdefault(size[i], []).append(i)
        have |= 1 << size[i]

    def take(s: int) -> int:
        nonlocal have
        i = stock[s].pop()
        if not stock[s]:
            have &= ~(1 << s)
        return i

    def leave(gap: int, container: int) -> None:
        nonlocal mask
        gaps.setdefault(gap, []).append(container)
        mask |= 1 << gap

    while have:
        s = have.bit_length() - 1
        where[take(s)] = n
        rest = capacity - s
        fits = have & ((1 << (rest + 1)) - 1)
        if fits:
            p = fits.bit_length() - 1
            where[take(p)] = n
            rest -= p
        leave(rest, n)
        n += 1
    for i in small:
        s = size[i]
        fits = mask >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            container = gaps[gap].pop()
            if not gaps[gap]:
                mask &= ~(1 << gap)
        else:
            gap, container, n = capacity, n, n + 1
        where[i] = container
        leave(gap - s, container)
    return where


def _pack(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="last").reset_index(drop=True)
        n = rows["n_tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-n // capacity))
        line = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(capacity, n[line] - start)
        full = size == capacity
        where = np.empty(len(line), np.int64)
        rest = fill_containers(size[~full], capacity)
        where[~full] = rest
        used = int(rest.max(initial=-1)) + 1
        where[full] = used + np.arange(int(full.sum()))
        group = int(rows["grp"].iloc[0])
        return pd.DataFrame({"container_id": (group << 32) + where, "doc_id": rows["doc_id"].array[line], "piece": piece.astype(np.int32), "start_token": start, "n_tokens": size})

    return pack


def pack_texts(df: DataFrame, row_id: str, tokens: Column, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``container_id, doc_id, piece, start_token, n_tokens``: the place of every text or piece.

    Only a text with more than ``capacity`` tokens has more than one piece, and
    all its pieces but the last one are full.  An empty or null text is one
    piece of 0 tokens.  Every row is an item, also with a null or repeated id.
    An empty table gives no row.
    """
    # the numbers are written once, so that a task that runs again finds the same ones
    items = materialize(df.select(F.monotonically_increasing_id().alias("line"), F.col(row_id).cast("long").alias("doc_id"), tokens.alias("n_tokens")), "items")
    groups = max(1, -(-items.count() // group_rows))
    spread = F.pmod(F.xxhash64("line"), F.lit(groups)).cast("int")
    return items.select("doc_id", "n_tokens", spread.alias("grp")).groupBy("grp").applyInPandas(_pack(capacity), "container_id long, doc_id long, piece int, start_token long, n_tokens long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, texts cut, tokens, the largest load and the share of the room that is used."""
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    whole = loads.agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("largest"))
    return whole.withColumn("filled", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * F.lit(capacity))))


def whole_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of what any right packing fulfils: texts, tokens, overfull containers, texts cut in vain, gaps between pieces.

    Ids must be unique for this.  ``texts_over`` counts the texts with more than
    one piece.
    """
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load")).agg(F.coalesce(F.sum((F.col("load") > capacity).cast("long")), F.lit(0)).alias("overfull"))
    per = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    texts = per.agg(
        F.count("*").alias("texts"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum((F.col("pieces") > 1).cast("long")), F.lit(0)).alias("texts_over"),
        F.coalesce(F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).cast("long")), F.lit(0)).alias("cut_in_vain"),
        F.coalesce(F.sum((F.col("tokens") != F.col("end")).cast("long")), F.lit(0)).alias("with_gaps"),
    )
    return texts.join(over, F.lit(True))
