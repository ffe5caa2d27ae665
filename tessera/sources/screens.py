"""Screens as configurations, and how the pools of a folder are found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Screen:
    """Parameters of a screen, with the usual values."""

    name: str
    categoriser: str = "pooled"
    has_umis: bool = True
    min_reads_per_cluster: int = 2
    min_reads_per_umi: int = 4
    read_length: int = 258
    guide_length: int = 45
    supplemental: tuple[str, ...] = ("hg19", "bosTau7", "e_coli")
    pools: tuple[str, ...] = field(default_factory=tuple)

    @property
    def is_merged(self) -> bool:
        return bool(self.pools)


def blunt_insertion_limit(read_length: int, primer_to_cut: int, margin: int = 5) -> int:
    """Longest insertion at the cut that a read from the primer can still span."""
    return read_length - primer_to_cut - margin


def screens_from_sheet(sheet: DataFrame) -> list[Screen]:
    """A sample sheet has a row per screen; columns that are absent or empty take the usual value."""
    out = []
    for row in sheet.collect():
        r = row.asDict()
        have = {k: v for k, v in r.items() if v not in (None, "")}
        out.append(
            Screen(
                name=have.get("screen_name") or have["short_name"],
                categoriser=have.get("categorizer", "pooled"),
                has_umis=str(have.get("has_UMIs", "True")).lower() in ("true", "1", "yes"),
                min_reads_per_umi=int(have.get("min_reads_per_UMI", 4)),
                read_length=int(float(have.get("R2_read_length", 258))),
                pools=tuple(have.get("pools_to_merge") or ()),
            )
        )
    return sorted(out, key=lambda s: s.name)


def discover(spark: SparkSession, records: DataFrame, column: str = "screen_name") -> list[str]:
    """Names of the screens that a fact table holds."""
    return [r[0] for r in records.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
