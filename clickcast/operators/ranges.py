"""Histograms of many value ranges at once.

The ranges overlap and have bin widths of their own.  Each row is placed in all of them, rows
placed alike make one cell (a partial aggregate: as many cells as the ranges' common bins), and the
cells, not the rows, are rolled up to every range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValueRange:
    """Values between ``lo`` and ``hi`` (None: open end) in bins of ``width``; ``source``: only rows of these sources."""

    name: str
    width: float
    lo: float | None = None
    hi: float | None = None
    lo_inclusive: bool = False
    hi_inclusive: bool = False
    source: tuple[str, ...] | str | None = None

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,) if isinstance(self.source, str) else self.source or ()

    def condition(self, value: Column, source: Column | None = None) -> Column:
        inside = value.isNotNull()
        if self.lo is not None:
            inside = inside & (value >= self.lo if self.lo_inclusive else value > self.lo)
        if self.hi is not None:
            inside = inside & (value <= self.hi if self.hi_inclusive else value < self.hi)
        return inside & source.isin(*self.sources) if self.sources else inside

    def sql(self, value: str, source: str) -> str:
        """The same condition as SQL text."""
        parts = [f"{value} IS NOT NULL"]
        if self.lo is not None:
            parts.append(f"{value} {'>=' if self.lo_inclusive else '>'} {self.lo}")
        if self.hi is not None:
            parts.append(f"{value} {'<=' if self.hi_inclusive else '<'} {self.hi}")
        if self.sources:
            parts.append(f"{source} IN ({', '.join(repr(s) for s in self.sources)})")
        return " AND ".join(parts)


def range_histograms(df: DataFrame, col: str, ranges: list[ValueRange], source: str | None = None) -> DataFrame:
    """(range, bin, count, bin_lo) of all ``ranges``, from one pass over ``df``; a null value is in none."""
    value, of = F.col(col), F.col(source) if source else None
    bins = [F.when(r.condition(value, of), F.floor(value / F.lit(float(r.width))).cast("long")) for r in ranges]
    cells = df.groupBy(F.array(*bins).alias("_bins")).agg(F.count(F.lit(1)).alias("_n"))
    names = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(float(r.width)).alias("width")) for r in ranges])
    placed = F.transform("_bins", lambda b, i: F.struct(F.get(names, i).alias("r"), b.alias("bin")))
    rows = cells.select("_n", F.explode(F.filter(placed, lambda p: p["bin"].isNotNull())).alias("p"))
    return rows.groupBy(F.col("p.r.name").alias("range"), F.col("p.r.width").alias("_w"), F.col("p.bin").alias("bin")).agg(
        F.sum("_n").alias("count")).select("range", "bin", "count", (F.col("bin") * F.col("_w")).alias("bin_lo"))
