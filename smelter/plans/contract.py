"""What a gold table declares about itself, so that later steps need not guess."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import small_frame


@dataclass(frozen=True)
class Classification:
    """Roles of a table's columns."""

    grain: str | None
    measures: list[str]
    dims: list[str]
    keys: list[str]
    pii: list[str]
    types: dict[str, str] = field(default_factory=dict)

    @property
    def is_fact(self) -> bool:
        return bool(self.grain and self.measures)


@dataclass(frozen=True)
class GoldContract:
    table: str
    kind: str  # "fact" or "dim"
    owner: str = "unassigned"
    grain: str | None = None
    dims: list[str] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    count_col: str | None = None
    measure_types: dict[str, str] = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


CONTRACT_SCHEMA = """
    table string, kind string, owner string, grain string, dims array<string>, measures array<string>,
    count_col string, measure_types map<string,string>, keys array<string>, dropped array<string>
"""


def contracts_frame(spark: SparkSession, contracts: list[GoldContract]) -> DataFrame:
    return small_frame(spark, [(c.table, c.kind, c.owner, c.grain, c.dims, c.measures, c.count_col, c.measure_types, c.keys, c.dropped)
         for c in contracts], CONTRACT_SCHEMA)


def pick_fact(contracts: list[GoldContract], wanted: str | None = None) -> GoldContract:
    """The fact asked for, else the one with most measures, then most dimensions."""
    facts = [c for c in contracts if c.kind == "fact"]
    if not facts:
        raise ValueError("no gold fact to choose from")
    for fact in facts:
        if wanted and fact.table in (wanted, f"agg_{wanted}_daily"):
            return fact
    return max(facts, key=lambda c: (len(c.measures), len(c.dims)))
