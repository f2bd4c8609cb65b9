"""The store's tables by name: their keys, and how they are written and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import valid_on
from tidemark.sources.writes import CHECKS, ConflictError, Store, append_immutable, append_new, checked

# Keys of tables to which rows are appended unless their key is there. Fixed values.
APPENDED = {
    "price_bars": ("security_id", "event_time", "source_version"),
    "fundamentals_asfiled": ("security_id", "concept", "unit", "period_start", "period_end", "source_version"),
    "insider_txns": ("accession", "seq"),
    "news_items": ("item_id", "source_version"),
    "features": ("security_id", "event_time", "source_version"),
    "universe_snapshots": ("snapshot_date", "security_id", "source_version"),
    "runs": ("run_id",),
    "gate_decisions": ("run_id", "security_id"),
}
# Keys of tables whose rows never change: another payload under a key is an error. Fixed values.
IMMUTABLE = {
    "tbill_rates": ("series", "observation_date", "vintage_date"),
    "tbill_vintage_coverage": ("series", "source_version"),
    "execution_references": ("run_id", "symbol_ref"),
    "halt_reference_requests": ("run_id", "trigger"),
    "halt_reference_symbol_sets": ("run_id", "trigger"),
    "halt_references": ("run_id", "trigger", "symbol_ref"),
}


def insert(store: Store, name: str, rows: DataFrame) -> int:
    """Rows of a table appended by its key and rule; how many were new. Rows that break the table's checks are refused whole."""
    if name in CHECKS:
        bad = checked(name, rows)[1].limit(1).collect()
        if bad:
            raise ConflictError(f"{name}: {bad[0].asDict()} breaks a check of the table")
    if name in APPENDED:
        return append_new(store, name, rows, APPENDED[name])
    return append_immutable(store, name, rows, IMMUTABLE[name])


def securities(dimension: DataFrame, listed_on: Column | None = None) -> DataFrame:
    """Common stock; with a day, only what is listed on it."""
    stock = dimension.filter(F.col("kind") == "equity").drop("kind")
    return stock if listed_on is None else valid_on(stock, listed_on)


def reference_instruments(dimension: DataFrame) -> DataFrame:
    """Funds and indexes, which are no universe members."""
    return dimension.filter(F.col("kind") != "equity")


def run_references(references: DataFrame, run_id: str, as_of: Column | None = None) -> DataFrame:
    """A run's references in order of their symbols; with an instant, those that were visible then."""
    own = references.filter(F.col("run_id") == run_id)
    return (own if as_of is None else own.filter(F.col("available_at") <= as_of)).orderBy("symbol_ref")
