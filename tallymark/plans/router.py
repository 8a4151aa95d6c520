"""One entry point for any table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..constants import Options
from ..operators.schema import detect_mapping, is_ledger
from .ledger import LedgerRun, run_ledger
from .universal import UniversalRun, run_universal


def run(df: DataFrame, options: Options | None = None) -> LedgerRun | UniversalRun:
    """The ledger rules where the headers make a ledger, the profiler elsewhere."""
    options = (options or Options()).resolved()
    mapping = options.mapping
    if mapping is None:
        mapping = detect_mapping([c for c in df.columns if c != options.order_by])
    return (run_ledger if is_ledger(mapping) else run_universal)(df, options)
