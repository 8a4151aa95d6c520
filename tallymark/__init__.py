"""Cleaning, validation and profiling of tabular data as Spark plans."""

from .constants import Options
from .operators.audit import audit
from .operators.explore import (filter_category, filter_choices, filter_view, preview,
                                raw_preview, search)
from .operators.keyed import drop_or_flag_duplicates
from .operators.profile import infer_types, profile, standardise
from .operators.report import (breakdown_share, daily_trend, flag_breakdown, revenue_totals,
                               status_pivot, top_clients, trend)
from .operators.schema import clean_headers, detect_mapping, is_ledger, map_columns
from .operators.sketches import Accuracy, sketched
from .plans.ledger import clean_ledger, run_ledger
from .plans.router import run
from .plans.universal import run_universal
from .session import tune
from .sources.delimited import read_delimited, read_ordered, source_metadata
from .sources.dirty import dirty_ledger
from .sources.sinks import append_history, export_clean, export_report, read_history
from .streaming.ingest import flag_stream, ingest_stream
from .streaming.profiled import profile_stream, stream_profile

__all__ = [n for n in dir() if not n.startswith("_")]
