"""Header mapping and routing: decisions on column names, taken on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..constants import CANONICAL, HEADER_ALIASES, LEDGER_MARKERS
from ..functions.text import is_blank, quoted


@dataclass(frozen=True)
class MappedTable:
    df: DataFrame
    mapping: dict[str, str]
    extras: list[str]


def norm_header(name: str) -> str:
    """Lower case, every run of other characters one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def detect_mapping(headers: list[str]) -> dict[str, str]:
    """Canonical column -> raw header. Exact aliases win over contained ones,
    earlier canonicals over later ones, and no header serves twice."""
    by_name = {norm_header(h): h for h in headers}
    mapping: dict[str, str] = {}

    def claim(canonical, candidates):
        free = (h for h in candidates if h not in mapping.values())
        header = next(free, None)
        if header is not None:
            mapping[canonical] = header

    for canonical, aliases in HEADER_ALIASES.items():
        claim(canonical, (by_name[a] for a in aliases if a in by_name))
    for canonical, aliases in HEADER_ALIASES.items():
        if canonical not in mapping:
            claim(canonical, (h for n, h in by_name.items() if any(a in n for a in aliases)))
    return mapping


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None,
                order_by: str | None = None) -> MappedTable:
    """All canonical columns (null when unmapped), then ``EXTRA_<header>``."""
    headers = [c for c in df.columns if c != order_by]
    mapping = detect_mapping(headers) if mapping is None else dict(mapping)
    extras = [h for h in headers if h not in mapping.values()]
    chosen = [quoted(mapping[c]).alias(c) if c in mapping
              else F.lit(None).cast("string").alias(c) for c in CANONICAL]
    chosen += [quoted(h).alias(f"EXTRA_{h}") for h in extras]
    if order_by:
        chosen.append(quoted(order_by))
    return MappedTable(df.select(*chosen), mapping, extras)


def is_ledger(mapping: dict[str, str]) -> bool:
    """Money plus at least two other ledger markers."""
    return "Amount" in mapping and sum(c in mapping for c in LEDGER_MARKERS) >= 3


def schema_report(df: DataFrame, mapping: dict[str, str] | None = None,
                  order_by: str | None = None) -> DataFrame:
    """Canonical Column, Source Header, Status and the cells filled, one row
    per canonical column and per extra. One aggregate over the table."""
    spark = df.sparkSession
    mapped = map_columns(df, mapping, order_by)
    sources = [(c, mapped.mapping.get(c)) for c in CANONICAL]
    sources += [(f"EXTRA_{h}", h) for h in mapped.extras]
    fields = {f.name: f.dataType for f in df.schema.fields}
    counts = [F.count_if(~is_blank(quoted(h), fields[h])) if h else F.lit(0).cast("bigint")
              for _, h in sources]
    rows = [F.struct(F.lit(name).alias("Canonical Column"),
                     F.lit(h or "— not found —").alias("Source Header"),
                     F.lit("Extra" if name.startswith("EXTRA_") else
                           "Mapped" if h else "Missing").alias("Status"),
                     F.col(f"n{i}").alias("Filled"))
            for i, (name, h) in enumerate(sources)]
    filled = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)])
    return filled.select(F.inline(F.array(*rows)))


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip headers, name the blank ones ``Column_<i>``, number repeats."""
    names: list[str] = []
    for i, raw in enumerate(df.columns, start=1):
        name = base = raw.strip() or f"Column_{i}"
        n = 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return df.toDF(*names)


def route_table(name: str, df: DataFrame) -> DataFrame:
    """One row: table, mode, mapped columns, rows."""
    mapping = detect_mapping(df.columns)
    mode = "sales" if is_ledger(mapping) else "universal"
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), F.lit(mode).alias("mode"),
        F.lit(len(mapping)).cast("bigint").alias("mapped"), "rows")
