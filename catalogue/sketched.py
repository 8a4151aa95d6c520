"""Queries on sketched profiles, whose bounds are checked against exact figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymark.functions.text import quoted
from tallymark.operators.profile import VALUE, Profile, with_values
from tallymark.operators.sketches import Sketched, sketched, state
from tallymark.plans.universal import sanitise
from tallymark.streaming.profiled import profile_stream, stream_profile

from . import sqltext as q
from .files import scratch, write_drops
from .fixture import ledger_raw
from .ledger import query
from .universal import DOCUMENTS, EVENTS, LEDGER, ORDERS, Source, profile_sql, profiled


def _share_of_ranks(rows: DataFrame, sketch: Sketched, s: Source) -> dict[str, tuple[float, float]]:
    """Shares of a column's numbers that lie below its sketched median, and not above it."""
    prof = sketch.profile
    names = [p.name for p in prof.of("Numeric")]
    if not names:
        return {}
    rows, aggs = with_values(rows, prof.types, s.options.resolved()), []
    for i, c in enumerate(names):
        value, median = quoted(VALUE + c).cast("double"), prof[c].stats["median"]
        aggs += [(F.count_if(value < median) / F.count(value)).alias(f"below{i}"),
                 (F.count_if(value <= median) / F.count(value)).alias(f"upto{i}")]
    r = rows.agg(*aggs).first()
    return {c: (r[f"below{i}"], r[f"upto{i}"]) for i, c in enumerate(names)}


def _top_in_bound(found: list[int], true: list[int], off: float) -> bool:
    """Counts in descending order, each at most ``off`` too high; only rare ones may be missing."""
    close = all(t - 0.5 <= f <= t + off + 0.5 for f, t in zip(found, true, strict=False))
    return close and all(t <= 2 * off for t in true[len(found):])


def in_bounds(rows: DataFrame, sketch: Sketched, exact: Profile, s: Source) -> DataFrame:
    ranks, out = _share_of_ranks(rows, sketch, s), []
    for p in sketch.profile.columns:
        b, e = sketch.bounds[p.name], exact[p.name]
        below, upto = ranks.get(p.name, (0.5, 0.5))
        out.append((p.name, p.type, p.non_null, p.nulls, b.unique[0] <= e.unique <= b.unique[1],
                    below - b.rank <= 0.5 <= upto + b.rank,
                    _top_in_bound([n for _, n in p.top], [n for _, n in e.top], b.count)))
    return rows.sparkSession.createDataFrame(
        out, "`Column` string, `Detected Type` string, `Non-Null` bigint, `Missing` bigint, "
             "`Unique in Bound` boolean, `Median in Bound` boolean, `Top in Bound` boolean")


_IN_BOUNDS = """SELECT col AS "Column", type AS "Detected Type", filled AS "Non-Null",
  nulls AS "Missing", true AS "Unique in Bound", true AS "Median in Bound",
  true AS "Top in Bound" FROM types"""

for _s in (ORDERS, EVENTS, DOCUMENTS):
    @query("sketch_profile_" + _s.name, profile_sql(_s, _IN_BOUNDS))
    def _(spark, sf, s=_s):
        rows = sanitise(s.read(spark, sf), s.options)
        return in_bounds(rows, sketched(state(rows, s.options)), profiled(spark, sf, s), s)


@query("sketch_numeric_stats", profile_sql(EVENTS, 'SELECT s.col AS "Column", filled AS "Count", ' + ", ".join(
    f'{q.cents("s." + c)} AS "{n}"' for c, n in (("total", "Sum"), ("mean", "Mean"), ("lo", "Min"),
                                                 ("hi", "Max"), ("std", "Std Dev")))
    + ', nulls AS "Missing" FROM stats s JOIN types t USING (col)'))
def _(spark, sf):
    rows = sanitise(EVENTS.read(spark, sf), EVENTS.options)
    return sketched(state(rows, EVENTS.options)).profile.numeric().drop("Median")


@query("stream_profile", profile_sql(LEDGER, _IN_BOUNDS))
def _(spark, sf):
    """The dirty ledger in five drops; four of their states are merged on the way."""
    path, out, rows = scratch(spark, "drop"), scratch(spark, "states"), ledger_raw(spark, sf)
    files = write_drops(rows, F.pmod("row_id", F.lit(5)), 5, path)
    profile_stream(spark, path, rows.schema, out, scratch(spark, "progress"), LEDGER.options,
                   maxFilesPerTrigger=files).awaitTermination()
    clean = sanitise(rows, LEDGER.options)
    return in_bounds(clean, stream_profile(spark, out), profiled(spark, sf, LEDGER), LEDGER)
