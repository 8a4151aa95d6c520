import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import negative_mining as nm
from tallymark.llm.queries import QUERIES, SQL

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=100):
    """rows: (id, label, vector) that take part."""
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]

    def ranked(found):
        return sorted(found, key=lambda x: (-x[1], x[0]))

    out = []
    for a, lab, q in whole:
        if a % every:
            continue
        scores = [(i, sum(x * y for x, y in zip(q, v)), other == lab) for i, other, v in whole if i != a]
        for p, ps, _ in ranked(s for s in scores if s[2])[:5]:
            under = ranked(s for s in scores if not s[2] and 80 * ps <= 100 * s[1] <= 100 * ps)[:5]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, ns, _) in enumerate(under)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_bounds_hold_and_exclude_most_of_a_clustered_table():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 96)) * 60
    which = rng.integers(0, 20, 3000)
    rows = np.floor(centres[which] + rng.standard_normal((3000, 96)) * 12)
    rows[5] = 0
    queries = rows[:40]
    turn = nm.rotation(96)
    low, high = nm.Planes(queries, turn).bounds(nm.Codes(rows, turn), 96, slice(0, 40))
    true = queries @ rows.T
    assert (low <= true).all() and (true <= high).all()
    tenth = np.sort(true, axis=1)[:, -10][:, None]
    assert (high[:5] >= tenth[:5]).mean() < 0.2


def test_query_matches_the_plain_version_and_its_sql(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = rows_of(QUERIES["op12_negative_mining"](spark, sf))
    assert got == plain(rows) and got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(NAMES)} FROM ({SQL['op12_negative_mining']})").fetchall()) == got


def test_several_blocks_and_steps_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 5) / 256]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3)
    monkeypatch.setattr(nm, "ANCHORS", 30)
    monkeypatch.setattr(nm, "STEP", 64)
    monkeypatch.setattr(nm, "QUERIES_AT_ONCE", 7)
    assert rows_of(nm.mine(df, F.col("id") % 10 == 0)) == plain(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (3, 1, [1.0]), (4, 2, [0.9, 0.5]), (5, 2, [0.9, 0.5]), (6, 3, []), (8, 2, [-1.0, 0.0])]
    bad = [(None, 1, [1.0]), (10, None, [1.0]), (11, 1, None), (12, 2, [1.0, None]), (13, 2, [nan]), (14, 2, [inf, 1.0]), (200, 1, [nan])]
    again = [(5, 2, [0.9, 0.5]), (4, 3, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + bad + again], "vec_id bigint, label int, embedding array<float>, id string")
    padded = [(i, lab, [*v, 0.0, 0.0][:2]) for i, lab, v in good]
    f32 = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in padded]
    assert rows_of(nm.mine(df, F.col("id") % 100 == 0)) == plain(f32)
    assert nm.mine(df.limit(0), F.col("id") % 100 == 0).collect() == []
    assert nm.mine(df.where("vec_id = 4"), F.col("id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(0, 1, [1e30])], "vec_id bigint, label int, embedding array<float>")
    with pytest.raises(Exception, match="62 bits"):
        nm.mine(huge, F.col("id") == 0).collect()
