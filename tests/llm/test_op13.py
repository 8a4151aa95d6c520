import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.llm import kd_shards
from tallymark.llm.queries import QUERIES


def plain_tree(points, dims, shards):
    """points: dicts with size, coordinates and ties. {row: shard}, by sorting each part and cutting at the nearest row."""
    whole = {d: max(p[d] for p in points) - min(p[d] for p in points) for d in dims}
    out = {}

    def part(rows, first, last):
        if first == last:
            out.update((p["row"], first) for p in rows)
            return
        count = last - first + 1
        left = []
        if rows:
            share = {d: (max(p[d] for p in rows) - min(p[d] for p in rows)) / max(1, whole[d]) for d in dims}
            dim = max(dims, key=lambda d: share[d])
            rows = sorted(rows, key=lambda p: (p[dim], *(p[t] for t in kd_shards.TIES)))
            goal, total = sum(p["size"] for p in rows) * (count // 2) / count, 0
            for k, p in enumerate(rows):
                if total + p["size"] >= goal or k + 1 == len(rows):
                    k += not goal - total < total + p["size"] - goal
                    left, rows = rows[:k], rows[k:]
                    break
                total += p["size"]
        part(left, first, first + count // 2 - 1)
        part(rows, first + count // 2, last)

    part(points, 0, shards - 1)
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_matches_a_tree_of_sorted_parts(spark, sf, shards):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, dims = kd_shards.points(docs, "doc_id", "text", ("source", "lang"))
    want = plain_tree([r.asDict() for r in rows.collect()], dims, shards)
    root = kd_shards.grow(rows, dims, shards)
    assert {r["row"]: r["s"] for r in rows.select("row", root.leaf().alias("s")).collect()} == want


def test_query_keeps_its_laws(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = QUERIES["op13_kd_shards"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots, held = defaultdict(list), Counter()
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    mean, most = sum(held.values()) / 40, max(r["size"] for r in got)
    assert max(held.values()) <= mean + 1.5 * most


def hot(spark, n=6000):
    """A third of the rows share a text, half a source; sizes are small, so shards can be even."""
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same words")).otherwise(F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "id")).alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("one")).otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"), F.lit("x").alias("size"), F.lit(1).alias("shard"))


def test_hot_text_and_source_leave_shards_even(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "BUCKET_ROWS", 30)
    got = kd_shards.shard(hot(spark), 13).collect()
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 13


def test_reruns_and_file_layout_do_not_matter(spark):
    rows = hot(spark, 900)
    one = sorted(kd_shards.shard(rows.repartition(5), 6).collect())
    assert one == sorted(kd_shards.shard(rows.coalesce(1), 6).collect())


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, None, None, None), (None, "", "s", None), (7, "a", None, "en"), (7, "a", None, "en"), (8, "é" * 900, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = kd_shards.shard(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert kd_shards.shard(docs.limit(0), 4).collect() == []
    assert {r.shard for r in kd_shards.shard(docs.select("doc_id", "text"), target_bytes=500).collect()} <= set(range(4))
    plan = kd_shards.shard(docs, 4)
    with pytest.raises(ValueError, match="unique"):
        kd_shards.write(docs, f"{tmp_path}/no", plan)
    own = hot(spark, 300)
    plan = kd_shards.shard(own, 3)
    kd_shards.write(own, f"{tmp_path}/out", plan)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()) == sorted((r.doc_id, r.shard) for r in plan.collect())
    words = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    assert sorted(r["size"] for r in kd_shards.shard(words, 2).collect()) == [17, 17, 17]


def test_rounds_share_their_plans(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, dims = kd_shards.points(docs, "doc_id", "text", ("source", "lang"))
    plans, extents = [], kd_shards._extents

    def watched(at, dims):
        plans.append(len(at._jdf.queryExecution().optimizedPlan().toString()))
        return extents(at, dims)

    monkeypatch.setattr(kd_shards, "_extents", watched)
    kd_shards.grow(rows, dims, 40)
    assert len(plans) == 6 and max(plans) < 3 * min(plans), "a level's plan must not hold the tree above it"
