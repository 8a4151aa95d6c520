import math
import re

from tallymark.llm.entropy_mix import mix
from tallymark.llm.queries import QUERIES


def water_fill(sizes):
    """sizes: {source: words}; None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def check(rows, texts):
    sizes, want = {}, {}
    for i, (source, text) in texts.items():
        want[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + want[i]
    aim, taken, biggest = water_fill(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        source = texts[r.doc_id][0]
        assert r["size"] == want[r.doc_id] and r.source_size == sizes[source]
        assert math.isclose(r.target, aim[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
        biggest[source] = max(biggest[source], r["size"])
    for s, t in taken.items():
        assert abs(t - aim[s]) <= biggest[s] + 1e-3 * aim[s], (s, t, aim[s])


def test_targets_and_words_on_documents(spark, sf):
    texts = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_entropy_mix"](spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    again = QUERIES["op6_entropy_mix"](spark, sf).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def test_rates_solve_the_dual(spark, sf):
    rows = mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert math.isclose(sum(r.rate * r["size"] for r in own), own[0].target, rel_tol=1e-6)
        tilts = {round(math.log(r.rate) / r["size"], 6) for r in own if 0 < r.rate < 2 and r["size"] > 200}
        assert len(tilts) <= 2


def test_odd_rows(spark):
    rows = [(i, "a b c d", "x", 0) for i in range(3000)] + [(5000, None, None, 0), (5001, "", "empty", 0),
                                                             (5002, "w " * 40000, "y", 0), (5003, "w", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    check(mix(df).collect(), {i: (s, t) for i, t, s, _ in rows})
    assert mix(df.limit(0)).collect() == []
    assert [r.taken for r in mix(df.where("doc_id = 5001")).collect()] == [0]
