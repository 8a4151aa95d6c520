import zlib

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import rule_ensemble
from tallymark.llm.queries import QUERIES
from tallymark.llm.rule_ensemble import fit, scored


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = (QUERIES["op7_rule_ensemble"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in kept) >= 0.97 * len(kept)
    bad = [r for r in kept if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 1.0), (3, "a word", 1.0), (3, "a word", 1.0), (None, "x", 0.0),
                                  (4, "long " * 100_000, 0.0)], "doc_id bigint, text string, words double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    model = fit(docs, labels)
    got = scored(docs, model)
    assert got.columns == ["doc_id", "text", "words", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 6
    nothing = fit(docs, labels.where(F.lit(False)))
    assert {r.score for r in scored(docs, nothing).collect()} == {0.5}
    assert scored(docs.limit(0), model).collect() == []


def test_number_of_trees(monkeypatch):
    roots, grow = [], rule_ensemble._grow

    def counted(binned, rows, grad, hess, path, depth, out):
        if not path:
            roots.append(len(rows))
        grow(binned, rows, grad, hess, path, depth, out)

    monkeypatch.setattr(rule_ensemble, "_grow", counted)
    rng = np.random.default_rng(1)
    binned = rng.integers(0, rule_ensemble.BINS, (400, 4)).astype(np.uint8)
    assert rule_ensemble._paths(binned, (binned[:, 0] > 9).astype(float))
    assert roots == [400] * 40


def test_compiled_score_is_that_of_the_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = rule_ensemble.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stats = {r.doc_id: r for r in rule_ensemble.with_statistics(docs.select("doc_id", "text"), "text").collect()}
    assert len(model.rules) > 5
    for r in rule_ensemble.scored(docs, model).collect():
        total = model.bias
        for weight, rule in model.rules:
            values = [(stats[r.doc_id][f"__stat_{name}"], bound, below) for name, bound, below in rule]
            total += weight * all((v <= bound) == below for v, bound, below in values)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
