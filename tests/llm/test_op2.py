import random
import re

import numpy as np

from tallymark.llm import robust_outliers as ro
from tallymark.llm.queries import QUERIES
from tallymark.llm.robust_outliers import base_statistics, judge


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, k = len(w), len(repeated)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), k, n < 20 or 100 * k > 30 * n


def test_base_and_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op2_robust_outliers"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts:
        r = rows[t.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t.text)
        assert not (r.kept and r.base_failed)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    print(sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) >= 0.995 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_outliers_are_found_though_many(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        w = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(80, 200))]
        if i % 3 == 0:
            w = [x + "###" if rng.random() < 0.8 else x for x in w]
        rows.append((i, " ".join(w), "en", "s"))
    got = judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", None, 0), (3, "a\n" * 30, None, "s", 0), (3, "a\n" * 30, None, "s", 0),
            (None, "w x " * 200_000, "en", "s", 0), (5, " ".join(f"w{i}" for i in range(100)), None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, w int")
    got = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in base_statistics(df).collect())
    assert got == sorted((str(i), *plain(t)) for i, t, *_ in rows)
    judged = {r.doc_id: r.kept for r in judge(df).collect()}
    assert judged == {1: False, 2: False, 3: False, None: False, 5: True}
    assert judge(df.limit(0)).collect() == []


def plain_mcd(x, rng, starts=200):
    """Least log determinant (of the factor) that concentration steps from many random subsets reach, and the mean there."""
    floors, best = np.diag(np.square(ro.FLOORS)), (np.inf, None)
    for _ in range(starts):
        own = x[rng.choice(len(x), 6, replace=False)]
        size = np.inf
        while True:
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) * ro.CONSISTENT + floors
            now = np.linalg.slogdet(cov)[1] / 2
            if len(own) > 6 and now >= size - 1e-9:
                break
            size = now if len(own) > 6 else size
            d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d)[: -(-len(x) // 2)]]
        best = min(best, (size, tuple(mean)))
    return best


def test_least_determinant_is_found(spark):
    rng = np.random.default_rng(5)
    groups = {}
    for k, (share, shift) in enumerate([(0.0, 0), (0.3, 6), (0.42, 9), (0.45, -4)]):
        mix = rng.standard_normal((4, 4))
        x = rng.standard_normal((400, 4)) @ mix
        # As wide as the others: a tight cluster of nearly half would have the least determinant itself.
        x[: int(share * 400)] += shift
        groups[f"g{k}"] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    sizes = {}
    real = ro._concentrated

    def watched(*args):
        out = real(*args)
        for r in out.collect():
            g = r.g.split(" ", 1)[1]
            sizes[g] = min(sizes.get(g, np.inf), r["size"])
        return out

    ro._concentrated = watched
    try:
        found = {r.g: r for r in ro.estimates(rows).collect()}
    finally:
        ro._concentrated = real
    for g, x in groups.items():
        size, _ = plain_mcd(x, rng)
        assert sizes[g] <= size + 0.05, g
        good = x[int({"g0": 0.0, "g1": 0.3, "g2": 0.42, "g3": 0.45}[g] * 400):]
        assert np.abs(np.array([found[g][f"m{i}"] for i in range(4)]) - good.mean(axis=0)).max() < 0.8, g


def test_small_groups_are_judged_by_their_language(spark):
    rng = random.Random(1)

    def text(mark=""):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) + mark for _ in range(rng.randrange(80, 200)))

    rows = [(i, text(), "en", "big") for i in range(300)] + [(1000 + i, text("###"), "en", "tiny") for i in range(3)]
    rows += [(2000 + i, text(), "en", "small") for i in range(3)] + [(3000, text(), "fr", None), (3001, text("###"), "fr", None)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert {i for i, kept in got.items() if not kept} == {1000, 1001, 1002, 3001}


def test_ties_and_all_failing(spark):
    same = [(i, "one two three " * 2 + " ".join(f"w{k}" for k in range(30)), "en", "s") for i in range(80)] + [(99, "few words", "de", "t")]
    got = judge(spark.createDataFrame(same, "doc_id int, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id != 99) for r in got)
    none = judge(spark.createDataFrame([(1, "few words", "de", "t")], "doc_id int, text string, lang string, source string")).collect()
    assert [(r.doc_id, r.kept, r.distance) for r in none] == [(1, False, None)]
