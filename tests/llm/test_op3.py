import random

from tallymark.llm import circulant_minhash
from tallymark.llm.circulant_minhash import near_duplicates
from tallymark.llm.queries import QUERIES

from .brute import near_components


def _rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_matches_brute_force_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, c, i == c) for i, (n, c) in near_components(rows, 3, 85).items())
    assert _rows(QUERIES["op3_circulant_minhash"](spark, sf)) == want


def test_family_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text[: rng.randrange(100, 121)])))
    want = sorted((i, n, c, i == c) for i, (n, c) in near_components(rows, 3, 85).items())
    got = _rows(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == want


def copies(n, seed, drop=False):
    """Near copies of one text, edited so much that many of them are linked to nobody."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(2000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            k = rng.randrange(len(text))
            text[k:k + 1] = [] if drop and rng.random() < 0.5 else [f"x{rng.randrange(10**7)}"]
        rows.append((i, " ".join(text)))
    return rows


def test_edits_that_have_nothing_in_common_never_meet(spark, monkeypatch):
    met = []
    linked = circulant_minhash._linked

    def count(pairs, sets, threshold):
        met.append(pairs.count())
        return linked(pairs, sets, threshold)

    monkeypatch.setattr(circulant_minhash, "_linked", count)
    for n in (200, 400, 800):
        near_duplicates(spark.createDataFrame(copies(n, 1), "doc_id bigint, text string")).count()
    # Each node meets a bucket's centre at most; all pairs of 800 would be 319,600.
    assert all(m <= circulant_minhash.BANDS * n for m, n in zip(met[::2], (200, 400, 800), strict=True))
    assert all(m <= n // 10 for m, n in zip(met[1::2], (200, 400, 800), strict=True))


def test_family_with_shared_edits(spark):
    rows = copies(120, 2, drop=True)
    # Members of a second family share a changed middle; some bridge both.
    rng = random.Random(3)
    for i in range(120, 200):
        words = rows[rng.randrange(5)][1].split()
        for k in range(40, 40 + rng.choice([4, 8, 12, 16])):
            words[k] = f"other{k}"
        words[rng.randrange(len(words))] = f"y{i}"
        rows.append((i, " ".join(words)))
    want = sorted((i, n, c, i == c) for i, (n, c) in near_components(rows, 3, 85).items())
    assert _rows(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def test_very_long_texts(spark):
    words = [f"w{i % 9973}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "new", *words[150_000:]])), (3, " ".join(words[::-1]))]
    want = sorted((i, n, c, i == c) for i, (n, c) in near_components(rows, 3, 85).items())
    assert _rows(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def test_odd_rows(spark):
    rows = [(5, "A b", 1), (2, "a B", 1), (7, None, 1), (8, " \n", 1), (9, "a b c", 1), (9, "a b c", 1), (None, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1, 2, False), (2, 1, 2, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True),
                          (9, 1, 9, True), (None, 1, None, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []
