import hashlib
import random
import zlib

import numpy as np
import pytest

from tallymark.llm import period_runs
from tallymark.llm.queries import QUERIES

from .brute import WORD


def plain_runs(words, least=6, times=4):
    """Every maximal stretch with a period, by trying each period; the smallest period of a stretch counts."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, times * q):
                best.setdefault((s, length), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def runs_of(texts, least=6, times=4):
    return period_runs._step([t.encode().split() for t in texts], least, times)


@pytest.mark.parametrize("least,times", [(6, 4), (3, 2), (9, 3), (4, 2)])
def test_random_words_match_every_period(least, times):
    rng = random.Random(least * 10 + times)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(1, 80):
            part = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            words += part * rng.choice([1, 1, 2, 3, 4, 5, 9])
        texts.append(" ".join(words))
    assert runs_of(texts, least, times) == [plain_runs(t.split(), least, times) for t in texts]


def test_long_and_deep_repeats():
    one = ["x"] * 30_000
    cycle = [f"w{i}" for i in range(7_000)] * 5
    nested = (["a", "b"] * 6 + ["c"]) * 900
    got = runs_of([" ".join(one), " ".join(cycle[:-3]), " ".join(nested)])
    assert got[0] == [(0, 30_000, 1)]
    assert got[1] == [(0, 34_997, 7_000)]
    assert (0, 11_700, 13) in got[2] and len(got[2]) == 901


def test_blocks_of_places_stay_ordered():
    rng = random.Random(3)
    values = rng.sample(range(10**6), 6_000)
    places = period_runs.Places(values[0])
    for x in values[1:]:
        places.add(x)
    assert list(places) == sorted(values) and places.size == 6_000 and len(places.blocks) > 3
    known = np.array(sorted(values))
    for x in rng.sample(sorted(set(range(10**6)) - set(values)), 300):
        k = int(np.searchsorted(known, x))
        assert places.around(x) == (known[k - 1] if k else None, known[k] if k < len(known) else None)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_every_period_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = [tuple(r[c] for c in NAMES) for r in QUERIES["op11_period_runs"](spark, sf).collect()]
    assert sorted(got) == sorted(expected(r.doc_id, r.text) for r in rows)
    assert sum(r[1] for r in got) > 10


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (None, "a a a a a a a", 5), (4, "a " * 6, 1), (4, "a " * 6, 1), (5, "a " * 5, None),
            (6, " x " * 8, 1), (24, "one two three four five six seven eight nine ten", 1), (26, "q " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in NAMES) for r in QUERIES["op11_period_runs"](spark, str(tmp_path)).collect()]
    short = [r for r in rows if r[0] != 26]
    assert sorted((g for g in got if g[0] != 26), key=str) == sorted((expected(i, t) for i, t, _ in short), key=str)
    long = next(g for g in got if g[0] == 26)
    assert long[1:6] == (1, 0, 50_000, 1, 50_000_000)
    found = period_runs.find_runs(docs.where("doc_id = 4")).collect()
    assert [(r.length, r.runs.n_words, [tuple(x) for x in r.runs.found], r.runs.collapsed) for r in found] == [(1, 6, [(0, 6, 1)], "a")] * 2
    assert period_runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        period_runs.find_runs(docs, into="length")
