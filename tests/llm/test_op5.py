import hashlib
import random
from collections import Counter

import numpy as np

from tallymark.llm import suffix_runs
from tallymark.llm.queries import QUERIES
from tallymark.llm.suffix_runs import merged, remove_repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p:p + length], []).append((i, p))
    gone = [bytearray(len(b)) for b in raw]
    for own in seen.values():
        if len(own) > 1:
            for i, p in own:
                gone[i][p:p + length] = b"\1" * length
    out = []
    for b, g in zip(raw, gone):
        spans = sum(g[i] and not (i and g[i - 1]) for i in range(len(g)))
        out.append((len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


def plain(texts, length):
    """As brute, on more texts: by the hash of each string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[p:p + length]) for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for p in range(len(b) - length + 1):
            if seen[hash(b[p:p + length])] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((gone & ~np.concatenate(([False], gone))[:len(b)]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_more_documents_and_what_is_left(spark):
    sf = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {t.doc_id: w for t, w in zip(texts, plain([t.text for t in texts], 400))}
    for r in QUERIES["op5_suffix_runs"](spark, sf).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
        assert r.kept_text == want[r.doc_id][4].decode("utf-8", "replace")


def test_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join([*words[30_000:31_000], "x", *words[100:400], "y", "same " * 3_000]), "z" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert rows(remove_repeats(df)) == sorted((i, *w[:4]) for i, w in enumerate(plain(texts, 400)))


def test_windows_with_equal_hashes_are_compared(monkeypatch):
    rng = random.Random(6)
    group = {("".join(rng.choices("ab", k=60)).encode(), b"cc"): 1 for _ in range(6)}
    group |= {(next(iter(group))[0][:50] + b"q" * 10, b"dc"): 1}
    for width in (1, 1000):
        monkeypatch.setattr(suffix_runs, "slice_hash", lambda sums, s, e, w=width, real=suffix_runs.slice_hash: real(sums, s, e) % np.uint64(w) if w == 1 else real(sums, s, e))
        windows = suffix_runs._Windows(group, 40)
        assert (windows.repeated() == windows._compared()).all() and windows.repeated().any()


def rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_documents(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([t.text for t in texts], 400)
    assert sum(w[1] > 0 for w in want) > 5
    assert rows(QUERIES["op5_suffix_runs"](spark, sf)) == sorted((t.doc_id, *w) for t, w in zip(texts, want))


def test_common_passages_and_edges(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(suffix_runs, "HOT", 16)

    def noise(n):
        return "".join(rng.choices("abcdeé ", k=n))

    core, other = noise(90), noise(60)
    texts = [noise(rng.randrange(0, 80)) + core[rng.randrange(0, 20):rng.randrange(50, 91)] + noise(rng.randrange(0, 80)) for _ in range(120)]
    texts += [noise(30) + other + noise(5) + other + noise(30), "ab" * 100, "a" * 41, "a" * 40, other, other, None, "", core]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, digest string")
    assert rows(remove_repeats(df, length=40, gram=20)) == sorted((i, *w) for i, w in enumerate(brute(texts, 40)))


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(2).choices("abcdef", k=900))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:500] + "x")], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    assert got == {(1, 900, 1), (None, 500, 1)}
    assert remove_repeats(df.limit(0)).collect() == []


def test_loser_tree():
    rng = random.Random(4)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted("".join(rng.choices("ab", k=rng.randrange(1, 9))).encode() for _ in range(rng.randrange(0, 30))) for _ in range(k)]

        def coded(run):
            for i, s in enumerate(run):
                yield s, suffix_runs._common(run[i - 1], s, 0) if i else 0, b"", []

        out = list(merged([coded(r) for r in runs]))
        assert [s for s, *_ in out] == sorted(s for r in runs for s in r)
        for (a, *_), (b, common, *_) in zip(out, out[1:]):
            assert common == suffix_runs._common(a, b, 0)
