import re

from tallymark.llm.bm25_wand import RATIO, build, search, split_text
from tallymark.llm.queries import QUERIES


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)


def grams(w, n):
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def contains(w, part):
    n = min(5, len(part))
    own = grams(part, n) if n else set()
    return not own or len(own & grams(w, n)) >= 0.8 * len(own)


def test_finds_what_whole_texts_contain(spark):
    sf = "/root/testdata/sf0.01"
    parts = {r.item_id: (terms(r.question), terms(r.answer)) for r in split_text(spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    longest = max(len(q) + len(a) for q, a in parts.values())
    rows = QUERIES["op4_bm25_wand"](spark, sf).collect()
    docs = {r.doc_id: terms(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    hits = 0
    for r in rows:
        w, want = docs[r.doc_id], set()
        step = max(32, longest)
        for at in range(0, max(1, len(w) - step), step):
            own = w[at:at + 2 * step]
            want |= {i for i, (q, a) in parts.items() if own and contains(own, q) and contains(own, a)}
        assert set(r.item_ids) == want, r.doc_id
        assert r.contaminated == bool(want)
        hits += len(want)
    assert hits > 20


def test_wand_equals_full_scores(spark):
    items = split_text(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    (index,) = build(items)
    by_item = {}
    for t, blocks in enumerate(index.postings):
        for own, shares, top in blocks.values():
            assert top == max(shares)
            for i, s in zip(own, shares):
                by_item.setdefault(i, {})[t] = s
    for i in by_item:
        assert abs(sum(by_item[i].values()) - 1) < 1e-9
    for i in range(len(by_item)):
        query = sorted(set(by_item[i]) | set(list(by_item[(i + 7) % len(by_item)])[::2]))
        want = {j for j, own in by_item.items() if sum(own.get(t, 0) for t in query) >= RATIO}
        assert {j for j, _ in index.search(query, list(range(index.tops.shape[1])))} == want


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six", "seven eight"), (1, "one two three four five six", "seven eight"),
                                   (2, None, ""), (None, "a b", "c"), (3, "Zwei", "Wörter")], "item_id int, question string, answer string")
    text = "x " * 5000
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, text + "One two, three four five six: seven eight!" + text, 3),
                                  (3, "zwei wörter", 4), (None, "zwei wörter", 5)], "doc_id bigint, text string, leaks_of int")
    got = sorted((r.leaks_of, r.leaks["items"]) for r in search(docs, items).collect())
    assert got == [(1, []), (2, []), (3, [1]), (4, [3]), (5, [3])]
    assert search(docs.limit(0), items).collect() == []
    assert {tuple(r.leaks["items"]) for r in search(docs, items.limit(0)).collect()} == {()}


def test_one_edit_at_every_place(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, want = [], {}
    for r in items.collect():
        own = terms(r.text)
        whole = grams(own, 5)
        for i in range(len(own)):
            edited = [*own[:i], "zzedit", *own[i + 1:]]
            key = f"{r.item_id}/{i}"
            rows.append((key, " ".join(["pre", *edited, "post"])))
            want[key] = len(whole & grams(edited, 5)) >= 0.8 * len(whole)
        rows.append((f"{r.item_id}/-", r.text))
        want[f"{r.item_id}/-"] = True
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    parts = split_text(items)
    got = {r.doc_id: {str(x) for x in r.leaks["items"]} for r in search(docs, parts).collect()}
    assert {k: k.rsplit("/", 1)[0] in v for k, v in got.items()} == want
    assert sum(want.values()) > len(rows) / 2


def test_one_edit_in_a_short_answer(spark):
    question = [f"q{i}" for i in range(40)]
    answer = "seven red foxes ran home".split()
    items = spark.createDataFrame([(1, " ".join(question), " ".join(answer))], "item_id int, question string, answer string")
    rows = [(i, " ".join([*question, *answer[:i], "other", *answer[i + 1:]])) for i in range(5)]
    rows += [(5, " ".join([*question, *answer[:2], "so", *answer[2:]])), (6, " ".join([*question, *reversed(answer)])),
             (7, " ".join([*question, *answer[:2], *["far"] * 9, *answer[2:]])), (8, " ".join([*question, *answer[:3]]))]
    got = {r.doc_id: r.leaks["items"] for r in search(spark.createDataFrame(rows, "doc_id int, text string"), items).collect()}
    assert got == {i: [1] if i < 6 else [] for i in range(9)}
