"""Benchmark overlaps against brute force over all windows."""

import hashlib
import random
import re

import pytest

from faultline.llm import decontaminate

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, item string, _n int")
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id bigint, text string, _id string, fp int")
    return sorted((tuple(r) for r in decontaminate.contamination(d, b).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30 if seed else 4)]  # few words: repeated grams and ties of their hashes
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25, 60])))) for i in range(40)]
    docs = []
    for i in range(150):
        text = [rng.choice([*vocabulary, *(f"z{j}" for j in range(200))]) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            if w:
                a = rng.randrange(len(w))
                at = rng.randrange(len(text) + 1)
                text[at:at] = w[a : a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", "-", ", "]).join(text)))
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (1, passage), (2, "É ñ"), (3, None), (4, ""), (5, "..."), (None, "null item of exactly ten words in its text here yes"), (6, "single"), (10, passage + " more")]
    docs = [(1, None), (2, ""), (3, passage.upper()), (4, passage[: len(passage) - 14]), (5, "a É-ñ b"), (6, "é ñ"), (7, "single single"), (8, "x " * 200_000 + passage + " y" * 10), (9, "null item of exactly ten words in its text here yes"),
            (None, passage), (3, "other text of the same id"), (3, passage.upper()), (11, "one\x00two three4 five")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], items) == []


def test_spans_are_where_the_words_are(spark):
    item = " ".join(f"i{n}" for n in range(40))
    text = "a b c " + " ".join(f"i{n}" for n in range(5, 30)) + " d"
    _, spans = decontaminate.overlaps(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    covered = {p for r in spans.collect() for p in range(r["start"], r["end"])}
    assert covered == set(range(3, 28)) and {r["item"] for r in spans.collect()} == {7}


def test_drop_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "clean text", "en"), (2, " ".join(f"i{n}" for n in range(12)), "en"), (None, "also clean", None)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, " ".join(f"i{n}" for n in range(12)))], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
