"""Near-duplicate components against brute force over all pairs."""

import random
import re

import pyarrow.parquet as pq
import pytest

from faultline.llm import components, ngram_jaccard

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(id, set size, component) of rows (id, text), comparing the distinct sets pair by pair."""
    sets = sorted({shingle_set(t) for _, t in rows} - {frozenset()}, key=len)
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    holders = {}
    for s in sets:
        for x in s:
            holders.setdefault(x, []).append(s)
    for s in sets:
        for other in {o for x in s for o in holders[x]}:
            if other is not s and 100 * len(s & other) >= 80 * len(s | other):
                parent[root(s)] = root(other)
    least = {}
    for i, t in rows:
        s = shingle_set(t)
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted(((i, len(shingle_set(t)), least.get(root(shingle_set(t))) if shingle_set(t) else i) for i, t in rows), key=str)


def got(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_components(docs).collect()), key=str)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    assert got(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == brute(rows)


def family(seed, copies, words, edits, vocabulary=5000, chain=False):
    """Copies of one text with random words replaced, dropped or added; in a chain each is a copy of the one before."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = [base]
    for _ in range(copies):
        text = list(out[-1] if chain else base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            if kind == 0:
                text[at] = f"x{rng.randrange(50)}"
            elif kind == 1 and len(text) > 3:
                del text[at]
            else:
                text.insert(at, f"y{rng.randrange(50)}")
        out.append(text)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("seed", range(3))
def test_families_of_near_copies(spark, seed):
    rng = random.Random(seed)
    texts = family(seed, 150, 100, 4) + family(seed + 10, 60, 60, 3, chain=True) + family(seed + 20, 80, 30, 2, vocabulary=12) + family(seed + 30, 40, 6, 1) + family(seed + 40, 30, 300, 12)
    passage = family(99, 0, 40, 0)[0]
    texts += [f"{passage} {t}" for t in family(seed + 50, 60, 9, 5, vocabulary=300)] + [passage] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_odd_rows(spark):
    long_ = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four"), (8, "a b c d e"), (8, "a b c d e"), (8, "other text under the same id"), (None, "a b c d e"), (None, "only null"),
            (9, long_), (10, long_ + " more"), (11, long_[: len(long_) // 2]), (12, " x É"), (13, " X É")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, cid string, n int")
    assert got(docs) == brute(rows)
    assert got(docs.where("false")) == []
    kept = ngram_jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 8, 9, 11, 12]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components.component_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.component_labels(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
