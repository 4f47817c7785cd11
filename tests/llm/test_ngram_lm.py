"""Language-model scores against a plain traversal with dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from faultline.llm import ngram_lm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), END]


def brute(rows):
    """Counts in dictionaries; probabilities by backing off from the longest history."""
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = {n: Counter(tuple(x[j : j + n]) for x in train for j in range(len(x) - n + 1)) for n in (1, 2, 3)}
    total, vocabulary = sum(c[1].values()), len(c[1])
    kept = {n: dict(c[n]) for n in (1, 2, 3)}
    arcs = {}
    for n in (2, 3):
        once, twice = (sum(k == m for k in kept[n].values()) for m in (1, 2))
        discount = min(0.95, max(0.5, once / max(1, once + 2 * twice)))
        for g, k in kept[n].items():
            arcs.setdefault(g[:-1], {})[g[-1]] = (k - discount) / c[n - 1][g[:-1]]

    def base(w):
        return (c[1][(w,)] + 0.5) / (total + 0.5 * (vocabulary + 1))

    def p(w, history):
        if not history:
            return base(w)
        if w in arcs.get(history, {}):
            return arcs[history][w]
        return weight(history) * p(w, history[1:])

    weights = {}

    def weight(history):
        if history not in weights:
            here = arcs.get(history, {})
            weights[history] = (1 - sum(here.values())) / (1 - sum(p(w, history[1:]) for w in here))
        return weights[history]

    out = {}
    for i, text in rows:
        x, score, history = tokens(text), 0.0, ()
        for w in x:
            score += math.log10(p(w, history))
            history = (*history, w)[-2:]
            while history and history not in kept[len(history)]:
                history = history[1:]
        out.setdefault(i, []).append((zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(x), sum(c[1][(w,)] > 0 for w in x), total, sum(math.log10(base(w)) for w in x), score))
    return out, arcs, p, c


def check(docs, rows, **options):
    want, *_ = brute(rows)
    got = {}
    for r in ngram_lm.score_documents(docs, **options).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rows)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a", "A a A", "the cat the cat the cat sat", "the cat sat on É é", "x " * 30_000, "the the the", "cat sat the cat", "é"])] + [(None, "the cat"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id bigint, text string, word string, score double")
    check(docs, rows)
    assert ngram_lm.score_documents(docs.where("false")).collect() == []
    only = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1]
    if only:
        found = ngram_lm.score_documents(spark.createDataFrame(only, "doc_id bigint, text string")).collect()
        assert all(r["base_score"] == 0 and r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in found)


def test_arcs_and_backoff_sum_to_one():
    """Over every history, the probabilities of all known words and of the unknown one sum to 1."""
    rows = [(r["doc_id"], r["text"][:400]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:40]]
    _, arcs, p, c = brute(rows)
    words = [w for (w,) in c[1]]
    unknown = object()
    for history in list(arcs)[:25]:
        assert sum(p(w, history) for w in words) + p(unknown, history) == pytest.approx(1)


def test_small_blocks(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rows, block=3_000)


def test_held_out_texts_gain_from_histories(spark):
    rows = ngram_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["score"] - r["base_score"] for r in rows]) > 0


def large_rows():
    """Given documents and a training text that alone has 2.5 million tokens: a share of 1e-6 is more than two occurrences."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    filler = next(i for i in range(10**6, 10**6 + 50) if zlib.crc32(str(i).encode()) % 5 != 1)
    return [*rows, (filler, "x " * 2_500_000)]


def test_rare_ngrams_stay_in_large_corpora(spark):
    rows = large_rows()
    want, *_ = brute(rows)
    got = {}
    for r in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_discounts_are_those_of_all_ngrams_in_large_corpora(spark):
    """Text of 2.5 million tokens: what is taken off follows from the n-grams that occur once and twice, not from the bounds."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:60]), "x " * 2_500_000, " ".join(words[:20])]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = list(zip(ids, texts))
    train = [tokens(t) for _, t in rows]
    c = {n: Counter(tuple(x[j : j + n]) for x in train for j in range(len(x) - n + 1)) for n in (1, 2, 3)}
    off = {}
    for n in (2, 3):
        once, twice = (sum(k == m for k in c[n].values()) for m in (1, 2))
        off[n] = once / (once + 2 * twice)
        assert ngram_lm.DISCOUNTS[0] < off[n] < ngram_lm.DISCOUNTS[1]
    assert sum(c[1].values()) > 2_500_000
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    total, vocabulary = sum(c[1].values()), len(c[1])
    for i, x in zip(ids, train):
        want = math.log10((c[1][(x[0],)] + 0.5) / (total + 0.5 * (vocabulary + 1))) + math.log10((c[2][(x[0], x[1])] - off[2]) / c[1][(x[0],)])
        want += sum(math.log10((c[3][tuple(x[j - 2 : j + 1])] - off[3]) / c[2][tuple(x[j - 2 : j])]) for j in range(2, len(x)))
        assert got[i] == pytest.approx(want, rel=1e-9)
