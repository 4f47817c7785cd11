"""Packing and token counts against the tokenizers library run on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import packing, token_counts
from faultline.llm.common import tokenizer_path
from faultline.llm.pieces import Pieces, spaced_units, word_units
from faultline.llm.words import text_bytes

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "a", "a b", "  two  spaces\t\ttab \n\n end ", "it's we'll 'S don'T x's", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "é è\u00a0nbsp \u0085x \u2028y\u3000z",
       "e\u0301 \u0301x É", "12 345 6,789.0 ½ ²", "日本語 テスト", "🙂 🙂🙂 a🙂", "\u00a0 a \u00a0", "A\nB\r\nC", "x" * 5000, "word " * 6000, " lead", "trail ", "a\n\nb", "a \nb", "a\n b", "İstanbul ΑΣ Σ"]


def brute_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_rows(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", 2), (3, "\n", "again", 3)], "doc_id bigint, text string, n_tokens string, _id int")


def test_token_counts_equal_the_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = odd_rows(spark).select("doc_id", "text").collect()
    got = token_counts.token_counts(odd_rows(spark), path).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(brute_ids(tokenizer, r["text"])), len(brute_ids(tokenizer, r["text"])) > 1024) for r in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.read.parquet(f"{SF}/documents.parquet"), path).collect()}
    assert got == {r["doc_id"]: len(brute_ids(tokenizer, r["text"])) for r in table}
    assert token_counts.token_counts(odd_rows(spark).where("false"), path).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\u00a0\u0085\u2003\u3000aBé'sñ1½,.<|>endoftx🙂\u0301", max_size=30), max_size=4))
def test_units_join_to_the_whole(texts):
    import pyarrow as pa

    for name, units in (("byte_bpe_50k.json", spaced_units), ("word_bpe_49k.json", word_units)):
        pieces = _pieces(name)
        data, offsets = text_bytes(pa.array(texts, pa.string()), 0, len(texts))
        if not len(data):
            continue
        starts, ends = units(data, offsets)
        entry = pieces.look_up(data, starts, ends)
        for i, text in enumerate(texts):
            mine = [entry[j] for j in range(len(starts)) if offsets[i] <= starts[j] < offsets[i + 1]]
            ids = [x for e in mine for x in pieces.ids[pieces.first[e] : pieces.first[e] + pieces.counts[e]]]
            assert ids == brute_ids(pieces.tokenizer, text)


_cache = {}


def _pieces(name):
    if name not in _cache:
        _cache[name] = Pieces(tokenizer_path(name), ids=True, limit=500)
    return _cache[name]


def check_packing(rows, texts, path, capacity):
    tokenizer = Tokenizer.from_file(path)
    sequences = defaultdict(list)
    for r in rows:
        ids = np.array([*brute_ids(tokenizer, texts[r["doc_id"]]), 1], "<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and r["length"] == len(part) == min(capacity, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing(spark):
    path = tokenizer_path("word_bpe_49k.json")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), path, partition_rows=40).collect()
    n = check_packing(rows, texts, path, 4096)
    total = sum(r["length"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == sum(-(-sum(r["length"] for r in rows if r["doc_id"] == d) // 4096) for d in texts)
    assert n <= -(-total // 4096) + 1


def test_packing_odd_rows(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack_documents(odd_rows(spark).where("doc_id is not null"), path, capacity=100, partition_rows=5).collect()
    check_packing(rows, dict(enumerate(ODD)), path, 100)
    assert sorted({r["doc_id"] for r in rows}) == list(range(len(ODD))) and len([r for r in rows if r["doc_id"] == 3]) == 2
    assert [r["length"] for r in packing.pack_documents(odd_rows(spark).where("doc_id is null"), path).collect()] == [3]
    assert packing.pack_documents(odd_rows(spark).where("false"), path).collect() == []
    with_ids = packing.pack_documents(odd_rows(spark).where("doc_id = 5"), path, with_ids=True).collect()[0]
    assert with_ids["ids"] == [*brute_ids(Tokenizer.from_file(path), "a b"), 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=12))
def test_bound_and_best_fit(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    found = packing.best_fit_decreasing(lengths, 20)
    assert max(np.bincount(found, weights=lengths)) <= 20
    assert packing.lower_bound(lengths, 20) <= optimum(lengths.tolist(), 20) <= found.max() + 1


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in sorted(set(range(len(bins))), key=lambda j: bins[j]):
            if bins[j] + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("gap", [0, 3])
def test_exchange_never_adds_sequences(spark, gap):
    lengths = [60] * (20 + gap) + [41, 39, 38, 22, 20, 19] * 10
    pieces = spark.createDataFrame([(i, 0, n, 0) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint, ids_crc32 bigint")
    many = packing.pack(pieces, 100, partition_rows=10).select("sequence_id").distinct().count()
    one = packing.pack(pieces, 100, partition_rows=1000).select("sequence_id").distinct().count()
    assert packing.lower_bound(np.array(lengths), 100) <= one <= many <= one + 2
