"""The pipeline stage by stage on its own input, against brute force."""

import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import test_ngram_jaccard  # noqa: E402
import test_token_operators  # noqa: E402
from faultline.llm.common import tokenizer_path, written  # noqa: E402

SF = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents before the first and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontaminate", "pack"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = texts(stages[0]), texts(stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    insults = {"idiot", "loser", "pathetic", "scum", "worthless", "disgusting", "clown", "moron", "stupid", "trash"}
    gone = set(before) - set(after)
    assert gone and all(after[i] == before[i] for i in after)
    assert not [i for i in gone if labels.get(i) == 0]
    insulting = [i for i in before if insults & set(before[i].translate(FOLD).split())]
    assert len([i for i in insulting if i in gone]) >= 0.95 * len(insulting)


def test_exact_copies(stages):
    before, after = texts(stages[1]), texts(stages[2])
    keep = {}
    for i, t in before.items():
        keep[t.translate(FOLD)] = max(i, keep.get(t.translate(FOLD), i))
    assert after == {i: before[i] for i in keep.values()}


def test_near_copies(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert after == {i: before[i] for i, _, component in test_ngram_jaccard.brute(list(before.items())) if i == component}


def test_benchmark(stages):
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))

    windows = set()
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    before, after = texts(stages[3]), texts(stages[4])
    clean = {}
    for i, t in before.items():
        w = words(t)
        if not any(tuple(w[j : j + m]) in windows for m in lengths for j in range(len(w) - m + 1)):
            clean[i] = t
    assert after == clean and len(clean) < len(before)


def test_packed(stages):
    kept = texts(stages[4])
    rows = stages[5].collect()
    n = test_token_operators.check_packing(rows, kept, tokenizer_path("word_bpe_49k.json"), 4096)
    assert {r["doc_id"] for r in rows} == set(kept) and n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    long_ = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "same text"), (4, "Same TEXT"), (None, "only this"), (5, "twice the row"), (5, "twice the row"), (6, long_), (7, long_ + " more"), (8, " \n ")]
    spark.createDataFrame([(i, t, None, "s", None, "x", 1, "c") for i, t in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, _id int, cid string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert name == "pack" or docs.columns == columns
        kept.append(sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect()))
    every = sorted(str(i) for i, _ in rows)
    once = sorted(["2", "4", "None", "5", "6", "7", "8"])
    assert kept[0] == every and kept[1] == once and kept[2] == kept[3] == sorted(["2", "4", "None", "5", "6", "8"])
    assert set(kept[4]) == set(kept[3])
