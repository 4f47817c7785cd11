"""The trie of conversations against a plain one in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import conversation_trie as ct
from faultline.llm import queries
from faultline.llm.tree_contraction import subtree_totals

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, conv string, block int, _keys int, words string, t1 string"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for *_, role, _, text in sorted(v)] for c, v in convs.items()}
    members, path_of = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path_of[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path_of[c]) + 1):
            members[path_of[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, saved + sum(totals[k][1] for k in kids[p]))
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(path_of[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def answer(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z") for r in rows], SCHEMA)
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op11_conversation_trie"](spark, str(tmp_path))
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: (r[1], r[0]))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 45), 60, 61, 79, 101, 102, 2047, 2048]:  # 80 and 100 are absent
        if c == 40:
            continue
        lines = [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\tc", "", None, "ü é", "x " * 500])) for _ in range(rng.randint(1, 6))]
        rows += [(c, t if rng.random() < 0.9 else None, *line) for t, line in enumerate(lines)]
    rows += [(7, 0, "user", "a b")] * 3 + [(8, 2, "user", "tie one"), (8, 2, "user", "tie two"), (None, 0, "user", "nobody"), (-21, 0, "user", "a b")]
    rows += [(c, t, "user", f"deep {t}") for c in (200, 201, 203) for t in range(70 if c < 203 else 33)]
    return rows


def test_trie_of_odd_conversations(spark, tmp_path):
    rows = conversations(1)
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_many_copies_of_one_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ct, "ID_BITS", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)] + [(1, 9, "user", "more")]
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_no_conversations(spark, tmp_path):
    assert answer(spark, [], tmp_path) == []
    assert answer(spark, [(None, 0, "user", "a")], tmp_path) == []


def test_long_conversations_are_read_in_blocks(spark):
    rows = [(c, t, "user", f"t{t}" if c < 3 or t < 8000 else "else") for c in (1, 2, 3) for t in range(9000)]
    turns = ct.ordered_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    keys = ct.prefixes(turns).groupBy("depth", "k1", "k2").agg(F.count("*").alias("n"), F.count_distinct("p1", "p2").alias("p"))
    got = {(r.depth, r.n): r.p for r in keys.collect()}
    assert got == {**{(d, 3): 1 for d in range(1, 8001)}, **{(d, n): 1 for d in range(8001, 9001) for n in (1, 2)}}


@pytest.mark.parametrize("shape", ["chain", "bush", "random", "caterpillar"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    parent = {i: {"chain": i - 1, "bush": 0, "random": rng.randrange(i), "caterpillar": i - 1 if i % 2 else i - 2}[shape] for i in range(1, 120)}
    depth, value = {0: 0}, {i: rng.randrange(9) for i in range(120)}
    for i in sorted(parent):
        depth[i] = depth[parent[i]] + 1
    rows = [(i, parent.get(i), depth[i], value[i] or None, 1) for i in depth] + [(500, None, 0, 4, 1), (501, 500, 3, 5, 1)]
    total, size = {**value, 500: 9, 501: 5}, {**dict.fromkeys(depth, 1), 500: 2, 501: 1}
    for i in sorted(parent, reverse=True):
        total[parent[i]] += total[i]
        size[parent[i]] += size[i]
    tree = spark.createDataFrame(rows, "node bigint, parent bigint, depth bigint, v bigint, n bigint")
    assert {r.node: (r.v, r.n) for r in subtree_totals(tree, ["v", "n"]).collect()} == {i: (total[i], size[i]) for i in total}


def test_totals_of_no_tree(spark):
    assert subtree_totals(spark.createDataFrame([], "node bigint, parent bigint, depth bigint, v bigint"), ["v"]).count() == 0
