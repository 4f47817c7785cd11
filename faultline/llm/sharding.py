"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id).  The splitters are found by counting, over all partitions, the exact bytes below
candidate keys, and looking closer at the intervals that hold a splitter until it lies within its tolerance.  Only then are rows exchanged,
once, to the ranges between splitters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultline.llm.common import written

STEP_BITS = 12
SHIFTS = (52, 40, 28, 16, 4, 0)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Ranges that are found at most; what the driver holds is bounded by this times the probes of a step.
MAX_RANGES = 1024
RANGE_BYTES = 64 << 20


def _splitters(rows: DataFrame, targets: list[tuple[float, float]], total: int) -> list[tuple[int, int]]:
    """A key (k1, k2) per target (bytes below, tolerance): rows from this key on lie to the right.

    A step divides each open interval into 2 ** STEP_BITS and counts the bytes of each part.  The second key is looked at only inside one
    value of the first, that is within a group of equal texts.
    """
    out: dict[int, tuple[int, int]] = {}
    open_: dict[tuple, list[tuple[int, float]]] = {(): [(i, t) for i, (t, _) in enumerate(targets)]}  # interval: targets, counted from its start
    for key in ("k1", "k2"):
        for step, shift in enumerate(SHIFTS):
            if not open_:
                break
            known = [*((F.col("k1"),) if key == "k2" else ()), *((F.shiftright(key, SHIFTS[step - 1]),) if step else ())]
            names = [f"_c{i}" for i in range(len(known))]
            found = rows.select(*[c.alias(n) for c, n in zip(known, names)], F.shiftright(key, shift).alias("_part"), "_size")
            if names:
                found = found.where(F.col(names[0]).isin([x[0] for x in open_]))
            if len(names) == 2:
                found = found.where(F.col("_c1").isin([x[1] for x in open_]))
            parts: dict[tuple, list] = {}
            for row in found.groupBy(*names, "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows")).collect():
                inside = tuple(row[n] for n in names)
                if inside in open_:
                    parts.setdefault(inside, []).append((row["_part"], row["_bytes"], row["_rows"]))
            deeper: dict[tuple, list[tuple[int, float]]] = {}
            for inside, wanted in open_.items():
                below, waiting = 0, sorted(wanted, key=lambda x: x[1])
                for part, size, n in sorted(parts[inside]):
                    while waiting and waiting[0][1] <= below + size:
                        i, at = waiting.pop(0)
                        nearest = min(at - below, below + size - at)
                        last = n == 1 or (key == "k2" and shift == 0)
                        if nearest > targets[i][1] and not last:
                            next_inside = (inside[0], part) if key == "k2" else (part,)
                            deeper.setdefault(next_inside, []).append((i, at - below))
                            continue
                        edge = (part if at - below <= below + size - at else part + 1) << shift
                        out[i] = (edge, LOWEST) if key == "k1" else (inside[0], edge)
                    below += size
            open_ = deeper
    return [(min(a, HIGHEST), min(b, HIGHEST)) for _, (a, b) in sorted(out.items())]


def histogram_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: Sequence = (), tolerance: float = 0.001) -> DataFrame:
    """Every document with its shard: ``id_col``, the ``carry`` columns, ``size``, ``shard``, ``slot`` (gapless from 0 in the shard).

    ``size`` is the text's UTF-8 bytes plus one (a null text has none).  A splitter is accepted when its bytes differ from the ideal by
    ``tolerance`` of a shard; otherwise it is taken between two rows, the nearer way.  Equal texts are neighbours; a group is cut only where
    a splitter can't avoid it.  Null ids sort by the hash of null; rows that repeat id and text have one key and stay together.  An empty
    table gives none.  ``carry`` holds column names or expressions over the documents (the text itself, for instance).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_none"), *carry).alias("_carry"), size.alias("_size"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col(id_col)).alias("k2"))
    rows = written(rows, "sharding")
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    per_shard = max(1, min(MAX_RANGES // n_shards, -(-total // (n_shards * RANGE_BYTES))))  # ranges that a task can sort
    ranges, shard = n_shards * per_shard, total / n_shards
    targets = [(total * i / ranges, shard * (tolerance if i % per_shard == 0 else 0.02 / per_shard)) for i in range(1, ranges)]
    splitters = _splitters(rows, targets, total) if total else []

    # A table of at most 4096 rows: of each part of the first step, the range that it starts in and the splitters inside it.
    top = SHIFTS[0]
    inside: dict[int, list] = {}
    for s in splitters:
        inside.setdefault(s[0] >> top, []).append(s)
    lookup, before = [], 0
    for part in range(-(1 << 63 - top), 1 << 63 - top):
        lookup.append((part, before, inside.get(part, [])))
        before += len(inside.get(part, []))
    table = docs.sparkSession.createDataFrame(lookup, "_part bigint, _before int, _splits array<struct<a: bigint, b: bigint>>")
    placed = rows.withColumn("_part", F.shiftright("k1", top)).join(F.broadcast(table), "_part")
    passed = F.expr("_before + size(filter(_splits, s -> s.a < k1 or (s.a = k1 and s.b <= k2)))")
    placed = placed.withColumn("_range", passed).drop("_part", "_before", "_splits")

    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts = [(r, r // per_shard, sum(counts.get(x, 0) for x in range(r - r % per_shard, r))) for r in range(ranges)]
    starts = docs.sparkSession.createDataFrame(starts, "_range int, shard int, _start bigint")
    order = Window.partitionBy("_range").orderBy("k1", "k2")
    numbered = placed.withColumn("_row", F.row_number().over(order)).join(F.broadcast(starts), "_range")
    out = numbered.select(F.col("_id").alias(id_col), "_carry.*", F.col("_size").alias("size"), "shard", (F.col("_start") + F.col("_row") - 1).alias("slot"))
    return out.drop("_none")
