"""Readers on files, and scores worked out by hand."""

import io
import json
import math
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from faultline.functions import tickets as T
from faultline.operators import retrieval, scoring, telemetry
from faultline.sources import logs, records
from faultline.sources import tickets as source
from faultline.sources import traces


def test_read_logs_numbers_lines_across_splits(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %d\r\n" % i for i in range(1, 5001)) + b"bad \xff byte")
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.png").write_text("no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = logs.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r.log_id.rsplit("/", 1)[-1], {})[r.line_no] = r.line
    assert set(by_file) == {"a.log", "b.txt"}
    assert by_file["b.txt"] == {1: "one", 2: "", 3: "two"}
    assert all(by_file["a.log"][i] == f"line {i}" for i in range(1, 5001)) and by_file["a.log"][5001].startswith("bad ")


def test_read_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("logs/app.log", "a\nb\n")
        z.writestr("../evil.log", "no")
        z.writestr("image.png", "no")
    for name, mode in (("y.tar.gz", "w:gz"), ("y.tar.bz2", "w:bz2"), ("y.tar", "w"), ("y.tgz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            info = tarfile.TarInfo("dmesg")
            info.size = 3
            t.addfile(info, io.BytesIO(b"k\nm"))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "broken.tar.gz").write_bytes(b"not a tar")
    got = {(r.log_id.rsplit("/", 1)[-1], r.member, r.line_no, r.line) for r in logs.read_log_archives(spark, str(tmp_path), batch_lines=1).collect()}
    want = {("x.zip", "logs/app.log", 1, "a"), ("x.zip", "logs/app.log", 2, "b")}
    want |= {(n, "dmesg", i, x) for n in ("y.tar.gz", "y.tar.bz2", "y.tar", "y.tgz") for i, x in ((1, "k"), (2, "m"))}
    assert got == want


def test_read_tickets(spark, tmp_path):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Netflix"}, {"type": "text", "text": "freezes"}]}]}
    fields = {"summary": "S", "description": tree, "priority": {"name": "Major"}, "labels": ["x"], "created": "2024-01-01T00:00:00.000+0000",
              "attachment": [{"id": "7", "filename": "a.zip", "size": 5, "mimeType": "application/zip", "content": "http://x"}]}
    (tmp_path / "t.json").write_text(json.dumps({"key": "K-1", "fields": fields}, indent=2))
    (tmp_path / "u.json").write_text(json.dumps({"key": "K-2", "fields": {"summary": "plain", "description": "text only", "priority": None}}))
    out = {r.ticket_id: r for r in source.read_tickets(spark, str(tmp_path)).collect()}
    assert (out["K-1"].description, out["K-1"].priority, out["K-1"].streaming_app) == ("Netflix freezes", "P1", "Netflix")
    assert (out["K-2"].description, out["K-2"].priority, out["K-2"].labels) == ("text only", "P2", [])
    attached = source.ticket_attachments(source.read_tickets(spark, str(tmp_path))).collect()
    assert [(a.ticket_id, a.attachment_id, a.size, a.url) for a in attached] == [("K-1", "7", 5, "http://x")]


def test_read_source_maps(spark, tmp_path):
    for app, version, name in (("n", "1", "z.js.map"), ("n", "1", "bundle.js.map"), ("n", "2", "b.js.map"), ("n", "2", "a.js.map")):
        folder = tmp_path / "maps" / app / version
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text('{"version":3}')
    (tmp_path / "maps" / "n" / "2.js.map").write_text("{}")
    (tmp_path / "maps" / "n" / "3.js.map").write_text("{}")
    out = {(r.app, r.version): r.file.rsplit("/", 1)[-1] for r in traces.read_source_maps(spark, str(tmp_path / "maps")).collect()}
    assert out == {("n", "1"): "bundle.js.map", ("n", "2"): "2.js.map", ("n", "3"): "3.js.map"}


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "fix_id long, updated_at long, error_category string")
    newer = spark.createDataFrame([(1, 2, "C"), (3, 1, "C")], "fix_id long, updated_at long, error_category string")
    records.write_records(records.upsert_records(rows, newer, "fix_id"), str(tmp_path / "r"))
    got = {(r.fix_id, r.error_category) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {(1, "C"), (2, "B"), (3, "C")}


def _signals(spark, **over):
    base = {"llm_confidence": 0.75, "retrieval_similarity": 0.60, "validation_score": 0.80, "historical_success_rate": 0.70,
            "reproduction_bonus": 0.10, "on_device_passed": False, "on_device_boost": 0.0}
    return spark.createDataFrame([{**base, **over}], ", ".join(f"{k} {'boolean' if k == 'on_device_passed' else 'double'}" for k in base))


def test_ensemble(spark):
    raw = 0.2 * 0.75 + 0.2 * 0.6 + 0.35 * 0.8 + 0.15 * 0.7 + 0.1 * 0.1
    row = scoring.ensemble_score(_signals(spark)).first()
    assert row.raw_score == pytest.approx(raw) and row.calibrated_score == pytest.approx(1 / (1 + math.exp(-raw)))
    boosted = scoring.ensemble_score(_signals(spark, on_device_passed=True, on_device_boost=0.25), 2.0, -1.0).first()
    assert boosted.raw_score == pytest.approx(raw + 0.25)
    assert boosted.calibrated_score == pytest.approx(1 / (1 + math.exp(-(2 * (raw + 0.25) - 1))))


@pytest.mark.parametrize("p, ensemble, generator", [(0.85, "AUTO_PR", "AUTO_PR"), (0.62, "ANALYSIS_ONLY", "PR_WITH_REVIEW"), (0.42, "ESCALATE_HUMAN", "ANALYSIS_ONLY")])
def test_confidence_routes(spark, p, ensemble, generator):
    row = spark.range(1).select(scoring.route_confidence(F.lit(p)), scoring.route_confidence(F.lit(p), "generator")).first()
    assert tuple(row) == (ensemble, generator)


def test_platt_finds_the_fit(spark):
    data = [(x / 100, 1 / (1 + math.exp(-(6 * x / 100 - 3))) > ((x * 37) % 100) / 100) for x in range(100) for _ in range(3)]
    row = scoring.fit_platt(spark.createDataFrame(data, "raw_score double, success boolean")).first()
    assert row.sample_count == 300 and 4 < row.platt_a < 9 and -5 < row.platt_b < -1.5


@pytest.mark.parametrize("data", [[], [(0.2, True), (0.9, True)], [(0.1, False), (0.2, False), (0.7, True)], [(0.5, True), (0.5, False), (0.5, True)], [(None, True), (float("nan"), False), (0.3, None)],
                                  [(0.2, False), (0.5, False), (0.5, True), (0.9, True)], [(3e6, True), (1e6, False), (2e6, True), (2.5e6, False)]])
def test_platt_of_odd_histories(spark, data):
    row = scoring.fit_platt(spark.createDataFrame(data, "raw_score double, success boolean")).first()
    good = [(x, y) for x, y in data if x is not None and not math.isnan(x) and y is not None]
    assert row.sample_count == len(good) and math.isfinite(row.platt_a) and math.isfinite(row.platt_b)
    if not good:
        assert (row.platt_a, row.platt_b) == (1.0, 0.0)
        return
    ones = [x for x, y in good if y]
    zeros = [x for x, y in good if not y]
    overlap = ones and zeros and max(zeros) > min(ones) and max(ones) > min(zeros)
    target = {True: 1.0, False: 0.0} if overlap else {True: (len(ones) + 1) / (len(ones) + 2), False: 1 / (len(zeros) + 2)}
    miss = [1 / (1 + math.exp(-(row.platt_a * x + row.platt_b))) - target[y] for x, y in good]
    assert abs(sum(miss)) < 1e-6 and abs(sum(m * x for m, (x, _) in zip(miss, good, strict=True))) < 1e-6 * max(abs(x) for x, _ in good)


@pytest.mark.parametrize("age, category, variant, low, high", [
    (1, "EME_DRM_FAILURE", "memory", 0.98, 1.0), (365, "COMPANION_LIB_TIMING", "memory", 0.0, 0.5), (365, "OTHER", "memory", 0.499, 0.501),
    (90, "OTHER", "router", 0.499, 0.501)])
def test_decay(spark, age, category, variant, low, high):
    now = F.lit("2024-06-01").cast("timestamp")
    df = spark.range(1).select(F.lit(1.0).alias("score"), F.lit(category).alias("error_category"),
                               (now - F.expr(f"INTERVAL {age} DAYS")).alias("created_at"))
    assert low < retrieval.temporal_decay(df, now, variant=variant, created="created_at").first().decay_weight < high


def test_fusion_prefers_ids_in_both_lists(spark):
    sparse = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    dense = spark.createDataFrame([(1, "d", 1), (1, "b", 2)], "query_id int, id string, rank int")
    out = retrieval.rrf_fuse(sparse, dense).orderBy(F.desc("score")).collect()
    assert len(out) == 4 and out[0].id == "b" and out[0].score == pytest.approx(1 / 62)


def test_dense_search_in_parts_and_with_match(spark):
    recs = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], "x" if i % 2 else "y") for i in range(60)], "id int, vector array<double>, cat string")
    asks = spark.createDataFrame([(q, [float(q), 1.0, 0.5], "x" if q % 2 else None) for q in range(7)], "query_id int, vector array<double>, cat string")
    whole = retrieval.dense_search(asks, recs, 4, match=["cat"]).collect()
    parts = retrieval.dense_search(asks, recs, 4, match=["cat"], block_floats=6).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts)) and len(whole) == 28
    cats = {r.id: r.cat for r in recs.collect()}
    assert all(cats[r.id] == "x" for r in whole if r.query_id % 2)


def test_spike_alert(spark):
    now = F.lit("2024-01-08").cast("timestamp")
    rows = spark.range(1680 + 400).select(
        F.when(F.col("id") < 400, now - F.expr("INTERVAL 10 MINUTES")).otherwise(now - F.make_interval(hours=2 + F.col("id").cast("int") % 160)).alias("ts"),
        (F.col("id") % 200).alias("user_id"), F.lit("netflix").alias("app"), F.lit("none").alias("layer"), F.lit("none").alias("chipset"),
        F.lit("none").alias("error_category"))
    row = telemetry.proactive_spikes(rows, now).first()
    assert (row.dimension, row.value, row.affected_users, row.priority, row.error_count) == ("app", "netflix", 200, "high", 9600)
    assert row.spike_factor == pytest.approx(400 / ((1680 + 400) / 168))


def test_steps_and_names(spark):
    df = spark.createDataFrame([("a.LOG", "5.2.1", "5.2.0"), ("kernel", "5.2.1", None), ("x.png", "5.2", "6.1"), (".log", "v", "v")], "n string, d string, r string")
    got = [tuple(r) for r in df.select(T.is_log_file("n"), T.firmware_compatible("d", "r")).collect()]
    assert got == [(True, True), (True, True), (False, False), (False, True)]
