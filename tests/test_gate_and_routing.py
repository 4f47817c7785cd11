"""Hand-worked rows for the time window, the gate, incidents and routing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.functions import lines as L
from faultline.operators import filters, incidents, matching
from faultline.rules.enriched import ENRICHED_PATTERNS
from faultline.rules.patterns import ROUTER_PATTERNS, Pattern


def lines_of(spark, lines, log="a"):
    return spark.createDataFrame([(log, i, x) for i, x in enumerate(lines, 1)], "log_id string, line_no long, line string")


def service(ts, text):
    return f"dtv_svc[123]: [{ts:%Y-%m-%d %H:%M:%S.%f}] {text}"


def gate(df):
    return L.with_timestamp(df, "gate")


ANCHOR = datetime(2024, 12, 17, 12)


def test_time_window_keeps_continuations_and_stops_at_first_late_line(spark):
    df = gate(lines_of(spark, [
        "leading line without time", service(ANCHOR - timedelta(hours=30), "too early"), "    at early.frame",
        service(ANCHOR, "in window"), "    at com.example.MyClass.method()", service(ANCHOR + timedelta(hours=24), "edge"),
        service(ANCHOR + timedelta(hours=30), "late"), service(ANCHOR, "lost behind the late line")]))
    out = filters.time_window(df, F.lit(ANCHOR), 24).orderBy("line_no").collect()
    assert [r.line_no for r in out] == [4, 5, 6]
    assert out[1].ts == ANCHOR


@pytest.mark.parametrize("n, passed", [(50, True), (2, False)])
def test_quality_gate(spark, n, passed):
    df = gate(lines_of(spark, [service(ANCHOR + timedelta(minutes=i), f"[ERROR] Error {i}") for i in range(n)]))
    row = filters.quality_gate(df).first()
    assert row.passed is passed and row.kept_lines == n and row.timestamp_coverage == 1.0
    assert row.score == pytest.approx(0.4 + 0.4 + 0.2 * n / 100)
    assert bool(row.reasons) is not passed


def test_gate_keeps_tickets_without_lines(spark):
    df = gate(lines_of(spark, ["[ERROR] x"]))
    ids = spark.createDataFrame([("a",), ("empty",)], "log_id string")
    row = filters.quality_gate(df, expected=ids, file_id="line_no").where("log_id = 'empty'").first()
    assert not row.passed and row.score == 0.0 and "No log files provided" in row.reasons


@pytest.mark.parametrize("text, level", [
    ("[WARN] x", "WARNING"), ("level=err", "ERROR"), ("FATAL boom", "CRITICAL"), ("errors only", None), ("crit", "CRITICAL")])
def test_levels(spark, text, level):
    assert lines_of(spark, [text]).select(L.log_level("line")).first()[0] == level


@pytest.mark.parametrize("text, strict, expected", [
    ("2024-03-15T10:30:00Z up", False, datetime(2024, 3, 15, 10, 30)), ("2024-03-15T10:30:00Z up", True, None),
    ("2024-03-15T10:30:00+05:00 up", False, datetime(2024, 3, 15, 5, 30))])
def test_iso_in_gate_profile(spark, text, strict, expected):
    assert L.with_timestamp(lines_of(spark, [text]), "gate", strict=strict).first().ts == expected


def test_first_layout_found_decides_in_multi_profile(spark):
    # The ISO text is no date, and the kernel time behind it is not tried.
    row = L.with_timestamp(lines_of(spark, ["2024-13-45T10:00:00 12-17 10:00:00.5"]), "multi").first()
    assert row.ts is None and row.ts_format == "iso8601"


def incident_rows(spark, seconds):
    base = datetime(2024, 3, 15, 10, 30)
    return spark.createDataFrame([("a", i, f"ERROR crash {i}", base + timedelta(seconds=s)) for i, s in enumerate(seconds, 1)],
                                 "log_id string, line_no long, line string, ts timestamp")


@pytest.mark.parametrize("seconds, n", [(range(0, 30, 5), 1), ([0, 5, 300, 305], 2), ([0, 60, 120], 1), ([0, 61], 2), ([100, 0, 10], 1)])
def test_incidents(spark, seconds, n):
    assert incidents.incidents_lines(incident_rows(spark, seconds)).count() == n


def test_missing_timestamp_breaks_an_incident(spark):
    rows = [("a", 1, "ERROR a", datetime(2024, 1, 1)), ("a", 2, "panic b", None), ("a", 3, "fail c", datetime(2024, 1, 1))]
    out = incidents.incidents_lines(spark.createDataFrame(rows, "log_id string, line_no long, line string, ts timestamp"))
    assert [(r.incident_id, r.severity) for r in out.orderBy("incident_id").collect()] == [(1, "medium"), (2, "critical"), (3, "medium")]


@pytest.mark.parametrize("lines, layer, confidence", [
    (["ERROR: Segmentation fault at 0x12345678", "null pointer dereference"], "LOKI", 1.0),
    (["ERROR: EME error: MediaKeySession error creation failed"], "HTML5", 1.0),
    (["sigsegv", "fetch timeout"], "CROSS_LAYER", 0.80),
    (["watchfree deeplink lost"], "CROSS_LAYER", 0.75),
    (["mali gpu hang", "mmc error", "sigsegv"], "MEDIATEK", (0.94 + 0.90) / (0.94 + 0.90 + 0.95)),
    (["all fine"], "UNKNOWN", 0.0)])
def test_routing(spark, lines, layer, confidence):
    df = lines_of(spark, lines)
    row = matching.route_layer(matching.match_patterns(df, ROUTER_PATTERNS), ids=df).first()
    assert row.layer == layer and row.confidence == pytest.approx(confidence)


def test_pattern_tables():
    assert len(ROUTER_PATTERNS) == 30 and len(ENRICHED_PATTERNS) == 90
    assert len({p.pattern_id for p in ROUTER_PATTERNS + ENRICHED_PATTERNS}) == 120


def test_own_patterns(spark):
    rows = [Pattern("p1", "mine", "boo+m", "high", "LOKI", "C", 0.5, False, 2.0, fix_hint="look")]
    hits = matching.match_patterns(lines_of(spark, ["BOOOM", "quiet"]), rows)
    assert [(r.line_no, r.pattern_id, r.weight) for r in hits.collect()] == [(1, "p1", 2.0)]
