"""Masked lines and the templates made of them."""

from pyspark.sql import functions as F

from faultline.functions import lines as masks
from faultline.operators import templates
from faultline.rules import formats

MASKED_TEXTS = [
    "\x1b[0;1mred", "\\x1b[0mred", "a 0e09c8f7-fd23-4c52-a853-c37112345678", "192.168.1.7", "at 0xff", "proctitle=abcdefabcdef", "x=abcdef0", "00 11 22  33 44 55 66 77", "Jan 02 03:04:05.123 host",
    "[ 12.3456] up", "svc[12]: on", "[12:34:DEBUG:x", "[123]", "LR  deadbeef", "/3rd/loki/libx.so.1", "PORT : 80801", "port=8080", "v1.2.3-rc", "1712345678", "ses : 5", "pid=1", "took 12345"]


def test_masks_are_tried_where_a_match_has_their_sign(spark):
    rows = [(a + " " + b,) for a in MASKED_TEXTS for b in MASKED_TEXTS] + [(a + b,) for a in MASKED_TEXTS for b in MASKED_TEXTS] + [("",), (None,), ("plain 1 22 x",)]
    df = spark.createDataFrame(rows, "line string")
    assert set(formats.MASK_SIGNS) == {regex for regex, _ in formats.MASKS}
    plain, values = F.col("line"), []
    for regex, to in formats.MASKS:
        assert df.where(F.col("line").rlike(regex)).count() > 0
        plain = F.regexp_replace(plain, regex, to.replace("\\1", "$1"))
        values += [F.regexp_extract_all("line", F.lit(regex), 0)] if to else []
    assert df.where(~plain.eqNullSafe(masks.mask_line("line"))).count() == 0
    assert df.where(~F.flatten(F.array(*values)).eqNullSafe(masks.mask_values("line"))).count() == 0


def test_digit_tokens_of_a_template(spark):
    df = spark.createDataFrame([("1 22  333 x4  5x 6\t7",), (" 8 ",), ("",), (None,)], "line string")
    assert [r[0] for r in df.select(templates.template_key("line")).collect()] == ["<N> <N> <N> x4 5x <N> <N>", "<N>", "", None]


def test_lines_are_masked_once_for_numbered_templates(spark):
    df = spark.createDataFrame([("a", 1, "took 1"), ("a", 2, "lost"), ("a", 3, "took 2"), (None, 1, "lost")], "log_id string, line_no bigint, line string")
    found = templates.templates_exact(df)
    assert {tuple(r) for r in found.select("log_id", "template", "count", "first_seen_line", "template_id").collect()} == {
        ("a", "took <N>", 2, 1, 1), ("a", "lost", 1, 2, 2), (None, "lost", 1, 1, 1)}
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
