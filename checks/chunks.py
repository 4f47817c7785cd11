"""Code chunks cut from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.lines import q
from checks.temporal import rounded
from faultline.operators import chunks as C
from faultline.rules import vocab

# One chunk per order line; the file is the part, the range grows with the line number.
_CHUNKS = """SELECT l_orderkey AS chunk_id, concat('repo', cast(l_suppkey % 2 AS {s})) AS repo, concat('src/f', cast(l_partkey AS {s}), '.cpp') AS file_path,
  cast(l_linenumber * 20 + l_orderkey % 7 AS bigint) AS start_line, cast(l_linenumber * 20 + l_orderkey % 7 + cast(l_quantity AS bigint) AS bigint) AS end_line,
  concat('void run_', cast(l_suppkey % 50 AS {s}), '() {{ deadlock(); open_file.cpp timeout ', cast(l_quantity AS bigint), ' }}',
    CASE WHEN l_discount > 0.05 THEN ' segfault' ELSE '' END) AS content,
  CASE l_returnflag WHEN 'A' THEN 'path_a' WHEN 'R' THEN 'path_b' ELSE 'path_c' END AS source, l_discount AS confidence,
  cast(l_orderkey * 1000000 + l_suppkey * 1000 + cast(floor(l_extendedprice) AS bigint) % 1000 AS bigint) AS position FROM {l}"""
CHUNKS_SQL = "ch AS (" + _CHUNKS.format(s="varchar", l="lineitem") + ")"


def code_chunks(spark, sf):
    # The text is formatted a second time by ``spark.sql``, so its braces are doubled again.
    sql = _CHUNKS.replace("{{", "{{{{").replace("}}", "}}}}").format(s="string", l="{l}")
    return spark.sql(sql, l=table(spark, sf, "lineitem"))


KEYS = "repo, file_path, start_line, end_line"


# Many chunks agree in range, confidence and position; the rest of the row decides then.
ORDER = ["position", "chunk_id", "content", "source"]
_ORDER = "'p': position, 'i': chunk_id, 't': content, 's': source"


@check("h5_dedup_chunks", f"""WITH {CHUNKS_SQL} SELECT {KEYS}, max(confidence) AS confidence,
  arg_min(content, {{'c': -confidence, {_ORDER}}}) AS content, arg_min(position, {{'c': -confidence, {_ORDER}}}) AS position FROM ch GROUP BY ALL""")
def h5(spark, sf):
    out = C.dedup_chunks(code_chunks(spark, sf), order=ORDER)
    return out.select("repo", "file_path", "start_line", "end_line", "confidence", "content", "position")


ISLANDS_SQL = """i1 AS (SELECT *, max(end_line) OVER (PARTITION BY repo, file_path ORDER BY start_line, position, chunk_id, content, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ch),
i2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file_path ORDER BY start_line, position, chunk_id, content, source ROWS UNBOUNDED PRECEDING) AS g FROM i1)"""


@check("h6_merge_chunks", f"""WITH {CHUNKS_SQL}, {ISLANDS_SQL} SELECT repo, file_path, min(start_line) AS start_line, max(end_line) AS end_line,
  arg_min(content, {{'l': -length(content), 'f': start_line, {_ORDER}}}) AS content, string_agg(source, '+' ORDER BY start_line, position, chunk_id, content, source) AS source,
  max(confidence) AS confidence FROM i2 GROUP BY repo, file_path, g""")
def h6(spark, sf):
    return C.merge_chunks(code_chunks(spark, sf), max_size=1_000_000, order=ORDER)


# Chunk by chunk: the one that is open (s, e, c, src, cf) and what the step let go (em).
_MERGED = "{'s': least(f.s, o.start_line), 'e': greatest(f.e, o.end_line), 'c': CASE WHEN length(f.c) >= length(o.content) THEN f.c ELSE o.content END, 'src': f.src || '+' || o.source, 'cf': greatest(f.cf, o.confidence::double)}"
_NEAR = "o.start_line <= f.e + 5"
_LARGE = "greatest(f.e, o.end_line) - least(f.s, o.start_line) + 1 > 60"
CAPPED_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY start_line, position, chunk_id, content, source) AS rn FROM ch),
f AS (SELECT repo, file_path, rn, start_line AS s, end_line AS e, content AS c, source AS src, confidence::double AS cf,
    NULL::STRUCT(s BIGINT, e BIGINT, c VARCHAR, src VARCHAR, cf DOUBLE) AS em FROM o WHERE rn = 1
  UNION ALL SELECT o.repo, o.file_path, o.rn, n.s, n.e, n.c, n.src, n.cf, em FROM (
    SELECT o.*, CASE WHEN {_NEAR} AND NOT {_LARGE} THEN {_MERGED} ELSE {{'s': o.start_line, 'e': o.end_line, 'c': o.content, 'src': o.source, 'cf': o.confidence::double}} END AS n,
      CASE WHEN NOT ({_NEAR}) THEN {{'s': f.s, 'e': f.e, 'c': f.c, 'src': f.src, 'cf': f.cf}} WHEN {_LARGE} THEN {_MERGED} END AS em
    FROM f JOIN o ON o.repo = f.repo AND o.file_path = f.file_path AND o.rn = f.rn + 1) o)"""


@check("h6_merge_chunks_capped", f"""WITH RECURSIVE {CHUNKS_SQL}, {CAPPED_SQL}, l AS (SELECT * FROM f QUALIFY rn = max(rn) OVER (PARTITION BY repo, file_path))
  SELECT repo, file_path, em.s AS start_line, em.e AS end_line, em.c AS content, em.src AS source, em.cf AS confidence FROM f WHERE em IS NOT NULL
  UNION ALL SELECT repo, file_path, s, e, c, src, cf FROM l""")
def h6_capped(spark, sf):
    return C.merge_chunks(code_chunks(spark, sf), max_size=60, order=ORDER)


@check("h7_expand_context", f"""WITH {CHUNKS_SQL}, files AS (SELECT 'repo0' AS repo, 'src/f' || doc_id || '.cpp' AS file_path, string_split(text, chr(10)) AS ls FROM documents)
  SELECT chunk_id, position, greatest(1, start_line - 5) AS start_line, CASE WHEN ls IS NULL THEN end_line + 5 ELSE least(end_line + 5, len(ls)) END AS end_line,
    CASE WHEN ls IS NULL THEN content ELSE coalesce(array_to_string(ls[greatest(1, start_line - 5):least(end_line + 5, len(ls))], chr(10)), '') END AS content
  FROM ch LEFT JOIN files USING (repo, file_path)""")
def h7(spark, sf):
    files = table(spark, sf, "documents").select(
        F.lit("repo0").alias("repo"), F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".cpp")).alias("file_path"), "text")
    out = C.expand_context(code_chunks(spark, sf), files)
    return out.select("chunk_id", "position", "start_line", "end_line", "content")


_CAUSE = "The call Run_7(x) in open_file.cpp and run_12 () hits a lock"
_KEYWORDS = ["deadlock", "timeout", "segfault", "hang"]
_W = [vocab.KEYWORD_WEIGHTS.get(k, 0.5) for k in _KEYWORDS]
REL_SQL = f"""rel AS (SELECT *, least(1.0, 0.4 * ({' + '.join(f"CASE WHEN contains(lower(content), {q(k)}) THEN {w} ELSE 0 END" for k, w in zip(_KEYWORDS, _W, strict=True))}) / 4
  + 0.6 * (contains(lower(content), 'run_7')::int + contains(lower(content), 'run_12')::int + contains(lower(content), 'open_file.cpp')::int) / 3)::double AS relevance FROM ch)"""


def scored_chunks(spark, sf):
    keywords = F.array(*[F.lit(k) for k in _KEYWORDS])
    return code_chunks(spark, sf).withColumn("relevance", C.relevance("content", F.lit(_CAUSE), keywords))


@check("h8_relevance", f"WITH {CHUNKS_SQL}, {REL_SQL} SELECT chunk_id, position, round(relevance, 6) AS relevance FROM rel WHERE relevance >= 0.3")
def h8(spark, sf):
    return rounded(C.relevant(scored_chunks(spark, sf)).select("chunk_id", "position", "relevance"), "relevance")


@check("h9_rank_chunks", f"""WITH {CHUNKS_SQL}, {REL_SQL} SELECT file_path, position, round(relevance, 6) AS relevance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY round(relevance, 9) DESC, position, content) AS rank FROM rel) WHERE rank <= 5""")
def h9(spark, sf):
    out = scored_chunks(spark, sf).withColumn("tie", F.struct("position", "content"))
    out = C.rank_chunks(out, keys=["file_path"], tie="tie")
    return rounded(out.select("file_path", "position", "relevance", F.col("rank").cast("bigint").alias("rank")), "relevance")
