"""Templates, sparse vectors, tf-idf, MinHash and compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.lines import MASK_SQL, q
from checks.logview import LINES_SQL, event_lines
from checks.temporal import rounded
from faultline.operators import compress, dedup, templates, vectors
from faultline.rules import formats, vocab
from faultline.session import materialized

KEY_SQL = f"""array_to_string(list_transform(list_filter(regexp_split_to_array({MASK_SQL}, '\\s+'), lambda t: t <> ''),
  lambda t: CASE WHEN regexp_full_match(t, '\\d+') THEN '<N>' ELSE t END), ' ')"""

TPL_SQL = f"""keyed AS (SELECT log_id, line_no, line, {KEY_SQL} AS template FROM lines),
tpl AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY first_seen_line) AS template_id FROM (
  SELECT log_id, template, count(*) AS count, min(line_no) AS first_seen_line FROM keyed GROUP BY ALL))"""


def line_templates(spark, sf):
    return templates.templates_exact(event_lines(spark, sf))


@check("f1_templates_exact", f"WITH {LINES_SQL}, {TPL_SQL} SELECT * FROM tpl")
def f1(spark, sf):
    return line_templates(spark, sf)


@check("f1_template_lines", f"""WITH {LINES_SQL}, {TPL_SQL} SELECT log_id, line_no, template_id,
  line_no = first_seen_line AS is_novel FROM keyed JOIN tpl USING (log_id, template)""")
def f1_lines(spark, sf):
    lines = event_lines(spark, sf)
    return templates.template_lines(lines, templates.templates_exact(lines))


@check("f1_reduction_ratio", f"""WITH {LINES_SQL}, {TPL_SQL} SELECT log_id, count(*) AS total_templates,
  sum(count)::bigint AS total_logs, round(1 - count(*) / sum(count), 6) AS reduction_ratio FROM tpl GROUP BY log_id""")
def f1_ratio(spark, sf):
    return rounded(templates.reduction_ratio(line_templates(spark, sf)), "reduction_ratio")


@check("f1_document_templates", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), keyed AS (SELECT doc_id, line_no, {KEY_SQL} AS template FROM l)
  SELECT doc_id, template, count(*) AS count, min(line_no) AS first_seen_line,
    row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS template_id FROM keyed GROUP BY doc_id, template""")
def f1_documents(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    return templates.templates_exact(lines, keys=["doc_id"])


# Line by line: each joins the first of the best templates of its log and token count, or opens one.
_SAME = "list_sum(list_transform(range(1, w + 1), lambda i: (x.t[i] = tokens[i] OR x.t[i] = '<*>' OR tokens[i] = '<*>')::int)) / w"
SIMILAR_SQL = f"""lt AS (SELECT log_id, line_no, trim(line, ' ') AS text, list_transform(list_filter(string_split_regex(trim(line, ' '), {q(formats.WHITESPACE + '+')}), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, {q(formats.VARIABLE_TOKEN)}) THEN '<*>' ELSE t END) AS tokens FROM lines),
lo AS (SELECT log_id, len(tokens) AS w, tokens, text[:200] AS ex, line_no, row_number() OVER (PARTITION BY log_id, len(tokens) ORDER BY line_no) AS rn FROM lt),
gr AS (SELECT log_id, w, rn, [{{'t': tokens, 'id': md5(array_to_string(tokens, ' '))[:16], 'n': 1::bigint, 'f': line_no, 'e': [ex]}}] AS ts FROM lo WHERE rn = 1
  UNION ALL SELECT log_id, w, rn, CASE WHEN top >= 0.5 THEN list_transform(ts, lambda x, j: CASE WHEN j <> best THEN x ELSE
      {{'t': list_transform(range(1, w + 1), lambda i: CASE WHEN x.t[i] = tokens[i] THEN tokens[i] ELSE '<*>' END), 'id': x.id, 'n': x.n + 1, 'f': x.f,
        'e': CASE WHEN len(x.e) < 3 THEN list_append(x.e, ex) ELSE x.e END}} END)
    ELSE list_append(ts, {{'t': tokens, 'id': md5(array_to_string(tokens, ' '))[:16], 'n': 1::bigint, 'f': line_no, 'e': [ex]}}) END
  FROM (SELECT *, list_max(sc) AS top, list_position(sc, list_max(sc)) AS best FROM (
    SELECT lo.*, ts, list_transform(ts, lambda x: CASE WHEN lo.w = 0 THEN 1.0 ELSE {_SAME.replace('w + 1', 'lo.w + 1').replace('/ w', '/ lo.w').replace('tokens[', 'lo.tokens[')} END) AS sc
    FROM gr JOIN lo ON lo.log_id = gr.log_id AND lo.w = gr.w AND lo.rn = gr.rn + 1))),
gl AS (SELECT log_id, unnest(ts) AS x FROM (SELECT * FROM gr QUALIFY rn = max(rn) OVER (PARTITION BY log_id, w)))"""


@check("f2_templates_similar", f"""WITH RECURSIVE {LINES_SQL}, {SIMILAR_SQL} SELECT log_id, x.id AS id, array_to_string(x.t, ' ') AS template, x.n AS count,
  x.f AS first_seen_line, array_to_string(x.e, ' | ') AS examples FROM gl""")
def f2(spark, sf):
    out = templates.templates_similar(event_lines(spark, sf))
    return out.withColumn("examples", F.array_join("examples", " | "))


@check("f3_novel_templates", f"""WITH {LINES_SQL}, keyed AS (SELECT *, {KEY_SQL} AS template FROM lines)
  SELECT DISTINCT template FROM keyed WHERE us >= epoch_us(TIMESTAMP '2024-01-03')
    AND template NOT IN (SELECT template FROM keyed WHERE us < epoch_us(TIMESTAMP '2024-01-03'))""")
def f3(spark, sf):
    lines = event_lines(spark, sf)
    at = F.unix_micros(F.lit("2024-01-03").cast("timestamp"))
    later = templates.templates_exact(lines.where(F.col("us") >= at)).select("template").distinct()
    return templates.novel_templates(later, templates.templates_exact(lines.where(F.col("us") < at)))


PARAM_SQL = "list_concat(" * (len([m for m in formats.MASKS if m[1]]) - 1)
for _i, (_p, _to) in enumerate([m for m in formats.MASKS if m[1]]):
    PARAM_SQL += (f", regexp_extract_all(line, {q(_p)}))" if _i else f"regexp_extract_all(line, {q(_p)})")


@check("f4_template_params", f"""WITH {LINES_SQL}, {TPL_SQL}, lastl AS (SELECT log_id, template, arg_max(line, line_no) AS line
    FROM keyed GROUP BY ALL) SELECT log_id, template, array_to_string({PARAM_SQL}, ' | ') AS sample_params FROM lastl""")
def f4(spark, sf):
    out = templates.template_params(event_lines(spark, sf))
    return out.withColumn("sample_params", F.array_join("sample_params", " | "))


WORDS_SQL = f"regexp_extract_all(lower(text), {q(formats.WORD)})"
TOKEN_ID = "cast(('0x' || right(md5(token), 4)) AS integer)"


@check("b17_sparse_vectors_bm25", f"""WITH t AS (SELECT doc_id, list_filter({WORDS_SQL}, lambda w: length(w) >= 2) AS ws FROM documents),
  c AS (SELECT doc_id, token, count(*) AS c, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM t) GROUP BY ALL)
  SELECT doc_id, token, {TOKEN_ID} AS token_id, round(c * 2.5 / (c + 1.5 * (0.25 + 0.75 * dl / 10)), 6) AS weight FROM c""")
def b17a(spark, sf):
    return rounded(vectors.sparse_vectors(table(spark, sf, "documents")), "weight")


@check("b17_sparse_vectors_tf", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{3,}}') AS ws FROM documents),
  e AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM t),
  c AS (SELECT doc_id, token, count(*) AS c, any_value(dl) AS dl, min(pos) AS f FROM e GROUP BY ALL)
  SELECT doc_id, {TOKEN_ID} AS token_id, arg_max(round(c / dl * ln(1 + 1 / (c + 1)), 6), f) AS weight FROM c GROUP BY ALL""")
def b17b(spark, sf):
    return vectors.sparse_vectors(table(spark, sf, "documents"), variant="tf")


_STOP = ", ".join(q(w) for w in dict.fromkeys(vocab.STOP_WORDS))
TERMS_SQL = f"""list_filter({WORDS_SQL}, lambda w: regexp_full_match(w, '[a-z0-9_]{{3,50}}') AND w NOT IN ({_STOP}))"""
TF_SQL = f"""tm AS (SELECT doc_id, lang, {TERMS_SQL} AS ts FROM documents),
tf AS (SELECT doc_id, lang, term, count(*) / any_value(total) AS tf FROM (SELECT doc_id, lang, len(ts) AS total, unnest(ts) AS term FROM tm) GROUP BY ALL)"""


@check("e9_tfidf_keywords", f"""WITH {TF_SQL}, s AS (SELECT term, max(tf) AS m, ln((SELECT count(*) FROM tm WHERE len(ts) > 0) / count(*)) AS idf
  FROM tf GROUP BY term) SELECT term, round(m * idf, 6) AS score FROM s WHERE idf >= 0.5 ORDER BY round(m * idf, 9) DESC, term LIMIT 10""")
def e9(spark, sf):
    return rounded(vectors.tfidf_keywords(table(spark, sf, "documents")), "score")


@check("e9_tfidf_keywords_by_language", f"""WITH {TF_SQL}, n AS (SELECT lang, count(*) AS n FROM tm WHERE len(ts) > 0 GROUP BY lang),
  s AS (SELECT lang, term, max(tf) AS m, ln(any_value(n) / count(*)) AS idf FROM tf JOIN n USING (lang) GROUP BY ALL)
  SELECT lang, term, round(m * idf, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang
    ORDER BY round(m * idf, 9) DESC, term) AS rank FROM s WHERE idf >= 0.5) WHERE rank <= 10""")
def e9_lang(spark, sf):
    out = vectors.tfidf_keywords(table(spark, sf, "documents"), keys=["lang"])
    return rounded(out, "score").withColumn("rank", F.col("rank").cast("bigint"))


@check("e10_score_texts", f"""WITH {TF_SQL}, idf AS (SELECT term, ln((SELECT count(*) FROM tm WHERE len(ts) > 0) / count(*)) AS idf FROM tf GROUP BY term)
  SELECT d.doc_id, round(coalesce(sum(tf * idf), 0), 6) AS score FROM documents d LEFT JOIN tf USING (doc_id) LEFT JOIN idf USING (term) GROUP BY d.doc_id""")
def e10(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(vectors.score_texts(docs, vectors.idf_table(docs)), "score")


# Fixed value in SQL form: the white space the normaliser collapses.
WS_SQL = q(formats.WHITESPACE + "+")
SIG_SQL = f"""norm AS (SELECT doc_id, trim(regexp_replace(lower(text), {WS_SQL}, ' ', 'g')) AS t FROM documents),
ch AS (SELECT doc_id, t, string_split(t, '') AS c FROM norm),
sh AS (SELECT doc_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1),
    lambda i: c[i] || c[i + 1] || c[i + 2])) END) AS s FROM ch WHERE t <> ''),
hs AS (SELECT s, i, cast('0x' || substr(md5(cast(i AS varchar) || ':' || s), 1, 16) AS ubigint) AS h
  FROM (SELECT DISTINCT s FROM sh), range(128) r(i)),
sg AS (SELECT doc_id, i, min(h) AS h FROM sh JOIN hs USING (s) GROUP BY ALL)"""


def signatures(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), dedup.minhash(dedup.normalized_text("text")).alias("signature"))


def kept_signatures(spark, sf):
    """Signatures computed once, where they are read more than once."""
    return materialized(signatures(spark, sf), "signatures")


@check("h1_minhash", f"""WITH {SIG_SQL} SELECT doc_id, md5(string_agg(lpad(lower(to_hex(h)), 16, '0'), ',' ORDER BY i)) AS signature FROM sg GROUP BY doc_id
  UNION ALL SELECT doc_id, CASE WHEN t = '' THEN md5(repeat('0000000000000000,', 127) || '0000000000000000') END FROM norm WHERE t IS NULL OR t = ''""")
def h1(spark, sf):
    text = F.array_join(F.transform("signature", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")
    docs = signatures(spark, sf)
    return docs.select(F.col("id").alias("doc_id"), F.md5(text).alias("signature"))


_EDGES = [round(i * 128 / 26) for i in range(27)]
_BAND = "CASE " + " ".join(f"WHEN i < {e} THEN {n}" for n, e in enumerate(_EDGES[1:])) + " END"


@check("h2_pair_similarity", f"""WITH {SIG_SQL}, bd AS (SELECT doc_id, {_BAND} AS band, list(h ORDER BY i) AS hs FROM sg GROUP BY ALL),
  pr AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY band, hs) AS id_a, doc_id AS id_b FROM bd QUALIFY id_a <> doc_id) SELECT a.doc_id AS id_a, b.doc_id AS id_b,
  round(sum((a.h = b.h)::int) / 128, 6) AS similarity FROM pr JOIN sg a ON pr.id_a = a.doc_id JOIN sg b ON pr.id_b = b.doc_id AND a.i = b.i GROUP BY ALL""")
def h2(spark, sf):
    # Every text with the first text of each of its bands.
    sigs = kept_signatures(spark, sf)
    bands = sigs.select("id", F.explode(dedup.band_keys("signature", 0.8)).alias("band"))
    pairs = bands.join(bands.groupBy("band").agg(F.min("id").alias("id_a")), "band").where("id_a <> id").select("id_a", F.col("id").alias("id_b")).distinct()
    return rounded(dedup.pair_similarity(pairs, sigs), "similarity")


@check("h3_dedup_groups")
def h3(spark, sf):
    return dedup.dedup_groups(table(spark, sf, "documents"))


@check("h4_find_similar", f"""WITH {SIG_SQL.replace('FROM documents', "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark UNION ALL SELECT -1000000 - doc_id, text FROM documents WHERE doc_id % 20 = 0)")}
  SELECT -1 - a.doc_id AS query_id, b.doc_id AS id, round(sum((a.h = b.h)::int) / 128, 6) AS similarity
  FROM sg a JOIN sg b ON a.doc_id < 0 AND b.doc_id >= 0 AND a.i = b.i GROUP BY ALL HAVING sum((a.h = b.h)::int) / 128 >= 0.5""")
def h4(spark, sf):
    # Benchmark items, and every twentieth text against all.
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    asked = asked.unionByName(table(spark, sf, "documents").where("doc_id % 20 = 0").select((F.col("doc_id") + 999_999).alias("id"), "text"))
    queries = asked.select("id", dedup.minhash(dedup.normalized_text("text")).alias("signature"))
    return rounded(dedup.find_similar(signatures(spark, sf), queries, 0.5), "similarity")


@check("h11_compress_text", f"""WITH src AS (SELECT doc_id, text, length(text) // 4 AS ot FROM documents),
  l0 AS (SELECT doc_id, unnest(string_split_regex(text, {q(compress.LINE_BREAK)})) AS line,
      generate_subscripts(string_split_regex(text, {q(compress.LINE_BREAK)}), 1) AS pos FROM src WHERE ot >= 50),
  l1 AS (SELECT *, regexp_replace(line, {q('^' + formats.WHITESPACE + '+|' + formats.WHITESPACE + '+$')}, '', 'g') AS bare FROM l0),
  l2 AS (SELECT *, coalesce(line = lag(line) OVER w AND NOT regexp_matches(line, {q(formats.PROTECTED)}), false) AS rep
    FROM l1 WHERE bare <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  l3 AS (SELECT *, rep AND lag(rep, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS again FROM l2),
  l4 AS (SELECT doc_id, pos, CASE WHEN rep THEN {q(compress.REPEATED)} ELSE line END AS line,
    NOT rep AND starts_with(bare, '```') AS fence FROM l3 WHERE NOT again),
  l5 AS (SELECT *, sum(fence::int) OVER (PARTITION BY doc_id ORDER BY pos) AS blk FROM l4),
  l6 AS (SELECT *, CASE WHEN NOT fence AND blk % 2 = 1 THEN row_number() OVER (PARTITION BY doc_id, blk ORDER BY pos) - 1 END AS depth FROM l5),
  l7 AS (SELECT doc_id, pos, CASE WHEN depth = 51 THEN {q(compress.TRUNCATED)} ELSE line END AS line FROM l6 WHERE depth IS NULL OR depth <= 51),
  l8 AS (SELECT *, CASE WHEN regexp_matches(line, {q(formats.PROTECTED)}) THEN 0 WHEN regexp_matches(line, {q(formats.LOW_SIGNAL)}) THEN 2 ELSE 1 END AS kind FROM l7),
  l9 AS (SELECT *, floor(count(*) OVER (PARTITION BY doc_id) * 0.5) AS target, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY doc_id) AS np,
    row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS place FROM l8),
  j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY kind, pos) AS text FROM l9 WHERE kind = 0 OR (kind = 1 AND place <= target - np) GROUP BY doc_id),
  o AS (SELECT doc_id, ot, CASE WHEN ot < 50 THEN src.text ELSE coalesce(j.text, '') END AS text, ot >= 50 AS big FROM src LEFT JOIN j USING (doc_id))
  SELECT doc_id, text, ot AS original_tokens, length(text) // 4 AS compressed_tokens,
    round(CASE WHEN big THEN (length(text) // 4) / ot ELSE 1.0 END, 6) AS ratio, CASE WHEN big THEN 'heuristic' ELSE 'none' END AS method FROM o""")
def h11(spark, sf):
    return rounded(compress.compress_text(table(spark, sf, "documents"), activation=50), "ratio")
