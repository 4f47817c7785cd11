"""The registered queries of the operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import conversation_trie, cross_polytope, decontaminate, exact_dedup, hard_negatives, ngram_jaccard, ngram_lm, packing, sharding, token_counts, toxicity, url_rules, warc
from faultline.llm.common import lower_ascii, shared_folder, tokenizer_path, written
from faultline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_histogram_shards")
def op4(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), 16, carry=[F.crc32(text).alias("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_exact_dedup", sql=f"""
    WITH d AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op7(spark, sf_dir):
    digest = F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256).alias("text_sha256")
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry=[digest])
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op8_url_rules", sql="""
    WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                                     ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
          FROM s JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
    SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""")
def op8(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_table(spark, URL_RULES))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


BENCHMARK_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query("op2_winnow_decontaminate", sql=f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, {BENCHMARK_WORDS}) AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({FOLDED}, {BENCHMARK_WORDS}) AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
           FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
    dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
    h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op2(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_token_counts")
def op9(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op10_ngram_jaccard")
def op10(spark, sf_dir):
    out = ngram_jaccard.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query("op5_seekable_warc", sql="""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM p LEFT JOIN k USING (payload_digest)""")
def op5(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(warc.records(table(spark, sf_dir, "pages")), folder)
    out = warc.read_bundles(index, folder)
    return out.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


@query("op3_backoff_lm")
def op3(spark, sf_dir):
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


# Unsigned CRC-32 of a decimal: the bytes in order, each followed by eight steps of one bit.
CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: list_prepend(ascii(ch)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@query("op11_conversation_trie", sql=f"""
    WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    m AS (SELECT c, c - c % 20 AS base, xor({CRC_SQL}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
    x AS (SELECT m.c, o.place, role, text FROM m JOIN o ON o.c = base AND o.place <= h
          UNION ALL SELECT m.c, o.place + 1000000, role, text FROM m JOIN o ON o.c = m.c AND o.place > h),
    t AS (SELECT c, row_number() OVER w AS d, list(sha256(role || chr(1) || text)) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
          FROM x WINDOW w AS (PARTITION BY c ORDER BY place ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT c, d, array_to_string(path, '') AS path, words FROM t UNION ALL SELECT c, 0, '', 0 FROM m),
    n AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY d, path),
    k AS (SELECT a.*, b.conv_id AS parent_conv_id FROM n a LEFT JOIN n b ON b.depth = a.depth - 1 AND b.path = left(a.path, 64 * (a.depth - 1)::INT)),
    f AS (SELECT k.*, (SELECT count(*) FROM n z WHERE z.depth = k.depth + 1 AND left(z.path, 64 * k.depth::INT) = k.path) AS n_children FROM k),
    s AS (SELECT a.depth, a.conv_id, count(*) FILTER (WHERE z.n_children = 0) AS n_leaves, sum((z.n_convs - 1) * z.words)::BIGINT AS saved_tokens
          FROM f a JOIN f z ON z.depth >= a.depth AND left(z.path, 64 * a.depth::INT) = a.path GROUP BY a.depth, a.conv_id),
    e AS (SELECT depth, conv_id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
          FROM (SELECT c, max(d) AS depth, max(path) AS path FROM p GROUP BY c) JOIN n USING (depth, path) GROUP BY depth, conv_id)
    SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, '{EMPTY_SHA256}') AS ends_sha256
    FROM f JOIN s USING (depth, conv_id) LEFT JOIN e USING (depth, conv_id)""")
def op11(spark, sf_dir):
    turns = written(conversation_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    nodes, ends = conversation_trie.conversation_trie(*conversation_trie.with_shared_heads(turns))
    out = nodes.join(conversation_trie.ends_digest(ends), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op12_cross_polytope_search")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = cross_polytope.nearest_neighbours(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), rows, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op13_hard_negatives", sql="""
    WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)
