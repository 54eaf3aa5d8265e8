"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import chat, exact_dedup, hmm, jaccard, line_dedup, mixing, packing, quality, sharding, spelling, url_filter, vantage, whitening
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


ESCAPES = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = chat.format_conversations(table(spark, sf_dir, "conversations"))
    record = [(-7, [("user", ESCAPES), ("assistant", ESCAPES)])]
    own = spark.createDataFrame(record, "conv_id long, messages array<struct<role: string, content: string>>")
    return chat.digests(given.unionByName(chat.format_conversations(own)))


def judged_documents(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source (the host) and language (the path below it)."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), docs["source"], docs["lang"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judged_documents(docs, spark, sf_dir).select(
        "row.doc_id", "row.source", "row.lang", "evidence", "host_rate", "path_rate", "posterior", "kept"
    )


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return hmm.score_texts(docs, remainder == 2).withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select(
        "row.doc_id", "keep_id", "group_size", "kept", F.sha2(F.col("normalised").cast("binary"), 256).alias("text_sha256")
    )


def op5_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("row.page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, mixing.weight_table(docs)).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, TOKENIZER).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs, new_path(spark, "shards")).select(
        "row.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).select(
        "row.vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality": op2_quality,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_vantage_points": op5_vantage_points,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling": op13_spelling,
}

_WHITE = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def crc32_sql(text: str) -> str:
    """DuckDB SQL for the checksum of a text in UTF-8: four bits at a time, the low half of a byte first."""
    rest = []
    for r in range(16):
        for _ in range(4):
            r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
        rest.append(r)
    half = f"strpos('0123456789ABCDEF', hex(encode({text}))[i - 1 + 2 * (i % 2)]) - 1"  # 2, 1, 4, 3, ...
    halves = f"list_transform(generate_series(1, len(hex(encode({text})))), lambda i: ({half})::BIGINT)"
    step = f"xor(c >> 4, {rest}[(xor(c, h) & 15) + 1])"
    return f"xor(list_reduce({halves}, lambda c, h: {step}, 4294967295::BIGINT), 4294967295)"


ORACLE = {
    "op1_chat_format": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '{ESCAPES}' UNION ALL SELECT -7, 1, 'assistant', '{ESCAPES}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '\\'))
                   + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: len(x) - 2)), 0)
                   + len(regexp_extract_all(text, '</turn>')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, row_number() OVER g AS rn, first_value(doc_id) OVER g AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size
              FROM n WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op5_vantage_points": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_url_filter": f"""
        WITH u AS (SELECT page_id,
                          {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(verdict, host, path) AS (VALUES {', '.join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)}),
        fit AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
                       row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS rn
                FROM u LEFT JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE rn = 1""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_WHITE}+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')))
                                  WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END AS g FROM w),
        c AS (SELECT g, min(doc_id) AS node FROM (SELECT doc_id, list_sort(g) AS g FROM g) WHERE len(g) > 0 GROUP BY g),
        s AS (SELECT node, len(g) AS n, unnest(g) AS s FROM c),
        l AS (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.s = b.s AND a.node < b.node
                     AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, to_node) AS (SELECT node, node FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_node),
        m AS (SELECT node, min(to_node) AS component_id FROM r GROUP BY node)
        SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(m.component_id, g.doc_id) AS component_id
        FROM g LEFT JOIN c ON list_sort(g.g) = c.g LEFT JOIN m ON m.node = c.node""",
    "op12_line_dedup": f"""
        WITH l AS (SELECT r, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
                   FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        k AS (SELECT r, doc_id, pos, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key)
        SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (k.doc_id <> f.first) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.first IS NULL OR k.doc_id = f.first), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, k.doc_id""",
    "op13_spelling": f"""
        WITH RECURSIVE t AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
        c AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY doc_id, run),
        h AS (SELECT run, n, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM c),
        s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
              FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
        e AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
              UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
        b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM e GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form,
                     CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
        r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
        FROM f JOIN r ON r.word = f.word JOIN f g ON g.word = r.root WHERE g.form IS NULL""",
}
