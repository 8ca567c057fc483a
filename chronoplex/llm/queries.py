"""The registered queries of this package and the SQL that must give the same rows, where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_chats
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .hard_negatives import mine_hard_negatives
from .language_model import score_documents
from .line_dedup import line_dedup
from .ngram_join import similar_components
from .packing import pack
from .quality import classify_quality
from .simhash import simhash_components
from .toxicity import classify_toxicity
from .url_filters import filter_urls
from .whitening import whiten

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}

#: The rules of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filters", f"""
    WITH rules(verdict, h, p) AS (VALUES {", ".join(map(str, URL_RULES))}),
    cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
    parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), {_AZ}), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
    SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(verdict, length(h || p)), 'allow') AS verdict
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id, host, path""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*fields)))
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_line_dedup", f"""
    WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k FROM split),
    shared AS (SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    marked AS (SELECT doc_id, i, line, keep IS NOT NULL AND keep <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_chat_formatting", r"""
    WITH all_turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    sized AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>')) AS body,
                     length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>')) AS name,
                     lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM all_turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(CASE WHEN before = role THEN 7 + body ELSE 17 + name + body END)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text"))
        for i, r in enumerate(("user", "assistant"))))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words_per_shingle=3, threshold=2)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=False).drop("ids")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query("op13_ngram_jaccard_join", rf"""
    WITH RECURSIVE split AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),
    tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
    links AS (SELECT a.r AS x, b.r AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r
              GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reached(x, y) AS (SELECT r, r FROM sets UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
    SELECT any_value(a.doc_id) AS doc_id, len(any_value(a.s)) AS n_shingles, min(b.doc_id) AS component_id
    FROM reached JOIN sets a ON a.r = x JOIN sets b ON b.r = y GROUP BY x""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("long"))


@query("op12_hard_negative_mining", """
    WITH usable AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
               FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    good AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
             QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
    ranked AS (SELECT g.anchor_id, positive_id, row_number() OVER (PARTITION BY g.a, g.b ORDER BY score DESC, vec_id)::INT AS rank,
                      vec_id AS negative_id, positive_score, score AS negative_score
               FROM good g JOIN scored s ON g.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM ranked WHERE rank <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)
