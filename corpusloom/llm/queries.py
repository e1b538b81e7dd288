"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, fingerprints, html_text, language_model, mixing, quality, secrets, sharding, simhash, toxicity, vector_codes, whitening
from .sparkutil import cut, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secrets.train(secrets.samples(spark, table(spark, sf_dir, "benchmark")))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ratios)
    return found.select(
        "doc_id", *(secrets.count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), hit).alias("contaminated"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.planned(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model).select("doc_id", quality.is_held_out().alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model).select("doc_id", toxicity.is_held_out().alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.joined(cut(fingerprints.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hex_of("f").alias("fingerprint"), fingerprints.hex_of("e").alias("edited_fingerprint"), "near_edited", "near_next", "n_links", "component_id"
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_embeddings": op7_embeddings,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_language_model": op10_language_model,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a text's UTF-8 bytes, in a query that has the tables crc_t (of the 256 byte steps) at hand.
_CRC_TABLE = "crc_t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t)"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT)), "
    "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
)

_BLOCKS = "string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '</?(?:p|h1|br)>')"
_PLAIN = "trim(regexp_replace(regexp_replace(replace(b, '&quot;', '\"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": vector_codes.oracle_sql(),
    "op2_sharding": f"""
        WITH {_CRC_TABLE}, d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id, 0) AS k FROM documents),
        h AS MATERIALIZED (SELECT d.*, octet_length(encode(text)) + 1 AS size, {sharding.jump_sql("k", 16)} AS shard, {sharding.jump_sql("k", 17)} AS grown,
                           ('0x' || substr(md5(k::VARCHAR || ':' || md5(text)), 1, 8))::BIGINT % greatest(256, ceil((SELECT count(*) FROM documents) / (16 * 100000)))::BIGINT AS piece, {_CRC.format(x="text")} AS crc FROM d, crc_t)
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY piece, k, size, crc) - 1 AS slot, grown AS grown_shard FROM h""",
    "op7_embeddings": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.vec_id),
        c AS (SELECT vec_id, min(low) AS component_id FROM r GROUP BY vec_id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op9_html": f"""
        WITH t AS (SELECT page_id, url, array_to_string(list_filter(list_transform({_BLOCKS}, lambda b: {_PLAIN}), lambda b: b <> ''), chr(10)) AS text FROM pages)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
    "op10_language_model": f"""
        WITH {_CRC_TABLE},
        d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, {_CRC.format(x="coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out,
                   list_concat(['^'], list_transform(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), lambda w: '.' || w), ['$']) AS w
            FROM documents, crc_t),
        k AS MATERIALIZED (
            SELECT r, held_out, w[i] AS w, w[i - 1] AS h, CASE WHEN i > 2 THEN w[i - 2] END AS g FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM d)),
        c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY ALL),
        c2 AS MATERIALIZED (SELECT h, w, count(*) AS c FROM k WHERE NOT held_out GROUP BY ALL),
        c3 AS MATERIALIZED (SELECT g, h, w, count(*) AS c FROM k WHERE NOT held_out AND g IS NOT NULL GROUP BY ALL),
        x2 AS MATERIALIZED (SELECT h, sum(c) AS c FROM c2 GROUP BY ALL),
        x3 AS MATERIALIZED (SELECT g, h, sum(c) AS c FROM c3 GROUP BY ALL),
        n AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
        p1 AS (SELECT k.*, coalesce(c1.c, 0) AS c1, (coalesce(c1.c, 0) + 1)::DOUBLE / (n.n + n.v + 1)::DOUBLE AS p1 FROM k CROSS JOIN n LEFT JOIN c1 USING (w)),
        p2 AS (SELECT p1.*, (coalesce(c2.c, 0) + {language_model.MU[0]}::DOUBLE * p1) / (coalesce(x2.c, 0) + {language_model.MU[0]}::DOUBLE) AS p2
               FROM p1 LEFT JOIN c2 USING (h, w) LEFT JOIN x2 USING (h)),
        p3 AS (SELECT p2.*, CASE WHEN g IS NULL THEN p2 ELSE (coalesce(c3.c, 0) + {language_model.MU[1]}::DOUBLE * p2) / (coalesce(x3.c, 0) + {language_model.MU[1]}::DOUBLE) END AS p3
               FROM p2 LEFT JOIN c3 USING (g, h, w) LEFT JOIN x3 USING (g, h)),
        s AS (SELECT r, count(*)::BIGINT AS n_tokens, count(*) FILTER (c1 > 0)::BIGINT AS n_known, sum(log10(p1)) AS base, sum(log10(p3)) AS score FROM p3 GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM n)::BIGINT AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM d JOIN s USING (r)""",
    "op3_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
        bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k : k + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
        lens AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n),
        dt AS MATERIALIZED (SELECT dw.r, dw.n, dw.k, array_to_string(d.w[dw.k : dw.k + dw.n - 1], ' ') AS win FROM dw JOIN d USING (r)),
        hit AS MATERIALIZED (SELECT dt.r, dt.n, dt.k, bw.item_id FROM dt JOIN bw ON dt.n = bw.n AND dt.win = bw.win),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
        ids AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit WHERE item_id IS NOT NULL GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""",
    "op4_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
        p AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class,
                     ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 8))::BIGINT % greatest(64, ceil((SELECT count(*) FROM documents) / 100000))::BIGINT AS piece FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
        w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
        o AS (SELECT *, row_number() OVER r AS place, sum(ss) OVER () - 3 * coalesce(sum(ss) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                     sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
              FROM w WINDOW r AS (ORDER BY 3 * ss / w, source NULLS LAST)),
        f AS (SELECT place, lft, ws FROM o WHERE lft * w <= 3 * ss * ws ORDER BY place LIMIT 1),
        t AS (SELECT o.source, o.ss, CASE WHEN o.place < f.place THEN (3 * o.ss)::DOUBLE ELSE (o.w * f.lft)::DOUBLE / f.ws::DOUBLE END AS target FROM o, f),
        r AS (SELECT p.*, t.ss, t.target, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS rate, ('0x' || substr(md5('17:' || coalesce(p.source, '')), 1, 4))::INTEGER / 65536 AS u,
                     row_number() OVER (PARTITION BY p.source ORDER BY class, piece, size, doc_id) AS place FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, (floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT AS copies FROM r)
        SELECT doc_id, size, ss AS source_size, target, copies * size AS taken, source, copies FROM c""",
}
