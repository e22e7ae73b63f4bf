"""The queries opN_<name>: each applies its operator to the whole of its table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, flac, langid, lloyd, mil, mining, mixing, ordinal, packing, rules, shard, simhash
from .common import crc_of_id, table, utf8

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as FLAC streams and back; the feature counts blocks and sums loudness and sign changes over the samples."""
    text = utf8("text")
    size = F.length(text)
    padded = F.greatest(F.ceil(size / 64) * 64, F.lit(64)).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("n_bytes"), F.concat(text, F.unhex(F.repeat(F.lit("00"), padded - size))).alias("payload"))
    decoded = flac.decode_flac(flac.encode_flac(docs, "payload").drop("payload"))
    pcm = F.unhex(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), ""))
    read = decoded.withColumn("pcm", pcm)
    last = F.col("blocks")[F.size("blocks") - 1]
    feature = F.concat_ws(":", F.size("blocks"), last["sample_offset"], last["byte_offset"], F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.crc32(b["pcm"])))
    return read.select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "error")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=3)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.balanced_shards(table(spark, sf_dir, "documents"), "doc_id", "text", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id() % 5 == 0
    model = langid.train(docs.filter(~held_out), "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), "text", model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.array_sort(F.map_keys("proportions")).alias("languages"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id() % 3 == 1
    model = mil.train(docs.filter(~held_out), table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return mil.score(docs, "text", model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages", "attention")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.risk_controlled(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang", table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return ordinal.score(docs, "text", model).select("doc_id", "severity", "p_toxic", "grade", "toxic")


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_bpe(docs, "text", public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False).drop("text")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(WORDS))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ids that 7 divides move on by one."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return mining.hard_negatives(vectors, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.coded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": media, "op2_simhash": near_duplicates, "op3_shards": sharding, "op4_chat": chat_format, "op5_mix": mixture,
    "op6_langid": languages, "op7_quality": quality, "op8_rules": quality_rules, "op9_toxicity": toxicity, "op10_bpe": byte_pairs, "op11_pack": packed, "op12_negatives": negatives, "op13_codes": vector_codes,
}


def _rules_sql() -> str:
    """The quality rules for DuckDB: statistics by unnesting words, certification by the binomial tail with lgamma."""
    grids = " UNION ALL ".join(f"SELECT '{rule}' AS rule, unnest([{', '.join(map(repr, grid))}]::DOUBLE[]) AS cutoff" for rule, grid in rules.GRID.items())
    shares = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0 END AS value FROM stats" for rule, (over, under) in rules.SHARES.items())
    return rf"""
    WITH base AS (SELECT doc_id, coalesce('s' || lang, 'n') AS stratum, coalesce(text, '') AS t FROM documents),
    listed AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
    windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS tri FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM listed)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM windows) WHERE c > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
    counted AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
               coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS upper_chars, len(l)::BIGINT AS n_lines
               FROM listed d LEFT JOIN covered c ON d.doc_id = c.doc_id),
    stats AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted),
    shares AS ({shares}), grid AS ({grids}),
    good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
    held AS (SELECT s.* FROM shares s JOIN good USING (doc_id) WHERE NOT base_failed),
    strata AS (SELECT stratum, count(DISTINCT doc_id) AS n FROM held GROUP BY stratum),
    tests AS (SELECT s.stratum, g.rule, g.cutoff, s.n, count(h.doc_id) FILTER (WHERE h.value > g.cutoff) AS k
              FROM strata s CROSS JOIN grid g JOIN held h ON h.stratum = s.stratum AND h.rule = g.rule GROUP BY ALL),
    tails AS (SELECT stratum, rule, cutoff, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rules.RISK}) + (n - j) * ln(1 - {rules.RISK})))) AS p
              FROM tests WHERE k <= n * {rules.RISK}),
    safe AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE p <= {rules.DELTA} / ((SELECT count(*) FROM strata) * {len(rules.GRID)}) GROUP BY ALL),
    broken AS (SELECT DISTINCT doc_id FROM shares JOIN safe USING (stratum, rule) WHERE value > cutoff)
    SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND b.doc_id IS NULL) AS kept
    FROM stats s LEFT JOIN broken b ON s.doc_id = b.doc_id"""


def _floored(scale: int) -> str:
    """Rows of embeddings with finite components only, each times `scale` and rounded down."""
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _negatives_sql() -> str:
    """All pairs of anchors and rows, ranked by windows."""
    return f"""
    WITH base AS ({_floored(256)}),
    kept AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM base WHERE label IS NOT NULL AND vec_id IS NOT NULL),
    scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
               list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
               FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""


def _codes_sql() -> str:
    """Six rounds, each a step of assigning and a step of averaging; codebooks are rows (round, part, entry)."""
    steps = [f"""WITH kept AS ({_floored(4096)}),
    numbered AS (SELECT row_number() OVER () AS r, * FROM kept),
    parts AS (SELECT r, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM numbered, range(8) AS t(p)),
    book0 AS (SELECT p, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM numbered) USING (r) WHERE e < 16)"""]
    near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    for k in range(7):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min_by(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT r, p, x, e, {near} AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p)")
        if k < 6:
            means = f"SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i])::HUGEINT / count(*))::BIGINT AS m FROM near{k}, range(1, 9) AS t(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e"
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM book{k} o LEFT JOIN ({means}) n USING (p, e))")
    return ", ".join(steps) + """,
    codes AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256 FROM codes JOIN numbered USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_rules": _rules_sql(), "op12_negatives": _negatives_sql(), "op13_codes": _codes_sql()}
