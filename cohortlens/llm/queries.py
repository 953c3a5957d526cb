"""The thin registered queries over the corpus operators: each derives the contract's columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    bitpack,
    bpe,
    decontam,
    filter_audit,
    html_extract,
    license_scan,
    line_dedup,
    pii,
    quality,
    simhash,
    spelling,
    suffix_dedup,
    word_bpe,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = license_scan.scan(table(spark, sf_dir, "documents"))
    word = F.transform("exact", lambda x: x["word"])
    base = F.transform("exact", lambda x: x["label"])
    extra = F.transform("fuzzy", lambda x: x["label"])
    spans = F.transform("fuzzy", lambda x: F.concat_ws(":", x["label"], x["word"], x["to"], x["edits"]))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return r.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, extra)).alias("labels"),
        "score",
        F.array_join(spans, ",").alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitpack.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return bitpack.read_digest(spark, files).select(
        F.col("doc").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return r.select(
        F.col("doc").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix_dedup.report(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
    return r.withColumn("has_repeat", F.col("n_removed") > 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pii.find(table(spark, sf_dir, "documents"))
    place = F.array(*[F.lit(k) for k in pii.KINDS])

    def joined(spans):
        ranked = F.transform(
            spans,
            lambda x: F.struct(
                F.coalesce(F.nullif(F.array_position(place, x["kind"]), F.lit(0)), F.lit(len(pii.KINDS) + 1)).alias("o"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")
            ),
        )
        return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return r.select(
        F.col("doc").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return r.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return r.select(
        F.col("doc").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_bitpack": op3_bitpack,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_html_extract": op7_html_extract,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_word_bpe": op12_word_bpe,
    "op13_filter_audit": op13_filter_audit,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     lines AS (SELECT doc_id, ls[pos] AS line, pos,
                      translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
               FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM texts)),
     held AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     marked AS (SELECT l.*, coalesce(l.doc_id < h.keeper, false) AS gone FROM lines l LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_decontamination": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     grams AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS gram
               FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM items)),
     windows AS (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS gram
                 FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
                       FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
     found AS (SELECT doc_id, item_id, p, k FROM windows JOIN grams USING (k, gram)),
     hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
             FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM found) GROUP BY doc_id),
     held AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op13_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
     known AS (SELECT doc_id, max(quality) FILTER (WHERE quality = 1) AS good, max(toxic) FILTER (WHERE toxic = 1) AS toxic
               FROM labels GROUP BY doc_id),
     failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                       CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                       || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                       || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                       || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                       || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
                FROM words LEFT JOIN known USING (doc_id)),
     sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
     letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
                WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     gone AS (SELECT part, fails, o, n, good, toxic,
                     CASE WHEN fails = '' THEN 9 ELSE list_min([strpos(o, l) FOR l IN string_split(fails, '')]) END AS place
              FROM sets, orders),
     steps AS (SELECT part, o, s, substr(o, s, 1) AS f,
                      sum(CASE WHEN place > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = s THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN place < s AND contains(fails, substr(o, s, 1)) THEN n ELSE 0 END) AS redundant,
                      sum(CASE WHEN fails = substr(o, s, 1) THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN place = s THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN place = s THEN toxic ELSE 0 END) AS toxic_lost
               FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY part, o, s)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps""",
}
