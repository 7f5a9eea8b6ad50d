"""One query per operator over its whole table, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, embeddings, language, licenses, mixing, pieces, pii, ranked, sharding, simhash, topk, toxicity
from .common import table

RANKS_FILE, PIECES_FILE, TABLE_FILE = corpus_pipeline.RANKS_FILE, "piece_bpe_32k.model", "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


_GOOD_VECTOR = ("embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, "
                "lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")


@query("op1_embedding_near_dedup", f"""
    WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                            WHERE {_GOOD_VECTOR} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM good a JOIN good b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(src, dst) AS (SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src),
    least AS (SELECT src, min(dst) AS low FROM reach GROUP BY src),
    counts AS (SELECT src, count(*) AS n FROM links GROUP BY src)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
    FROM embeddings LEFT JOIN least ON least.src = vec_id LEFT JOIN counts ON counts.src = vec_id""")
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_source_mix")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op4_exact_top_k", f"""
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND {_GOOD_VECTOR}),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    plain = f"(' ' || regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"
    for other, word in licenses.SPELLINGS.items():
        plain = f"replace({plain}, ' {other} ', ' {word} ')"
    return f"sha256(trim(regexp_replace({plain}, ' +', ' ', 'g')))"


@query("op8_license_scan", f"""
    WITH known AS (SELECT {_canonical_sql('body')} AS digest, min(license) AS license
                   FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(b)})' for n, b in licenses.KNOWN)}) AS k(license, body)
                   GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
             FROM (SELECT * FROM lines WHERE regexp_matches(lower(line), '{"|".join(licenses.STEMS)}')) l
             JOIN known ON digest = {_canonical_sql('line')} GROUP BY doc_id)
    SELECT d.doc_id, k.license, coalesce(h.n, 0)::BIGINT AS n_notices, coalesce(h.names, '') AS notices
    FROM documents d LEFT JOIN known k ON k.digest = {_canonical_sql('d.text')} LEFT JOIN hits h ON h.doc_id = d.doc_id""")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "license", "n_notices", F.array_join("notices", ",").alias("notices"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


@query("op10_shard_placement")
def op10_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.select("doc_id", *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), "spans")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TABLE_FILE), public_tokenizers.path(PIECES_FILE))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"),
                                 alignment.piece_count(public_tokenizers.path(PIECES_FILE)))


_TERMS = (r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@query("op12_ranked_search", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
    words AS (SELECT r, doc_id, unnest({_TERMS.format(text='text')}) AS term FROM d),
    sizes AS (SELECT r, count(*)::BIGINT AS n FROM words GROUP BY r),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
    asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest({_TERMS.format(text='text')}) AS term
              FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark WHERE text IS NOT NULL))),
    tfs AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
    scored AS (SELECT i, item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
                 * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score
               FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN sizes USING (r), whole GROUP BY i, item_id, r, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES_FILE))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
