"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, remainder, table
from folioscope.llm.exact_dedup import duplicate_groups
from folioscope.llm.extraction import extract_pages
from folioscope.llm.fingerprints import FAN_OUT, RUN_WORDS, fingerprint_documents
from folioscope.llm.jaccard_join import shingle_components
from folioscope.llm.language import identify_languages
from folioscope.llm.manifest import dataset_manifest, leaf_hash
from folioscope.llm.mixing import mixing_probabilities
from folioscope.llm.negatives import mine_negatives
from folioscope.llm.packing import pack
from folioscope.llm.quality import score_quality
from folioscope.llm.rules import judge_quality, trusted_ids
from folioscope.llm.suffix_dedup import remove_repeats
from folioscope.llm.url_filter import document_id, judge_urls

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Weights of the mix, relative to a category's own share of the tokens; all others have 1.
MIX_WEIGHTS = {"lang": {"en": 0.8}, "topic": {"table": 0.5, "capitals": 0.5}}

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select(
        F.col("row_id").alias("doc_id"), (~F.col("learned_from")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round("near_edited", 9).alias("near_edited"), F.round("near_next", 9).alias("near_next")
    )


@query
def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select(
        F.col("row_id").alias("page_id"), F.col("row_url").alias("url"), F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = identify_languages(table(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        F.col("row_id").alias("doc_id"), (~F.col("learned_from")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its calibrated probability and whether it was drawn."""
    mixed = mixing_probabilities(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)
    return mixed.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_probability", 9).alias("mix_probability"), "mix_kept")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the rules, the tree learns from the labels of the documents whose ids end the URLs."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES, labels=labels, label_key=document_id(F.col("url").cast("string")), pool=True)
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", F.col("template"), F.round("purity", 6).alias("purity")
    )


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are found in lower case where a third of the ids, by their CRC, are tampered with."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(remainder(F.col("doc_id"), 3) == 0, leaf_hash(*fields, ascii_lower(F.col("text"))))
    manifest = dataset_manifest(table(spark, sf_dir, "documents"), leaf_hash(*fields, F.col("text")), tampered)
    return manifest.select(
        F.col("row_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=label)


@query
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as good and not as toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    judged = judge_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels"), good))
    return judged.withColumnRenamed("row_id", "doc_id").withColumn("score", F.round("score", 9))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _tree_sql(text: str) -> str:
    """The fingerprint of a text expression."""
    leaves = f"regexp_replace(regexp_replace(p, '([.!?]) ', '\\1 ' || chr(10), 'g'), '((?:[^ ]* ){{{RUN_WORDS}}})', '\\1' || chr(10), 'g')"
    paragraphs = f"list_transform(string_split({text}, chr(10)), lambda p: array_to_string(list_transform(string_split_regex({leaves}, '\\n+'), lambda q: substr(sha256(q), 1, 12)), ' '))"
    ends = f"p = substr(sha256(''), 1, 12) OR ('0x' || substr(sha256(p), 1, 4))::INT % {FAN_OUT} = 0"
    sections = f"string_split(array_to_string(list_transform({paragraphs}, lambda p: p || CASE WHEN {ends} THEN chr(10) ELSE '|' END), ''), chr(10))"
    nodes = f"array_to_string(list_transform(list_filter(list_transform({sections}, lambda s: rtrim(s, '|')), lambda s: s <> ''), lambda s: substr(sha256(s), 1, 12) || '(' || s || ')'), '')"
    return f"(SELECT sha256(sha256({text}) || x.nodes) || ':' || x.nodes FROM (SELECT {nodes} AS nodes) x)"


def _likeness_sql(left: str, right: str) -> str:
    leaves = lambda f: f"list_distinct(flatten(list_transform(list_filter(string_split(split_part({f}, ':', 2), ')'), lambda s: s <> ''), lambda s: string_split_regex(split_part(s, '(', 2), '[ |]'))))"
    return f"(SELECT CASE WHEN {left} = {right} THEN 1.0::DOUBLE ELSE len(list_intersect(x.a, x.b))::DOUBLE / len(list_distinct(list_concat(x.a, x.b))) END FROM (SELECT {leaves(left)} AS a, {leaves(right)} AS b) x)"


def _levels_sql(name: str, start: str, tree: str, levels: int) -> str:
    """The tree over ``(tree, pos, d, n)`` of a statement, level by level, with the siblings of each node."""
    steps = [f"{name}0 AS MATERIALIZED ({start})"]
    around = "string_agg(d, '') OVER (PARTITION BY {tree}, pos // 8 ORDER BY pos ROWS BETWEEN {frame})"
    for k in range(levels):
        before = around.format(tree=tree, frame="UNBOUNDED PRECEDING AND 1 PRECEDING")
        after = around.format(tree=tree, frame="1 FOLLOWING AND UNBOUNDED FOLLOWING")
        steps.append(f"{name}{k}_runs AS MATERIALIZED (SELECT *, coalesce({before}, '') AS l, coalesce({after}, '') AS r FROM {name}{k})")
        steps.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT {tree}, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n,
                CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d
                FROM {name}{k} GROUP BY {tree}, pos // 8)"""
        )
    return ",\n".join(steps)


def _folds_sql(name: str, start: str, runs: str, tree: str, levels: int) -> str:
    steps = [f"{name}0 AS ({start})"]
    for k in range(levels):
        steps.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.pos // 8 AS pos,
                CASE WHEN t.n > 1 THEN sha256(t.l || v || t.r) ELSE v END AS v,
                CASE WHEN t.n > 1 THEN proof || t.l || t.r ELSE proof END AS proof)
                FROM {name}{k} f JOIN {runs}{k}_runs t ON f.pos = t.pos AND f.{tree} IS NOT DISTINCT FROM t.{tree})"""
        )
    return ",\n".join(steps)


def _leaf_sql(text: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Eight levels hold 16 million rows per language, three 512 languages.
_ROW_LEVELS, _LANGUAGE_LEVELS = 8, 3

_MANIFEST_SQL = f"""
    WITH digits AS (SELECT *, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT) AS codes FROM documents),
    crc AS (SELECT *, xor(4294967295::BIGINT, list_reduce(codes, lambda c, x:
              list_reduce(range(8), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END, xor(c, x)), 4294967295::BIGINT)) AS crc FROM digits),
    leaves AS MATERIALIZED (SELECT doc_id, lang, {_leaf_sql("text")} AS d,
              CASE WHEN crc % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS v FROM crc),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    {_levels_sql("t", "SELECT lang, pos, n, d FROM placed", "lang", _ROW_LEVELS)},
    languages AS MATERIALIZED (SELECT 0 AS whole, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d FROM t{_ROW_LEVELS}),
    {_levels_sql("u", "SELECT whole, pos, n, d FROM languages", "whole", _LANGUAGE_LEVELS)},
    {_folds_sql("f", "SELECT doc_id, lang, pos, d AS leaf, v, '' AS proof FROM placed", "t", "lang", _ROW_LEVELS)},
    {_folds_sql("g", f"SELECT f.* REPLACE (s.pos AS pos), s.d AS subroot, 0 AS whole FROM f{_ROW_LEVELS} f JOIN languages s ON s.lang IS NOT DISTINCT FROM f.lang", "u", "whole", _LANGUAGE_LEVELS)}
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified
    FROM g{_LANGUAGE_LEVELS}, (SELECT d AS root FROM u{_LANGUAGE_LEVELS})
"""

SQL: dict[str, str] = {
    "op2_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
                   FROM d WINDOW w AS (ORDER BY doc_id, text)),
             e AS (SELECT doc_id, text, next_text, length(text) AS n_chars,
                          substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM n),
             f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_tree_sql("e.text")} AS fingerprint,
                          {_tree_sql("e.edited")} AS edited_fingerprint, {_tree_sql("e.next_text")} AS next_fingerprint FROM e)
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
               round({_likeness_sql("f.fingerprint", "f.edited_fingerprint")}, 9) AS near_edited,
               round({_likeness_sql("f.fingerprint", "f.next_fingerprint")}, 9) AS near_next FROM f
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op11_manifest": _MANIFEST_SQL,
    "op12_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS (SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same,
                          list_inner_product(a.vector, r.vector)::BIGINT AS score
                   FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0),
             p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.positive_id,
               (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INT AS rank,
               n.id AS negative_id, p.positive_score, n.score AS negative_score
        FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same
             AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
        QUALIFY rank <= 5
    """,
}
