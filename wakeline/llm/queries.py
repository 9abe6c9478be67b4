"""The registered queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_back
from .common import read
from .divergence import divergences
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .language import fit_language, predict_language
from .license_scan import scan_licenses
from .mixing import mix
from .neighbours import neighbours
from .packing import pack
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .whitening import whiten


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op4_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    segments, leaves = format_chats(rows)
    # A very common conversation is one large key of leaves, which Spark's skew join splits; read_back has one row for it.
    return leaves.join(read_back(segments), "digest").drop("digest")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict_language(docs, fit_language(docs))


def op10_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op11_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_jaccard_metric_join,
        op3_best_fit_packing,
        op4_quality_compression,
        op5_exact_dedup,
        op6_chat_prefix_tree,
        op7_license_scan,
        op8_nearest_neighbours,
        op9_language_ecoc,
        op10_substring_fm_index,
        op11_balanced_label_propagation,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_ROLE = f"replace({_ESCAPED}, chr(10), '\\' || chr(10))"

ORACLE_SQL: dict[str, str] = {
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), t AS (SELECT id, lang, source, unnest(words) AS term FROM d
        ), tf AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS df FROM t GROUP BY lang, source, term
        ), kept AS (SELECT lang, term, sum(c) AS total FROM tf GROUP BY lang, term HAVING sum(df) >= 3
        ), v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
        ), sums AS (SELECT lang, source, sum(c) AS n FROM tf SEMI JOIN kept USING (lang, term) GROUP BY lang, source
        ), g AS (
            SELECT lang, source, coalesce(sums.n, 0)::HUGEINT AS n, coalesce(v.v, 0)::HUGEINT AS v
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sums USING (lang, source) LEFT JOIN v USING (lang)
        ), p AS (
            SELECT lang, g.source, term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (g.n + g.v) AS p,
                   1 + 1000000000::HUGEINT * (total + 1) // (v.n + v.v)::HUGEINT AS q
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN tf USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op10_substring_fm_index": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), win AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
        ), hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM win
        ), often AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1
        ), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM hashed WHERE h IN (SELECT h FROM often)
        ), gone AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM covered GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(js, k)], ' ') END) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op6_chat_prefix_tree": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(length('<|turn|>') + length({_ROLE.format("role")}) + 1 + length({_ESCAPED.format("text")}) + length('<|end|>') + 1)::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
}
