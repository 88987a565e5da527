"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetlake.llm.clustering import cluster_report
from sheetlake.llm.common import table
from sheetlake.llm.exact_dedup import exact_duplicates
from sheetlake.llm.license_scan import license_labels
from sheetlake.llm.mixing import mix_sources, mixed_words
from sheetlake.llm.packing import pack_documents
from sheetlake.llm.passage_dedup import passage_report
from sheetlake.llm.personal_data import personal_data
from sheetlake.llm.resampling import importance_ranks
from sheetlake.llm.shingle_join import similar_documents
from sheetlake.llm.simhash_dedup import near_duplicates
from sheetlake.llm.tool_calls import CHAT_SCHEMAS, chat_calls, linked_calls
from sheetlake.llm.toxicity import toxicity_scores
from sheetlake.llm.vector_search import nearest_neighbours
from sheetlake.plans.registry import registry

QUERIES, ORACLES, register = registry()


@register("op5_mix_sources", r"""
WITH sized AS (
    SELECT doc_id, source, md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents),
named AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
    FROM sized GROUP BY source),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 4 * source_size AS cap2 FROM named),
filled AS (
    SELECT *, 3 * sum(source_size) OVER () AS pool2,
           coalesce(sum(cap2) OVER (ORDER BY cap2 * 6 // w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
           sum(w) OVER (ORDER BY cap2 * 6 // w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM weighed),
levelled AS (SELECT *, cap2 * rest <= w * (pool2 - gone) AS is_full FROM filled),
opened AS (
    SELECT *, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS ow,
           pool2 - sum(CASE WHEN is_full THEN cap2 ELSE 0 END) OVER () AS op
    FROM levelled),
targets AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN CAST(cap2 AS DOUBLE) / 2 ELSE CAST(w * op AS DOUBLE) / CAST(ow * 2 AS DOUBLE) END AS target,
           CASE WHEN is_full THEN cap2 // 2 ELSE (w * op + ow) // (2 * ow) END AS quota
    FROM opened),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.quota,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) AS BIGINT) AS taken
FROM placed""")
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_words(mix_sources(table(spark, folder, "documents")))


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op7_pack_documents")
def op7_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), *tokenizer_files())


@register("op8_exact_dedup", r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS group_size,
       row_number() OVER g = 1 AS kept, s AS text_sha256
FROM d WINDOW g AS (PARTITION BY s ORDER BY chars DESC, doc_id NULLS LAST)""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@register("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@register("op4_nearest_vectors")
def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op6_personal_data")
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


@register("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_labels(table(spark, folder, "documents"))


@register("op3_line_dedup", r"""
WITH pieces AS (
    SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece
    FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS p FROM documents)),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS past FROM pieces),
words AS (
    SELECT doc_id, past - length(piece) AS a, past AS b,
           translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, row_number() OVER w AS n,
           right(piece, 1) IN ('.', '!', '?', ',', ';', ':') OR lead(i) OVER w IS NULL AS closes
    FROM placed WHERE NOT regexp_matches(piece, '^[\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
clauses AS (SELECT doc_id, n AS stop, lag(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS start FROM words WHERE closes),
units AS (SELECT c.doc_id, c.start, e.stop FROM clauses c ASOF JOIN clauses e ON c.doc_id = e.doc_id AND c.start + 40 <= e.stop),
texts AS (SELECT doc_id, list(word ORDER BY n) AS ws, list(a ORDER BY n) AS starts, list(b ORDER BY n) AS ends FROM words GROUP BY doc_id),
spans AS (
    SELECT doc_id, starts[start + 1] AS a, ends[stop] AS b, array_to_string(ws[start + 1:stop], ' ') AS normal FROM units JOIN texts USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY doc_id, a) > 1 AS gone FROM spans),
begun AS (
    SELECT doc_id, a, b, a >= coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh
    FROM ranked WHERE gone),
numbered AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM begun),
merged AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, k),
cut AS (SELECT doc_id, sum(b - a) AS size, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM merged GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed,
       CAST(length(coalesce(text, '')) - coalesce(size, 0) AS BIGINT) AS kept_chars, coalesce(removed_spans, '') AS removed_spans
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN cut USING (doc_id)""")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_report(table(spark, folder, "documents"))


@register("op1_tool_calls")
def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return linked_calls(*chat_calls(table(spark, folder, "conversations")), CHAT_SCHEMAS)


@register("op11_shingle_join", r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""")
def op11_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents"))


@register("op12_importance_resampling", r"""
WITH remainders AS (
    SELECT list(list_reduce(list_prepend(i, range(8)),
                            lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS of_byte
    FROM (SELECT unnest(range(256)) AS i)),
texts AS (
    SELECT 0 AS kind, doc_id, doc_id AS place, text FROM documents
    UNION ALL SELECT 1, item_id, item_id, text FROM benchmark),
split AS (
    SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
features AS (SELECT kind, doc_id, unnest(words) AS word FROM split),
summed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(word) + 1),
                lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM features), remainders),
filled AS (SELECT kind, doc_id, bucket, count(*) AS n FROM features JOIN summed USING (word) GROUP BY ALL),
histogram AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t
    FROM filled GROUP BY bucket),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM histogram),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM histogram, totals),
weights AS (SELECT doc_id, sum(n * gain) AS weight FROM filled JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (
    SELECT s.doc_id, len(s.words) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || s.doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE
               / 4294967296))) AS BIGINT) AS BIGINT) AS score
    FROM split s LEFT JOIN weights w ON w.doc_id = s.doc_id WHERE s.kind = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth,
           10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= drawn THEN nth END AS rank FROM ranked""")
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _rounds_of_centroids(rounds: int) -> str:
    """The CTEs ``near1, centroids1`` and so on: each round's nearest centroids, then the floors of their means."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""far{n} AS (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance
    FROM parts v JOIN centroids{n} c USING (dimension) GROUP BY ALL),
near{n} AS (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{n} GROUP BY vec_id),
sums{n} AS (
    SELECT cluster, dimension, sum(x) AS s, count(*) AS n FROM parts JOIN near{n} USING (vec_id) GROUP BY ALL),
centroids{n + 1} AS (
    SELECT c.cluster, c.dimension, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - (s % n + n) % n) // n AS BIGINT) END AS x
    FROM centroids{n} c LEFT JOIN sums{n} USING (cluster, dimension))""")
    return ",\n".join(steps)


@register("op13_centroid_clusters", f"""
WITH kept AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (
    SELECT vec_id, generate_subscripts(embedding, 1) AS dimension, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
    FROM kept),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept),
centroids0 AS (SELECT CAST(cluster AS INTEGER) AS cluster, dimension, x FROM parts JOIN starts USING (vec_id) WHERE cluster < 16),
{_rounds_of_centroids(3)},
digests AS (
    SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dimension)) AS centroid_sha256 FROM centroids3 GROUP BY cluster)
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM near3 JOIN digests USING (cluster)""")
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_report(table(spark, folder, "embeddings"))
