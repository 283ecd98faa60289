"""Queries ``opN_<name>``: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, weights=(5.0, 2.0, 1.0), max_repeat=3)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies", "source")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_sequences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_sequences(docs, path("byte_bpe_50k.json"), limit=1024, end_id=2, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, graded

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, graded(table(spark, sf_dir, "labels")), levels=3, keep_at=0.6)
    return scored.select("doc_id", F.col("quality.expected").alias("expected_grade"), F.col("quality.tail").alias("tail_probability"), "quality.keep")


def op4_sniff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_texts, stored_features

    return stored_features(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_drop_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_shared_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_shared_lines(docs, min_chars=40, min_docs=5)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("lines.n_lines").cast("long").alias("n_lines"), F.col("lines.n_dropped").cast("long").alias("n_dropped"), digest.alias("kept_sha256"))


def op6_similar_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


def op7_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors, k=20)


def op9_capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_history

    history = capture_history(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_range", "history_pos")


def op10_count_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .tokencount import count_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_pieces(docs, path("byte_bpe_50k.json")).select("doc_id", "n_words", "n_pieces")


def op11_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import drop_repeats

    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ballmeans import ball_kmeans, described

    assigned, centroids = ball_kmeans(table(spark, sf_dir, "embeddings"), 16, rounds=3, dim=64, scale=64.0, seed=1)
    return described(assigned, centroids, spark).withColumnRenamed("id", "vec_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fillmiddle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, plain_percent=10, spm_percent=20)
    again = restored(F.col("fim.output"), F.col("fim.form"))
    return cut.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pack_sequences": op2_pack_sequences,
    "op3_quality": op3_quality,
    "op4_sniff_media": op4_sniff_media,
    "op5_drop_shared_lines": op5_drop_shared_lines,
    "op6_similar_components": op6_similar_components,
    "op7_scan_licenses": op7_scan_licenses,
    "op8_nearest": op8_nearest,
    "op9_capture_history": op9_capture_history,
    "op10_count_pieces": op10_count_pieces,
    "op11_drop_repeats": op11_drop_repeats,
    "op12_ball_clusters": op12_ball_clusters,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LINE_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ORACLE_5 = f"""
    WITH lines AS (
        SELECT doc_id, list_transform(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1),
                                      lambda i: {{'pos': i, 'line': string_split(coalesce(text, ''), chr(10))[i]}}) AS ls
        FROM documents
    ), flat AS (SELECT doc_id, unnest(ls) AS l FROM lines),
    keyed AS (
        SELECT doc_id, l.pos AS pos, l.line AS line,
               translate(trim(l.line, {_LINE_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM flat
    ), shared AS (
        SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
    ), judged AS (
        SELECT keyed.doc_id, pos, line, shared.top IS NOT NULL AND keyed.doc_id <> shared.top AS gone
        FROM keyed LEFT JOIN shared ON keyed.k = shared.k
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
"""

_ORACLE_11 = """
    WITH texts AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    -- pieces of 100 starts each, because cutting a string takes time in proportion to where the cut is
    pieces AS MATERIALIZED (
        SELECT doc_id, 100 * c AS base, least(100, n - 99 - 100 * c) AS starts, substr(h, 200 * c + 1, 398) AS h
        FROM (SELECT *, unnest(range(CAST(ceil((n - 99) / 100) AS BIGINT))) AS c FROM texts WHERE n >= 100)
    ),
    strings AS (SELECT doc_id, base, unnest(range(starts)) AS i, h FROM pieces),
    named AS MATERIALIZED (SELECT doc_id, base + i AS s, md5_number(substr(h, 2 * i + 1, 200)) AS name FROM strings),
    numbered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY name ORDER BY doc_id, s) AS k FROM named),
    later AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM numbered WHERE k > 1),
    runs AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later),
    spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run),
    edges AS (
        SELECT t.doc_id, t.h, p.a AS a, p.b AS b, coalesce(lag(p.b) OVER (PARTITION BY t.doc_id ORDER BY p.a), 0) AS from_,
               lead(p.a) OVER (PARTITION BY t.doc_id ORDER BY p.a) AS next_a
        FROM texts t JOIN spans p ON t.doc_id = p.doc_id
    ),
    kept AS (
        SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
               string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || max(CASE WHEN next_a IS NULL THEN substr(h, 2 * b + 1) ELSE '' END) AS rest
        FROM edges GROUP BY doc_id
    )
    SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(k.rest, t.h))) AS kept_sha256
    FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def _oracle_12(rounds: int = 3) -> str:
    """The rounds of k-means written out, every vector against every centroid."""
    sql = """
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept QUALIFY cluster < 16
        )"""
    for r in range(rounds + 1):
        sql += f""", d{r} AS (
            SELECT vec_id, v, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance FROM kept CROSS JOIN c{r}
        ), a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY distance, cluster) = 1)"""
        if r < rounds:
            sql += f""", s{r} AS (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY cluster, i),
            m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster),
            c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)"""
    return sql + f"""
        SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
    """


_ORACLE_13 = """
    WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    x AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM h),
    y AS (
        SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
                    WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM x
    ), z AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM y)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM z
"""

_ORACLE_6 = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, md5_number(s) AS s FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words
        )
    ),
    sizes AS MATERIALIZED (SELECT w.doc_id, count(s.s) AS n FROM words w LEFT JOIN shingles s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
    links AS MATERIALIZED (
        SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) p
        JOIN sizes a ON a.doc_id = p.x JOIN sizes b ON b.doc_id = p.y WHERE 100 * c >= 75 * (a.n + b.n - c)
    ),
    reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
    SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id FROM sizes s LEFT JOIN reached r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""

ORACLES: dict[str, str] = {
    "op6_similar_components": _ORACLE_6,
    "op11_drop_repeats": _ORACLE_11,
    "op12_ball_clusters": _oracle_12(),
    "op13_fill_in_middle": _ORACLE_13,
    "op5_drop_shared_lines": _ORACLE_5,
    "op8_nearest": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score,
                   CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS INTEGER) AS rank
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        ) WHERE rank <= 20
    """,
}
