"""Query catalogue over the driver's tables: each query with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ChunkConfig
from .functions import text as T
from .operators import answers, cells, changes, chunking, citations, entities, fusion, index, metrics, models, segments, topk, vectors
from .sources import arrays, corpora, keyed
from .storage import scratch_path, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# -- text ------------------------------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_MASK = rf"regexp_replace(regexp_replace({_CLEAN}, 'T\.C\.?\s*Kimlik\s*No\s*[:\-]?\s*\d+|TC\s*Kimlik\s*No\s*[:\-]?\s*\d+', '[ANONIM]', 'gi'), '\b\d{{11}}\b', '[ANONIM]', 'g')"
_PERSONS = (
    rf"regexp_replace(regexp_replace(regexp_replace({_MASK}, '\b\d{{11}}\b', '[TC_KIMLIK_NO]', 'g'), '\b0?5\d{{9}}\b', '[TELEFON]', 'g'), "
    r"'[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '[EMAIL]', 'g')"
)
#: Sources and languages stand in for articles and laws; classes of the little lexicons are languages.
_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, {_CLEAN} AS cleaned, {_MASK} AS masked, {_PERSONS} AS anonymous FROM documents")
def q_clean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3"""
    c = F.col("text")
    masked = T.mask_ids(c)
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_whitespace(c).alias("cleaned"), masked.alias("masked"), T.mask_persons(masked).alias("anonymous"))


@query(f"SELECT doc_id, length({_MASK}) AS char_len, length({_PERSONS}) >= 300 AS decision_passes FROM documents WHERE length({_MASK}) >= 50")
def q_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", T.mask_persons(T.mask_ids(F.col("text"))).alias("anonymous"))
    return changes.statute_gate(docs).select("doc_id", "char_len", (F.length("anonymous") >= 300).alias("decision_passes"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5"""
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(
    f"SELECT doc_id, len({_WORDS}) AS words, len({_WORDS}) * 13 // 10 AS about_tokens, len({_TOKENS}) AS search_tokens, "
    f"array_to_string({_TOKENS}[1:5], ' ') AS first_tokens FROM documents"
)
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T11, T25"""
    tokens = T.search_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.word_count(F.col("text")).cast("long").alias("words"), T.approx_tokens(F.col("text")).cast("long").alias("about_tokens"),
        F.size(tokens).cast("long").alias("search_tokens"), F.array_join(F.slice(tokens, 1, 5), " ").alias("first_tokens"),
    )


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n, list_max(list_transform({_SENTENCES}, lambda s: length(s))) AS longest, md5(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16"""
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest")
    )


_PARTS = r"list_filter(list_transform(string_split(regexp_replace(text, '(\(\s*\d+\s*\))', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_CLAUSES = (
    r"list_filter(list_transform(flatten(list_transform(" + _PARTS + r", lambda p: string_split(regexp_replace(p, '(\s[a-zA-ZçğışöüÇĞIİŞÖÜ]\)\s)', chr(1) || '\1', 'g'), chr(1)))), "
    r"lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
)


@query(f"SELECT doc_id, len({_CLAUSES}) AS n, md5(array_to_string({_CLAUSES}, '|')) AS digest FROM documents")
def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15"""
    p = T.paragraphs(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|").cast("binary")).alias("digest"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]') THEN regexp_extract(source, '([0-9]+)', 1) ELSE '' END AS number, "
    "regexp_replace(source || '/' || lang, '[^A-Za-z0-9_]', '_', 'g') AS slug, lang || ' Madde ' || source || ': ' || text AS enriched, substr(text, 1, 200) || '...' AS snippet, "
    "round(1 / (1 + exp(-(doc_id % 9 - 4))), 6) AS squashed FROM documents"
)
def q_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, T19, T20, T22, T26"""
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.first_number(F.col("source")).alias("number"), T.slug(F.concat("source", F.lit("/"), "lang")).alias("slug"),
        T.enriched_text(F.col("lang"), F.col("source"), F.col("text")).alias("enriched"), T.snippet(F.col("text")).alias("snippet"), T.sigmoid(F.col("doc_id") % 9 - 4).alias("squashed"),
    )


# -- index -----------------------------------------------------------------------------------------------------

_FLAT = f"tokens AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), flat AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tokens)"


@query(f"WITH {_FLAT} SELECT doc_id, term, count(*) AS tf FROM flat GROUP BY doc_id, term")
def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, D8"""
    return index.postings(index.tokenised(table(spark, sf_dir, "documents"))).select("doc_id", "term", "tf")


_STATS = "stats AS (SELECT count(*) AS n, sum(len(ts)) / greatest(count(*), 1) AS avgdl FROM tokens)"
_IDF = "terms AS (SELECT term, count(DISTINCT doc_id) AS df FROM flat GROUP BY term), idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM terms, stats)"


@query(f"WITH {_FLAT}, {_STATS}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3"""
    tokens = index.tokenised(table(spark, sf_dir, "documents"))
    return index.term_stats(index.postings(tokens), index.corpus_stats(tokens)).select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = f"""
    {_FLAT}, {_STATS}, {_IDF},
    posts AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM flat GROUP BY doc_id, term),
    asked AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    wanted AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
    scores AS (
        SELECT query_id, doc_id, sum(qtf * idf * (tf * 2.6 / (tf + 1.6 * (1 - 0.68 + 0.68 * dl / avgdl)) + 1.0)) AS raw
        FROM wanted JOIN posts USING (term) JOIN idf USING (term), stats GROUP BY query_id, doc_id
    ), sparse AS (
        SELECT query_id, doc_id, round(raw, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, doc_id) AS rank FROM scores
    )"""


def _sparse(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return topk.bm25_top(table(spark, sf_dir, "documents"), queries, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM sparse WHERE rank <= 10")
def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship"""
    return _sparse(spark, sf_dir, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_COS = "list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v)))"


@query(f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, round({_COS}, 4) AS score FROM e q JOIN e p USING (label) WHERE q.vec_id % 50 = 0)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 200
""")
def q_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label plays the law; the stated query set is every 50th vector"""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("law"))
    asked = e.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    return vectors.dense_top(asked, e, 200).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(ORACLES["q_dense_topk"])
def q_quantised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from vectors stored as bytes"""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("law"))
    asked = e.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    stored = written(e.select("doc_id", vectors.quantise(F.col("vector")).alias("quantised"), "law"), "quantised")
    found = vectors.quantised_top(asked, stored, 200, whole=e)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH {_BM25}, few AS (SELECT * FROM sparse WHERE rank <= 50),
    w AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM few)
    SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS scaled FROM w
""")
def q_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6"""
    return _sparse(spark, sf_dir, 50).select("query_id", "doc_id", F.round(fusion.min_max(F.col("score")), 6).alias("scaled"))


def _round(x: str, places: int) -> str:
    """A double rounded by its shortest decimal form, half up, as Spark does: products with 0.7 are often ties."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS DOUBLE)"


_HYBRID = f"""{_BM25},
    meta AS (SELECT doc_id, lang AS law, source AS article_no, regexp_extract(source, '([0-9]+)', 1) AS number FROM documents),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    asked2 AS (
        SELECT b.item_id AS query_id, CASE b.item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS query_law, CASE WHEN b.item_id % 4 = 0 THEN CAST(b.item_id % 20 AS VARCHAR) END AS query_article,
               CASE WHEN b.item_id % 4 = 0 THEN 0.3 WHEN len({_WORDS}) < 4 THEN 0.5 WHEN len({_WORDS}) > 15 THEN 0.7 ELSE 0.6 END AS alpha
        FROM benchmark b
    ),
    sp AS (
        SELECT s.query_id, s.doc_id, {_round('CASE WHEN m.law <> a.query_law THEN s.score * 0.7 ELSE s.score END', 4)} AS score
        FROM sparse s JOIN meta m USING (doc_id) JOIN asked2 a USING (query_id) WHERE rank <= 200
    ),
    ds AS (
        SELECT a.query_id, p.vec_id AS doc_id, round({_COS}, 4) AS score
        FROM asked2 a JOIN e q ON q.vec_id = a.query_id, e p JOIN meta m ON m.doc_id = p.vec_id WHERE a.query_law IS NULL OR m.law = a.query_law
    ),
    dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ds) WHERE r <= 200),
    dn AS (SELECT query_id, doc_id, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS d FROM dr WINDOW w AS (PARTITION BY query_id)),
    sn AS (SELECT query_id, doc_id, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM sp WINDOW w AS (PARTITION BY query_id)),
    fused AS (
        SELECT query_id, doc_id, round(alpha * coalesce(d, 0.0) + (1 - alpha) * coalesce(s, 0.0), 6) AS score
        FROM dn FULL OUTER JOIN sn USING (query_id, doc_id) JOIN asked2 USING (query_id)
    ),
    lifted AS (
        SELECT f.query_id, f.doc_id, m.law, m.article_no, m.number, a.query_law, a.query_article,
               CASE WHEN m.number = a.query_article THEN round(f.score * 10, 6) ELSE f.score END AS one
        FROM fused f JOIN meta m USING (doc_id) JOIN asked2 a USING (query_id)
    ),
    boosted AS (SELECT *, CASE WHEN law = query_law THEN round(one * 1.2, 6) ELSE one END AS score FROM lifted),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM boosted WHERE score >= 0.001)"""


def _law(item: Column) -> Column:
    """A query's law: one language, another, or none."""
    return F.when(item % 3 == 0, "en").when(item % 3 == 1, "de")


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boosted hits, queries, and corpus: language as law, source as article, and the vector of the item's number as query vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("law"), F.col("source").alias("article_no"))
    e = table(spark, sf_dir, "embeddings")
    article = F.when(F.col("item_id") % 4 == 0, (F.col("item_id") % 20).cast("string"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", _law(F.col("item_id")).alias("query_law"), article.alias("query_article"))
    meta = docs.select("doc_id", "law", "article_no")
    asked = queries.select("query_id", "query_law", "query_article")
    sparse = topk.bm25_top(docs, queries, 200).drop("rank")
    sparse = index.penalise_other_law(sparse.join(meta, "doc_id").join(asked, "query_id"), 0.70)
    points = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")).join(meta.select("doc_id", "law"), "doc_id")
    q = asked.select("query_id", F.col("query_law").alias("law")).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    dense = vectors.dense_top(q, points, 200)
    alphas = queries.select("query_id", fusion.alpha(F.col("text"), F.col("query_article")).alias("alpha"))
    hits = fusion.fuse(dense, sparse, alphas).join(meta, "doc_id").join(asked, "query_id")
    return written(fusion.ranked(fusion.boost(hits)), "hits"), asked, meta


@query(f"""
    WITH {_HYBRID},
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, law, number ORDER BY rank) AS place FROM hits),
    few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final FROM capped WHERE place <= 2)
    SELECT query_id, doc_id, score, final AS rank FROM few WHERE final <= 10
""")
def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, H1-H3, F10, W3-W6"""
    hits, _, _ = _hybrid(spark, sf_dir)
    return fusion.diversify(hits, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH {_HYBRID}, near AS (SELECT * FROM hits WHERE rank <= 20),
    served AS (SELECT DISTINCT query_id FROM near WHERE number = query_article),
    top AS (SELECT query_id, max(score) AS top FROM near GROUP BY query_id),
    found AS (
        SELECT a.query_id, m.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY m.doc_id) AS place
        FROM asked2 a JOIN meta m ON m.number = a.query_article AND (a.query_law IS NULL OR m.law = a.query_law) WHERE a.query_id NOT IN (SELECT query_id FROM served)
    ),
    more AS (SELECT f.query_id, f.doc_id, round(coalesce(top, 1.0) * 1.2, 6) AS score, -place AS r, true AS injected FROM found f LEFT JOIN top USING (query_id) WHERE place <= 3),
    every AS (
        SELECT query_id, doc_id, score, rank AS r, false AS injected FROM near WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM more)
        UNION ALL SELECT * FROM more
    )
    SELECT query_id, doc_id, score, injected, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM every
""")
def q_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, W7 on the first twenty hits"""
    hits, asked, meta = _hybrid(spark, sf_dir)
    out = fusion.inject(hits.filter("rank <= 20"), asked, meta)
    return out.select("query_id", "doc_id", "score", "injected", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    q AS (SELECT vec_id, v, CASE WHEN vec_id % 100 = 0 THEN 99 ELSE label END AS law FROM e WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, p.label = q.law AS own, round({_COS}, 4) AS score FROM q, e p),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE own) WHERE r <= 20),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 20),
    few AS (SELECT vec_id AS query_id FROM q WHERE (SELECT count(*) FROM a WHERE a.query_id = q.vec_id) < 10)
    SELECT query_id, doc_id, score FROM a UNION ALL
    SELECT query_id, doc_id, score FROM b WHERE query_id IN (SELECT query_id FROM few) AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id)
""")
def q_fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second query asks for a label that no vector has"""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("law"))
    asked = e.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    asked = asked.withColumn("law", F.when(F.col("query_id") % 100 == 0, 99).otherwise(F.col("law")))
    blocks = cells.built(e)
    return vectors.fallback(vectors.dense_top(asked, e, 20, blocks=blocks), vectors.dense_top(asked, e, 20, filtered=False, blocks=blocks), 10)


@query("""
    WITH r AS (SELECT doc_id, doc_id % 50 AS query_id, lang, regexp_extract(source, '([0-9]+)', 1) AS number, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang, number ORDER BY rank) AS place FROM r),
    f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM c WHERE place <= 2)
    SELECT query_id, doc_id, rank FROM f WHERE rank <= 12
""")
def q_diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of fifty groups as hits, the longest first; two of each language and source, and the first twelve"""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id"))
    hits = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("query_id"), F.col("lang").alias("law"), F.col("source").alias("article_no"), "n_chars").withColumn("rank", rank)
    return fusion.diversify(hits, 12).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


# -- evaluation ------------------------------------------------------------------------------------------------

_TRUTH = (
    "truth AS (SELECT b.item_id AS query_id, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS law, coalesce(list(d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL), []) AS expected "
    "FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"
)
_METRICS = f"""{_BM25}, {_TRUTH},
    h AS (SELECT t.query_id, t.law, t.expected, s.rank, s.doc_id, coalesce(list_contains(t.expected, s.doc_id), false) AS hit FROM truth t LEFT JOIN (SELECT * FROM sparse WHERE rank <= 10) s USING (query_id)),
    m AS (
        SELECT query_id, any_value(law) AS law, count(rank) AS n, len(any_value(expected)) AS wanted, count(DISTINCT doc_id) FILTER (WHERE hit) AS got, min(rank) FILTER (WHERE hit) AS first_hit,
               sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg,
               list_sum(list_transform(range(1, least(len(any_value(expected)), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal, any_value(expected) AS expected,
               coalesce(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)) FILTER (WHERE hit)), []) AS found
        FROM h GROUP BY query_id
    ),
    metrics AS (
        SELECT query_id, law, CASE WHEN wanted > 0 THEN got / wanted ELSE 0.0 END AS recall, CASE WHEN n > 0 THEN got / 10 ELSE 0.0 END AS precision, coalesce(1 / first_hit, 0.0) AS mrr,
               CASE WHEN wanted > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg, CASE WHEN first_hit IS NOT NULL THEN 1.0 ELSE 0.0 END AS hit, found,
               list_sort(list_filter(list_transform(expected, lambda x: CAST(x AS VARCHAR)), lambda x: NOT list_contains(found, x))) AS missed FROM m
    )"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits against the documents that hold the item's whole text (none, for some items)."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    holds = entities.contained(docs.select("doc_id", "text"), items.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")), lower=False)
    holds = holds.groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected"))
    law = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")
    expected = items.select(F.col("item_id").alias("query_id")).join(holds, "query_id", "left")
    expected = expected.select("query_id", law.alias("law"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))
    results = _sparse(spark, sf_dir, 10).select("query_id", "rank", F.col("doc_id").cast("string").alias("article_no"))
    return metrics.per_query(results, expected, 10)


@query(f"WITH {_METRICS} SELECT query_id, law, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, hit FROM metrics")
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9-A13"""
    return _metrics(spark, sf_dir).select("query_id", "law", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")], "hit")


@query(f"WITH {_METRICS} SELECT law, count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(hit), 4) AS hit FROM metrics GROUP BY law")
def q_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, A15"""
    return metrics.macro(_metrics(spark, sf_dir), "law")


@query(f"""
    WITH {_METRICS}, a AS (SELECT round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM metrics),
    r AS (SELECT 'recall' AS metric, recall AS value, 0.75 AS target FROM a UNION ALL SELECT 'mrr', mrr, 0.60 FROM a UNION ALL SELECT 'ndcg', ndcg, 0.70 FROM a)
    SELECT metric, value, CAST(target AS DOUBLE) AS target, round(value - target, 4) AS difference, value >= target AS passed FROM r
""")
def q_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16"""
    return metrics.against_targets(metrics.macro(_metrics(spark, sf_dir)))


@query(f"""
    WITH {_METRICS} SELECT query_id, 'no hit' AS cause FROM metrics WHERE hit = 0
    UNION ALL SELECT query_id, 'partial' FROM metrics WHERE recall > 0 AND recall < 0.75 UNION ALL SELECT query_id, 'late' FROM metrics WHERE mrr > 0 AND mrr < 0.5
""")
def q_root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17"""
    return metrics.root_causes(_metrics(spark, sf_dir)).select("query_id", "cause")


@query(f"WITH {_METRICS} SELECT query_id, array_to_string(found, ',') AS found, array_to_string(missed, ',') AS missed FROM metrics")
def q_found_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return _metrics(spark, sf_dir).select("query_id", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"))


# -- chunking --------------------------------------------------------------------------------------------------


def _word_count(c: str) -> str:
    return _WORDS.replace("text", c).join(("len(", ")"))


def _windows(pieces: str) -> str:
    """CTEs after a table ``pieces`` (key, i, s) of sentences: windows (key, place, text). The fold is a recursion over numbered items: sentences, or the words of one that is too long.

    A window is a run of items; the state holds where its pieces begin (starts) and their words (ws), so that those carried over are found from the sums at the end.
    """
    tail = "len(list_filter(range(1, len(ws) + 1), lambda j: list_sum(list_transform(ws[len(ws) - j + 1:], lambda w: w * 13 // 10)) <= 37))"
    return f"""
    sized AS (SELECT key, i, s, {_word_count('s')} AS w FROM {pieces}),
    items AS MATERIALIZED (
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY i, j) AS k, s, w, long, long AND j = 1 AS opens, long AND j = count(*) OVER (PARTITION BY key, i) AS closes
        FROM (SELECT key, i, 1 AS j, s, w, false AS long FROM sized WHERE w * 13 // 10 <= 250
              UNION ALL SELECT key, i, unnest(range(1, w + 1)) AS j, unnest({_WORDS.replace("text", "s")}) AS s, 1 AS w, true FROM sized WHERE w * 13 // 10 > 250)
    ),
    fold AS (
        SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS starts, []::BIGINT[] AS ws, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS inner_start, CAST(0 AS BIGINT) AS inner_size,
               CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b
        FROM items
        UNION ALL
        SELECT key, k + 1,
               CASE WHEN long AND closes THEN [inner_from] WHEN long AND opens AND full_ THEN kept_starts WHEN long THEN starts WHEN full_ THEN list_append(kept_starts, k + 1) ELSE list_append(starts, k + 1) END,
               CASE WHEN long AND closes THEN [k + 2 - inner_from] WHEN long AND opens AND full_ THEN kept_ws WHEN long THEN ws WHEN full_ THEN list_append(kept_ws, w) ELSE list_append(ws, w) END,
               CASE WHEN long AND closes THEN (k + 2 - inner_from) * 13 // 10 WHEN long THEN size WHEN full_ THEN coalesce(kept_ws[1], 0) * 13 // 10 + w * 13 // 10 ELSE size + w * 13 // 10 END,
               inner_from, CASE WHEN opens THEN 1 WHEN inner_full THEN 49 ELSE inner_size + 1 END,
               CASE WHEN inner_full THEN inner_start WHEN full_ THEN starts[1] END, CASE WHEN inner_full OR full_ THEN k END
        FROM (
            SELECT *, CASE WHEN t > 0 THEN [starts[len(starts) - t + 1]] ELSE [] END AS kept_starts, CASE WHEN t > 0 THEN [CAST(list_sum(ws[len(ws) - t + 1:]) AS BIGINT)] ELSE [] END AS kept_ws,
                   CASE WHEN opens THEN k + 1 WHEN inner_full THEN k - 36 ELSE inner_start END AS inner_from
            FROM (
                SELECT f.*, x.w, x.long, x.opens, x.closes, {tail} AS t,
                       CASE WHEN x.long THEN x.opens AND len(starts) > 0 ELSE size + x.w * 13 // 10 > 250 AND size >= 180 END AS full_,
                       x.long AND NOT x.opens AND inner_size + 1 > 250 AND inner_size >= 180 AS inner_full
                FROM fold f JOIN items x ON x.key = f.key AND x.k = f.k + 1
            )
        )
    ),
    closed AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY k) AS place, a, b FROM fold WHERE a IS NOT NULL),
    rest AS (SELECT f.key, f.starts[1] AS a, f.k AS b, list_sum(f.ws) * 13 // 10 AS n FROM fold f JOIN (SELECT key, max(k) AS k FROM items GROUP BY key) m ON m.key = f.key AND m.k = f.k),
    runs AS (
        SELECT key, place, a, b FROM closed UNION ALL
        SELECT r.key, coalesce(c.n, 0) + CASE WHEN r.n >= 50 THEN 1 ELSE 0 END, r.a, r.b FROM rest r LEFT JOIN (SELECT key, max(place) AS n FROM closed GROUP BY key) c ON c.key = r.key
    ),
    windows AS (
        SELECT key, place - 1 AS place, string_agg(text, ' ' ORDER BY a) AS text
        FROM (SELECT r.key, r.place, r.a, string_agg(x.s, ' ' ORDER BY x.k) AS text FROM runs r JOIN items x ON x.key = r.key AND x.k BETWEEN r.a AND r.b WHERE r.place > 0 GROUP BY r.key, r.place, r.a, r.b)
        GROUP BY key, place
    )"""


@query(f"""
    WITH RECURSIVE pieces AS (SELECT doc_id AS key, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents)),
    {_windows("pieces")}
    SELECT key AS doc_id, CAST(place AS INTEGER) AS chunk_index, text, {_word_count("text")} * 13 // 10 AS token_len FROM windows
""")
def q_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C3, C9, C12"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = chunking.chunk_windows(docs, config=ChunkConfig())
    return out.select("doc_id", "chunk_index", "text", T.approx_tokens(F.col("text")).alias("token_len"))


@query(f"""
    WITH RECURSIVE clauses AS MATERIALIZED (
        SELECT doc_id, lang, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, lang, {_CLAUSES} AS l FROM documents)
    ),
    sized_clauses AS MATERIALIZED (SELECT doc_id, i, s, {_word_count("s")} * 13 // 10 AS n FROM clauses),
    grouping_ AS (
        SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS size, true AS fresh, CAST(0 AS BIGINT) AS g FROM sized_clauses
        UNION ALL
        SELECT f.doc_id, c.i, CASE WHEN c.n > 250 THEN f.size WHEN f.fresh OR f.size + c.n > 250 THEN c.n ELSE f.size + c.n END, c.n > 250,
               f.g + CASE WHEN c.n > 250 OR f.fresh OR f.size + c.n > 250 THEN 1 ELSE 0 END
        FROM grouping_ f JOIN sized_clauses c ON c.doc_id = f.doc_id AND c.i = f.i + 1
    ),
    ends AS (SELECT doc_id, arg_max(g, i) AS g, arg_max(NOT fresh AND size < 40 AND g > 1, i) AS joins FROM grouping_ GROUP BY doc_id),
    grouped AS (
        SELECT f.doc_id, CASE WHEN e.joins AND f.g = e.g THEN f.g - 1 ELSE f.g END AS g, string_agg(c.s, ' ' ORDER BY c.i) AS text
        FROM grouping_ f JOIN ends e ON e.doc_id = f.doc_id JOIN clauses c ON c.doc_id = f.doc_id AND c.i = f.i GROUP BY 1, 2
    ),
    pieces AS (
        SELECT key, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s
        FROM (SELECT {{'d': doc_id, 'g': g}} AS key, {_SENTENCES} AS l FROM grouped WHERE {_word_count("text")} * 13 // 10 > 250)
    ),
    {_windows("pieces")},
    parts AS (
        SELECT doc_id, g, 0 AS place, text FROM grouped WHERE {_word_count("text")} * 13 // 10 <= 250 UNION ALL SELECT key.d, key.g, place, text FROM windows
    ),
    placed AS (
        SELECT p.doc_id, d.lang AS law, p.text, row_number() OVER (PARTITION BY p.doc_id ORDER BY g, place) - 1 AS chunk_index, count(*) OVER (PARTITION BY p.doc_id) AS chunk_total
        FROM parts p JOIN documents d ON d.doc_id = p.doc_id
    )
    SELECT law, CAST(doc_id AS VARCHAR) AS article_no, regexp_replace(law || '_' || doc_id || '_' || chunk_index, '[^A-Za-z0-9_]', '_', 'g') AS chunk_id,
           CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_total AS INTEGER) AS chunk_total, {_word_count("text")} * 13 // 10 AS token_len, text
    FROM placed
""")
def q_section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses grouped into chunks of a statute's article"""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("law"), F.lit(None).cast("string").alias("law_no"), F.col("doc_id").cast("string").alias("article_no"), "text")
    return chunking.chunk_statutes(docs).select("law", "article_no", "chunk_id", "chunk_index", "chunk_total", "token_len", "text")


_LINES = r"list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@query(f"""
    WITH c AS (SELECT source, len({_WORDS}) * 13 // 10 AS n FROM documents)
    SELECT source, count(*) AS chunks, round(avg(n), 1) AS mean_tokens, min(n) AS least_tokens, max(n) AS most_tokens, count(*) FILTER (WHERE n < 100) AS short_chunks,
           count(*) FILTER (WHERE n BETWEEN 180 AND 250) AS band_chunks FROM c GROUP BY source
""")
def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks"""
    chunks = table(spark, sf_dir, "documents").select("source", T.approx_tokens(F.col("text")).cast("long").alias("token_len"))
    return chunking.chunk_stats(chunks)


@query("SELECT doc_id, source || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def q_positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10"""
    return chunking.positional_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"]).select("doc_id", "chunk_id")


# -- tables that are kept up to date -----------------------------------------------------------------------------


@query(f"""
    WITH now AS (
        SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(text, '') || ' ' || coalesce(source, '') ELSE text END AS text FROM documents
        WHERE coalesce(lang = 'en', false) OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
    ), {_FLAT.replace("FROM documents", "FROM now")}, {_STATS}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf
""")
def q_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents; then the English ones are replaced by longer texts, and toxic ones that are not English deleted"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    own = segments.SegmentedIndex(spark, scratch_path(spark, "index"), fanout=2)
    own.apply(docs)
    longer = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")))
    own.apply(docs.filter("lang = 'en'").withColumn("text", longer), table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))
    own.merge()
    return own.term_stats().select("term", "df", F.round("idf", 6).alias("idf"))


@query("""
    SELECT doc_id, lang AS law, sha256(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'withdrawn' ELSE coalesce(text, '') END) AS content_hash,
           doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND coalesce(text, '') <> 'withdrawn' AS embed_again FROM documents
""")
def q_keyed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all documents, those of toxic ones replaced; then the points that no longer are those of their texts"""
    points = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("law"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    own = keyed.KeyedTable(spark, scratch_path(spark, "points"), "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    own.upsert(points)
    own.upsert(points.join(toxic, "doc_id", "left_semi").withColumn("content_hash", F.sha2(F.lit("withdrawn"), 256)))
    again = own.missing(points, same="content_hash").select("doc_id", F.lit(True).alias("embed_again"))
    return own.read().join(again.hint("merge"), "doc_id", "left").withColumn("embed_again", F.coalesce("embed_again", F.lit(False)))


@query("SELECT doc_id, lang, length(text) AS n, md5(text) AS digest FROM documents")
def q_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON arrays, a file for some megabytes, and read back in ranges"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, size >> 23)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), F.to_json(F.struct("doc_id", "text", "lang")).alias("j"))
    files = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value"))
    at = scratch_path(spark, "arrays")
    files.repartition(groups, "g").select("value").write.text(at)
    found = arrays.read_array(spark, at, "doc_id long, text string, lang string")
    return found.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


# -- entities and intent ---------------------------------------------------------------------------------------

_ALIASES = [(1, "licensed under", "license"), (2, "the of", "en"), (3, "der die", "de"), (4, "que la", "es")]
_KEYWORDS = [("en", "tion", 2), ("en", "the", 3), ("de", "sch", 3), ("de", "ung", 2), ("fr", "eau", 3), ("fr", "ment", 2), ("es", "ción", 4)]
_SYNONYMS = [(1, "the", "this that"), (2, "ung", "heit"), (3, "tion", "ing")]
_INTENTS = [(1, "info", "what", 7), (1, "info", "the", 7), (2, "compare", "and", 10), (2, "compare", "or", 10), (3, "steps", "ing", 8), (3, "steps", "sch", 8)]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


@query(f"""
    WITH a AS (SELECT item_id, arg_min(c, o) AS class FROM benchmark, {_values(_ALIASES)} t(o, p, c) WHERE contains(lower(text), p) GROUP BY item_id),
    k AS (SELECT item_id, c, sum(w) AS points FROM benchmark, {_values(_KEYWORDS)} t(c, p, w) WHERE contains(lower(text), p) GROUP BY item_id, c),
    r AS (SELECT *, row_number() OVER w AS n, lead(points) OVER w AS second FROM k WINDOW w AS (PARTITION BY item_id ORDER BY points DESC, c)),
    b AS (SELECT item_id, c FROM r WHERE n = 1 AND points >= 4 AND (second IS NULL OR points / second >= 1.8))
    SELECT item_id AS query_id, coalesce(a.class, b.c) AS class FROM benchmark LEFT JOIN a USING (item_id) LEFT JOIN b USING (item_id)
""")
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N2, J9, A18"""
    aliases = spark.createDataFrame(_ALIASES, "ord int, phrase string, class string")
    keywords = spark.createDataFrame(_KEYWORDS, "class string, phrase string, weight int")
    return entities.detect_class(_queries(spark, sf_dir), aliases, keywords).select("query_id", "class")


@query(f"""
    WITH m AS (SELECT item_id, o, i, k, count(*) AS n FROM benchmark, {_values(_INTENTS)} t(o, i, p, k) WHERE contains(lower(text), p) GROUP BY ALL),
    b AS (SELECT item_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, o) AS r FROM m) WHERE r = 1)
    SELECT item_id AS query_id, coalesce(i, 'info') AS intent, coalesce(k, 7) AS k FROM benchmark LEFT JOIN b USING (item_id)
""")
def q_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6"""
    lexicon = spark.createDataFrame(_INTENTS, "ord int, intent string, phrase string, k int")
    return entities.intent(_queries(spark, sf_dir), lexicon, "info", 7).select("query_id", "intent", "k")


@query(f"""
    SELECT conv_id, turn, NOT list_has_any({_WORDS.replace('text', 'lower(text)')}, ['the', 'la']) AND (contains(lower(text), 'tion') OR contains(lower(text), 'sch') OR len({_WORDS}) >= 3) AS on_topic,
           CASE WHEN contains(lower(text), 'ing') THEN 'comparison' WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN 'statute' ELSE 'general' END AS kind,
           trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) IN ('hello', 'of.') AS greeting, len({_WORDS}) BETWEEN 4 AND 30 AS may_rewrite
    FROM conversations
""")
def q_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F8, N5, N8"""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", entities.on_topic(c, ["the", "la"], ["tion", "sch"]).alias("on_topic"),
        entities.first_kind(c, [("comparison", ["ing"]), ("statute", ["the", "der"])], "general").alias("kind"),
        entities.is_greeting(c, ["hello", "of."]).alias("greeting"), entities.may_rewrite(c).alias("may_rewrite"),
    )


@query(f"""
    SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 0.3 WHEN len({_WORDS}) < 4 THEN 0.5 WHEN len({_WORDS}) > 15 THEN 0.7 ELSE 0.6 END::DOUBLE AS alpha,
           CASE WHEN item_id % 4 = 0 THEN 'exact_article' WHEN len({_WORDS}) < 4 THEN 'short_keyword' WHEN len({_WORDS}) > 15 THEN 'semantic_story' ELSE 'standard_semantic' END AS label FROM benchmark
""")
def q_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, N7"""
    article = F.when(F.col("query_id") % 4 == 0, "1")
    return _queries(spark, sf_dir).select("query_id", fusion.alpha(F.col("text"), article).alias("alpha"), fusion.retrieval_intent(F.col("text"), article).alias("label"))


@query(f"""
    WITH s AS (SELECT item_id, string_agg(x, ' ' ORDER BY o) AS more FROM benchmark, {_values(_SYNONYMS)} t(o, p, x) WHERE contains(lower(text), p) GROUP BY item_id)
    SELECT item_id AS query_id, concat_ws(' ', text, more) AS expanded FROM benchmark LEFT JOIN s USING (item_id)
""")
def q_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4"""
    return entities.expand(_queries(spark, sf_dir), spark.createDataFrame(_SYNONYMS, "ord int, key string, expansion string")).select("query_id", "expanded")


# -- graph, changes, memory ------------------------------------------------------------------------------------


@query(r"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
    d AS (SELECT href AS key, CAST(page_id AS VARCHAR) AS decision_id, min(page_id) AS pos FROM l GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, decision_id) AS place FROM d)
    SELECT key, count(*) AS cited, string_agg(decision_id, ',' ORDER BY place) AS pages FROM r WHERE place <= 20 GROUP BY key
""")
def q_citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as citations, the first twenty pages of each"""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(corpora.links(F.col("html"))).alias("key"))
    cited = pages.groupBy("key", F.col("page_id").cast("string").alias("decision_id")).agg(F.min("page_id").alias("pos")).withColumn("section", F.lit(T.NO_TAG))
    out = citations.citation_map(cited)
    return out.select("key", F.size("citations").cast("long").alias("cited"), F.array_join(F.transform("citations", lambda c: c["decision_id"]), ",").alias("pages"))


_HREFS = r"""regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)"""


@query(f"SELECT page_id, len({_HREFS}) AS n, array_to_string({_HREFS}, ' ') AS hrefs FROM pages")
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3"""
    found = corpora.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("hrefs"))


_BODY = "CASE WHEN contains(lower(html), '<body') THEN regexp_replace(html, '(?is)^.*?<body[^>]*>', '') ELSE html END"
_MARKED = (
    rf"regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', chr(1), 'g'), "
    r"'(?s)<!--.*?-->|<![^>]*>', chr(1), 'g'), '</?[a-zA-Z][^>]*>', chr(1), 'g')"
)
_ENTITIES = "x"
for _name, _sign in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '&{_name};?', '{_sign}', 'g')"


@query(f"""
    SELECT page_id, array_to_string(list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: trim({_ENTITIES}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), chr(10)) AS text
    FROM pages
""")
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S6"""
    return table(spark, sf_dir, "pages").select("page_id", corpora.html_text(F.col("html")).alias("text"))


@query("""
    WITH e AS (SELECT DISTINCT lang AS law, 'src' || (item_id % 25) AS article_no FROM benchmark, (SELECT DISTINCT lang FROM documents))
    SELECT e.law, e.article_no, count(d.doc_id) AS chunks, arg_min(d.text, d.doc_id) AS first_text FROM e LEFT JOIN documents d ON d.lang = e.law AND d.source = e.article_no GROUP BY ALL
""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8"""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("law"), F.col("source").alias("article_no"), "text", F.col("doc_id").alias("chunk_index"))
    wanted = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("article_no")).distinct()
    laws = docs.agg(F.collect_set("law").alias("laws"))  # one row
    expected = wanted.crossJoin(F.broadcast(laws)).select(F.explode("laws").alias("law"), "article_no")
    return citations.coverage(expected, docs)


@query("""
    SELECT doc_id, lower(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR)))) AS digest
    FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector, by point id"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    stored = table(spark, sf_dir, "embeddings").select(T.point_id(F.col("vec_id").cast("string")).alias("point_id"))
    left = vectors.not_embedded(docs, stored, by_content=False)
    return left.select("doc_id", F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.col("chunk_id").cast("binary"))).alias("digest"))


@query("""
    WITH h AS (SELECT source, doc_id, sha256(text) AS hash, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents),
    c AS (SELECT *, CASE WHEN before IS NULL OR before <> hash THEN 1 ELSE 0 END AS changed FROM h)
    SELECT source, doc_id, hash, CAST(version AS BIGINT) AS version FROM (SELECT *, sum(changed) OVER (PARTITION BY source ORDER BY doc_id) AS version FROM c) WHERE changed = 1
""")
def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 along a source's documents"""
    return changes.versions_along(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("""
    SELECT user_id, event_id, event_type, value FROM events WHERE event_type <> 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)
    UNION ALL SELECT user_id, event_id, event_type, value FROM events WHERE event_type = 'purchase'
""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases replace what is there of their user"""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return changes.upsert(rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'"), ["user_id"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 8")
def q_memory_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, L6"""
    return answers.session_tail(table(spark, sf_dir, "conversations"), 8, session="conv_id", order="turn").select("conv_id", "turn", "role")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
    SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 300), chr(10) ORDER BY turn) AS context FROM r WHERE r <= 4 GROUP BY conv_id
""")
def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9"""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return answers.session_context(rows, session="conv_id", order="turn")


@query("""
    WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
    r AS (SELECT c.conv_id, c.turn, 'see m. ' || (c.conv_id % 30) AS mention, [CAST(c.turn AS VARCHAR), CAST(c.conv_id % 7 AS VARCHAR)] AS articles, c.conv_id % 3 = 0 AS silent FROM conversations c)
    SELECT conv_id, turn, CASE WHEN silent THEN true ELSE len(list_filter(articles, lambda a: contains(mention, a))) > 0 END AS faithful,
           CASE WHEN silent THEN 'unnamed' WHEN len(list_filter(articles, lambda a: contains(mention, a))) = 0 THEN 'unsupported' ELSE '' END AS warning FROM r
""")
def q_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3"""
    mention = F.when(F.col("conv_id") % 3 == 0, "nothing here").otherwise(F.concat(F.lit("see m. "), (F.col("conv_id") % 30).cast("string")))
    articles = F.array(F.col("turn").cast("string"), (F.col("conv_id") % 7).cast("string"))
    check = answers.faithfulness(answers.article_mentions(mention), articles)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", check["faithful"].alias("faithful"), check["warning"].alias("warning"))


@query(f"""
    WITH {_BM25}, near AS (SELECT query_id, doc_id FROM sparse WHERE rank <= 20),
    q AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS qt FROM benchmark), d AS (SELECT doc_id, list_distinct({_TOKENS}) AS dt FROM documents),
    s AS (SELECT query_id, doc_id, round(1 / (1 + exp(-(len(list_intersect(qt, dt)) / len(qt) * 8 - 4))), 6) AS rerank_score FROM near JOIN q USING (query_id) JOIN d USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, rerank_score, rank FROM r WHERE rank <= 5
""")
def q_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, T26 with the word-overlap stand-in"""
    near = _sparse(spark, sf_dir, 20).select("query_id", "doc_id")
    queries = _queries(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    near = written(near, "near")
    # every text and every query is cut into words once, however many pairs it is in
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = written(docs.select("doc_id", models.word_set(F.col("text")).alias("text_words")), "near-words")
    pairs = near.join(queries.select("query_id", models.word_set(F.col("query")).alias("query_words")), "query_id").join(docs, "doc_id")
    out = fusion.rerank(pairs, models.overlap_of(F.col("query_words"), F.col("text_words")), 5)
    return out.select("query_id", "doc_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


def _asked(spark: SparkSession, sf_dir: str):
    """Corpus and queries of whole retrieval; a query without a vector has sparse hits only."""
    from .plans.retrieval import Corpus

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("law"), F.col("source").alias("article_no"))
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")).join(docs.select("doc_id", "law"), "doc_id")
    queries = _queries(spark, sf_dir).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")
    article = F.when(F.col("query_id") % 4 == 0, (F.col("query_id") % 20).cast("string"))
    return queries.withColumns({"query_law": _law(F.col("query_id")), "query_article": article, "expanded": F.col("text")}), Corpus(docs, points)


#: As _HYBRID, with the points of all laws for queries that have fewer than ten hits of their own, and sparse ranks by scores that are not yet rounded to four places.
_WITH_FALLBACK = _HYBRID.replace("round(raw, 4)", "round(raw, 9)").replace("dr AS (", "dr0 AS (").replace(
    "    dn AS (",
    f"""    lacking AS (SELECT query_id FROM asked2 LEFT JOIN (SELECT query_id, count(*) AS n FROM dr0 GROUP BY query_id) USING (query_id) WHERE query_law IS NOT NULL AND coalesce(n, 0) < 10),
    du AS (SELECT a.query_id, p.vec_id AS doc_id, round({_COS}, 4) AS score FROM lacking a JOIN e q ON q.vec_id = a.query_id, e p JOIN meta m ON m.doc_id = p.vec_id),
    dr AS (
        SELECT query_id, doc_id, score FROM dr0 UNION ALL
        SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM du)
        WHERE r <= 200 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM dr0)
    ),
    dn AS (""",
)


#: The ranked hits of the whole of retrieval: few, with final as rank.
_RETRIEVED = f"""{_WITH_FALLBACK},
    served AS (SELECT DISTINCT query_id FROM hits WHERE number = query_article),
    top AS (SELECT query_id, max(score) AS top FROM hits GROUP BY query_id),
    found AS (
        SELECT a.query_id, m.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY m.doc_id) AS place
        FROM asked2 a JOIN meta m ON m.number = a.query_article AND (a.query_law IS NULL OR m.law = a.query_law) WHERE a.query_id NOT IN (SELECT query_id FROM served)
    ),
    more AS (SELECT f.query_id, f.doc_id, round(coalesce(top, 1.0) * 1.2, 6) AS score, -place AS r, true AS injected FROM found f LEFT JOIN top USING (query_id) WHERE place <= 3),
    every AS (
        SELECT query_id, doc_id, score, rank AS r, false AS injected FROM hits WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM more)
        UNION ALL SELECT * FROM more
    ),
    placed AS (SELECT e.*, m.law, m.number, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM every e JOIN meta m USING (doc_id)),
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, law, number ORDER BY rank) AS place FROM placed),
    few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final FROM capped WHERE place <= 2)"""


@query(f"WITH {_RETRIEVED} SELECT query_id, doc_id, score, final AS rank, injected FROM few WHERE final <= 10")
def q_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of retrieval: A1-A6, J4-J7, H1-H3, W1-W7"""
    from .plans.retrieval import retrieve

    return retrieve(*_asked(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "injected")


_Q_TOKENS, _S_TOKENS = _TOKENS, _TOKENS.replace("text", "s")


@query(rf"""
    WITH {_RETRIEVED},
    lines AS (SELECT f.query_id, f.final AS r, '[' || f.final || '] ' || m.law || ' m.' || m.article_no || ': ' || d.text AS line FROM few f JOIN meta m USING (doc_id) JOIN documents d USING (doc_id) WHERE f.final <= 10),
    contexts AS (SELECT query_id, count(*) AS n_sources, string_agg(line, chr(10) || chr(10) ORDER BY r) AS text FROM lines GROUP BY query_id),
    cut AS (SELECT query_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT query_id, {_SENTENCES} AS l FROM contexts)),
    ranked AS (
        SELECT c.query_id, c.s, c.i, len(list_intersect(list_distinct(q.ts), list_distinct({_S_TOKENS}))) AS n
        FROM cut c JOIN (SELECT item_id AS query_id, {_Q_TOKENS} AS ts FROM benchmark) q USING (query_id)
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS place FROM ranked),
    replies AS (SELECT query_id, string_agg(s, ' ' ORDER BY place) AS text FROM best WHERE place <= 3 GROUP BY query_id),
    judged AS (
        SELECT query_id, text, len(list_filter(range(1, len(w) + 1), lambda k: regexp_matches(w[k], '(?i)(madde|m)\.?\d+($|[^\pL\pN_])')
               OR (regexp_matches(w[k], '(?i)(madde|m)\.?$') AND regexp_matches(coalesce(w[k + 1], ''), '^\d+($|[^\pL\pN_])')))) AS mentions
        FROM (SELECT query_id, text, {_WORDS} AS w FROM replies)
    )
    SELECT b.item_id AS query_id, coalesce(j.text, '') || CASE WHEN mentions > 0 THEN chr(10) || chr(10) || 'Check the cited articles.' ELSE '' END AS answer, CAST(NULL AS VARCHAR) AS intent,
           CAST(NULL AS VARCHAR) AS rewritten, CAST(n_sources AS INTEGER) AS n_sources, coalesce(mentions, 0) = 0 AS faithful
    FROM benchmark b LEFT JOIN judged j ON j.query_id = b.item_id LEFT JOIN contexts c ON c.query_id = b.item_id
""")
def q_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the stand-in generator to all items, with intent, sources and checks; an article that is mentioned is never one of the sources' here, since these have names"""
    from .plans.retrieval import answer, retrieve

    queries, corpus = _asked(spark, sf_dir)
    hits = written(retrieve(queries, corpus), "retrieved")
    out = answer(queries, hits, corpus.docs)
    return out.select("query_id", "answer", "intent", "rewritten", F.size("sources").alias("n_sources"), F.col("check.faithful").alias("faithful"))


@query()
def q_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing stand-in encoder over documents"""
    docs = table(spark, sf_dir, "documents")
    vector = models.encode(F.col("text"), lambda: models.hashing_encoder(64))
    return docs.select("doc_id", vector.alias("vector")).select("doc_id", F.round(vectors.norm(F.col("vector")), 3).alias("norm"), F.size("vector").alias("dim"))
