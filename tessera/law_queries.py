"""Queries for the operators on laws, decisions and issues, over texts in their language planted into the driver's rows.

The tables hold invented prose without laws, so every row's id and number columns are put into fixed sentences. The oracles don't read these
sentences: they state what must be found from the ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import references as R
from .functions import text as T
from .operators import answers, changes, citations, entities, vectors
from .queries import _MASK, _PERSONS, query, table


def _id() -> Column:
    return F.col("doc_id")


def _put(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every document: six citations, one of each form."""
    text = _put(
        "Dava. TBK m. {a}, TTK'nın {b}. maddesi ve (TKHK, m. {c}/1); 6098 sayılı Kanunun madde {d} hükmü, TTK {e}/2. Sonuç: (TBK {f}/1) ile TBK {g}x ve m. 5",
        a=_id() % 40, b=_id() % 30 + 1, c=_id() % 20 + 1, d=_id() % 25 + 1, e=_id() % 35 + 1, f=_id() % 45 + 1, g=_id() % 9 + 900,
    )
    return _docs(spark, sf_dir).select(_id().cast("string").alias("decision_id"), text.alias("text"), _id().alias("pos"))


_CITED = """cited AS (
    SELECT DISTINCT doc_id, unnest(['TBK_' || (doc_id % 40), 'TTK_' || (doc_id % 30 + 1), 'TKHK_' || (doc_id % 20 + 1), 'TBK_' || (doc_id % 25 + 1), 'TTK_' || (doc_id % 35 + 1), 'TBK_' || (doc_id % 45 + 1)]) AS key
    FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, CAST(doc_id AS VARCHAR)) AS place FROM cited)"""


@query(f"WITH {_CITED} SELECT key, CAST(doc_id AS VARCHAR) AS decision_id, 'SONUÇ' AS section FROM cited")
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that every decision cites"""
    return citations.citations(_decisions(spark, sf_dir)).select("key", "decision_id", "section")


_CHUNKS = "chunks AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'TBK' WHEN 1 THEN 'TTK' ELSE 'TKHK' END AS law, CAST(item_id % 60 AS VARCHAR) AS article_no FROM benchmark)"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    law = F.when(item % 3 == 0, "TBK").when(item % 3 == 1, "TTK").otherwise("TKHK")
    chunks = table(spark, sf_dir, "benchmark").select("item_id", law.alias("law"), (item % 60).cast("string").alias("article_no"), law.alias("source"))
    return citations.attach(chunks, citations.citation_map(citations.citations(_decisions(spark, sf_dir))))


@query(f"""
    WITH {_CITED}, {_CHUNKS}, few AS (SELECT key, count(*) AS n, string_agg(doc_id, ',' ORDER BY place) AS ids FROM placed WHERE place <= 20 GROUP BY key)
    SELECT item_id, coalesce(n, 0) AS cited, coalesce(ids, '') AS decisions FROM chunks LEFT JOIN few ON key = law || '_' || article_no
""")
def q_citations_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the first twenty decisions that cite them"""
    out = _attached(spark, sf_dir)
    return out.select("item_id", F.size("citations").cast("long").alias("cited"), F.array_join(F.transform("citations", lambda c: c["decision_id"]), ",").alias("decisions"))


@query(f"""
    WITH {_CITED}, {_CHUNKS}, few AS (SELECT key, count(*) AS n FROM placed WHERE place <= 20 GROUP BY key)
    SELECT law AS source, CAST(sum(coalesce(n, 0)) AS BIGINT) AS citations FROM chunks LEFT JOIN few ON key = law || '_' || article_no GROUP BY law
""")
def q_total_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    return citations.total_citations(_attached(spark, sf_dir))


_NAMES = ["Ali Veli", "Ayşe", "Şule Öz Can", "İnci Gül"]
_SIGNS = [": ", " - ", " ", ":"]


def _pick(values: list[str] | tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


@query("""
    SELECT doc_id, 'Dosya ' || doc_id || ' ' || ['DAVACI', 'DAVALI', 'SANIK', 'MÜŞTEKİ', 'VEKİLİ', 'KATILAN'][doc_id % 6 + 1] || ': [KISI] geldi, ' ||
           CASE WHEN doc_id % 2 = 0 THEN '[EMAIL]' ELSE '[TELEFON]' END || '; KATILAN yok, no [ANONIM] ve ' || ['DAVACI', 'DAVALI', 'SANIK', 'MÜŞTEKİ', 'VEKİLİ', 'KATILAN'][doc_id % 5 + 1] || ': [KISI]' AS masked
    FROM documents
""")
def q_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled numbers first, then contacts, then names after role words"""
    contact = F.when(_id() % 2 == 0, F.concat(F.lit("a.b"), _id().cast("string"), F.lit("@c.org"))).otherwise(F.lit("05321234567"))
    text = _put(
        "Dosya {id} {role}{sign}{name} geldi, {contact}; KATILAN yok, no {number} ve {other} {name}", id=_id(), role=_pick(T.ROLES, _id()), sign=_pick(_SIGNS, _id()),
        name=_pick(_NAMES, _id()), contact=contact, number=F.when(_id() % 3 == 0, F.concat(F.lit("TC Kimlik No: "), _id().cast("string"))).otherwise("12345678901"), other=_pick(T.ROLES, _id() % 5),
    )
    # a phone number of eleven digits is masked as an identity number, so here persons are masked on the phone's ten
    text = F.regexp_replace(text, "05321234567", "5321234567")
    return _docs(spark, sf_dir).select("doc_id", T.mask_persons(T.mask_ids(text)).alias("masked"))


@query("""
    WITH d AS (SELECT doc_id, 'MADDE ' || (doc_id % 90 + 2) || ' ' || repeat('y', CAST(doc_id % 80 AS BIGINT)) AS last FROM documents)
    SELECT doc_id, CASE WHEN length(trim(last)) >= 50 THEN '1,' || (doc_id % 90 + 2) ELSE '1' END AS articles, '5=ilk ' || doc_id || ';6/A=son' AS changed,
           CASE WHEN doc_id % 2 = 0 THEN '6098,6102' ELSE '6098' END AS laws, 'Dava: a' || doc_id || '|GEREKÇE : b|hüküm: c' AS sections, 'HÜKÜM' AS tag
    FROM d
""")
def q_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of statutes and gazettes, named laws, sections"""
    statute = F.concat(F.lit("Önsöz MADDE 1 - " + "x" * 60 + " MADDE "), (_id() % 90 + 2).cast("string"), F.lit(" "), F.repeat(F.lit("y"), (_id() % 80).cast("int")))
    changed = T.gazette_articles(_put("giriş MADDE 5 – ilk {id}\nmadde 6/A -  son", id=_id()))
    laws = T.named_laws(F.concat(F.lit("Bu 6098 sayılı, 6502 SAYILI "), F.when(_id() % 2 == 0, "ve 6102 sayılı").otherwise("ve 6102 nolu")), ["6098", "6102", "6502"])
    decision = _put("Dava: a{id} GEREKÇE : b hüküm: c", id=_id())
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(T.statute_articles(statute), lambda a: a["article_no"]), ",").alias("articles"),
        F.array_join(F.transform(changed, lambda a: F.concat(a["madde_no"], F.lit("="), a["icerik"])), ";").alias("changed"), F.array_join(laws, ",").alias("laws"),
        F.array_join(T.decision_sections(decision), "|").alias("sections"), T.section_tag(decision).alias("tag"),
    )


_QUESTIONS = ["TBK m.{n} nedir", "{n}. madde nedir", "borçlar kanunu {n} hükmü", "6098 sayılı kanunun {n} hükmü", "madde {n} ne der", "kira bedeli ne kadar", "tbk'nın {n}. maddesi", "Bu {n} kişi, 6502"]


@query("""
    WITH d AS (SELECT doc_id, doc_id % 8 AS form, CAST(doc_id % 900 + 1 AS VARCHAR) AS n FROM documents)
    SELECT doc_id, CASE WHEN form IN (5, 7) THEN NULL ELSE n END AS article, CASE WHEN form IN (2, 4, 5, 7) THEN NULL ELSE n END AS article_first_kinds,
           form IN (0, 3, 4, 7) AS names_law, array_to_string(list_sort(list_distinct(['6098 sayılı', n || 'a', n, '7'])), ',') AS refs
    FROM d
""")
def q_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3 with and without its fixes, T24, T8"""
    n = (_id() % 900 + 1).cast("string")
    question = F.lit(None).cast("string")
    for k, form in enumerate(_QUESTIONS):
        question = F.when(_id() % 8 == k, _put(form, n=n)).otherwise(question)
    number = lambda fixed: R.article_number(question, ["tbk", "ttk"], ["6098", "6502"], ["borçlar"], fixed=fixed)
    refs = R.law_references(_put("6098 sayılı kanun, TBK m.{n} ile madde {n}a, 12 ve atom 7", n=n))
    # without its fixes a bare marker before a number is no form, nor is a law's name
    return _docs(spark, sf_dir).select("doc_id", number(True).alias("article"), number(False).alias("article_first_kinds"), R.has_reference(question).alias("names_law"), F.array_join(refs, ",").alias("refs"))


@query("""
    WITH r AS (SELECT conv_id, turn, (conv_id % 30) AS n, turn % 4 AS form FROM conversations)
    SELECT conv_id, turn, CASE form WHEN 0 THEN 'Bkz. TBK m. ' || n || '/a' WHEN 1 THEN 'TTK madde ' || n || ' ve m. 5' WHEN 2 THEN '' ELSE 'm.' || n END AS mentions,
           form = 2 OR contains(CASE form WHEN 0 THEN 'm. ' || n || '/a' WHEN 1 THEN n || ' 5' ELSE 'm.' || n END, CAST(turn % 7 + 1 AS VARCHAR)) AS faithful
    FROM r
""")
def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3: mentions of four forms against one source article"""
    n, form = (F.col("conv_id") % 30).cast("string"), F.col("turn") % 4
    answer = F.when(form == 0, _put("Evet Bkz. TBK m. {n}/a", n=n)).when(form == 1, _put("TTK madde {n} ve m. 5.", n=n)).when(form == 2, F.lit("Bilinmiyor, 12 gün")).otherwise(_put("(m.{n})", n=n))
    found = answers.article_mentions(answer)
    check = answers.faithfulness(found, F.array((F.col("turn") % 7 + 1).cast("string")))
    joined = F.when(form == 0, F.concat(F.lit("Bkz. "), F.array_join(found, " "))).otherwise(F.array_join(found, " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined.alias("mentions"), check["faithful"].alias("faithful"))


_ISSUES = """
    i AS (SELECT doc_id, CAST(doc_id % 97 AS VARCHAR) AS rg_sayi, 'u' || (doc_id % 300) AS url, source, doc_id % 3 = 0 AS relevant FROM documents),
    state AS (SELECT DISTINCT rg_sayi, url FROM i WHERE doc_id % 5 = 0)"""


def _issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    laws = F.when(_id() % 3 == 0, F.array(F.lit("6098"))).otherwise(F.array().cast("array<string>"))
    article = F.struct((_id() % 50).cast("string").alias("madde_no"), _put(" a;b,c ( {id} )  25,49 ", id=_id()).alias("icerik"))
    issues = _docs(spark, sf_dir).select(
        "doc_id", (_id() % 97).cast("string").alias("rg_sayi"), _put("u{k}", k=_id() % 300).alias("url"), _put("  b \t {s} ", s=F.col("source")).alias("baslik"), laws.alias("kanunlar"), F.array(article).alias("degisen_maddeler")
    )
    return issues, changes.next_state(issues.filter(_id() % 5 == 0), F.lit("now"))


@query(f"""
    WITH {_ISSUES}
    SELECT doc_id, 'b ' || source AS title, 'a; b, c (' || doc_id || ') 25,49' AS body, CAST(length('a; b, c (' || doc_id || ') 25,49') AS INTEGER) AS characters
    FROM i WHERE relevant AND (rg_sayi, url) NOT IN (SELECT (rg_sayi, url) FROM state)
""")
def q_new_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that the state has not seen and that name a law, prepared"""
    issues, state = _issues(spark, sf_dir)
    out = changes.prepare_issue(changes.relevant_issues(changes.new_issues(issues, state)))
    first = F.col("degisen_maddeler")[0]
    return out.select("doc_id", F.col("baslik").alias("title"), first["icerik"].alias("body"), first["karakter_sayisi"].alias("characters"))


@query(f"WITH {_ISSUES} SELECT rg_sayi, url, 'now' AS last_checked_at FROM state")
def q_issue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6"""
    return _issues(spark, sf_dir)[1]


@query(f"""
    WITH r AS (SELECT doc_id, doc_id % 3 AS kind, length({_MASK}) AS masked, length({_PERSONS}) AS named, length(text) AS plain FROM documents)
    SELECT doc_id, ['yargitay', 'mevzuat', 'other'][kind + 1] AS source, CASE kind WHEN 0 THEN named WHEN 1 THEN masked ELSE plain END AS n
    FROM r WHERE kind = 2 OR (kind = 0 AND named >= 300) OR (kind = 1 AND masked >= 50)
""")
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source through its own gate"""
    items = _docs(spark, sf_dir).select("doc_id", "text", _pick(["yargitay", "mevzuat", "other"], _id()).alias("source"))
    out = changes.route(items, {"yargitay": (changes.decision_gate,), "mevzuat": (changes.statute_gate,)})
    return out.select("doc_id", "source", F.length("text").cast("long").alias("n"))


_STEPS = """
    c AS (SELECT user_id, event_id, event_type, lag(event_type, 1, 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE user_id % 3 <> 0),
    s AS (SELECT *, CASE WHEN event_type <> before THEN 1 ELSE 0 END AS step FROM c)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A first version for two users of three, and all events as changes."""
    events = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string").alias("key")
    old = events.filter("user_id % 3 <> 0").select(key).distinct()
    old = old.select("key", F.lit(1).alias("version"), F.lit("0").alias("issue"), F.lit("d").alias("date"), F.lit("view").alias("text"), T.content_hash(F.lit("view")).alias("hash"))
    new = events.select(key, F.col("event_id").cast("string").alias("issue"), F.lit("d").alias("date"), F.col("event_type").alias("text"), F.col("event_id").alias("ord"))
    return old, changes.add_versions(old, new)


@query(f"""
    WITH {_STEPS}
    SELECT CAST(user_id AS VARCHAR) AS key, 1 AS version, '0' AS issue, 'view' AS text FROM c GROUP BY user_id
    UNION ALL
    SELECT CAST(user_id AS VARCHAR), CAST(version AS INTEGER), CAST(event_id AS VARCHAR), event_type
    FROM (SELECT *, 1 + sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM s) WHERE step = 1
""")
def q_add_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version wherever the text changes; unknown keys bring none"""
    return _versions(spark, sf_dir)[1].select("key", "version", "issue", "text")


@query(f"WITH {_STEPS} SELECT CAST(user_id AS VARCHAR) AS key FROM s GROUP BY user_id HAVING sum(step) > 0")
def q_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: keys to embed again"""
    return changes.changed_keys(*_versions(spark, sf_dir))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 4 <> 1")
def q_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every fourth question is blank"""
    blank = F.when(F.col("turn") % 8 == 1, F.lit(" \t\n ")).otherwise(F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, blank).otherwise(F.concat(F.lit("x"), F.col("text"))))
    return entities.asked(rows).select("conv_id", "turn")


@query("""
    SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || CASE WHEN turn % 3 = 0 THEN '-' ELSE role END || ' m.' || (turn % 5) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS context,
           string_agg(substr(text, 1, 200) || '...', '|' ORDER BY turn) AS snippets
    FROM conversations GROUP BY conv_id
""")
def q_context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources and their snippets"""
    turn = F.col("turn")
    law = F.when(turn % 3 != 0, F.col("role"))
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (turn + 1).alias("rank"), law.alias("law"), (turn % 5).cast("string").alias("article_no"), "text")
    both = answers.context_block(hits).join(answers.sources(hits), "query_id")
    return both.select(F.col("query_id").alias("conv_id"), "context", F.array_join(F.transform("sources", lambda s: s["summary"]), "|").alias("snippets"))


@query(f"""
    WITH own AS (SELECT conv_id AS query_id, turn AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE turn < conv_id % 5),
    more AS (SELECT conv_id AS query_id, turn + 2 AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE conv_id % 2 = 0),
    few AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM more) LEFT JOIN (SELECT query_id, count(*) AS n FROM own GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 3),
    both_ AS (
        SELECT query_id, doc_id, 0 AS part, rank AS r FROM own UNION ALL
        SELECT query_id, doc_id, 1, rank FROM more WHERE query_id IN (SELECT query_id FROM few) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM own)
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, r, doc_id) AS rank FROM both_)
    SELECT query_id, doc_id, rank FROM placed WHERE part = 0 OR rank <= 4
""")
def q_rewrite_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the rewritten question where the question itself has fewer than three, cut to k"""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    own = turns.filter(F.col("turn") < F.col("conv_id") % 5).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.lit(1.0).alias("score"), rank.alias("rank"))
    more = turns.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 2).alias("doc_id"), F.lit(0.5).alias("score"), rank.alias("rank"))
    return vectors.rewrite_union(own, more, 4).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e)
    SELECT vec_id, round(scale, 12) AS scale, array_to_string(list_transform(v, lambda x: CAST(round(x / scale) AS INTEGER)), ',') AS codes FROM s
""")
def q_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes with a scale"""
    q = vectors.quantise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    return rows.select("vec_id", F.round("q.scale", 12).alias("scale"), F.array_join(F.transform("q.codes", lambda x: x.cast("string")), ",").alias("codes"))
