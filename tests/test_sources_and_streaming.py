import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.sources import corpora
from tessera.sources.keyed import KeyedTable
from tessera.streaming import ingest

PAGE = "<html><head><title>t</title></head><body><p> one </p><script>var x;</script><a data-modal='True' href='/a'>A</a><a data-modal='True' href='/b.PDF'>B</a><a href=\"/c\">two</a></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("no <b>body",)], "html string")
    got = df.select(corpora.html_text(F.col("html")).alias("t"), corpora.html_text(F.col("html"), scripts=True).alias("s"), corpora.modal_links(F.col("html")).alias("m"), corpora.links(F.col("html")).alias("l")).collect()
    assert got[0].t == "one\nA\nB\ntwo" and "var x;" in got[0].s and got[0].m == ["/a"] and got[0].l == ["/c"]
    assert got[1].t == "" and got[2].t == "no\nbody"
    assert spark.createDataFrame([("31234 Sayılı Gazete",)], "t string").select(corpora.issue_number(F.col("t")).alias("x")).first().x == "31234"


def test_crawled_pages(spark):
    body = "MADDE 1 " + "x" * 60
    s = corpora.statutes(spark.createDataFrame([("TBK", "6098", "u", f"<body>{body}</body>")], "law string, law_no string, url string, html string")).collect()
    assert [(r.article_no, r.char_len) for r in s] == [("1", len(body))]
    d = corpora.decisions(spark.createDataFrame([("1", "q", json.dumps({"data": "<p>a</p><p>b</p>"})), ("2", "q", "broken"), ("3", "q", json.dumps({"data": ""}))], "decision_id string, query string, body string")).collect()
    assert [(r.decision_id, r.text) for r in d] == [("1", "a\nb")]
    h = corpora.search_hits(spark.createDataFrame([("q", json.dumps({"data": {"data": [{"id": "5"}, {"id": "6"}]}}))], "query string, body string")).collect()
    assert [r.decision_id for r in h] == ["5", "6"]
    g = corpora.gazette(spark.createDataFrame([("1", "u", "b", "<body>6098 sayılı MADDE 1 - metin</body>"), ("2", "u", "b", "<body>x</body>")], "rg_sayi string, url string, baslik string, html string"), ["6098"]).collect()
    assert len(g) == 1 and g[0].degisen_maddeler[0].icerik == "metin"


def test_json_and_points(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": "x"}, {"a": "ç"}]')
    (tmp_path / "map.json").write_text('{"k": {"a": "y"}}')
    schema = StructType([StructField("a", StringType())])
    assert sorted(r.a for r in corpora.read_json_corpus(spark, str(tmp_path / "*.json"), schema).collect()) == ["x", "y", "ç"]
    points = spark.createDataFrame([(1, [1.0], "A"), (2, [2.0], "B")], "point_id long, vector array<double>, law string")
    at = str(tmp_path / "points")
    corpora.write_points(points, at, reset=True)
    corpora.write_points(points.filter("point_id = 2").withColumn("point_id", F.lit(3).cast("long")), at)
    assert corpora.read_points(spark, at).count() == 3 and "vector" not in corpora.read_points(spark, at, vectors=False).columns
    assert corpora.stored_ids(spark, at, spark.createDataFrame([(1,), (9,)], "point_id long")).count() == 1
    assert [r.point_id for r in corpora.sample_for_test(points, "point_id", 1).collect()] == [1]
    corpora.write_report(points.select("law"), points.select("point_id"), str(tmp_path / "report"), "run1")
    assert spark.read.json(str(tmp_path / "report/run1/summary")).count() == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "issues")
    rows = [("1", "u", " t ", ["6098"], [("1", "a")], "2024-01-01 00:00:00")] * 2 + [("2", "u", "t", [], [], "2024-01-01 00:00:01")]
    kind = "rg_sayi string, url string, baslik string, kanunlar array<string>, degisen_maddeler array<struct<madde_no:string,icerik:string>>, fetched_at string"
    spark.createDataFrame(rows, kind).withColumn("fetched_at", F.to_timestamp("fetched_at")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = ingest.gated_issues(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.rg_sayi, r.baslik) for r in spark.sql("SELECT * FROM gated").collect()] == [("1", "t")]
    messages = str(tmp_path / "messages")
    spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(10)], "session_id long, seq long, role string, content string").write.parquet(messages)
    stream = spark.readStream.schema(spark.read.parquet(messages).schema).parquet(messages)
    q = ingest.session_memory(stream, 8).writeStream.format("memory").queryName("memory").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.sql("SELECT * FROM memory").collect()) == list(range(2, 10))
    points = str(tmp_path / "in")
    kind = "point_id long, law string, text string"
    spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, "B", "y")], kind).write.parquet(points)
    out = str(tmp_path / "out")
    for k in range(2):  # the second run finds a changed chunk and a new one
        stream = spark.readStream.schema(kind).parquet(points)
        ingest.upsert_points(stream, out, str(tmp_path / "c3"), buckets=4).awaitTermination(120)
        if k == 0:
            assert sorted(map(tuple, KeyedTable(spark, out).read().collect())) == [(1, "A", "x"), (2, "B", "y")]
            spark.createDataFrame([(2, "B", "changed"), (3, "A", "z")], kind).write.mode("append").parquet(points)
    assert sorted(map(tuple, KeyedTable(spark, out).read().collect())) == [(1, "A", "x"), (2, "B", "changed"), (3, "A", "z")]


def test_keyed_table_against_a_dict(spark, tmp_path):
    import random

    r = random.Random(4)
    at = str(tmp_path / "keyed")
    kind = "point_id string, content_hash string, n int"
    truth = {}
    for turn in range(4):
        rows = [(f"k{r.randint(0, 40)}", f"h{r.randint(0, 3)}", turn * 100 + i) for i in range(25)] + [(None, "none", 0)]
        KeyedTable(spark, at, buckets=4).upsert(spark.createDataFrame(rows, kind).repartition(3), order="n", epoch=turn)
        truth |= {k: (k, h, n) for k, h, n in sorted(rows, key=lambda x: x[2]) if k is not None}
    own = KeyedTable(spark, at)
    own.upsert(spark.createDataFrame([("k1", "again", 0)], kind), epoch=3)  # applied before
    assert own.buckets == 4 and {x["point_id"]: tuple(x) for x in own.read().collect()} == truth and own.read().count() == len(truth)
    # another session finds table and buckets
    spark.catalog.dropTempView("none")
    spark.sql(f"DROP TABLE keyed_{own.version}")
    own = KeyedTable(spark, at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.createDataFrame([("k1", truth.get("k1", (0, "x"))[1]), ("k2", "other"), ("new", "h")], "point_id string, content_hash string")
        left = own.missing(asked, same="content_hash")
        assert sorted(x["point_id"] for x in left.collect()) == sorted([k for k in ("k2", "new")] + ([] if "k1" in truth else ["k1"]))
        assert [x["point_id"] for x in own.missing(asked.filter("point_id <> 'k1'")).collect()] == ["new"] if "k2" in truth else True
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    own.upsert(spark.createDataFrame([("k1", "h", 7.5)], "point_id string, content_hash string, extra double"))
    found = {x["point_id"]: x for x in KeyedTable(spark, at).read().collect()}
    assert found["k1"]["extra"] == 7.5 and found["k1"]["n"] is None and found["k2"]["extra"] is None
    assert own.vacuum() == 4 and KeyedTable(spark, at).read().count() == len(set(truth) | {"k1"})
