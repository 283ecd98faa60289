"""Reading saved pages and JSON corpora, and writing corpora, vector points and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.batches import pieces
from ..functions.text import gazette_articles, named_laws, statute_articles


class _Text(HTMLParser):
    """Text nodes of the body. Script and style text counts as body text unless it is left out."""

    def __init__(self, scripts: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.scripts, self.hidden, self.in_body = scripts, 0, False
        self.nodes: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.in_body = self.in_body or tag == "body"
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if self.in_body and (self.scripts or not self.hidden):
            self.nodes.append(data)


def html_nodes(html: str | None, scripts: bool) -> list[str]:
    parser = _Text(scripts)
    parser.in_body = "<body" not in (html or "").lower()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def _mapped(batches: Iterator[pa.Array], of: Callable[[str | None], str]) -> Iterator[pa.Array]:
    """A function of every string, a piece of a batch at a time."""
    for strings in batches:
        for piece in pieces(pa.RecordBatch.from_arrays([strings], names=["s"]), 0):
            yield pa.array([of(s.as_py()) for s in piece.column(0)], pa.string())


def html_text(html: Column, *, joined_by: str = "\n", stripped: bool = True, scripts: bool = False) -> Column:
    """Text of pages: stripped non-empty nodes joined by line feeds, or raw nodes joined as they are."""

    def of(page: str | None) -> str:
        return joined_by.join(x for x in ((n.strip() if stripped else n) for n in html_nodes(page, scripts)) if x)

    @F.arrow_udf(StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _mapped(batches, of)

    return text(html)


def links(html: Column) -> Column:
    """href of all links."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def modal_links(html: Column) -> Column:
    """href of links that open a window of their own and are no PDF."""
    tags = F.regexp_extract_all(html, F.lit(r"(<a\s[^>]*data-modal='True'[^>]*>)"), F.lit(1))
    found = F.transform(tags, lambda t: F.regexp_extract(t, r"""href=["']([^"']*)["']""", 1))
    return F.filter(found, lambda h: (h != "") & ~F.lower(h).endswith(".pdf"))


def issue_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(?iu)(\d{5})\s+Sayılı", 1)


def statutes(pages: DataFrame) -> DataFrame:
    """Articles of saved statute pages (law, law_no, url, html)."""
    rows = pages.withColumn("body", html_text(F.col("html"))).select("law", "law_no", "url", F.explode(statute_articles(F.col("body"))).alias("a"))
    out = rows.select("law", "law_no", F.col("a.article_no"), F.col("a.text"), F.lit("mevzuat").alias("source"), F.col("url").alias("source_url"))
    return out.withColumn("char_len", F.length("text"))


def decisions(responses: DataFrame) -> DataFrame:
    """Decisions of saved responses (decision_id, query, body): html in the field ``data`` of a JSON envelope; unreadable ones go."""
    rows = responses.withColumn("html", F.get_json_object("body", "$.data")).filter(F.coalesce("html", F.lit("")) != "")
    rows = rows.select("decision_id", "query", html_text(F.col("html")).alias("text"), F.lit("yargitay").alias("source"))
    return rows.filter(F.length("text") > 0).withColumn("char_len", F.length("text"))


def search_hits(responses: DataFrame) -> DataFrame:
    """(query, decision_id) of saved search responses (query, body)."""
    ids = F.from_json(F.get_json_object("body", "$.data.data"), "array<struct<id:string>>")
    return responses.select("query", F.explode(ids).alias("hit")).select("query", F.col("hit.id").alias("decision_id"))


def gazette(pages: DataFrame, law_numbers: list[str]) -> DataFrame:
    """Issues of saved gazette pages (rg_sayi, url, baslik, html) that name one of the laws."""
    rows = pages.withColumn("body", html_text(F.col("html"), joined_by=" ", stripped=False)).withColumn("kanunlar", named_laws(F.col("body"), law_numbers))
    return rows.filter(F.size("kanunlar") > 0).select("rg_sayi", "url", "baslik", "kanunlar", gazette_articles(F.col("body")).alias("degisen_maddeler"))


def read_json_corpus(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON files that hold either an array or an object whose values are the rows."""
    raw = spark.read.text(path, wholetext=True)
    ddl = schema.simpleString()
    as_list = F.from_json("value", f"array<{ddl}>")
    as_map = F.map_values(F.from_json("value", f"map<string,{ddl}>"))
    rows = F.when(F.trim("value").startswith("["), as_list).otherwise(as_map)
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)




def write_points(points: DataFrame, path: str, *, reset: bool = False) -> None:
    """Vector points, partitioned by law so that a law filter prunes files; reset drops what is there."""
    points.write.mode("overwrite" if reset else "append").partitionBy("law").parquet(path)


def read_points(spark: SparkSession, path: str, *, vectors: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return df if vectors else df.drop("vector")


def stored_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Those of the wanted point ids that are stored."""
    return wanted.join(spark.read.parquet(path).select("point_id"), "point_id", "left_semi")


def write_report(summary: DataFrame, detail: DataFrame, path: str, stamp: str) -> None:
    """Evaluation as JSON: one folder per run for the summary, one for the detail."""
    summary.write.mode("overwrite").json(f"{path}/{stamp}/summary")
    detail.write.mode("overwrite").json(f"{path}/{stamp}/detail")


def sample_for_test(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    return df.orderBy(order).limit(n)


