"""Gates, upserts and versions of a growing corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_gazette, clean_whitespace, content_hash, mask_ids, mask_persons
from ..storage import written


def statute_gate(items: DataFrame, least: int = 50) -> DataFrame:
    """Masked texts of at least so many characters, with char_len."""
    out = items.withColumn("text", mask_ids(F.col("text"))).withColumn("char_len", F.length("text"))
    return out.filter(F.col("char_len") >= least)


def decision_gate(items: DataFrame, source: str = "yargitay", least: int = 300) -> DataFrame:
    """As statute_gate, with persons masked after numbers, and a default source."""
    out = items.filter(F.coalesce("text", F.lit("")) != "").withColumn("text", mask_persons(mask_ids(F.col("text"))))
    out = out.withColumn("char_len", F.length("text")).filter(F.col("char_len") >= least)
    given = F.col("source") if "source" in items.columns else F.lit(None).cast("string")
    return out.withColumn("source", F.coalesce(given, F.lit(source)))


def route(items: DataFrame, gates: dict[str, tuple]) -> DataFrame:
    """Each source through its own gates; others pass. gates: source to functions of a DataFrame."""
    out = items.filter(~F.coalesce("source", F.lit("")).isin(list(gates)))
    for source, steps in gates.items():
        part = items.filter(F.col("source") == source)
        for step in steps:
            part = step(part)
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def new_issues(issues: DataFrame, state: DataFrame, key: tuple[str, ...] = ("rg_sayi", "url")) -> DataFrame:
    """Issues that the state has not seen. With a page's url in the key, all pages of an issue pass."""
    return issues.join(state.select(*key).distinct(), list(key), "left_anti")


def relevant_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.size("kanunlar") > 0)


def next_state(issues: DataFrame, checked_at: Column, key: tuple[str, ...] = ("rg_sayi", "url")) -> DataFrame:
    return issues.select(*key).distinct().withColumn("last_checked_at", checked_at)


def prepare_issue(issues: DataFrame) -> DataFrame:
    """Clean title and articles; count the articles' characters."""
    body = lambda m: clean_gazette(m["icerik"])
    made = F.transform("degisen_maddeler", lambda m: F.struct(m["madde_no"].alias("madde_no"), body(m).alias("icerik"), F.length(body(m)).alias("karakter_sayisi")))
    return issues.withColumn("baslik", clean_whitespace(F.col("baslik"))).withColumn("degisen_maddeler", made)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _changes_along(rows: DataFrame, key: str, order: list[str], seed: DataFrame | None = None) -> DataFrame:
    """rows (key, order, hash and more) with _changed, whether the hash differs from that of the key's row before, and _count, how often it did so far.

    A segmented scan: rows are range-partitioned by key and order, so a key that most rows have spreads over many partitions; a partition counts its own
    changes, and one summary row for each partition and key (first hash, last hash, changes) carries hash and count over the borders. seed: (key, _seed) the hash
    before a key's first row; without it, or where it is null, the first row is a change.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key, *order)
    # written once: a second evaluation could cut the ranges elsewhere
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "versions")
    w = Window.partitionBy(key, "_part").orderBy(*order)
    local = ranged.withColumn("_before", F.lag("hash").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    local = local.withColumn("_step", F.when(F.col("_first"), 0).otherwise((~F.col("_before").eqNullSafe(F.col("hash"))).cast("int")))
    place = F.struct(*order)
    ends = local.groupBy(key, "_part").agg(F.min_by("hash", place).alias("_from"), F.max_by("hash", place).alias("_to"), F.sum("_step").alias("_steps"))
    along = Window.partitionBy(key).orderBy("_part")  # a row for each partition and key
    head, before = F.row_number().over(along) == 1, F.lag("_to").over(along)
    if seed is None:
        edge = head | ~before.eqNullSafe(F.col("_from"))
    else:
        ends = ends.join(seed.select(F.col(key).alias("_k"), "_seed"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        edge = ~F.when(head, F.col("_seed")).otherwise(before).eqNullSafe(F.col("_from")) | (head & F.col("_seed").isNull())
    ends = ends.withColumn("_edge", edge.cast("int"))
    ends = ends.withColumn("_start", F.sum(F.col("_edge") + F.col("_steps")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_steps"))
    both = local.join(ends.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_edge", "_start"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    upto = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_count", (F.col("_start") + F.sum("_step").over(upto)).cast("long"))
    changed = F.when(F.col("_first"), F.col("_edge") == 1).otherwise(F.col("_step") == 1)
    return both.withColumn("_changed", changed).drop("_part", "_before", "_first", "_step", "_key", "_p", "_edge", "_start")


def add_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """versions (key, version, issue, date, text, hash) with those that changes (key, issue, date, text, in order of ord) bring.

    A change adds a version where its hash differs from that of the text before it; unknown keys are ignored. A change without text is none: the text
    before it stays the current one. Changes of a key with equal ord are taken in the order of their hashes. The stored version is where the scan along a key begins.
    """
    last = versions.groupBy("key").agg(F.max_by(F.struct("version", "hash"), "version").alias("last"))
    last = written(last.select("key", F.col("last.version").alias("_version"), F.col("last.hash").alias("_seed")), "last-versions")
    rows = changes.filter(F.col("text").isNotNull()).select("key", "issue", "date", "text", "ord", content_hash(F.col("text")).alias("hash"))
    along = _changes_along(rows.join(last.hint("merge").select("key", "_version"), "key"), "key", ["ord", "hash"], last)
    added = along.filter("_changed").select("key", (F.col("_version") + F.col("_count")).cast("int").alias("version"), "issue", "date", "text", "hash")
    return versions.unionByName(added)


def versions_along(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, version, hash) of each row at which the text of a key changes; a null text is a text like others."""
    along = _changes_along(rows.select(key, order, content_hash(F.col(text)).alias("hash")), key, [order])
    return along.filter("_changed").select(key, order, "hash", F.col("_count").alias("version"))


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose current version moved: those to embed again."""
    latest = lambda d, c: d.groupBy("key").agg(F.max("version").alias(c))
    both = latest(after, "now").join(latest(before, "then"), "key", "left")
    return both.filter(F.col("then").isNull() | (F.col("now") > F.col("then"))).select("key")
