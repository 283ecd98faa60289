"""Fill-in-the-middle examples by escaped marker injection, in SQL functions only.

A delimiter (and the escape character) is escaped in the text; ``regexp_replace`` then puts a plain delimiter after every unit, a code point or its escape.
Counting delimiters counts units, and ``substring_index`` takes the parts before and after a ranked delimiter: prefix, middle and suffix, which are unescaped and
put together in one of three forms:

    plain  the text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Cuts and forms come from the sha256 of seed and id. A marker begins with its only ``<`` and ends with its only ``>``, so joining parts never makes a new one:
``restored`` finds the parts by the first markers and gives the text back.

Defined results: a null text is an empty one and plain; texts that hold a marker are plain; very long texts are cut whole (their marked form is at most three times as long);
a null id is hashed as an empty string; rows with equal ids are cut by the same numbers, each by its own length, so repeated rows get equal results; both cuts may fall on one
place, then the middle is empty; an empty table gives an empty result; an input column named like ``info``, in any case of letters, is replaced, other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import but

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter and the escape character, and what stands for them in an escaped text.
_MARK, _ESCAPE = "\x01", "\x02"
_MARK_OUT, _ESCAPE_OUT = "\x02d", "\x02e"
_UNIT = "(?s)(\x02[de]|[^\x01\x02])"


def _lit(x: str) -> Column:
    return F.lit(x)


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after every unit."""
    escaped = F.replace(F.replace(text, _lit(_ESCAPE), _lit(_ESCAPE_OUT)), _lit(_MARK), _lit(_MARK_OUT))
    return F.regexp_replace(escaped, _UNIT, "$1" + _MARK)


def units(marks: Column) -> Column:
    """Number of units of a marked text: of its delimiters."""
    return (F.length(marks) - F.length(F.replace(marks, _lit(_MARK), _lit("")))).cast("long")


def unmarked(part: Column) -> Column:
    """The text of a part of a marked text."""
    plain = F.replace(part, _lit(_MARK), _lit(""))
    return F.replace(F.replace(plain, _lit(_MARK_OUT), _lit(_MARK)), _lit(_ESCAPE_OUT), _lit(_ESCAPE))


def _first(marks: str, count: str) -> Column:
    return F.expr(f"substring_index({marks}, '\\u0001', cast({count} as int))")


def _numbers(seed: int, id_: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between the leading marker, ``second`` and the middle's marker."""
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, info: str = "fim"
) -> DataFrame:
    """docs with a struct column ``info``: n (code points), form, prefix_chars and middle_chars (null if plain), output.

    plain_percent of the texts stay as they are; spm_percent of the others put the suffix first.
    """
    columns = but(docs, info)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"), F.array(*_numbers(seed, F.col(f"`{id_col}`"))).alias("_h"))
    out = out.withColumn("_marks", marked(F.col("_text"))).withColumn("_n", units(F.col("_marks")))
    x, y = F.col("_h")[0] % (F.col("_n") + 1), F.col("_h")[1] % (F.col("_n") + 1)
    out = out.withColumn("_a", F.least(x, y)).withColumn("_b", F.greatest(x, y))
    whole = (F.col("_n") == 0) | (F.col("_h")[2] % 100 >= 100 - plain_percent)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.contains(F.col("_text"), F.lit(marker))
    form = F.when(whole, "plain").when(F.col("_h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumn("_form", form)
    # parts by rank: the first b units, of these the last b - a; and after the text's last delimiter stands one empty part more
    out = out.withColumn("_head", _first("_marks", "_b"))
    prefix, middle = unmarked(_first("_head", "_a")), unmarked(_first("_head", "-(_b - _a)"))
    suffix = unmarked(_first("_marks", "-(_n - _b + 1)"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("_form") == "plain", F.col("_text")).when(F.col("_form") == "spm", spm).otherwise(psm)
    cut = F.col("_form") != "plain"
    fields = [F.col("_n").alias("n"), F.col("_form").alias("form"), F.when(cut, F.col("_a")).alias("prefix_chars")]
    fields += [F.when(cut, F.col("_b") - F.col("_a")).alias("middle_chars"), output.alias("output")]
    return out.select(*[F.col("_row")[c].alias(c) for c in columns], F.struct(*fields).alias(info))
