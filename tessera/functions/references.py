"""References to laws and articles: heads, and rules over the types of the tokens behind them.

A head (a law's code, number or name, an article's number, a marker) is found by one pass that also hands over the text behind it, up to some reach (a look-ahead, so heads may
overlap). That text is cut into tokens: words, runs of digits, runs of blanks, single signs. Every token has a type, written as one letter, so that what may follow a head is a short rule over
a string of types; which token is the number follows from where the rule's match ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CITATION_REACH, NAME_REACH, NUMBER_REACH

#: Words that mark an article number, the word that follows a law's number, and endings of ordinals.
MARKER_WORDS = ("madde", "md", "m")
NUMBERED = "say[ıi]l[ıi]"
ORDINALS = ("inci", "ıncı", "üncü", "uncu")


def one_of(words: Sequence[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def heads(c: Column, words: Sequence[str], reach: int | None = None, whole: bool = True) -> Column:
    """array<struct<head, tail>>: where one of the words (patterns) stands, and the text behind it, up to ``reach`` characters.

    whole: a word begins where no letter, digit or underscore is before it.
    """
    start = r"(?<![\p{L}\p{N}_])" if whole else ""
    far = "*" if reach is None else f"{{0,{reach}}}"
    rx = F.lit(rf"(?iu){start}({one_of(words)})(?=((?s:.{far})))")
    return F.arrays_zip(F.regexp_extract_all(c, rx, F.lit(1)).alias("head"), F.regexp_extract_all(c, rx, F.lit(2)).alias("tail"))


def behind(tail: Column, link: str) -> Column:
    """What is behind a link at the start of the tail; null where the link is not there."""
    rx = rf"(?iu)\A(?:{link})"
    return F.when(tail.rlike(rx), F.regexp_replace(tail, rx, ""))


def leading(tail: Column, what: str) -> Column:
    return F.regexp_extract(tail, rf"(?iu)\A({what})", 1)


def ends_here(rest: Column) -> Column:
    """No letter, digit or underscore goes on."""
    return ~rest.rlike(r"(?U)\A\w")


def after(text: Column, part: Column) -> Column:
    return F.substring(text, F.length(part) + 1, F.length(text))


def _found(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


# -- tokens and their types ------------------------------------------------------------------------------------

TOKEN = r"(?sU)(\p{L}+|\d+|\s+|.)"
#: Types of signs and of words, the first that fits; other words are w, other signs o.
SIGNS = {".": "p", ",": "c", "(": "(", ")": ")", "/": "/", "'": "a", "’": "a", ":": ":", "-": ":"}
WORDS = (("M", "madde"), ("D", "md"), ("m", "m"), ("i", "|".join(ORDINALS)), ("I", f"(?:{'|'.join(ORDINALS)})m.*"), ("y", NUMBERED + ".*"), ("k", "kanun.*"), ("x", "m.*"), ("z", ".*madde"))
WORD, BLANK = "[MDmiIykxzw]", "[sn]"


def tokens(c: Column) -> Column:
    """All of a text, in pieces."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def token_type(t: Column) -> Column:
    """One letter: d digits, s blanks, n blanks with a line's end, and those of ``SIGNS`` and ``WORDS``."""
    word = F.lit("w")
    for kind, form in reversed(WORDS):
        word = F.when(t.rlike(rf"(?iu)\A(?:{form})\z"), kind).otherwise(word)
    out = F.when(t.rlike(r"(?U)\A\p{L}"), word).when(t.rlike(r"(?U)\A\d"), "d").when(t.rlike(r"(?U)\A\s"), F.when(F.contains(t, F.lit("\n")), "n").otherwise("s"))
    for sign, kind in SIGNS.items():
        out = out.when(t == sign, kind)
    return out.otherwise("o")


def token_types(parts: Column) -> Column:
    return F.array_join(F.transform(parts, token_type), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def read(tail: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(tokens, types) of a text."""
    return let(tokens(tail), lambda t: let(token_types(t), lambda k: use(t, k)))


def run_length(types: Column, rule: str) -> Column:
    """Tokens that a rule takes from the start, 0 if it does not fit."""
    return F.length(F.regexp_extract(types, rf"\A(?:{rule})", 0))


def text_between(parts: Column, first: Column | int, last: Column) -> Column:
    """Text of the tokens from ``first`` up to and without ``last`` (both from 0)."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.array_join(F.slice(parts, first + 1, F.greatest(last - first, F.lit(0))), "")


# -- questions -------------------------------------------------------------------------------------------------


def article_number(c: Column, laws: Sequence[str], numbers: Sequence[str], names: Sequence[str], *, fixed: bool = True) -> Column:
    """Article number that a query names, or null; the earliest head wins, then the earlier kind.

    The number (its first four digits) stands behind a law's code, with an ending or a marker between; before a marker, as an ordinal or plain; behind a
    law's number or name, as the next number of the sentence within reach; or behind a bare marker.
    fixed=False keeps two quirks: a law's name followed by a number is not recognised, nor is a bare marker before a number.
    """
    c = F.lower(c)

    def last_number(t: Column, n: Column) -> Column:
        return F.when(n > 0, F.substring(F.get(t, n - 1), 1, 4))

    def by_code(h: Column) -> Column:
        return read(h["tail"], lambda t, k: last_number(t, run_length(k, f"(?:a?{WORD})?{BLANK}?(?:[MDm]p?)?{BLANK}?d")))

    def by_marker(h: Column) -> Column:
        return read(h["tail"], lambda t, k: F.when(run_length(k, f"(?:a?i)?p?{BLANK}?[MDmx]|a?I") > 0, h["head"]))

    def in_sentence(kind: str, word: str, reach: int) -> Callable[[Column], Column]:
        """The next number behind a word of that type, no sentence's or line's end between."""

        def judged(t: Column, k: Column) -> Column:
            n = run_length(k, f"{BLANK}{kind}[^pnd]*d")
            gap = F.length(F.regexp_replace(text_between(t, 1, n - 1), rf"\A{word}", ""))
            return last_number(t, F.when(gap <= reach, n).otherwise(0))

        return lambda h: read(h["tail"], judged)

    def bare(h: Column) -> Column:
        return read(h["tail"], lambda t, k: last_number(t, run_length(k, f"{BLANK}?d")))

    kinds = [(laws, by_code), ([r"\d{1,4}"], by_marker), (numbers, in_sentence("y", NUMBERED, NUMBER_REACH))]
    if fixed:
        kinds += [(names, in_sentence("k", "kanunu?", NAME_REACH)), (["madde", r"m\."], bare)]

    def judge(kind: int, number: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def judged(h: Column) -> Column:
            at = F.length(c) - F.length(h["tail"]) - F.length(h["head"])
            return let(number(h), lambda n: F.when(n.isNotNull(), F.struct(at.alias("at"), F.lit(kind).alias("kind"), n.alias("number"))))

        return judged

    candidates = [_found(F.transform(heads(c, words), judge(kind, number))) for kind, (words, number) in enumerate(kinds)]
    return F.array_min(F.flatten(F.array(*candidates)))["number"]


def has_reference(c: Column, laws: Sequence[str] = ("tbk", "tkhk", "ttk"), numbers: Sequence[str] = ("6098", "6502", "6102")) -> Column:
    """Whether the text names an article of a law, a bare article, or a law's number."""

    def numbered(words: Sequence[str], link: str) -> Column:
        def judged(h: Column) -> Column:
            rest = behind(h["tail"], link)
            return F.coalesce((leading(rest, r"\d+") != "") & ends_here(after(rest, leading(rest, r"\d+"))), F.lit(False))

        return F.exists(heads(c, words, 60), judged)

    law_number = F.exists(heads(c, numbers, 1), lambda h: ends_here(h["tail"]))
    return numbered(laws, r"\s*(?:(?:madde|m\.)\s*)?(?=\d)") | law_number | numbered(["madde", r"m\."], r"\s*(?=\d)")


def law_references(c: Column, laws: Sequence[str] = ("TBK", "TTK", "TKHK")) -> Column:
    """Sorted distinct law numbers ("6098 sayılı") and article numbers after a marker."""
    law_numbers = _found(F.transform(heads(c, [r"\d{4}"], 60, whole=False), lambda h: F.when(leading(h["tail"], rf"\s+{NUMBERED}") != "", F.concat(h["head"], leading(h["tail"], rf"\s+{NUMBERED}")))))

    def article(link: str) -> Callable[[Column], Column]:
        def judged(h: Column) -> Column:
            rest = behind(h["tail"], link)
            number = leading(rest, r"\d+[A-Za-z]*")
            return F.when((number != "") & ~after(rest, number).rlike(rf"(?iu)\A\s+{NUMBERED}"), number)

        return judged

    of_laws = _found(F.transform(heads(c, laws, 60, whole=False), article(r"\s+(?:madde|m\.?)\s*(?=\d)")))
    bare = _found(F.transform(heads(c, ["madde", r"m\.?"], 60, whole=False), article(r"\s+(?=\d)")))
    return F.array_sort(F.array_distinct(F.concat(law_numbers, of_laws, bare)))


# -- decisions -------------------------------------------------------------------------------------------------

#: What may follow a law's code, in types; V: letters of an article's number.
CITED = {
    "marked": f"{BLANK}(?:mp|M){BLANK}?d",
    "ending": f"a{WORD}{BLANK}d(?:/d)?p",
    "bracketed": rf"c{BLANK}?mp{BLANK}?d{WORD}?(?:/d)?{BLANK}?\)",
    "plain": rf"{BLANK}d(?:/d)?[pcsn)]",
}


def cited_articles(c: Column, codes: Sequence[str], numbers: Sequence[str]) -> Column:
    """array<struct<law, article>> of a decision's citations; law is a code or a number as it stands in the text.

    A code is followed by a marker, by an ending and an ordinal's dot, in brackets by a comma and a marker, or by a plain number before a
    blank, dot, comma or bracket. A law's number is followed by its word and, within reach in the same sentence, a marker. Only numbers behind a marker have letters.
    """

    def numbered(t: Column, k: Column, at: Column, letters: bool) -> Column:
        """The article's number at a token: digits, letters, and a paragraph behind a slash."""
        more = F.regexp_extract(F.coalesce(F.get(t, at + 1), F.lit("")), r"\A[A-Za-z]+", 0) if letters else F.lit("")

        def whole(own: Column) -> Column:
            slash = at + 1 + (own != "").cast("int")
            there = ((own == "") | (own == F.get(t, at + 1))) & (F.substring(k, slash + 1, F.lit(2)) == "/d")
            return F.concat(F.get(t, at), own, F.when(there, F.concat(F.lit("/"), F.get(t, slash + 1))).otherwise(""))

        return let(more, whole)

    def by_code(h: Column) -> Column:
        def judged(t: Column, k: Column) -> Column:
            at = F.instr(k, "d") - 1
            fits = {name: run_length(k, rule) > 0 for name, rule in CITED.items()}
            fits["ending"] = fits["ending"] & (F.get(t, F.lit(0)) == "'") & (F.length(F.get(t, F.lit(1))) <= 5)
            fits["bracketed"] = fits["bracketed"] & h["head"].startswith("(")
            return F.when(fits["marked"] | fits["bracketed"], numbered(t, k, at, True)).when(fits["ending"] | fits["plain"], numbered(t, k, at, False))

        law = F.regexp_replace(h["head"], r"\A\(\s*", "")
        return let(read(h["tail"], judged), lambda a: F.when(a.isNotNull(), F.struct(law.alias("law"), a.alias("article"))))

    def by_number(h: Column) -> Column:
        def judged(t: Column, k: Column) -> Column:
            n = run_length(k, f"{BLANK}y[^p]*?[Mz]{BLANK}d")
            gap = F.length(F.regexp_replace(text_between(t, 1, n - 2), rf"(?iu)\A{NUMBERED}|madde\z", ""))
            return F.when((n > 0) & (gap <= CITATION_REACH), numbered(t, k, n - 1, True))

        return let(read(h["tail"], judged), lambda a: F.when(a.isNotNull(), F.struct(h["head"].alias("law"), a.alias("article"))))

    coded = F.transform(heads(c, [rf"(?:\(\s*)?(?:{one_of(codes)})"], 60, whole=False), by_code)
    by_numbers = F.transform(heads(c, numbers, 120, whole=False), by_number)
    return F.concat(_found(coded), _found(by_numbers))


def article_mentions(answer: Column) -> Column:
    """Mentions of an article in an answer: the word before the marker, the marker, and the number with a letter behind a slash.

    A word that merely ends in a marker counts as one.
    """
    words = F.filter(F.split(answer, r"(?U)\s+"), lambda w: w != "")
    marker = r"(?:madde|m)\.?"
    number = r"\d+(?:/[a-z](?!\w))?(?!\w)"

    def mention(w: Column, k: Column) -> Column:
        before, then = F.coalesce(F.get(words, k - 1), F.lit("")), F.coalesce(F.get(words, k + 1), F.lit(""))
        parted = F.when(w.rlike(rf"(?iU)\w*{marker}\z") & (leading(then, number) != ""), F.concat(F.regexp_extract(w, rf"(?iU)(\w*{marker})\z", 1), F.lit(" "), leading(then, number)))
        glued = F.regexp_extract(w, rf"(?iU)(\w*{marker}{number})", 1)
        found = F.coalesce(parted, F.when(glued != "", glued))
        alone = w.rlike(rf"(?iU)\A{marker}(?:\d|\z)")
        word = F.regexp_extract(before, r"(?U)(\w+)\z", 1)
        return F.when(found.isNotNull(), F.when(alone & (word != ""), F.concat(word, F.lit(" "), found)).otherwise(found))

    return _found(F.transform(words, mention))
