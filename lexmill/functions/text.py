"""Scalar text functions: Columns in, Columns out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def contains_any(x: Column, terms: list[str]) -> Column:
    """x should be a column or a bound variable, as each term looks at it anew."""
    return reduce(lambda a, b: a | b, [x.contains(t) for t in terms])


def fold_unicode(x: Column) -> Column:
    """Typographic signs as ASCII: dashes, quotes, ellipsis, no-break space, soft hyphen, bullet."""
    one = F.translate(x, "\u2013\u2012\u2018\u2019\u201c\u201d\u00a0\u2022\u00ad", "--''\"\" *")
    return F.replace(F.replace(F.replace(one, F.lit("\u2014"), F.lit("--")), F.lit("\u2015"), F.lit("--")), F.lit("\u2026"), F.lit("..."))


def sentences(x: Column) -> Column:
    """Trimmed sentences that aren't blank, cut after . ! or ? and white space."""
    return F.filter(F.split(strip(x), r"(?<=[.!?])\s+"), lambda s: s != "")  # only the ends of the text can be blank


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))


def _title(token: Column) -> Column:
    """Each run of letters with a capital first, also after digits."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(token), F.lit("([a-z]+|[0-9]+)"), 1), _capital), "")


def group_key(x: Column) -> Column:
    """The label that facts are grouped by: signs as spaces, capitals of up to six letters kept, else title case."""
    clean = F.btrim(F.regexp_replace(x, "[^a-zA-Z0-9]+", " "))
    token = lambda t: F.when(t.rlike("^[A-Z]{1,6}$"), t).otherwise(_title(t))
    # Most labels have neither short capitals nor digits, and need no look at each token.
    return F.when(clean.rlike(r"[0-9]|\b[A-Z]{1,6}\b"), F.array_join(F.transform(words(clean), token), " ")).otherwise(F.initcap(clean))


def _parentheses(x: Column) -> Column:
    """"Name (ABC)" as "Name" where ABC has its initials or repeats it, else as "Name ABC"."""
    form = r"^\s*(.*?)\s*\(([^()]+)\)\s*$"

    def parts(p: Column) -> Column:
        left, inside = p["l"], p["i"]
        initials = F.upper(F.array_join(F.transform(F.regexp_extract_all(left, F.lit("([A-Za-z0-9]+)"), 1), lambda w: F.left(w, F.lit(1))), ""))
        compact = F.upper(F.regexp_replace(inside, "[^A-Za-z0-9]", ""))
        same = (compact == initials) & F.length(compact).between(2, 6) | (F.lower(left) == F.lower(inside))
        return F.when(left == "", inside).when(inside == "", left).when(same, left).otherwise(F.concat_ws(" ", left, inside))

    both = F.struct(collapse(F.regexp_extract(x, form, 1)).alias("l"), collapse(F.regexp_extract(x, form, 2)).alias("i"))
    return F.when(x.rlike(form), let(both, parts)).otherwise(x)


def _filler(x: Column) -> Column:
    out = x
    for f in reversed(vocab.LEADING_FILLERS):
        out = F.when(F.lower(x).startswith(f), F.substring(x, len(f) + 1, 1 << 30)).otherwise(out)
    return strip(out)


def _singular(last: Column) -> Column:
    low, n = F.lower(last), F.length(last)
    keep = low.isin(vocab.SINGULAR_EXCEPTIONS) | (n <= 3) | ~low.endswith("s")
    return F.when(keep, last).when(low.endswith("ies") & (n > 4), F.concat(F.substring(last, F.lit(1), n - 3), F.lit("y"))).when(low.endswith("ss"), last).otherwise(F.substring(last, F.lit(1), n - 1))


def _but_last(w: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))


def normalize_label(x: Column) -> Column:
    """A label in its normal form: fillers, repeats, generic suffixes and plurals go, acronyms stay."""
    text = _filler(collapse(F.replace(_parentheses(strip(x)), F.lit("-"), F.lit(" "))))
    once = let(words(text), lambda w: F.filter(w, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(w, i - 1)))))

    def stem(w: Column) -> Column:
        enough = (F.size(w) >= 3) | ((F.size(w) == 2) & (F.length(F.get(w, F.lit(0))) > 3))
        return F.when((F.size(w) > 0) & F.lower(F.element_at(w, -1)).isin(vocab.GENERIC_SUFFIXES) & enough, _but_last(w)).otherwise(w)

    single = let(let(once, stem), lambda w: F.when(F.size(w) > 0, F.concat(_but_last(w), F.array(_singular(F.element_at(w, -1))))).otherwise(w))

    def cased(t: Column) -> Column:
        clean = F.regexp_replace(t, "[^A-Za-z0-9]", "")
        return F.when(clean.rlike("[A-Z]") & ~clean.rlike("[a-z]") & F.length(clean).between(2, 6), clean).otherwise(_capital(t))

    return F.array_join(F.transform(single, cased), " ")


def merge_key(x: Column) -> Column:
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(vocab.MERGE_STOPWORDS)), " ")


def match_tokens(x: Column) -> Column:
    """Tokens for comparing labels; only the last is made singular, without exceptions."""
    low = F.regexp_replace(F.lower(x), r"(?<![a-z0-9])'|'(?![a-z0-9])", " ")

    def last(t: Column) -> Column:
        n = F.length(t)
        plural = t.endswith("s") & (n > 3) & ~t.endswith("'s")
        return F.when(plural & t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when(plural, F.substring(t, F.lit(1), n - 1)).otherwise(t)

    return let(words(F.regexp_replace(low, r"[^a-z0-9'\s]", " ")), lambda w: F.when(F.size(w) > 0, F.concat(_but_last(w), F.array(last(F.element_at(w, -1))))).otherwise(w))


def concept_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(vocab.TOKEN_STOPWORDS) & (F.length(t) > 1)))


def compare_text(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def template_of(x: Column) -> Column:
    """compare_text with numbers as one mark."""
    return number_marked(compare_text(x))


def number_marked(x: Column) -> Column:
    return F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"\b\$?\d[\d,]*(?:\.\d+)?%?\b", "<num>")).otherwise(x)


def numeric_density(x: Column) -> Column:
    """Share of the tokens that have a digit."""
    low = F.lower(x)
    numbers = F.regexp_count(low, F.lit("[a-z]*[0-9][a-z0-9]*"))
    return F.when(x.rlike("[0-9]"), numbers / F.regexp_count(low, F.lit("[a-z0-9]+"))).otherwise(F.lit(0.0))


def title_case(x: Column, acronyms: Column | None = None) -> Column:
    """Display case: known acronyms, capitals of 2 to 6 letters kept, connectors small but at the start."""

    def cased(t: Column, i: Column) -> Column:
        upper = t.rlike("[A-Z]") & ~t.rlike("[a-z]") & F.length(t).between(2, 6)
        out = F.when(upper, t).when((i > 0) & F.lower(t).isin(vocab.CONNECTORS), F.lower(t)).otherwise(_capital(t))
        return out if acronyms is None else F.coalesce(F.try_element_at(acronyms, F.lower(t)), out)

    return F.when(strip(x) == "", x).otherwise(F.array_join(F.transform(words(x), cased), " "))


def page_title(x: Column, acronyms: Column | None = None) -> Column:
    """title_case, with a last word that has the initials of those before in parentheses."""

    def titled(w: Column) -> Column:
        tail, head = F.element_at(w, -1), _but_last(w)
        initials = F.upper(F.array_join(F.transform(F.filter(head, lambda t: t.rlike("[A-Za-z]")), lambda t: F.left(t, F.lit(1))), ""))
        acronym = tail.rlike("[A-Z]") & ~tail.rlike("[a-z]") & F.length(tail).between(2, 6) & (initials.contains(tail) | (tail == F.substring(initials, F.lit(1), F.length(tail))))
        return F.when((F.size(w) >= 2) & acronym, F.concat(title_case(F.array_join(head, " "), acronyms), F.lit(" ("), tail, F.lit(")"))).otherwise(title_case(x, acronyms))

    return F.when(strip(x) == "", x).otherwise(let(words(x), titled))


def lead(definition: Column, key_points: Column) -> Column:
    """The definition's first sentence, else the first key point."""
    first = strip(F.get(F.split(strip(definition), r"(?<=[.!?])\s+"), F.lit(0)))
    has = definition.isNotNull() & ~definition.isin("", "No definition available.")
    return F.when(has, F.when(first != "", first).otherwise(definition)).when(F.size(key_points) > 0, F.get(key_points, F.lit(0))).otherwise("No lead available.")


def emphasize_once(x: Column, title: Column) -> Column:
    """The title's first occurrence, in any case, in bold; else the title in bold before the text."""
    at = F.call_function("locate", F.lower(title), F.lower(x))
    bold = F.concat(F.lit("**"), title, F.lit("**"))
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), bold, F.substring(x, at + F.length(title), F.lit(1 << 30)))).otherwise(F.concat(bold, F.lit(": "), x))


def summary(items: Column, most: int = 2, chars: int = 320) -> Column:
    text = strip(F.array_join(F.slice(items, 1, most), " "))
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(chars - 3)), r"\s+$", ""), F.lit("..."))
    return F.when(F.size(items) == 0, "No summary available.").when(F.length(text) <= chars, text).otherwise(cut)


def key_terms(x: Column, stopwords: list[str]) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"\b([a-z]+)\b"), 1), lambda t: ~t.isin(stopwords) & (F.length(t) > 2)))


def safe_filename(title: Column) -> Column:
    """A title as a file name: signs that file systems reject go."""
    clean = strip(F.translate(title, '\\/:*?"<>|', ""))
    return F.when(clean == "", "Unnamed Concept").otherwise(clean)
