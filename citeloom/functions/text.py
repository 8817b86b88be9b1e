"""Column expressions for titles, authors, years, citations and fuzzy scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .doi import SPACE, once, trim


def normalize_title(c: Column) -> Column:
    """Lower case; everything but ASCII letters, digits, ``_`` becomes a space; spaces collapse."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: x and "".join(ch for ch in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(ch) <= 0x36F))


def author_surname(c: Column) -> Column:
    """Last token of a name that is no initial, without diacritics; empty for none."""
    bare = c.rlike(r"^\p{ASCII}*$")
    folded = F.when(bare, c).otherwise(_decomposed(F.when(~bare, c)))  # a null goes to Python for other names
    plain = F.regexp_replace(F.lower(folded), r"[^a-z0-9_\s-]", " ")
    names = F.filter(F.split(plain, r"\s+"), lambda t: ~t.rlike(r"^[a-z]?$"))
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))


def byline_metadata(c: Column) -> Column:
    """Struct (first_author, year) of ``A Author, B Author - Journal, 2016 - host``."""
    first = F.replace(F.get(F.split(F.get(F.split(c, " - "), F.lit(0)), ","), F.lit(0)), F.lit("…"), F.lit(""))
    tokens = F.split(F.regexp_replace(first, rf"[^\p{{L}}\p{{N}}{SPACE}-]", " "), rf"[{SPACE}]+")
    names = F.filter(tokens, lambda t: ~t.rlike(r"^[A-Za-z]?$"))
    return F.struct(F.try_element_at(names, F.lit(-1)).alias("first_author"), parse_year(c).alias("year"))


def parse_year(c: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def works_year(json: Column) -> Column:
    """Year of a work record: of the first date present, even where that one holds no year."""
    dates = [F.get_json_object(json, f"$['{k}']['date-parts']") for k in ("issued", "published-print", "published-online", "published")]
    return F.get_json_object(F.coalesce(*dates), "$[0][0]").try_cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Share of the longer text that edits leave; 1 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def title_tokens(normal: Column) -> Column:
    """Distinct tokens of a normalised title."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def _token_parts(ta: Column, tb: Column) -> tuple[Column, Column, Column]:
    """Shared tokens, and what each title has besides, as sorted texts."""
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return text(F.array_intersect(ta, tb)), text(F.array_except(ta, tb)), text(F.array_except(tb, ta))


def _ratio(shared: Column, wa: Column, wb: Column) -> Column:
    # Each title begins with the shared tokens, so its distance to them is the
    # rest's length; only the two titles need an edit distance.
    part = lambda w: F.when(F.length(w) == 0, 1.0).otherwise(F.length(shared) / F.length(w))
    return F.greatest(part(wa), part(wb), similarity(wa, wb)) * 100


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best similarity among the shared tokens and each title's tokens after them."""
    shared, ra, rb = _token_parts(title_tokens(normalize_title(a)), title_tokens(normalize_title(b)))
    return _ratio(shared, F.trim(F.concat_ws(" ", shared, ra)), F.trim(F.concat_ws(" ", shared, rb)))


def with_token_set_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the ratio of two columns of normalised titles, in steps, so that no part is evaluated twice."""
    ta, tb, shared, ra, rb = (f"__{x}" for x in ("ta", "tb", "shared", "ra", "rb"))
    out = df.withColumns({ta: title_tokens(F.col(a)), tb: title_tokens(F.col(b))})
    out = out.withColumns(dict(zip((shared, ra, rb), _token_parts(F.col(ta), F.col(tb)))))
    out = out.withColumns({x: F.trim(F.concat_ws(" ", shared, x)) for x in (ra, rb)})
    return out.withColumn(name, _ratio(F.col(shared), F.col(ra), F.col(rb))).drop(ta, tb, shared, ra, rb)


#: Labels of action links that publishers put after a citation, fixed values.
LINK_LABELS = (
    r"Cross\s?Ref", r"PubMed(?:\s+Central)?", r"Web\s+of\s+Science", r"Google\s+Scholar", "ISI", "Medline", "Scopus", "CAS",
    r"View\s+(?:Article|in\s+Article|on\s+Publisher\s+Site)", r"Full[\s-]?Text", "PDF", r"Free\s+Article", r"Open\s+Access",
    r"Find\s+in\s+Worldcat", "ChemPort", r"Bing(?:\s+Scholar)?", "OpenURL", "DOI", r"Direct\s+Link", "ADS", "ProQuest",
    r"Show\s+Abstract", r"Read\s+(?:Article|Abstract)",
)
_LABELS = rf"(?i)(?:[\s|·•,]+(?:{'|'.join(LINK_LABELS)})\b[\s.,;|·•]*)+\z"


def clean_reference_text(c: Column) -> Column:
    """A citation without the link labels at its end."""
    return trim(F.regexp_replace(trim(c), _LABELS, ""))


def parse_notice_date(c: Column) -> Column:
    """Timestamp of ``M/d/yyyy H:mm``; null where it does not parse."""
    stamp = F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2})", 1), F.lit(""))
    return F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit("M/d/yyyy H:mm"))


def outcome_class(c: Column) -> Column:
    """success, failure or mixed, tested in this order."""
    low = F.lower(c)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("success") | has("replicated") | (low == "yes"), "success").when(has("fail") | (low == "no"), "failure").when(c.isNotNull(), "mixed")


def author_label(authors: Column) -> Column:
    """Family, else given name of the first author; ``et al.`` for more than one; null for none."""
    first = F.get(authors, F.lit(0))
    name = F.coalesce(F.nullif(first["family"], F.lit("")), F.nullif(first["given"], F.lit("")))
    return F.when(F.size(authors) > 1, F.concat(name, F.lit(" et al."))).otherwise(name)


#: Entities that rendered citations hold, fixed values.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "amp": "&"}
_INLINE = "i|em|b|strong|sub|sup"


def _decode_entities(c: Column) -> Column:
    # ``amp`` last: what it uncovers is not decoded again
    for name, char in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    return c


def _left(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+", "")


def _right(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]+\z", "")


def _rejoined(c: Column, phrase: str, join: Callable[[Column, Column, Column], Column]) -> Column:
    """``c`` split at a phrase and put together again: ``join`` takes what stands so far, the phrase as it is spelt, and what follows it."""

    def joined(text: Column, parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        found = F.regexp_extract_all(text, F.lit(f"({phrase})"), F.lit(1))
        steps = F.zip_with(found, rest, lambda p, after: F.struct(p.alias("phrase"), after.alias("after")))
        return F.aggregate(steps, F.get(parts, F.lit(0)), lambda so_far, step: join(so_far, step["phrase"], step["after"]))

    return once(c, lambda text: once(F.split(text, phrase), lambda parts: joined(text, parts)))


def _editor_joined(before: Column, phrase: Column, after: Column) -> Column:
    # the phrase names nobody if a mark follows it at once
    def joined(left: Column, then: Column) -> Column:
        mark, rest = F.substring(then, 1, 1), _left(F.substr(then, F.lit(2)))
        stop = F.when(F.endswith(left, F.lit(".")), left).otherwise(F.concat(F.when(F.endswith(left, F.lit(",")), F.left(left, F.length(left) - 1)).otherwise(left), F.lit(",")))
        return F.when(mark == ",", F.concat(stop, F.lit(" "), rest)).when(mark == ".", F.concat(left, F.lit(" "), rest)).otherwise(F.concat(before, phrase, after))

    return once(_right(before), lambda left: once(_left(after), lambda then: joined(left, then)))


def _abbreviated_joined(before: Column, comma: Column, after: Column) -> Column:
    # ", ed." that follows a full stop
    part = _left(after)
    empty = (F.lower(F.left(part, F.lit(3))) == "ed.") & F.endswith(_right(before), F.lit(".")) & F.substr(part, F.lit(4)).rlike(rf"\A[{SPACE}]")
    return F.when(empty, F.concat(_right(before), F.lit(" "), _left(F.substr(part, F.lit(4))))).otherwise(F.concat(before, comma, after))


def _unnumbered(c: Column) -> Column:
    """Without the place in a list that a citation begins with: digits and a full stop, or digits in brackets."""
    digits = "0123456789"
    open_ = F.startswith(c, F.lit("["))
    inside = F.when(open_, F.substr(c, F.lit(2))).otherwise(c)
    after = F.ltrim(inside, F.lit(digits))
    numbered = (F.length(after) < F.length(inside)) & F.startswith(after, F.when(open_, F.lit("]")).otherwise(F.lit(".")))
    return F.when(numbered, F.substr(after, F.lit(2))).otherwise(c)


def _one_line(c: Column) -> Column:
    """A citation without editor phrases that name nobody and without its number in the list; runs of space are one."""
    named = _rejoined(_rejoined(c, "(?i)edited by", _editor_joined), ",", _abbreviated_joined)
    return trim(F.regexp_replace(once(named, _unnumbered), rf"[{SPACE}]+", " "))


def _verbatim(fmt: Column) -> Column:
    return F.lower(fmt).isin("bibtex", "ris")


def tidy_citation(raw: Column, fmt: Column) -> Column:
    """Plain text of a rendered citation; BibTeX and RIS keep their layout."""
    plain = trim(_decode_entities(F.regexp_replace(raw, "<[^>]*>", "")))
    return once(plain, lambda text: F.when(_verbatim(fmt), text).otherwise(_one_line(text)))


def tidy_citation_html(raw: Column, fmt: Column) -> Column:
    """The citation with bare emphasis tags only; null for BibTeX and RIS, and where nothing is left."""
    other = F.regexp_replace(raw, rf"(?i)</?(?!(?:{_INLINE})\b)[a-z0-9]+[^>]*>", "")
    bare = F.regexp_replace(other, rf"(?i)<(/?)({_INLINE})\b[^>]*>", "<$1$2>")
    return F.when(~_verbatim(fmt), F.nullif(_one_line(trim(bare)), F.lit("")))
