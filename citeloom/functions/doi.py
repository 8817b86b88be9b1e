"""Column expressions for DOIs and PubMed Central ids. All give null for null."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers define it (Java's ``\s`` is ASCII only), for use in a character class.
SPACE = r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Characters that sites put inside a DOI for line wrapping, fixed values.
WORD_BREAKS = "\u200b\u200c\u200d\u00ad\u2060"

_HEAD = r"10\.\d{4,}+(?:\.\d++)*+"
#: A slash and a bare word before a separator or the end is page routing, a fixed pattern.
_ROUTE = rf"(?![a-zA-Z-]++(?:[/{SPACE},#?&<>{{}}\[\]]|\z))"


def _pattern(suffix: str) -> str:
    return rf"({_HEAD}/{suffix}++(?:/{_ROUTE}{suffix}++)*+)"


#: DOIs in links, addresses and plain text; with the next, fixed patterns.
DOI_PATTERN = _pattern(rf"[^{SPACE},/\]}}>'\"<#?&\\]")
#: DOIs in rendered text, where ``<``, ``>`` and ``}`` belong to old-style identifiers.
DOI_TEXT_PATTERN = _pattern(rf"[^{SPACE},/\]'\"#?&\\]")
_ENCODED = rf"{_HEAD}%2[fF][^{SPACE},/\]}}>'\"<#?&\\]++"
_EMBEDDED = rf"\b({_HEAD}/[^{SPACE}&\"'#?]++)"
_EMBEDDED_SEGMENT = rf"\b({_HEAD}/[^{SPACE}&\"'#?/]++)"
_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"
_END_MARKS = r"[.,;:]+\z"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def percent_decode(c: Column) -> Column:
    """Decoded text; null where the encoding is broken. A plus stays a plus."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd"))
    return F.when(~F.contains(c, F.lit("%")), c).when(~broken, decoded)


def _may_hold_doi(c: Column) -> Column:
    """A cheap look before patterns and decoding: all others hold no DOI, not even an encoded one."""
    return F.contains(c, F.lit("10.")) | F.contains(c, F.lit("%"))


def normalise_doi(c: Column) -> Column:
    """Lower-case DOI without its resolver prefix; null if it does not look like one."""
    bare = lambda raw: F.regexp_replace(F.coalesce(percent_decode(raw), raw), _PREFIX, "")
    lowered = lambda doi: F.when(doi.rlike(r"^10\.\d{4,}"), F.lower(doi))
    return F.when(_may_hold_doi(c), once(trim(c), lambda raw: once(bare(raw), lowered)))


def clean_doi_trailing(c: Column) -> Column:
    """Drop sentence punctuation, an unbalanced closing parenthesis and what follows, and final groups in parentheses."""
    first = F.regexp_replace(c, _END_MARKS, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("cut"))

    def step(acc, ch):
        below = (ch == ")") & (acc["depth"] == 0) & (acc["cut"] < 0)
        depth = acc["depth"] + F.when(ch == "(", 1).when((ch == ")") & (acc["depth"] > 0), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), F.when(below, acc["at"]).otherwise(acc["cut"]).alias("cut"))

    cut = F.aggregate(F.split(first, ""), start, step, lambda acc: acc["cut"])
    balanced = F.when(F.contains(first, F.lit(")")), F.when(cut >= 0, F.substring(first, F.lit(1), cut)).otherwise(first)).otherwise(first)
    groups = F.regexp_replace(F.regexp_replace(balanced, _END_MARKS, ""), r"(?:[.,;:]*\([^()]*\))+\z", "")
    return F.regexp_replace(groups, _END_MARKS, "")


def is_valid_doi_suffix(c: Column) -> Column:
    """Two characters at least after the first slash."""
    slash = F.instr(c, "/")
    return (slash > 0) & (F.length(c) - slash >= 2)


def decode_encoded_dois(c: Column) -> Column:
    """Decode percent escapes inside DOIs whose slash is encoded, and nowhere else."""
    gaps, found = F.split(c, _ENCODED, -1), F.regexp_extract_all(c, F.lit(_ENCODED), F.lit(0))
    decoded = F.transform(found, lambda m: F.coalesce(percent_decode(m), m))
    woven = F.zip_with(gaps, decoded, lambda g, d: F.concat(g, F.coalesce(d, F.lit(""))))
    return F.when(F.contains(c, F.lit("%2")) & c.rlike(_ENCODED), F.array_join(woven, "")).otherwise(c)


def strip_word_breaks(c: Column) -> Column:
    some = functools.reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in WORD_BREAKS])  # few texts have any, and to look is cheaper
    return F.when(some, F.translate(c, WORD_BREAKS, "")).otherwise(c)


def found_dois(c: Column, pattern: str = DOI_PATTERN) -> Column:
    """Distinct DOIs of a text in order of appearance."""

    def found(text: Column) -> Column:
        clean = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), clean_doi_trailing)
        dois = F.transform(F.filter(clean, is_valid_doi_suffix), normalise_doi)
        return F.array_distinct(F.filter(dois, lambda d: d.isNotNull()))

    none = F.array().cast("array<string>")
    return once(strip_word_breaks(c), lambda x: F.when(F.contains(x, F.lit("10.")), once(decode_encoded_dois(x), found)).otherwise(none))


def _query_values(href: Column, name: str) -> Column:
    """Values of a query parameter, form-decoded."""
    query = F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*:[^?#]*\?([^#]*)", 1)
    values = F.regexp_extract_all(query, F.lit(rf"(?:^|&){name}=([^&]*)"), F.lit(1))
    return F.transform(values, lambda v: F.coalesce(F.try_url_decode(v), v))


def doi_from_query(href: Column) -> Column:
    """A DOI that a query parameter names: ``doi=``, or ``identifierValue=`` beside ``identifierName=doi``."""
    direct = F.filter(F.transform(_query_values(href, "(?i:doi)"), normalise_doi), lambda d: d.isNotNull())
    either = lambda what: F.coalesce(F.get(_query_values(href, f"identifier{what}"), F.lit(0)), F.get(_query_values(href, f"identifier_{what.lower()}"), F.lit(0)))
    named = F.when(F.lower(either("Name")) == "doi", normalise_doi(either("Value")))
    return F.coalesce(F.get(direct, F.lit(0)), named)


def doi_in_path(href: Column, one_segment: bool = False) -> Column:
    """A DOI anywhere in the decoded address; with ``one_segment`` its suffix ends at the next slash, uncleaned."""
    decoded = percent_decode(href)
    match = F.nullif(F.regexp_extract(decoded, _EMBEDDED_SEGMENT if one_segment else _EMBEDDED, 1), F.lit(""))
    if one_segment:
        return normalise_doi(match)
    clean = clean_doi_trailing(match)
    return F.when(is_valid_doi_suffix(clean), normalise_doi(clean))


def doi_from_href(href: Column) -> Column:
    """The DOI of a link: the address itself, else a query parameter, else one inside the address."""
    return F.coalesce(normalise_doi(href), doi_inside_href(href))


def doi_inside_href(href: Column) -> Column:
    """The DOI of a query parameter, else one inside the address."""
    return F.when(_may_hold_doi(href), F.coalesce(doi_from_query(href), doi_in_path(href)))


def contains_doi_candidate(text: Column, hrefs: Column) -> Column:
    """A cheap and over-inclusive look before a costly parse."""
    in_text = (F.length(text) >= 12) & text.rlike(r"10\.\d{4,}")
    return F.coalesce(in_text, F.lit(False)) | F.coalesce(F.exists(hrefs, lambda h: F.contains(h, F.lit("10."))), F.lit(False))


def normalise_pmcid(c: Column) -> Column:
    digits = F.regexp_extract(c, rf"(?i)^[{SPACE}]*pmc(\d{{3,9}})[{SPACE}]*\z", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def pmcid_from_text_or_href(text: Column, hrefs: Column) -> Column:
    """A PubMed Central id in the text, else in an article link."""
    in_text = F.regexp_extract(text, rf"(?i)\bPMC[:{SPACE}]{{0,2}}(\d{{3,9}})\b", 1)
    in_href = F.transform(hrefs, lambda h: F.regexp_extract(h, r"(?i)ncbi\.nlm\.nih\.gov/(?:pmc/)?articles/PMC(\d{3,9})", 1))
    first = F.get(F.filter(in_href, lambda d: d != ""), F.lit(0))
    return F.concat(F.lit("PMC"), F.coalesce(F.nullif(in_text, F.lit("")), first))


def is_real_doi(c: Column) -> Column:
    """Neither empty nor the feed's word for none."""
    return F.coalesce((trim(c) != "") & (F.lower(trim(c)) != "unavailable"), F.lit(False))
