"""Personal data: base spans by pattern, and terms that disclose them.

Native: DataFrame expressions alone.

Base spans are leftmost and non-overlapping within each kind (email, ip, card,
phone). Terms are judged by information content, after C-sanitisation. A base
value is a protected entity ``e``, and so is the group that it belongs to: the
domain of an address, the network of an ip, the issuer of a card, the area of a
phone. A term ``t`` discloses ``PMI(e; t)`` bits of the entity's information
``IC(e) = -log2 p(e)``; what it leaves unknown is ``IC(e) - PMI(e; t) = -log2
p(e | t)``, which does not depend on the corpus's size. ``p(e | t)`` comes from
rows: those in which ``t`` stands in a context of ``e``, over all rows of the
corpus that hold ``t``, plus one not seen. A term that leaves ``GENERALISE``
bits or less is replaced by its shape, at ``REMOVE`` or less by a placeholder: a
word that is found once in the corpus, beside an address, is generalised; one
that is found twice, each time beside the address, goes.

A context is ``CONTEXT`` terms to either side, up to the next match of the same
kind and within ``REACH`` characters. What is decided of an entity and a term
holds for every place of the term in every row that holds the entity. Copies of
a row count like other rows. Terms inside base spans are left to those.

Null texts are empty and have no spans; in ``sanitise`` they stay null. A row is
treated by itself: repeated rows and null ids are kept; other columns pass
through ``sanitise`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms of the plain ones: they match the same
#: spans, in time linear in the text. A start inside a run only repeats the
#: attempt at its beginning, unless the match before ended there (``\G``).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What lies between terms.
_TERM_GAP = r"[^\p{L}\p{N}]++"
_TERM = r"[\p{L}\p{N}]++"
CONTEXT = 8
REACH = 200
GENERALISE = 1.0
REMOVE = 0.6
_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"
_TERMS = "array<struct<start:int,end:int,left:double>>"
_CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """Running sums of an array of ints, by chunks, so that growing arrays stay short."""
    grown = lambda items, of: F.aggregate(items, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + of(x))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda i: F.slice(lengths, i * _CHUNK + 1, F.lit(_CHUNK)))
    inner = F.transform(chunks, lambda c: grown(c, lambda x: x))
    shifted = lambda c, before: F.transform(F.slice(c, 2, F.lit(_CHUNK)), lambda x: x + before)
    sums = let(inner, lambda parts: F.flatten(F.zip_with(parts, F.slice(grown(parts, lambda c: F.element_at(c, -1)), F.lit(1), F.size(parts)), shifted)))
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """(text, before, after, end) of all matches: each one, what lies before and after it up to the next, and where it ends."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def zipped(both):
        n = F.size(both["found"])
        sides = F.zip_with(F.slice(both["gaps"], F.lit(1), n), F.slice(both["gaps"], F.lit(2), n), lambda g, h: F.struct(g.alias("before"), h.alias("after")))
        rows = F.zip_with(both["found"], sides, lambda m, g: F.struct(m.alias("text"), g["before"].alias("before"), g["after"].alias("after")))
        ends = let(F.transform(rows, lambda r: F.length(r["before"]) + F.length(r["text"])), running)
        return F.zip_with(rows, ends, lambda r, e: F.struct(r["text"].alias("text"), r["before"].alias("before"), r["after"].alias("after"), e.alias("end")))

    return let(F.struct(found.alias("found"), gaps.alias("gaps")), zipped)


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(reverse, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, text) of the base kinds, by start, then kind."""
    likely = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(text, F.lit("+")),
    }  # a cheap look before the full search
    return F.array_sort(F.concat(*[F.when(likely[kind], _spans(text, k)).otherwise(F.array().cast(_SPANS)) for k, kind in enumerate(KINDS)]))


def _valid_matches(text: Column, kind: str) -> Column:
    return F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["text"]))


def _spans(text: Column, k: int) -> Column:
    span = lambda m: F.struct((m["end"] - F.length(m["text"])).alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["text"].alias("text"))
    return F.transform(_valid_matches(text, KINDS[k]), span)


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term_hash, df): how many rows hold each term, over the whole corpus."""
    hashes = F.array_distinct(F.transform(F.split(F.lower(F.col(text_col)), _TERM_GAP), lambda t: F.xxhash64(t)))
    return docs.select(F.explode(hashes).alias("term_hash")).groupBy("term_hash").agg(F.count("*").alias("df"))


def _entities(kind: Column, value: Column) -> Column:
    """A value and the group that it belongs to."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    whole = F.when(kind < 2, F.lower(value)).otherwise(digits)
    group = F.when(kind == 0, F.substring_index(F.lower(value), "@", -1)).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    name = lambda level, x: F.concat_ws(":", F.lit(level), kind.cast("string"), x)
    return F.array(name("value", whole), name("group", group))


def contexts(found: DataFrame, width: int = CONTEXT, reach: int = REACH) -> DataFrame:
    """(row, entity, term_hash): each term in a context of each entity of a row once, from rows (row, text)."""
    # a word that the reach cuts through is no term
    left = lambda g: F.when(F.length(g) > reach, F.regexp_replace(F.substring(g, -reach, reach), rf"^{_TERM}", "")).otherwise(g)
    right = lambda g: F.when(F.length(g) > reach, F.regexp_replace(F.substring(g, 1, reach), rf"{_TERM}$", "")).otherwise(g)
    beside = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["text"].alias("value"), left(m["before"]).alias("left"), right(m["after"]).alias("right"))
    each = F.concat(*[F.transform(_valid_matches(F.col("text"), kind), beside(k)) for k, kind in enumerate(KINDS)])
    span = found.select("row", F.explode(each).alias("s")).select("row", "s.*")
    words = lambda side: F.filter(F.split(F.lower(F.col(side)), _TERM_GAP), lambda t: t != "")
    span = span.select("row", "kind", "value", words("left").alias("l"), words("right").alias("r"))
    near = F.concat(F.slice("l", F.greatest(F.size("l") - width + 1, F.lit(1)), F.lit(width)), F.slice("r", 1, width))
    pairs = span.select("row", F.explode(_entities(F.col("kind"), F.col("value"))).alias("entity"), near.alias("near"))
    return pairs.select("row", "entity", F.explode("near").alias("term")).select("row", "entity", F.xxhash64("term").alias("term_hash")).distinct()


def disclosing(near: DataFrame, frequency: DataFrame) -> DataFrame:
    """(entity, term_hash, left): pairs of which the term leaves ``GENERALISE`` bits or less."""
    joint = near.groupBy("entity", "term_hash").agg(F.count("*").alias("both"))
    bits = -F.log2(F.col("both") / (F.col("df") + 1))
    return joint.join(frequency, "term_hash").withColumn("left", bits).where(F.col("left") <= GENERALISE).select("entity", "term_hash", "left")


def term_spans(found: DataFrame, near: DataFrame, told: DataFrame) -> DataFrame:
    """(row, terms): of rows (row, text, base), where terms stand that disclose an entity of the row, apart from base spans."""
    place = lambda m: F.struct(F.xxhash64(F.lower(m["text"])).alias("term_hash"), (m["end"] - F.length(m["text"])).alias("start"), m["end"].alias("end"))
    tokens = found.select("row", F.explode(F.transform(matches(F.col("text"), _TERM), place)).alias("t")).select("row", "t.*")
    # a row's terms first, each once: it may hold a term at many places and many entities
    own = tokens.select("row", "term_hash").distinct().join(told, "term_hash").join(near.select("row", "entity").distinct(), ["row", "entity"])
    hits = tokens.join(own.groupBy("row", "term_hash").agg(F.min("left").alias("left")), ["row", "term_hash"]).select("row", "start", "end", "left")
    base = found.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.end", F.lit(None).cast("double").alias("left"))
    rows = hits.unionByName(base).withColumn("cover", F.when(F.col("left").isNull(), F.struct("start", "end")))
    # two running windows: a frame that ends with the partition would be summed anew for each row
    sofar = lambda *by: Window.partitionBy("row").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    until = F.max("cover.end").over(sofar("start", F.col("left").isNotNull()))
    next_ = F.min("cover.start").over(sofar(F.desc("start"), F.col("left").isNotNull()))
    rows = rows.withColumns({"until": until, "next": next_}).where(F.col("left").isNotNull())
    apart = rows.where((F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("end") <= F.col("next"))))
    return apart.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "left"))).alias("terms"))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, base, terms): each row as a struct, and its spans: (start, kind, end, text) and (start, end, left)."""
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows.select("doc", "row", base_spans(text).alias("base")))
    found = rows.where(F.size("base") > 0).select("row", text.alias("text"), "base")
    near = materialise(contexts(found))
    told = materialise(disclosing(near, document_frequency(rows.select(text.alias("text")))))
    # only rows with base spans are shuffled
    some = rows.where(F.size("base") > 0).join(term_spans(found, near, told), "row", "left")
    some = some.select("doc", "base", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))
    return some.unionByName(rows.where(F.size("base") == 0).select("doc", "base", F.array().cast(_TERMS).alias("terms")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas; kind 4 is a term."""
    name = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Base and term spans of ``find``'s rows by start, then kind."""
    shape = lambda s, kind, weight: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), weight.alias("left"))
    base = F.transform("base", lambda s: shape(s, s["kind"], F.lit(0.0)))
    term = F.transform("terms", lambda s: shape(s, F.lit(len(KINDS)), s["left"]))
    return F.array_sort(F.concat(base, term))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with spans replaced: bytes of gaps and replacements, joined once."""
    tag = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def new(s, raw):
        shape = F.when(raw.rlike(r"^\p{N}+$"), F.lit("<number>")).when(raw.rlike(r"^\p{Lu}"), F.lit("<Name>")).otherwise(F.lit("<word>"))
        return F.when(s["kind"] < len(KINDS), F.element_at(tag, F.least(s["kind"], F.lit(len(KINDS) - 1)) + 1)).when(s["left"] <= REMOVE, F.lit("<TERM>")).otherwise(shape)

    # overlapping spans of two kinds are one, named by the first
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int,left:double>>").alias("out"))
    item = lambda a, e, s: F.struct(a.alias("start"), e.alias("end"), s["kind"].alias("kind"), s["left"].alias("left"))

    def merge(acc, s):
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(item(last["start"], s["end"], last)))
        return (
            F.when(s["end"] <= acc["at"], acc)
            .when((s["start"] < acc["at"]) & (F.size(acc["out"]) > 0), F.struct(s["end"].alias("at"), longer.alias("out")))
            .otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(item(s["start"], s["end"], s))).alias("out")))
        )

    merged = F.aggregate(spans, start, merge, lambda acc: acc["out"])

    def rebuilt(m):
        before = F.concat(F.array(F.lit(0)), F.transform(m, lambda s: s["end"]))
        parts = F.zip_with(m, F.slice(before, F.lit(1), F.size(m)), lambda s, at: F.concat(F.substring(text, at + 1, s["start"] - at), new(s, F.substring(text, s["start"] + 1, s["end"] - s["start"]))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(before, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(merged, rebuilt)).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced in the text; all columns as they were."""
    found = find(docs, text_col)
    text = F.col("doc").getField(text_col)
    new = _replaced(text, all_spans())
    return found.select(*[(new if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the hash of base spans, all spans, and how many terms are generalised and removed."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    of = lambda k: lambda s: s["kind"] == k
    count = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    terms = [F.size(F.filter("terms", f)).cast("long").alias(n) for n, f in (("n_generalised", lambda s: s["left"] > REMOVE), ("n_removed", lambda s: s["left"] <= REMOVE))]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(all_spans()).alias("spans"), *terms)
