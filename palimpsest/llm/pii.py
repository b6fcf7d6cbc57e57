"""Personal data by patterns, and terms that give it away by corpus co-occurrence.

Entities are the values that four patterns find: emails, ip addresses, payment cards and phones, and
with each the class that it belongs to: an email's domain, an ip's first three parts, the first six
digits of a card or phone. A term t that stands with an entity c is held against the corpus: anywhere
in the document if several documents hold that very value, else near it (on its line, among the next
words on either side). p(c|t) is the share of the documents with t in which it stands with c, shrunk towards p(c) as if ``shrink`` documents more had been seen, so that rare entities count,
with less certainty. The term discloses c if

- their pointwise mutual information, log p(c|t) / p(c), reaches the information content of c,
  -log p(c), divided by ``alpha``, and
- who knows t is left with at most ``residual_bits`` of uncertainty about c, -log p(c|t).

Such terms are marked wherever they stand, also in documents without that entity, to be replaced by a
general label or removed.

Everything here is DataFrame expressions. Spans, and the terms near them, are worked out in their own
row; what is shuffled are counts of terms near entities, combined beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._util import BROADCAST_IDS, among, fresh, settle

#: Kinds of the base spans, in their order; spans of disclosing terms come last.
KINDS = ("email", "ip", "card", "phone", "term")

#: A start inside a run that cannot match is skipped, and repetition is possessive where what follows
#: lies outside its class: the same matches as without, in time and stack that stay linear.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Any text with an entity has a match of this.
_HINT = r"@|\+[0-9]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?+[0-9]){13}"
_TERM = r"\p{L}[\p{L}\p{M}\p{N}_'’-]*+"
_CHUNK = 256

_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _placed(steps: Column, kind: int) -> Column:
    """Spans from (gap before, value) pairs: lengths are summed by chunks, and then within each."""
    advance = lambda x: x["g"] + F.length(x["v"])
    most = F.least(F.lit(_CHUNK), F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(steps))).cast("int")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / most).cast("int")), lambda c: F.slice(steps, c * most + 1, most))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + advance(x)))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    zipped = F.arrays_zip(chunks.alias("c"), F.slice(starts, 1, F.size(chunks)).alias("at"))

    def within(z: Column) -> Column:
        first = F.struct(z["at"].alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["g"]
            end = begin + F.length(x["v"])
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["v"].alias("v")))).alias("out"))

        return F.aggregate(z["c"], first, step, lambda a: a["out"])

    return F.flatten(F.transform(zipped, within))


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = reverse.substr(i + 1, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda x: _valid(kind, x["v"]))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def _matches(df: DataFrame, text: str, pattern: str, kind: int, out: str, guard: Column | None = None) -> DataFrame:
    """Adds ``out``: the spans of all matches of ``pattern`` in column ``text``, before any check."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", found if guard is None else F.when(guard, found).otherwise(none))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.when(F.size("_m") > 0, F.transform(F.arrays_zip(F.slice(gaps, 1, F.size("_m")).alias("g"), F.col("_m").alias("v")), lambda x: F.struct(x["g"].alias("g"), x["v"].alias("v"))))
    df = df.withColumn("_s", steps)
    return df.withColumn(out, F.when(F.col("_s").isNotNull(), _placed(F.col("_s"), kind)).otherwise(F.array().cast(_SPANS))).drop("_m", "_s")


def entity_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, h, text) with ``base``: the sorted spans s, k, e, v of all entities of each text."""
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for i, kind in enumerate(KINDS[:4]):
        rows = _matches(rows, "text", _PATTERNS[kind], i, f"_{kind}", guards.get(kind))
    checked = [_checked(kind) for kind in KINDS[:4]]
    return rows.select("doc_id", "h", "text", F.array_sort(F.concat(*checked)).alias("base"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def _class_of(kind: str, value: Column) -> Column:
    """The class of an entity, itself an entity of a coarser kind."""
    if kind == "email":
        return F.concat(F.lit("@"), F.substring_index(value, "@", -1))
    if kind == "ip":
        return F.concat(F.substring_index(value, ".", 3), F.lit("."))
    return F.concat(F.substring(F.regexp_replace(value, r"[^0-9]", ""), 1, 6), F.lit("*"))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower)


def _near(kind: str, reach: int) -> Column:
    """(entity, terms near it) of all entities of one kind in column ``text``, with their classes.

    The text is split by the kind's pattern once: what lies between two matches stands before one and
    after the other, so that the work is linear however many there are.
    """
    pattern = F.lit(_PATTERNS[kind])
    found, between = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", _PATTERNS[kind], -1)
    if kind != "email":  # of all kinds, emails alone hold letters
        between = F.transform(between, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, _PATTERNS["email"], "@")).otherwise(x))
    before = F.transform(between, lambda x: F.reverse(F.slice(F.reverse(_terms(F.substring_index(x, "\n", -1))), 1, reach)))
    after = F.transform(between, lambda x: F.slice(_terms(F.substring_index(x, "\n", 1)), 1, reach))
    n = F.size(found)
    zipped = F.arrays_zip(found.alias("v"), F.slice(before, 1, n).alias("a"), F.slice(after, 2, n).alias("b"))
    sound = F.filter(zipped, lambda z: _valid(kind, z["v"]))
    said = F.transform(sound, lambda z: F.struct(F.array(F.concat(F.lit(kind + ":"), z["v"]), F.concat(F.lit(kind + ":"), _class_of(kind, z["v"]))).alias("c"), F.array_distinct(F.concat(z["a"], z["b"])).alias("t")))
    guard = F.contains("text", F.lit("@" if kind == "email" else "+" if kind == "phone" else "."  if kind == "ip" else ""))
    return F.when(guard & (n > 0), said).otherwise(F.array().cast("array<struct<c:array<string>,t:array<string>>>"))


_MARK = "\x01"
#: What the class of an entity looks like, after its kind: a domain, three numbers and a point, or six digits and a star.
_CLASS = r"^email:@|^ip:.*\.$|\*$"


def disclosure(df: DataFrame, *, alpha: float = 1.25, shrink: float = 1.0, residual_bits: float = 1.0, reach: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(c, t, n_c, n_t, n_ct, n): each pair of an entity and a term that discloses it, with the counts of documents.

    n_ct are the documents in which t stands with c, n_c and n_t those that hold either, n all. Every
    row counts as a document. Without entities, or in an empty table, there are no pairs.
    """
    rows = _rows(df, id_col, text_col).withColumn("d", F.xxhash64("doc_id", "h"))
    hinted = rows.where(F.col("text").rlike(_HINT))
    near = hinted.select("d", F.concat(*[_near(kind, reach) for kind in KINDS[:4]]).alias("near")).where(F.size("near") > 0)
    near = settle(near)
    held = F.array_distinct(F.flatten("near.c"))
    entities = settle(near.select(F.explode(held).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_c")))
    pair = F.flatten(F.transform("near", lambda x: F.flatten(F.transform(x["c"], lambda c: F.transform(x["t"], lambda t: F.concat(c, F.lit(_MARK), t))))))
    pairs = near.select(F.explode(F.array_distinct(pair)).alias("ct")).groupBy("ct").agg(F.count(F.lit(1)).alias("n_ct"))
    pairs = pairs.select(F.substring_index("ct", _MARK, 1).alias("c"), F.substring_index("ct", _MARK, -1).alias("t"), "n_ct")
    pairs = settle(pairs.join(entities, "c"))
    # Values that several documents hold are held against all terms of these documents.
    shared = entities.where((F.col("n_c") >= 2) & ~F.col("c").rlike(_CLASS))
    carriers = near.select("d", F.explode(held).alias("c")).groupBy("d", "c").agg(F.count(F.lit(1)).alias("m")).join(shared, "c")
    carriers = settle(carriers)
    texts = among(hinted, carriers.select("d").distinct(), ["d"]).select("d", F.regexp_replace("text", _PATTERNS["email"], "@").alias("text"))
    tokens = settle(texts.select("d", F.explode(F.array_distinct(_terms(F.col("text")))).alias("t")).distinct())
    candidates = settle(pairs.select("t").unionByName(tokens.select("t")).distinct())
    said = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("t"))
    if candidates.count() <= BROADCAST_IDS:  # counted: all other words go before any are aggregated
        said = said.join(F.broadcast(candidates), "t", "left_semi")
    frequency = said.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    n = rows.count()
    p_c = F.col("n_c") / F.lit(max(n, 1))

    def telling(p: Column) -> Column:
        content, mutual = -F.log2(p_c), F.log2(p / p_c)
        return (content > 0) & (mutual * alpha >= content) & (-F.log2(p) <= residual_bits)

    def share(n_ct: Column) -> Column:
        return (n_ct + F.lit(shrink) * p_c) / (F.col("n_t") + F.lit(shrink))

    # No term can stand in more documents with an entity than hold the entity: the others go before they meet it.
    most = carriers.groupBy("d").agg(F.max("n_c").alias("most"))
    rare = tokens.join(frequency, "t").join(most, "d").where((F.col("most") + F.lit(shrink)) / (F.col("n_t") + F.lit(shrink)) >= 2.0**-residual_bits).drop("most")
    wide = rare.join(carriers, "d").where(telling(share(F.col("n_c")))).groupBy("c", "t", "n_c", "n_t").agg(F.sum("m").alias("n_ct"))
    found = pairs.join(shared.select("c"), "c", "left_anti").join(frequency, "t").select("c", "t", "n_c", "n_t", "n_ct").unionByName(wide)
    return found.where(telling(share(F.col("n_ct")))).select("c", "t", "n_c", "n_t", "n_ct", F.lit(n).cast("long").alias("n"))


def disclosing_terms(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, h, terms): for each text (h is its hash) the spans of terms that disclose an entity, its own or not.

    ``thresholds`` are those of ``disclosure``. Texts without such terms, null and empty ones among
    them, have no row; a null id is an id of its own; rows of equal id and text have one row. Work on
    a text is linear in its length. Columns other than the two named are never read.
    """
    rows = _rows(df, id_col, text_col).withColumn("d", F.xxhash64("doc_id", "h"))
    telling = settle(disclosure(df, id_col=id_col, text_col=text_col, **thresholds).select("t").distinct())
    said = rows.select("d", F.explode(F.array_distinct(_terms(F.col("text")))).alias("t"))
    having = settle(among(said, telling, ["t"]).select("d").distinct())
    some = among(rows, having, ["d"])
    tokens = _matches(entity_spans(some), "text", _TERM, 4, "words").select(
        "doc_id", "h",
        F.explode(F.filter("words", lambda w: ~F.exists("base", lambda b: (w["s"] < b["e"]) & (w["e"] > b["s"])))).alias("w"),
    )
    tokens = tokens.select("doc_id", "h", F.lower("w.v").alias("t"), F.struct("w.s", "w.k", "w.e").alias("span"))
    return among(tokens, telling, ["t"]).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("span")).alias("terms"))


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Personal data in every text: one row per input row, offsets in code points, ends exclusive.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (over the spans of those kinds), spans (all,
    with those of kind term), n_term. ``spans`` lists kind:start:end by start, then kind.
    ``thresholds`` are those of ``disclosure``.

    A null or empty text has no spans; a null id is passed on; repeated rows each give a row. No rows
    give no rows. Columns other than the two named are never read.
    """
    rows = entity_spans(_rows(df, id_col, text_col)).drop("text")
    terms = disclosing_terms(df, id_col=id_col, text_col=text_col, **thresholds).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "terms")
    joined = rows.join(terms, rows["doc_id"].eqNullSafe(terms["_d"]) & (rows["h"] == terms["_h"]), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    short = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    every = F.when(F.col("terms").isNull(), short).otherwise(F.array_sort(F.concat(short, F.col("terms"))))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    n_term = F.coalesce(F.when(F.col("terms").isNotNull(), F.size("terms")), F.lit(0)).cast("long")
    return joined.select("doc_id", *counts, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(every).alias("spans"), n_term.alias("n_term"))


def sanitize(df: DataFrame, *, mode: str = "generalise", id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``df`` with every entity and disclosing term of the text replaced by ``<KIND>``, or removed (mode "remove").

    All rows and columns are kept, whatever their names, repeated rows too; a null text stays null, an
    empty one empty, and a null id is an id of its own. Of overlapping spans the first is replaced.
    No rows give no rows.
    """
    rows = entity_spans(_rows(df, id_col, text_col)).dropDuplicates(["doc_id", "h"])
    terms = disclosing_terms(df, id_col=id_col, text_col=text_col, **thresholds).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "terms")
    short = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    joined = rows.join(terms, rows["doc_id"].eqNullSafe(terms["_d"]) & (rows["h"] == terms["_h"]), "left").withColumn("all", F.array_sort(F.concat(short, F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int>>")))))
    labels = F.array(*[F.lit(f"<{k.upper()}>" if mode == "generalise" else "") for k in KINDS])

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(F.col("text").substr(a["at"] + 1, x["s"] - a["at"]), F.element_at(labels, x["k"] + 1))
        return F.when(x["s"] < a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("all", first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.col("text").substr(a["at"] + 1, F.length("text"))))
    d, h, clean = fresh(df.columns, "_d", "_h", "_clean")
    found = joined.where(F.size("all") > 0).select(F.col("doc_id").alias(d), F.col("h").alias(h), done.alias(clean))
    out = df.join(found, df[id_col].cast("long").eqNullSafe(found[d]) & (F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == found[h]), "left")
    return out.select(*[F.coalesce(found[clean], df[c]).alias(c) if c == text_col else df[c] for c in df.columns])
