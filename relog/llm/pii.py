"""Personal data: patterns, and terms that disclose a protected entity by their co-occurrence with it.
DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread_join, text_key, text_of

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive loops (nothing after them could take back what they match)
#: and without starts inside a run that an earlier start has failed on: linear, no deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must hold; the patterns run only on such texts.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Between the terms of a text: a term is a run of letters of any length.
APART = r"[^\p{L}]+"
#: A term discloses an entity if pointwise mutual information reaches this share of the entity's
#: information content, in at least SUPPORT different texts.
DISCLOSURE = 0.9
SUPPORT = 3
#: Matches whose places are summed up in one run.
STEP = 256
#: Characters of a piece of a text that is rewritten.
CUT = 4096
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def scanned(every: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Array of kind: what step(value so far, element) gives for each element, beside the next value.

    Elements are taken in runs of STEP, so that no long array is copied for each of them."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        value, out = step(acc["value"], x)
        return F.struct(value.alias("value"), F.concat(acc["out"], F.array(out)).alias("out"))

    def scan(xs: Column) -> Column:
        def run(acc: Column, i: Column) -> Column:
            begin = F.struct(F.element_at(acc, -1)["value"].alias("value"), empty.alias("out"))
            return F.concat(acc, F.array(F.aggregate(F.slice(xs, i * STEP + 1, F.lit(STEP)), begin, one)))

        first = F.array(F.struct(zero.alias("value"), empty.alias("out")))
        last = F.floor((F.size(xs) - 1) / STEP).cast("int")
        runs = F.when(F.size(xs) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(runs, first, run, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))

    return F.element_at(F.transform(F.array(every), scan), 1)  # an array of one: elements are made once


def located(text: Column, pattern: str | Column, kind: str) -> Column:
    """Array of SPAN for all matches: what split leaves between the matches gives their places."""
    pattern = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(pos: Column, p: Column) -> tuple[Column, Column]:
        start = pos + p["gap"]
        end = start + F.coalesce(F.length(p["m"]), F.lit(0))
        return end, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["m"].alias("value"))

    return F.filter(scanned(pairs, F.lit(0), step, SPAN), lambda s: s["value"].isNotNull())  # null: after the last match


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.element_at(twice, c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The checks that a match of the kind must pass."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def passing(kind: str) -> Callable[[Column], Column]:
    return lambda s: holds(kind, s["value"])


def with_base(docs: DataFrame) -> DataFrame:
    """Adds a column for each kind with the spans that its pattern finds and that pass its checks."""
    empty = F.array().cast(f"array<{SPAN}>")
    for kind in KINDS:
        may = F.col("t").contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        docs = docs.withColumn(kind, F.when(may & F.col("t").rlike("@" if kind == "email" else "[0-9]"), F.filter(located(F.col("t"), PATTERNS[kind], kind), passing(kind))).otherwise(empty))
    return docs


def forms(text: Column) -> Column:
    """The different terms of a text, as written."""
    return F.array_distinct(F.split(text, APART))


def entities_of(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.lower(s["value"])))


def marked(text: Column, base: Column, terms: Column) -> Column:
    """The spans of all occurrences of terms (lower-cased; null: none) in a text, outside its base spans."""
    own = F.filter(forms(text), lambda x: F.array_contains(terms, F.lower(x)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(own, "|"), F.lit(r")(?!\p{L})"))
    outside = F.filter(located(text, pattern, "term"), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return F.when(F.size(own) > 0, outside).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """k1, k2, k3, terms: for each text the terms (lower-cased) that disclose an entity of it.

    docs: all texts (t), for the corpus counts of terms. found: (k1, k2, k3, t, base) of documents with
    entities. A term goes with each entity of the same text, however far apart. All counts are numbers of
    whole documents; a pair's support counts different texts, so copies of one text alone never make a term
    disclosing. Before entities and terms meet, those go that can be in no disclosing pair: entities and terms
    of fewer than SUPPORT texts, and terms too frequent for the entity."""
    n = docs.count()
    keys = ["k1", "k2", "k3"]
    lower = F.filter(F.array_distinct(F.transform(forms(F.col("t")), F.lower)), lambda x: x != "").alias("terms")
    each = checkpoint(found.select(*keys, entities_of(F.col("base")).alias("entities"), lower).groupBy(*keys, "entities", "terms").agg(F.count("*").alias("copies")))
    held = each.select(*keys, "copies", F.explode("entities").alias("entity"))
    words = each.select(*keys, F.explode("terms").alias("term"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("n"))
    entities = checkpoint(entities.where((F.col("n") >= SUPPORT) & (F.col("with_entity") < n)))  # others have no content or no support
    # what a term's count may be: pmi >= DISCLOSURE * content, and a pair is no more frequent than its entity
    limit = F.pow("with_entity", F.lit(DISCLOSURE)) * float(max(n, 1)) ** (1 - DISCLOSURE) * (1 + 1e-6)
    most = entities.agg(F.max(limit)).first()[0] or 0.0
    terms = docs.select(F.explode(F.array_distinct(F.transform(forms(F.col("t")), F.lower))).alias("term")).where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("with_term")).where(F.col("with_term").between(SUPPORT, most))
    own = checkpoint(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).join(terms, "term"))
    named = spread_join(held, entities, ["entity"]).drop("n")
    rows = named.join(spread_join(words, own, ["term"]).drop("n"), keys).where(F.col("with_term") <= limit)
    pairs = rows.groupBy("entity", "term", "with_entity", "with_term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    content = F.log2(F.lit(float(n)) / F.col("with_entity"))
    pmi = F.log2(F.col("both") * F.lit(float(n)) / (F.col("with_entity") * F.col("with_term")))
    disclosing = checkpoint(pairs.where((content > 0) & (pmi >= DISCLOSURE * content)).select("entity", "term"))
    told = named.select(*keys, "entity").join(disclosing, "entity").select(*keys, "term").distinct()
    return told.join(words, [*keys, "term"], "left_semi").groupBy(*keys).agg(F.collect_set("term").alias("terms"))


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, text_of().alias("t"), *text_key())


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every text of docs (doc_id, text): doc_id, counts of the base kinds,
    base_sha256 and spans (all spans, with those of disclosing terms last).

    Null and empty texts have no spans. Null or repeated ids and repeated rows are kept as they are;
    equal texts get equal spans. An empty table gives an empty result."""
    texts = keyed(docs, "doc_id")
    base = with_base(texts).withColumn("base", F.concat(*KINDS))
    base = checkpoint(base.select("doc_id", "k1", "k2", "k3", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", F.when(F.size("base") > 0, F.col("t")).alias("t")))
    terms = checkpoint(disclosing_terms(texts, base.where(F.size("base") > 0)))
    out = base.join(terms, ["k1", "k2", "k3"], "left")
    every = F.concat("base", F.when(F.col("terms").isNotNull(), marked(F.col("t"), F.col("base"), F.col("terms"))).otherwise(F.array().cast(f"array<{SPAN}>")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one.

    The text is cut into pieces of CUT characters once, so that what stands between two spans is found
    without counting characters from the text's begin: time is linear in the text and in its spans."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    stop = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("kind"))  # after all spans

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(pos, s["end"]), F.struct(pos.alias("pos"), s["start"].alias("start"), s["kind"].alias("kind"))

    def between(pieces: Column, x: Column) -> Column:
        first = F.floor(x["pos"] / CUT).cast("int")
        n = F.floor(x["start"] / CUT).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(pieces, first + 1, n), ""), x["pos"] - first * CUT + 1, x["start"] - x["pos"])

    def out(pieces: Column, gaps: Column) -> Column:
        apart = F.filter(gaps, lambda x: x["start"] >= x["pos"])
        return F.array_join(F.transform(apart, lambda x: F.concat(between(pieces, x), F.when(x["kind"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))), "")

    gaps = scanned(F.concat(ordered, F.array(stop)), F.lit(0), step, "struct<pos:int,start:int,kind:string>")
    made = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("pieces"), gaps.alias("gaps")))
    return F.element_at(F.transform(made, lambda m: out(m["pieces"], m["gaps"])), 1)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with personal data and disclosing terms generalised to
    their kind. Only documents with a base span move to meet their terms; all others pass as they are."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = with_base(keyed(docs, *cols)).withColumn("base", F.concat(*KINDS)).drop(*KINDS)
    found = checkpoint(texts.where(F.size("base") > 0))
    terms = checkpoint(disclosing_terms(keyed(docs), found))
    every = F.concat("base", F.when(F.col("terms").isNotNull(), marked(F.col("t"), F.col("base"), F.col("terms"))).otherwise(F.array().cast(f"array<{SPAN}>")))
    text = rewritten(F.col("t"), every)
    changed = found.join(terms, ["k1", "k2", "k3"], "left").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return texts.where(F.size("base") == 0).select(*cols).unionByName(changed.select(*cols))
