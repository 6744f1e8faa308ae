"""Information-theoretic sanitisation of personal data, with Spark expressions only.

Addresses of mail and network, card and phone numbers are protected entities: patterns find them, and checks (parts of
an address, Luhn, digits of a phone number) confirm them. Words of a document with an entity may give it away as well.
Protected are entities themselves and the classes that they name: the domain of a mail address, the net of an address, the
issuer of a card, the exchange of a phone number. Over the whole corpus texts are counted, copies once: n(t, e) in which a term
stands together with an entity, n(t) in which it stands at all, n(e) and n(k) with the entity and with any of its kind. A term
discloses an entity if it makes it likely, n(t, e) / n(t) >= disclosure, tells more than that there is something of the kind,
log2 of that share over n(e) / n(k) >= gain bits, and does so in at least support texts. It is generalised wherever it
stands, or only in the documents with that entity.

Of the texts only the words of documents with repeated entities are shuffled, and which texts hold disclosing terms. Terms
are joined to the corpus's words, by broadcast only if they are few enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.expressions import let, replaced, running, running_sum
from labelmill.llm.shared import fits_broadcast, scratch, staged

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: The patterns as asked for, in forms that don't go back over a run of characters again and again: a match begins at the
#: start of a run, or where the last one ended, and repeated groups give nothing back. What can't be said so without deep recursion (card numbers) is cut up after.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD_RUN = r"[0-9][0-9\x20-]{14,}[0-9]"
CARD_GAP = r"[\x20-]{2,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SUPPORT = 3
DISCLOSURE = 0.8
GAIN = 1.0
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"

_SPAN = "array<struct<kind: string, start: int, end: int, value: string>>"


def _empty(kind: str = _SPAN) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _found(text: Column, pattern: str | Column, kind: str, offset: Column | int = 0) -> Column:
    """All matches of a pattern with their places, from what stands between matches and the matches in turn."""
    matches, between = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return _placed(between, matches, kind, offset)


def _placed(between: Column, values: Column, kind: str, offset: Column | int = 0) -> Column:
    """values with their places; between are the texts before each of them."""

    def spans(values: Column, ends: Column) -> Column:
        return F.zip_with(values, ends, lambda v, e: F.struct(F.lit(kind).alias("kind"), (e + offset - F.length(v)).cast("int").alias("start"), (e + offset).cast("int").alias("end"), v.alias("value")))

    def placed(values: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda a, b: F.length(a) + F.length(b))
        return let(running_sum(steps), lambda ends: spans(values, ends))

    return let(values, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_byte(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("long"), F.lit(256)) <= 255


def base_spans(text: Column) -> Column:
    """The entities of a text: (kind, start, end, value), by kind and then place, in code points."""
    email = F.when(text.contains("@"), _found(text, EMAIL, "email"))
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(_found(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), _is_byte)))
    # a run of digits, blanks and hyphens is cut where two of the latter stand together; what follows a cut keeps its place
    runs = _found(text, CARD_RUN, "card")
    cut = F.flatten(F.transform(runs, lambda r: _cut(r["value"], r["start"])))
    card = F.when(text.rlike(CARD_RUN), F.filter(cut, lambda s: F.length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"]))))
    phone = F.when(text.contains("+"), F.filter(_found(text, PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(8, 15)))
    return F.concat(*(F.coalesce(x, _empty()) for x in (email, ip, card, phone)))


def _cut(run: Column, offset: Column) -> Column:
    parts, gaps = F.split(run, CARD_GAP, -1), F.regexp_extract_all(run, F.lit(CARD_GAP), F.lit(0))
    # as _placed, with the gaps between the values
    before = F.concat(F.array(F.lit("")), gaps)
    return _placed(before, parts, "card", offset)


def _word_parts(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _lowered(words: Column) -> Column:
    return F.array_distinct(F.transform(words, F.lower))


def _merged(spans: Column) -> Column:
    """Spans by place, those that overlap as one with the kind of the first."""
    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def grouped(sorted_spans: Column, upto: Column) -> Column:
        # one begins where all before it have ended
        firsts = F.filter(F.sequence(F.lit(0), F.size(sorted_spans) - 1), lambda i: (i == 0) | (F.get(sorted_spans, i)["start"] >= F.get(upto, i - 1)))
        return let(
            firsts,
            lambda f: F.transform(
                f,
                lambda i, k: F.struct(
                    F.get(sorted_spans, i)["start"].alias("start"),
                    F.get(upto, F.coalesce(F.get(f, k + 1), F.size(sorted_spans)) - 1).alias("end"),
                    F.get(sorted_spans, i)["kind"].alias("kind"),
                ),
            ),
        )

    found = let(by_place, lambda x: let(running(F.transform(x, lambda s: -s["back"]), F.greatest), lambda upto: grouped(x, upto)))
    return F.when(F.size(spans) > 0, found).otherwise(_empty("array<struct<start: int, end: int, kind: string>>"))


def _term_spans(text: Column, words: Column, base: Column) -> Column:
    """Where words stand in a text as whole words outside its entities."""
    told = F.filter(_found(text, f"{WORD}+", "term"), lambda t: F.array_contains(words, t["value"]))
    return F.filter(told, lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def _protected(base: Column) -> Column:
    """The entities of a text and their classes, as kind, colon and value; a class has a star after its kind."""

    def whose(s: Column) -> Column:
        value, digits = F.lower(s["value"]), _digits(s["value"])
        return F.when(s["kind"] == "email", F.substring_index(value, "@", -1)).when(s["kind"] == "ip", F.substring_index(value, ".", 3)).when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.left(digits, F.length(digits) - 4))

    return F.array_distinct(F.concat(F.transform(base, lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))), F.transform(base, lambda s: F.concat(s["kind"], F.lit("*:"), whose(s)))))


def _kind(entity: str) -> Column:
    return F.rtrim(F.substring_index(entity, ":", 1), F.lit("*"))


def _analysed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base, the entities found in text_col."""
    return docs.withColumn("_base", base_spans(F.coalesce(F.col(text_col), F.lit(""))))


def revealing_terms(slim: DataFrame, corpus: DataFrame, text_col: str, support: int, disclosure: float, gain: float) -> DataFrame:
    """(entity, term) of the terms that disclose an entity. slim has the entities and terms of the texts with entities, each text once; corpus has all texts in text_col."""
    each = slim.select(F.explode("entities").alias("entity"))
    of_kind = slim.select(F.explode(F.array_distinct(F.transform("entities", lambda e: F.rtrim(F.substring_index(e, ":", 1), F.lit("*"))))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    often = each.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).where(F.col("of_entity") >= support)
    # a row for each kind
    often = often.withColumn("kind", _kind("entity")).join(F.broadcast(of_kind), "kind").select("entity", F.log2(F.col("of_entity") / F.col("of_kind")).alias("known"))
    # what has most of its kind can't be told more of by any term
    often = staged(often.where(-F.col("known") >= gain), "entities")
    holding = slim.select(F.explode("entities").alias("entity"), "terms").join(often, "entity")
    pairs = holding.select("entity", "known", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"), F.first("known").alias("known")).where(F.col("together") >= support)
    # texts that have the term and any entity are some of those that have it at all: what falls short of these already
    # can't reach the share among all, and needn't be looked for in the corpus
    beside = slim.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("beside"))
    pairs = staged(pairs.join(beside, "term").where(F.col("together") >= F.lit(disclosure) * F.col("beside")).select("entity", "term", "together", "known"), "pairs")
    terms = staged(pairs.select("term").distinct(), "terms")
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = corpus.select(F.xxhash64(text).alias("th"), F.length(text).alias("tl"), F.explode(_lowered(_word_parts(text))).alias("term"))
    seen = seen.join(F.broadcast(terms) if fits_broadcast(terms, "term") else terms, "term", "left_semi")
    # copies of a text are one witness
    counted = seen.groupBy("term", "th", "tl").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("one").alias("all"))
    share = F.col("together") / F.col("all")
    return pairs.join(counted, "term").where((share >= disclosure) & (F.log2(share) - F.col("known") >= gain)).select("entity", "term")


def _with_spans(docs: DataFrame, text_col: str, support: int, disclosure: float, gain: float, everywhere: bool, least_chars: int) -> DataFrame:
    """docs with spans: entities and disclosing terms as (kind, start, end), by kind as listed and then by place."""
    with scratch() as keep:
        analysed = _analysed(docs, text_col)
        # what the corpus is asked about: documents with entities
        entities = _protected(F.col("_base"))
        words = F.array_distinct(_word_parts(replaced(F.col(text_col), F.col("_merged"), lambda s: F.lit(" "))))
        slim = _analysed(docs.select(text_col), text_col).where(F.size("_base") > 0).withColumn("_merged", _merged(F.col("_base")))
        slim = slim.select(F.xxhash64(text_col).alias("th"), F.length(text_col).alias("tl"), entities.alias("entities"), F.filter(words, lambda w: F.length(w) >= least_chars).alias("words"))
        once = slim.groupBy("th", "tl").agg(F.first("entities").alias("entities"), F.first("words").alias("words"))
        slim = staged(once.withColumn("terms", _lowered(F.col("words"))), "terms")
        reveal = staged(revealing_terms(slim, docs, text_col, support, disclosure, gain), "reveal")
        if everywhere:
            names = staged(reveal.select("term").distinct(), "names")
            source = docs.select(F.xxhash64(text_col).alias("th"), F.length(text_col).alias("tl"), F.explode(F.array_distinct(_word_parts(F.col(text_col)))).alias("word"))
            told = source.withColumn("term", F.lower("word")).join(F.broadcast(names) if fits_broadcast(names, "term") else names, "term", "left_semi")
        else:
            source = slim.select("th", "tl", F.explode("entities").alias("entity"), "words").join(reveal.select("entity").distinct(), "entity", "left_semi").select("th", "tl", "entity", F.explode("words").alias("word"))
            told = source.withColumn("term", F.lower("word")).join(reveal, ["entity", "term"], "left_semi")
        told = keep(staged(told.groupBy(F.col("th").alias("_th"), F.col("tl").alias("_tl")).agg(F.sort_array(F.collect_set("word")).alias("_told")), "told"))
        keyed = analysed.withColumn("_h", F.xxhash64(text_col)).withColumn("_l", F.length(text_col))
        out = keyed.join(F.broadcast(told) if fits_broadcast(told, F.array_join("_told", ",")) else told, (F.col("_h") == F.col("_th")) & (F.col("_l") == F.col("_tl")), "left")
        base = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        terms = F.when(F.col("_told").isNotNull(), _term_spans(F.col(text_col), F.col("_told"), F.col("_base")))
        terms = F.transform(terms, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return out.withColumn("_spans", F.concat(base, F.coalesce(terms, _empty("array<struct<kind: string, start: int, end: int>>"))))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, gain: float = GAIN, everywhere: bool = True, least_chars: int = 1) -> DataFrame:
    """One row for each row of docs: id and spans, an array of (kind, start, end) in code points.

    Kinds are those of KINDS and term. Matches of one kind don't overlap; those of different kinds may. A null or empty
    text has none. Disclosing terms of at least least_chars characters are marked in all texts; without everywhere, only in those that
    hold an entity they disclose. Terms are words of ASCII letters and digits and all other characters; equal texts have
    equal spans and count once, however often they are repeated; repeated rows are given each. Other columns aren't read.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return _with_spans(source, "_text", support, disclosure, gain, everywhere, least_chars).select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"))


def sanitised(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, gain: float = GAIN, everywhere: bool = True, least_chars: int = 1) -> DataFrame:
    """docs with each span of text_col generalised to the name of its kind, as <EMAIL>; of overlapping spans the first gives the name. All other columns and rows stay, null texts too."""
    columns = docs.columns
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    text = f"c{columns.index(text_col)}"
    found = _with_spans(named, text, support, disclosure, gain, everywhere, least_chars).withColumn("_merged", _merged(F.col("_spans")))
    clean = replaced(F.col(text), F.col("_merged"), lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    return found.withColumn("_clean", clean).select(*(F.col("_clean" if c == text_col else f"c{k}").alias(c) for k, c in enumerate(columns)))
