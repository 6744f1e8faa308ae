"""License scans by diagonal voting, with Spark expressions only.

All rolling k-grams of a text's words are hashed and joined to the places of the same hashes in the templates. A match
of document word p with template word q, verified word by word, votes for the diagonal p - q. Votes are added up by
diagonal; neighbouring diagonals, between which words were put in or left out, are merged to spans; a span counts if
enough of the template's words stand in its verified grams. A phrase is a template of which every word must stand on one
diagonal.

Templates are a table of bounded size, so it is broadcast. Texts are never shuffled: only matches and one row for each
document are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.expressions import let
from labelmill.llm.license_texts import PHRASES, TEMPLATES

PHRASE_GRAM, TEMPLATE_GRAM = 2, 3
#: Diagonals at most this many words apart are merged.
NEIGHBOURS = 6
#: Share of a template's words that must stand in a span's verified grams.
LEAST_SHARE = 0.6
#: Templates are broadcast: they may have this many characters together.
TEMPLATE_CHARS = 8 << 20


def words_of(text: Column) -> Column:
    """Words of digits, lower-case letters and non-ASCII characters, A-Z in lower case. The Kelvin sign, whose lower case is an ASCII letter, is kept apart."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("￼")))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _places(docs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """docs with a row for each word place and the words from there on; a text without words has one row with a null place."""
    cut = docs.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("n_words", F.size("words").cast("long"))
    grams = F.arrays_zip(F.col("words").alias("w0"), *(F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(1, most)))
    return cut.select(*keys, "n_words", F.posexplode_outer(grams).alias("pos", "gram"))


def _gram_hash(k: int) -> Column:
    return F.when(F.col(f"gram.w{k - 1}").isNotNull(), F.xxhash64(*(F.col(f"gram.w{j}") for j in range(k))))


def _listed(templates: dict[str, str] | DataFrame) -> list[tuple[str, str]]:
    """(text, label) of templates, or an error if they are too many to be sent."""
    if isinstance(templates, dict):
        return list(templates.items())
    size = templates.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    if size > TEMPLATE_CHARS:
        raise ValueError(f"templates have {size} characters, more than {TEMPLATE_CHARS}")
    return [(r.text, r.label) for r in templates.select("text", "label").distinct().orderBy("label", "text").collect()]


def _template_tables(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of each template: its words, gram and label; for phrases and for others the places of each gram hash)."""
    named = [(i, t, label, i < len(phrases)) for i, (t, label) in enumerate([*phrases, *templates])]
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(label).alias("label"), F.lit(base).alias("base")) for i, t, label, base in named)) if named else F.expr("cast(array() as array<struct<template: int, text: string, label: string, base: boolean>>)")
    table = spark.range(1).select(F.inline(rows))
    gram = F.when(F.col("base"), PHRASE_GRAM).otherwise(TEMPLATE_GRAM)
    words = words_of(F.col("text"))
    facts = table.select("template", "label", "base", words.alias("of"), gram.alias("k"))
    facts = facts.withColumn("of", F.when(F.size("of") >= F.col("k"), F.col("of")).otherwise(F.raise_error(F.lit("a phrase or template is shorter than its grams"))))
    places = _places(table.select("template", "base", "text"), ["template", "base"], TEMPLATE_GRAM)

    def grams(k: int, base: bool, name: str) -> DataFrame:
        each = places.where(F.col("base") == base).withColumn("h", _gram_hash(k)).where("h is not null")
        return each.groupBy(F.col("h").alias(f"h_{name}")).agg(F.collect_list(F.struct("template", F.col("pos").alias("place"))).alias(f"in_{name}"))

    return facts, grams(PHRASE_GRAM, True, "phrases"), grams(TEMPLATE_GRAM, False, "templates")


def _spans(each: Column, base: Column, of: Column, k: Column) -> Column:
    """Spans (first, end, share) of the sorted diagonals of one template: of a phrase each is one, of others neighbours are merged."""

    def cut(diagonals: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(diagonals) - 1), lambda i: (i == 0) | base | (F.get(diagonals, i)["diagonal"] - F.get(diagonals, i - 1)["diagonal"] > NEIGHBOURS))
        return let(starts, lambda s: F.transform(s, lambda i, n: F.slice(diagonals, i + 1, F.coalesce(F.get(s, n + 1), F.size(diagonals)) - i)))

    def span(group: Column) -> Column:
        words = F.array_distinct(F.flatten(F.flatten(F.transform(group, lambda d: F.transform(d["places"], lambda p: F.sequence(p, p + k - 1))))))
        first = F.array_min(F.transform(group, lambda d: d["diagonal"] + F.array_min(d["places"])))
        end = F.array_max(F.transform(group, lambda d: d["diagonal"] + F.array_max(d["places"]) + k))
        return F.struct(first.cast("long").alias("first"), end.cast("long").alias("end"), (F.size(words) / F.size(of)).alias("share"))

    return let(each, lambda diagonals: F.transform(cut(diagonals), span))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | DataFrame | None = None, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words and spans, an array of (label, base, first, end, share): whether it is a phrase's place, its words [first, end) and the share of the template's words that was found.

    phrases and templates are labels by text, or tables (text, label); a phrase has two words at least, a template three.
    A null or empty text has no words and no spans. Repeated rows give repeated results. Other columns of docs aren't
    read.
    """
    spark = docs.sparkSession
    facts, in_phrases, in_templates = _template_tables(spark, _listed(PHRASES if phrases is None else phrases), _listed(TEMPLATES if templates is None else templates))
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.length(docs[text_col]).alias("tl"), docs[text_col].alias("text"))
    key = ["id", "th", "tl"]
    places = _places(source, key, TEMPLATE_GRAM).withColumn("h_phrases", _gram_hash(PHRASE_GRAM)).withColumn("h_templates", _gram_hash(TEMPLATE_GRAM))
    matched = places.join(F.broadcast(in_phrases), "h_phrases", "left").join(F.broadcast(in_templates), "h_templates", "left")
    # the first place of each document goes on in any case, and counts its rows
    matched = matched.where(F.coalesce("pos", F.lit(0)).eqNullSafe(0) | F.col("in_phrases").isNotNull() | F.col("in_templates").isNotNull())
    none = F.expr("cast(array() as array<struct<template: int, place: int>>)")
    found = F.concat(F.coalesce("in_phrases", none), F.coalesce("in_templates", none), F.when(F.coalesce("pos", F.lit(0)) == 0, F.expr("array(named_struct('template', cast(null as int), 'place', 0))")).otherwise(none))
    votes = matched.select(*key, "n_words", "pos", "gram", F.inline(found)).join(F.broadcast(facts), "template", "left")
    # equal hashes are compared word by word
    same = [(F.col(f"gram.w{j}") == F.get("of", F.col("place") + j)) | (F.col("k") <= j) for j in range(TEMPLATE_GRAM)]
    votes = votes.where(F.col("template").isNull() | (same[0] & same[1] & same[2]))
    votes = votes.select(*key, "n_words", "template", "place", (F.coalesce("pos", F.lit(0)) - F.col("place")).cast("int").alias("diagonal")).repartition(*key)
    diagonals = votes.groupBy(*key, "n_words", "template", "diagonal").agg(F.sort_array(F.collect_set("place")).alias("places"), F.count(F.lit(1)).alias("rows"))
    by_template = diagonals.groupBy(*key, "n_words", "template").agg(F.sort_array(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("diagonal", "places")))).alias("each"), F.sum(F.when(F.col("template").isNull(), F.col("rows"))).alias("rows"))
    by_template = by_template.join(F.broadcast(facts), "template", "left")
    spans = F.filter(_spans(F.col("each"), F.col("base"), F.col("of"), F.col("k")), lambda s: F.when(F.col("base"), s["share"] == 1.0).otherwise(s["share"] >= LEAST_SHARE))
    spans = F.transform(spans, lambda s: F.struct(F.col("label").alias("label"), F.col("base").alias("base"), s["first"].alias("first"), s["end"].alias("end"), s["share"].alias("share")))
    empty = F.expr("cast(array() as array<struct<label: string, base: boolean, first: bigint, end: bigint, share: double>>)")
    by_template = by_template.withColumn("spans", F.when(F.col("template").isNotNull(), spans).otherwise(empty))
    by_doc = by_template.groupBy(*key, "n_words").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("rows").alias("rows"))
    return by_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(F.col("id").alias(id_col), "n_words", "spans")
