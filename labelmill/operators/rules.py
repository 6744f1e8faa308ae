"""Rules that records pass or fail: label rules, the validity mask, verdicts, gates and routes.

All are single projections: one CASE in the order of the rules, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import RETRIEVAL_TEMPLATE, blank, echo_overlap, first_filled, mask_bullets, strip, without_thinking, word_count

# Fixed values.
NO_INSTRUCTIONS = (
    r"(?i)(there (are|is) no (instructions?|constraints?|explicit)|"
    r"no instructions or constraints|"
    r"no explicit constraints|"
    r"the (user )?message does not contain|"
    r"does not (contain|include|have) (any )?(instructions?|constraints?)|"
    r"i (cannot|could not|couldn'?t) (find|identify|extract))"
)
MARKERS = ("<<<MESSAGE_START>>>", "<<<MESSAGE_END>>>")
SENTENCE_ENDS = (".", "?", "!", ")", "]", "*", "-", '"', "'", "`")
TEMPLATE_LEAKS = (
    r"(?iu)do not (carry out|demonstrate|comply with).{0,100}instruction",
    r"(?iu)enumerate the instructions and explicit constraints",
    r"(?iu)output only the bullet list",
    r"(?iu)begin (the reply|your reply) with",
    r"<<<MESSAGE_(START|END)>>>",
)
GENERIC_PHRASES = ("i was asked to answer", "i was asked to help", "answer a question helpfully", "i was asked to respond", "help with a task")
VERDICT_SEPARATORS = " —-–:"


@dataclass(frozen=True)
class LabelRules:
    min_label_chars: int = 10
    echo_share: float = 0.75
    min_prompt_chars: int = 25
    min_prompt_words: int = 5
    truncation_share: float = 0.95
    label_tokens: int = 512
    chars_per_token: int = 4


@dataclass(frozen=True)
class RecordGate:
    min_response_words: int = 20
    min_label_chars: int = 80


def failed_rule(label: Column, prompt: Column, retrieval: Column | None = None, rules: LabelRules | None = None) -> Column:
    """Name of the first rule that a record fails, or empty. A missing retrieval prompt is the built-in one."""
    rules = rules or LabelRules()
    label, prompt = strip(F.coalesce(label, F.lit(""))), strip(F.coalesce(prompt, F.lit("")))
    source = F.lit(RETRIEVAL_TEMPLATE) if retrieval is None else F.coalesce(F.nullif(strip(retrieval), F.lit("")), F.lit(RETRIEVAL_TEMPLATE))
    has_marker = label.contains(MARKERS[0]) | label.contains(MARKERS[1])
    near_budget = F.length(label) >= rules.truncation_share * rules.label_tokens * rules.chars_per_token
    return (
        F.when(F.length(label) < rules.min_label_chars, "empty_or_short")
        .when(label.rlike(NO_INSTRUCTIONS), "no_instructions_response")
        .when(echo_overlap(label, source) >= rules.echo_share, "prompt_b_echo")
        .when(has_marker, "marker_leak")
        .when(~label.contains("- ") & ~label.contains("* "), "no_bullets")
        .when(near_budget & ~F.right(label, F.lit(1)).isin(*SENTENCE_ENDS), "truncated")
        .when((F.length(prompt) < rules.min_prompt_chars) | (word_count(prompt) < rules.min_prompt_words), "prompt_too_short")
        .otherwise("")
    )


def template_leak(text: Column) -> Column:
    found = F.lit(False)
    for pattern in TEMPLATE_LEAKS:
        found = found | text.rlike(pattern)
    return found


def mask_reason(label: Column, max_bullets: int = 6) -> Column:
    """Why a record isn't in the validity mask, or "kept"."""
    label = F.coalesce(label, F.lit(""))
    # the bullets are found once and named
    seen = F.transform(F.array(mask_bullets(label)), lambda b: F.struct(F.size(b).alias("n"), F.size(F.filter(b, lambda x: word_count(x) <= 2)).alias("short")))

    def reason(s: Column) -> Column:
        return (
            F.when(template_leak(label), "template_leak")
            .when((s["n"] >= 5) & (s["short"] >= 0.7 * s["n"]), "word_fragmentation")
            .when(s["n"] > max_bullets, F.concat(F.lit("over_cap (n="), s["n"].cast("string"), F.lit(")")))
            .when(s["n"] == 0, "no_bullets")
            .otherwise("kept")
        )

    return F.get(F.transform(seen, reason), F.lit(0))


def verdict(raw: Column) -> Column:
    """struct(verdict, reason): YES, NO or null, read from the start of what follows the thinking, else from the first such word."""
    clean = strip(F.coalesce(raw, F.lit("")))
    answer = without_thinking(raw)
    lead = rf"^[{VERDICT_SEPARATORS.replace('-', chr(92) + '-')}]+"

    def tail(text: Column, n: int) -> Column:
        return strip(F.regexp_replace(F.substring(text, n + 1, 1 << 30), lead, ""))

    no_word = F.upper(answer).startswith("NO") & ((F.length(answer) < 3) | ~F.substring(answer, 3, 1).rlike(r"(?U)^\p{IsAlphabetic}"))
    word = r"(?iU)\b(YES|NO)\b"
    found = F.upper(F.regexp_extract(answer, word, 1))
    parts = F.split(answer, word, 2)
    after = strip(F.regexp_replace(F.get(parts, F.lit(1)), lead, ""))
    reason = F.coalesce(F.nullif(after, F.lit("")), F.nullif(strip(F.get(parts, F.lit(0))), F.lit("")), F.substring(answer, 1, 200))
    said = (
        F.when(clean == "", F.lit(None).cast("string"))
        .when(F.upper(answer).startswith("YES"), "YES")
        .when(no_word, "NO")
        .when(found != "", found)
    )
    why = (
        F.when(clean == "", "empty judge response")
        .when(answer.isNull(), "judge output truncated inside thinking block")
        .when(answer == "", "no content after thinking block")
        .when(F.upper(answer).startswith("YES"), tail(answer, 3))
        .when(no_word, tail(answer, 2))
        .when(found != "", reason)
        .otherwise(F.concat(F.lit("ambiguous judge response: "), F.substring(answer, 1, 200)))
    )
    return F.struct(F.when(answer != "", said).alias("verdict"), why.alias("reason"))


def judged_route(rule: Column, said: Column, judged: Column) -> Column:
    """kept, removed or errors: a rule or a NO removes, what was judged without a verdict is an error."""
    return F.when(F.coalesce(rule, F.lit("")) != "", "removed").when(judged & said.isNull(), "errors").when(judged & (said == "NO"), "removed").otherwise("kept")


def valid_record(response: Column, label: Column, gate: RecordGate | None = None) -> Column:
    """Whether a record is long enough in both fields and its label isn't one of the generic phrases."""
    gate = gate or RecordGate()
    response, label = F.coalesce(response, F.lit("")), F.coalesce(label, F.lit(""))
    generic = F.lit(False)
    for phrase in GENERIC_PHRASES:
        generic = generic | F.lower(label).contains(phrase)
    return (response != "") & (label != "") & (word_count(response) >= gate.min_response_words) & (F.length(label) >= gate.min_label_chars) & ~generic


def response_gate(response: Column, min_words: int = 20) -> Column:
    return word_count(F.coalesce(response, F.lit(""))) >= min_words


def missing_fields(record: dict[str, Column], legacy: list[Column]) -> Column:
    """Names of required fields that are null or empty; none if a legacy field is filled."""
    empty = F.filter(F.array(*(F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in record.items())), lambda x: x.isNotNull())
    filled = F.lit(False)
    for c in legacy:
        filled = filled | (F.coalesce(c, F.lit("")) != "")
    return F.when(filled, F.slice(empty, 1, 0)).otherwise(empty)


def accepted_paraphrase(paraphrase: Column, original: Column) -> Column:
    """Not blank and, but for white space at the ends, not the original."""
    return ~blank(paraphrase) & (strip(paraphrase) != strip(original))


def with_system(messages: Column, override: Column) -> Column:
    """Messages with a system message before them, if there is one to put and they have none."""
    has = F.exists(messages, lambda m: m["role"] == "system")
    added = F.array(F.struct(F.lit("system").alias("role"), override.alias("content")))
    return F.when(override.isNotNull() & (override != "") & ~has, F.concat(added, messages)).otherwise(messages)


def label_messages(prompt: Column, response: Column, request: Column, mode: str) -> Column:
    """Messages that ask for a label: of the prompt alone, or as a third turn."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if mode == "prompt_only":
        return F.array(message("user", request))
    if mode == "multi_turn":
        return F.array(message("user", prompt), message("assistant", response), message("user", request))
    raise ValueError(f"unknown mode of labelling: {mode!r}")


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def legacy_view(raw: DataFrame) -> DataFrame:
    """Records with current names, read from current or legacy ones."""

    def named(*names: str) -> Column:
        have = [F.col(n) for n in names if n in raw.columns]
        return first_filled(*have) if have else F.lit("")

    group = F.get_json_object("metadata", "$.paraphrase_group_id") if "metadata" in raw.columns else F.lit(None).cast("string")
    kept = [c for c in ("source_file", "ord", "value") if c in raw.columns]
    return raw.select(
        *kept,
        named("id").alias("id"),
        named("source_dataset").alias("source_dataset"),
        named("prompt", "prompt_a").alias("prompt"),
        named("response", "response_a").alias("response"),
        named("instruction_set", "response_b").alias("instruction_set"),
        named("retrieval_prompt", "prompt_b").alias("retrieval_prompt"),
        group.alias("paraphrase_group_id"),
    )
