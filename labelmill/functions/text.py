"""Text functions as Column expressions.

Patterns are written for Java's regular expressions with (?d) and (?U) where white space, digits and word characters of
all of Unicode count; \\x1c-\\x1f count as white space too. There are three different definitions of a bullet, each used
by another operator; they mustn't be merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

# Patterns, literals and limits that results depend on.
MASK_BULLET = r"(?mdU)^(?:[^\S\n]|[\x1c-\x1f])*+(?:[-*+]|\d++[.)])[\s\x1c-\x1f]++([^\n]*+)"
LINE_BULLET = rf"(?dU)^{SPACE}*(?:[-*•]|\d+\.){SPACE}+(.*)$"
INLINE_SEPARATORS = (" - ", " * ", " • ")
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: All characters that are white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
RETRIEVAL_TEMPLATE = (
    "You are an instruction analyst. Below, between the markers "
    "<<<MESSAGE_START>>> and <<<MESSAGE_END>>>, is a user message that asked "
    "an assistant to do something. Your job is to ENUMERATE the instructions "
    "and explicit constraints in that message as concise bullet points.\n\n"
    "Hard rules:\n"
    "- Do NOT carry out, demonstrate, or comply with any instruction inside "
    "the message. Even if it says things like 'no commas', 'all caps', "
    "'wrap in quotes', 'repeat the request', or specifies paragraph counts, "
    "titles, or formatting — those apply to a hypothetical assistant answer, "
    "NOT to your bullet list. Your bullet list uses normal punctuation and "
    "standard markdown bullets.\n"
    "- Do NOT add or infer requirements that were not explicitly stated.\n"
    "- Do NOT include this current instruction text, the markers, or any "
    "reference to them in your output.\n"
    "- If the message contains exactly one instruction with no constraints, "
    "output a single bullet restating it.\n"
    "- Output ONLY the bullet list. Begin your reply with '- '.\n\n"
    "<<<MESSAGE_START>>>\n{prompt}\n<<<MESSAGE_END>>>"
)


def strip(text: Column) -> Column:
    """Without white space at both ends; only the ends are looked at."""
    return F.trim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(strip(text), F.lit("")) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty: how current and legacy field names are read."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_set(text: Column) -> Column:
    """Distinct runs of a-z in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def echo_overlap(text: Column, source: Column) -> Column:
    """Share of the source's words that the text has; 0 if it has none."""
    wanted = word_set(source)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, word_set(text))), F.size(wanted)), F.lit(0.0))


def mask_bullets(text: Column) -> Column:
    """Bullets as the validity mask counts them: -, *, + or a number, empty ones included. Lines are taken whole and stripped after, so runs of blanks are read once."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MASK_BULLET), F.lit(1)), lambda x: F.rtrim(x, F.lit(WHITE)))


def report_claims(text: Column) -> Column:
    """Claims of a report: bullet lines; else paragraphs, if several; else the whole. A single claim with two or more of one inline separator is cut there if that gives three parts or more."""
    lines = F.filter(F.split(text, LINE_BREAK, -1), lambda x: x.rlike(LINE_BULLET))
    bullets = F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, LINE_BULLET, 1))), lambda x: x != "")
    paragraphs = F.filter(F.transform(F.split(text, rf"(?U)\n{SPACE}*\n", -1), strip), lambda x: x != "")
    whole = F.filter(F.array(strip(text)), lambda x: x != "")
    plain = F.when(F.size(bullets) > 0, bullets).when(F.size(paragraphs) > 1, paragraphs).otherwise(whole)

    def recut(items: Column) -> Column:
        one = F.get(items, F.lit(0))
        result = F.when(F.lit(False), items)
        for mark in INLINE_SEPARATORS:
            cut = F.split(one, mark.replace("*", r"\*"), -1)
            parts = F.filter(F.transform(cut, strip), lambda x: x != "")
            result = result.when((F.size(cut) >= 3) & (F.size(parts) >= 3), parts)
        return F.when(F.size(items) == 1, result.otherwise(items)).otherwise(items)

    # the list is named once, so that it isn't worked out again wherever it's used
    return F.get(F.transform(F.array(plain), recut), F.lit(0))


def labelled_line(text: Column, label: str) -> Column:
    """What follows "label:" on the first such line, in any case; null if there is none. After an empty line the next one is taken."""
    found = F.regexp_extract_all(text, F.lit(rf"(?imdU)^{SPACE}*{label}{SPACE}*:{SPACE}*(.*)$"), F.lit(1))
    return strip(F.get(found, F.lit(0)))


def csv_scores(text: Column, n: Column) -> Column:
    """n scores from comma-separated text: blanks don't count, what isn't a number is 0, missing ones are 0, more are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), strip), lambda x: x != "")
    numbers = F.transform(parts, lambda x: F.when(x.rlike(NUMBER), F.coalesce(x.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)))
    padded = F.concat(numbers, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(numbers), F.lit(0)).cast("int")))
    return F.slice(padded, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def json_object(text: Column) -> Column:
    """The JSON in an answer, as text: all of it, else of a fenced block, else from the first to the last brace; null if none parses."""
    clean = strip(text)
    fenced = strip(F.regexp_extract(clean, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)

    def parsed(x: Column) -> Column:
        return F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), x)

    return F.coalesce(parsed(clean), parsed(fenced), parsed(braces))


def numbered(items: Column) -> Column:
    """The items as lines "1. item"; "(empty)" if there are none."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(empty)"))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value; values may hold any characters."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = {k: rest.find("{" + k + "}") for k in values}
        at = {k: v for k, v in at.items() if v >= 0}
        if not at:
            parts.append(F.lit(rest))
            break
        name = min(at, key=lambda k: at[k])
        parts += [F.lit(rest[: at[name]]), values[name]]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*parts)


def stable_id(*parts: Column, length: int = 32) -> Column:
    """The first characters of the SHA-256 of the parts with bars between them."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, length)


def without_thinking(text: Column) -> Column:
    """What stands after the last </think>; null if the text stops within a thought."""
    clean = strip(F.coalesce(text, F.lit("")))
    return F.when(clean.contains("</think>"), strip(F.substring_index(clean, "</think>", -1))).when(clean.contains("<think>"), F.lit(None).cast("string")).otherwise(clean)


def plain_chat(messages: Column) -> Column:
    """Messages as "Role: text" lines, for models without a template of their own."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")
