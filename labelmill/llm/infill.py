"""Fill-in-middle transformation of whole texts.

A text is a row of units (a word with the white space before it, or white space at the end). Two unit boundaries, drawn
from the hash of the row's id, cut it into prefix, middle and suffix, which are written in the order in which a model
learns to fill the middle in.

A text is walked twice by a lazy matcher: the first walk counts its units, so the boundaries can be drawn, the second
stops at both boundaries. No list of units is ever made, so work memory is that of the text. No row depends on another:
there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.shared import bounded_batches, tidy

#: Possessive, so that no unit is tried in more than one way.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")


@dataclass(frozen=True)
class Infilling:
    """Marks, the salt of the hash, and of 100 texts how many are cut up and how many of these begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    salt: str = "42:"
    percent: int = 50
    suffix_first_percent: int = 80


def draws(salt: str, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256((salt + key).encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def count_units(text: str) -> int:
    """The first walk."""
    return sum(1 for _ in UNIT.finditer(text))


def ends_of(text: str, low: int, high: int) -> tuple[int, int]:
    """The second walk: where the first low units end, and the first high ones."""
    units = UNIT.finditer(text)
    at = 0
    for unit in islice(units, low):
        at = unit.end()
    first = at
    for unit in islice(units, high - low):
        at = unit.end()
    return first, at


def infilled(text: str, key: str, how: Infilling = Infilling()) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form, characters of the prefix, of the middle) of one text; the last two are None if it stays plain."""
    h1, h2, h3, h4 = draws(how.salt, key)
    n = count_units(text)
    if not text or h3 % 100 >= how.percent or any(m in text for m in (how.prefix, how.suffix, how.middle)):
        return text, n, "plain", None, None
    a, b = ends_of(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.suffix_first_percent:
        return f"{how.suffix}{suffix}{how.prefix}{prefix}{how.middle}{middle}", n, "spm", a, b - a
    return f"{how.prefix}{prefix}{how.suffix}{suffix}{how.middle}{middle}", n, "psm", a, b - a


def restored(output: str, form: str, how: Infilling = Infilling()) -> str:
    """The text that an output was made of. Marks stand once each, since texts that hold one stay plain, and no mark begins inside another or its neighbours."""
    if form == "plain":
        return output
    one, two = (how.suffix, how.prefix) if form == "spm" else (how.prefix, how.suffix)
    first, _, rest = output.removeprefix(one).partition(two)
    second, _, middle = rest.partition(how.middle)
    return second + middle + first if form == "spm" else first + middle + second


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Infilling | None = None, prove: bool = False) -> DataFrame:
    """One row for each row of docs: id, output, n (units), form ('plain', 'psm' or 'spm'), prefix_chars and middle_chars; with prove also restored, the text rebuilt from output and form.

    Null and empty texts have no units, stay plain and empty. Equal texts with different ids are cut at different
    places; rows that repeat id and text give equal rows. A null id is drawn for as an empty one. Other columns of docs
    aren't read, so their names can't clash. An empty table gives an empty result.
    """
    how = how or Infilling()
    bounded_batches(docs.sparkSession)
    text_type, long = T.StringType(), T.LongType()
    fields = [("output", text_type), ("n", long), ("form", text_type), ("prefix_chars", long), ("middle_chars", long)]
    fields += [("restored", text_type)] if prove else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    kinds = [pa.string() if t == text_type else pa.int64() for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(1), batch.column(2), strict=True):
                row = infilled(text.as_py() or "", key.as_py() or "", how)
                rows.append((*row, restored(row[0], row[2], how)) if prove else row)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select(docs[id_col], docs[id_col].cast("string").alias("key"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema)


def infill_digest(docs: DataFrame) -> DataFrame:
    """What the query returns: texts as digests."""
    return fill_in_middle(docs, prove=True).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
