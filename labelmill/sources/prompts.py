"""Prompts as a Spark data source: spark.read.format("prompts").

Files of rows (Parquet or JSON lines) are read in parallel, by row group or by stretch of bytes, and come out as prompts of a
named source. Conditions on the columns that are passed on go into the scan: row groups whose statistics rule them out
aren't read, and rows are left out before they reach Spark. So does a cap on the rows of a part.

Conditions are an option of the scan. Filters that Spark pushes down by itself aren't taken up: it keeps the reader that they
were pushed to with the table, so that the next query on the same DataFrame would miss rows.

    prompts.registered(spark)
    spark.read.format("prompts").option("source", "ultrachat").option("path", uri).option("text", "text").option("keep", "conv_id,turn,role").load()
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from labelmill.operators.batches import first_rows
from labelmill.sources.loaders import REGISTRY
from labelmill.sources.stores import opened

#: Bytes of a JSON file that one task reads.
STRETCH = 64 << 20
OWN = ("source", "task_type", "file", "row", "prompt")
#: What conditions (column, how, value) can ask; known has no value.
CONDITIONS = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(v),
    "known": lambda c, v: c.is_valid(),
}


@dataclass
class _Part(InputPartition):
    """A row group, or a stretch of bytes, of the file that stands at a place in the list of files; row: where its numbering begins."""

    file: int
    uri: str
    at: int
    row: int


@dataclass
class _Asked:
    """What of the options a reader acts upon."""

    source: str
    task_type: str
    files: list[str]
    text: str
    keep: list[str]
    cap: int | None
    where: list[tuple] = field(default_factory=list)

    def expression(self) -> ds.Expression | None:
        found = None
        for name, how, *value in self.where:
            one = CONDITIONS[how](ds.field(name), value[0] if value else None)
            found = one if found is None else found & one
        return found


def _is_json(uri: str) -> bool:
    return uri.endswith((".jsonl", ".json"))


class PromptReader(DataSourceReader):
    def __init__(self, asked: _Asked, schema: T.StructType):
        self.asked, self.schema = asked, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        wanted, parts = self.asked.expression(), []
        for k, uri in enumerate(self.asked.files):
            store, path = opened(uri)
            if _is_json(uri):
                size = store.get_file_info(path).size
                parts += [_Part(k, uri, at, 0) for at in range(0, size, STRETCH)]
                continue
            whole = ds.ParquetFileFormat().make_fragment(path, store)
            rows = [whole.metadata.row_group(g).num_rows for g in range(whole.metadata.num_row_groups)]
            left = [g.id for part in whole.split_by_row_group(wanted) for g in part.row_groups] if wanted is not None else range(len(rows))
            parts += [_Part(k, uri, g, sum(rows[:g])) for g in left]
        # a scan without parts isn't allowed
        return parts or [_Part(-1, "", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.file < 0:
            return
        given, wanted = 0, self.asked.expression()
        for table, row in self._lines(partition) if _is_json(partition.uri) else self._group(partition):
            table = table.append_column("row", row)
            if wanted is not None:
                table = table.filter(wanted)
            text = pc.utf8_trim_whitespace(table[self.asked.text].cast(pa.string()))
            table, text = (x.filter(pc.fill_null(pc.greater(pc.utf8_length(text), 0), False)) for x in (table, text))
            if self.asked.cap is not None:
                table, text = table.slice(0, self.asked.cap - given), text.slice(0, self.asked.cap - given)
            given += len(text)
            own = {"source": self.asked.source, "task_type": self.asked.task_type, "file": partition.file}
            columns = [table["row"] if n == "row" else text if n == "prompt" else pa.array([own[n]] * len(text), self.schema.field(n).type) if n in own else table[n].cast(self.schema.field(n).type) for n in self.schema.names]
            yield from pa.table(columns, schema=self.schema).to_batches()
            if given == self.asked.cap:
                return

    def _group(self, part: _Part) -> Iterator[tuple[pa.Table, pa.Array]]:
        store, path = opened(part.uri)
        row, names = part.row, list(dict.fromkeys([self.asked.text, *self.asked.keep]))
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(8192, row_groups=[part.at], columns=names):
                yield pa.Table.from_batches([batch]), pa.array(range(row, row + batch.num_rows), pa.int64())
                row += batch.num_rows

    def _lines(self, part: _Part) -> Iterator[tuple[pa.Table, pa.Array]]:
        """Lines that begin in the stretch; row is a line's place in the file in bytes. Lines that aren't JSON objects are skipped."""
        store, path = opened(part.uri)
        names = list(dict.fromkeys([self.asked.text, *self.asked.keep]))
        kinds = {n: self.schema.field(n).type for n in self.asked.keep}
        held, rows = {n: [] for n in names}, []

        def table() -> tuple[pa.Table, pa.Array]:
            return pa.table({n: pa.array(v, kinds.get(n, pa.string())) for n, v in held.items()}), pa.array(rows, pa.int64())

        with store.open_input_file(path) as raw:
            at = max(0, part.at - 1)
            raw.seek(at)
            f = io.BufferedReader(raw, 1 << 20)
            if part.at:
                at += len(f.readline())
            while at < part.at + STRETCH and (line := f.readline()):
                try:
                    obj = json.loads(line)
                except ValueError:
                    obj = None
                if isinstance(obj, dict) and isinstance(obj.get(self.asked.text), str):
                    rows.append(at)
                    for n in names:
                        held[n].append(obj.get(n))
                at += len(line)
                if len(rows) == 8192:
                    yield table()
                    held, rows = {n: [] for n in names}, []
        if rows:
            yield table()


class Prompts(DataSource):
    """Options: source (a registered name, for its type of task), path (URIs, one on each line, in order), text (the prompt's column, "prompt"), keep (other columns that are passed on), types (of all these in order, as in a schema; else those of the first Parquet file, or strings), where (conditions that hold all, as JSON: [[column, how, value], ...]), cap (rows of each part at most)."""

    @classmethod
    def name(cls) -> str:
        return "prompts"

    def _asked(self) -> _Asked:
        name = self.options.get("source", "")
        if name not in REGISTRY:
            raise KeyError(f"no source is called {name!r}")
        keep = [c.strip() for c in self.options.get("keep", "").split(",") if c.strip()]
        if clash := set(keep) & set(OWN):
            raise ValueError(f"columns {sorted(clash)} are made by the source")
        cap, where = self.options.get("cap"), [tuple(w) for w in json.loads(self.options.get("where", "[]"))]
        if unknown := [w for w in where if w[0] not in keep or w[1] not in CONDITIONS]:
            raise ValueError(f"conditions must be on columns that are kept, and of {sorted(CONDITIONS)}: {unknown}")
        return _Asked(name, REGISTRY[name].task_type, [p for p in self.options.get("path", "").split("\n") if p], self.options.get("text", "prompt"), keep, int(cap) if cap else None, where)

    def schema(self) -> str:
        asked = self._asked()
        own = "source string, task_type string, file int, row long, prompt string"
        if "types" in self.options:
            return f"{own}, {self.options['types']}"
        kinds = {}
        if asked.keep and asked.files and not _is_json(asked.files[0]):
            store, path = opened(asked.files[0])
            with store.open_input_file(path) as f:
                found = pq.read_schema(f)
            kinds = {n: from_arrow_type(found.field(n).type, prefer_timestamp_ntz=True).simpleString() for n in asked.keep}
        return ", ".join([own, *(f"`{n}` {kinds.get(n, 'string')}" for n in asked.keep)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PromptReader(self._asked(), schema)


def registered(spark: SparkSession) -> SparkSession:
    """spark, which now knows the format."""
    spark.dataSource.register(Prompts)
    return spark


def read_prompts(spark: SparkSession, source: str, files: list[str], text: str = "prompt", keep: list[str] | None = None, types: str | None = None, where: list[tuple] | None = None, most: int | None = None) -> DataFrame:
    """Prompts of files in the order given, stripped, empty ones left out, those for which all conditions on kept columns hold; the first most of them. A part gives most rows at most, and of all parts the first are taken."""
    options = {"source": source, "path": "\n".join(files), "text": text, "keep": ",".join(keep or []), "where": json.dumps(where or [])}
    options |= ({"types": types} if types else {}) | ({"cap": str(most)} if most is not None else {})
    return first_rows(registered(spark).read.format("prompts").options(**options).load(), most, ["file", "row"])


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files of a table, in the order of their names."""
    return sorted(spark.read.parquet(path).inputFiles())


def listed(rows: DataFrame) -> DataFrame:
    """(source, task_type, ord, prompt), as other sources give them; ord orders by file and row."""
    return rows.select("source", "task_type", F.struct("file", "row").alias("ord"), "prompt")
