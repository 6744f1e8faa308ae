"""Dense numerics in Arrow batches with numpy: what no expression of columns can say at a bearable cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

IGNORED = -100


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of arrays, one after the other, and the places between rows; a null row has none."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), bounds


def _matrices(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """For each row of a column of arrays of arrays, these as the rows of a matrix; None for a null or empty one. Numbers are taken as they stand in the batch, not made into Python's."""
    outer = column.offsets.to_numpy().astype(np.int64)
    values, inner = _flat(column.values)
    for lo, hi in zip(outer[:-1].tolist(), outer[1:].tolist(), strict=True):
        yield values[inner[lo] : inner[hi]].astype(np.float64).reshape(hi - lo, -1) if hi > lo else None


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, bounds = _flat(column)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield values[lo:hi]


def sequence_logprobs(df: DataFrame, key: str, logits: str = "logits", labels: str = "labels", chunk: int = 256) -> DataFrame:
    """(key, logp_sum, logp_mean, n_tokens): log-probability of each next label under the logits before it; labels of IGNORED don't count. Sequences are worked on chunk places at a time, with the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            for x, y in zip(_matrices(batch.column(1)), _rows(batch.column(2)), strict=True):
                total, n = 0.0, 0
                if x is not None and len(y):
                    table, wanted = x[:-1], y[1:].astype(np.int64)
                    for lo in range(0, len(table), chunk):
                        part, w = table[lo : lo + chunk], wanted[lo : lo + chunk]
                        at = np.flatnonzero(w != IGNORED)
                        total += float(_log_softmax(part[at])[np.arange(len(at)), w[at]].sum()) if len(at) else 0.0
                        n += len(at)
                sums.append(total)
                counts.append(n)
            sums, counts = np.array(sums, float), np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums), pa.array(sums / np.maximum(counts, 1)), pa.array(counts)], names=[key, "logp_sum", "logp_mean", "n_tokens"])

    return df.select(key, logits, labels).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, logp_sum double, logp_mean double, n_tokens long")


def token_kl(df: DataFrame, key: str, policy: str = "policy", reference: str = "reference", mask: str = "mask") -> DataFrame:
    """(key, kl_sum, kl_mean): exact KL of policy to reference logits over the places whose mask is 1; 0 without places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            for p, q, m in zip(_matrices(batch.column(1)), _matrices(batch.column(2)), _rows(batch.column(3)), strict=True):
                at = np.flatnonzero(m == 1)
                if len(at):
                    lp, lq = _log_softmax(p[at]), _log_softmax(q[at])
                    sums.append(float((np.exp(lp) * (lp - lq)).sum()))
                else:
                    sums.append(0.0)
                counts.append(len(at))
            sums, counts = np.array(sums, float), np.array(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums), pa.array(sums / np.maximum(counts, 1))], names=[key, "kl_sum", "kl_mean"])

    return df.select(key, policy, reference, mask).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, kl_sum double, kl_mean double")


def projected(df: DataFrame, vector: str, weight: np.ndarray, bias: np.ndarray | None = None, out: str = "projected") -> DataFrame:
    """df with out, weight @ vector + bias; null for a null vector. The matrix is a model's, of fixed size, and sent to the executors once."""
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(weight, np.float64), None if bias is None else np.asarray(bias, np.float64)))
    at = df.columns.index(vector)
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            known = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            x = batch.column(at).drop_null()
            y = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) @ w.T if len(x) else np.zeros((0, len(w)))
            y = (y if b is None else y + b).astype(np.float32)
            ends = np.concatenate([[0], np.cumsum(known) * len(w)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")


def tokenised_context(rows: DataFrame, key: str, prompt: str, response: str, encode: Callable[[list[dict], bool], list[int]], wrap: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """(key, ids, response_start): prompt and response as one conversation, and where the response begins.

    encode(messages, add_generation_prompt) is a tokenizer's chat template; wrap puts a model's own messages around. The
    response begins after the prompt by itself, or at the end where the template made that longer than both together.
    Null texts count as empty.
    """
    wrap = wrap or (lambda messages: messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = [], []
            for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                asked = {"role": "user", "content": p or ""}
                alone = encode(wrap([asked]), True)
                both = encode(wrap([asked, {"role": "assistant", "content": r or ""}]), False)
                ids.append(both)
                starts.append(min(len(alone), len(both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.int32())], names=[key, "ids", "response_start"])

    return rows.select(key, prompt, response).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>, response_start int")


def plain_encoder(tokens: Callable[[str], list[int]]) -> Callable[[list[dict], bool], list[int]]:
    """A chat template for tokenizers that have none: "Role: text" lines."""

    def encode(messages: list[dict], add_generation_prompt: bool) -> list[int]:
        lines = [f"{m['role'].title()}: {m['content']}" for m in messages] + ["Assistant:"] * add_generation_prompt
        return tokens("\n".join(lines))

    return encode
