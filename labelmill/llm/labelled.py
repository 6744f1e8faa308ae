"""Bounded samples of labelled texts, and the logistic curve that turns features into scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.shared import crc_fold, staged

#: Of each class at most this many labelled documents are learnt from; the hash of their id chooses them.
SAMPLE_PER_CLASS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, part): distinct texts of at most per_class labelled documents of each class outside the held fold. part is 0 for two thirds, to count on, and 1 for the rest, to calibrate on.

    A null label or id is no label; of several labels of an id the greatest counts.
    """
    y = labels.where(F.col(label).isin(0, 1) & (crc_fold(id_col, folds) != held)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = [staged(y.where(F.col("y") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class), "labels") for k in (0, 1)]
    ids = chosen[0].union(chosen[1])
    # at most 2 * per_class rows
    found = docs.select(docs[id_col].alias("label_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(ids), "label_id").select("text", "y")
    parted = found.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    return staged(parted.select("text", "y", (F.pmod(F.col("h"), F.lit(3)) == 0).cast("int").alias("part")), "sample")


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        self.weights = np.zeros(z.shape[1])
        penalty = np.eye(z.shape[1]) * ridge
        penalty[0, 0] = 1e-3
        for _ in range(60):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ self.weights)
            self.weights += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        return 1.0 / (1.0 + np.exp(-np.clip(z @ self.weights, -30, 30)))
