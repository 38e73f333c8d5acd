"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words, their beginnings, and both once more where a word comes twice, hashed into buckets. The
machine has a weight and a short vector for each bucket and scores the sum of the weights and of the inner products of
all pairs, so two terms that mean little alone can mean much together.

It is trained on the driver from a sample of labelled rows with a fixed bound; the buckets it uses are those whose
document counts in the sample stand out most among texts of label 1. Scoring reads every text whole, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, text_of

_WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 20


def word_terms(word: str) -> list[int]:
    """The buckets of a word and of its beginnings of three to seven letters."""
    terms = [f"={word}", *(f"^{word[:n]}" for n in range(3, min(8, len(word) + 1)))]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def again(bucket: int) -> int:
    """The bucket that says that another one comes twice or more."""
    return (bucket * 2654435761 + 97) % BUCKETS


def text_terms(text: str, wanted: dict[int, int] | None = None, seen: dict | None = None) -> list[int]:
    """The distinct buckets of a text, in order; with ``wanted``, only these, as its numbers.

    ``seen`` remembers the wanted buckets of words between calls.
    """
    times: Counter = Counter()
    if wanted is None:
        for word, n in Counter(_WORD.findall(text.lower())).items():
            for b in word_terms(word):
                times[b] += n
        return sorted({*times, *(again(b) for b, n in times.items() if n > 1)})
    for word in _WORD.findall(text.lower()):
        hits = seen.get(word)
        if hits is None:
            if len(seen) > 300_000:
                seen.clear()
            hits = seen[word] = tuple(b for b in word_terms(word) if b in wanted or again(b) in wanted)
        if hits:
            times.update(hits)
    return sorted({wanted[x] for b, n in times.items() for x in ((b, again(b)) if n > 1 else (b,)) if x in wanted})


@dataclass
class Machine:
    """bias, weight of each term and its vector."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def score(self, terms: list[int]) -> float:
        z = self.bias
        if terms:
            v = self.vector[terms]
            s = v.sum(0)
            z += float(self.weight[terms].sum() + 0.5 * (s @ s - (v * v).sum()))
        return 1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z))))


def train(rows: list[list[int]], labels: np.ndarray, n_terms: int, k: int = 8, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, batch: int = 256) -> Machine:
    """A machine for ``rows`` of term numbers by Adam on the logistic loss; the same rows always give the same one."""
    rng = np.random.default_rng(0)
    share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 1e-4
    bias = np.array([np.log(share / (1 - share))])
    weight, vector = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, k))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, weight, vector)]
    step = 0
    for _ in range(epochs if 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            row = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
            term = np.fromiter((t for i in take for t in rows[i]), np.int64, len(row))
            v = vector[term]
            s = np.zeros((len(take), k))
            np.add.at(s, row, v)
            z = bias[0] + np.bincount(row, weight[term], len(take)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (v * v).sum(1), len(take)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) / len(take)
            d_weight, d_vector = decay * weight / 10, decay * vector
            np.add.at(d_weight, term, g[row])
            np.add.at(d_vector, term, g[row, None] * (s[row] - v))
            step += 1
            for p, d, (m1, m2) in zip((bias, weight, vector), (np.array([g.sum()]), d_weight, d_vector), state, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), weight, vector)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, n_terms: int = 2048
) -> tuple[dict[int, int], Machine]:
    """The buckets in use and the machine, from ``most_rows`` labelled rows at most, taken by the hash of their id.

    An id labelled twice counts with its larger label; null ids and labels are left out. Without both labels the machine
    gives every text the share of label 1.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    sample = sample.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([text_terms(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], names=["_id", "_label", "terms"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = scratch.keep(texts.mapInArrow(run, f"_id {id_type}, _label int, terms array<int>"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("n1")).first()
    n, n1 = total["n"], total["n1"]
    if not 0 < n1 < n:
        return {}, Machine(float(np.log((n1 + 1e-3) / (n - n1 + 1.0))), np.zeros(0), np.zeros((0, 1)))
    by = rows.select("_label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("_label").alias("a"), F.count("*").alias("m"))
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    expected = m * (n1 / n)
    chi2 = (a - expected) * (a - expected) / (expected * (1 - n1 / n) + 1.0)
    picked = [r["term"] for r in by.filter((F.col("m") >= 2) & (a > expected)).orderBy(chi2.desc(), "term").limit(n_terms).collect()]
    wanted = {b: i for i, b in enumerate(picked)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([[wanted[b] for b in x if b in wanted] for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], names=["_id", "_label", "terms"])

    found = rows.mapInArrow(pick, rows.schema).select(F.xxhash64("_id").alias("h"), "_label", "terms").toPandas().sort_values("h", kind="stable")
    scratch.drop(rows)
    return wanted, train([list(x) for x in found["terms"]], found["_label"].to_numpy(float), len(wanted))


def score(docs: DataFrame, model: tuple[dict[int, int], Machine], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1) of every text, empty ones too; null texts are empty."""
    wanted, machine = model
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            scores = [machine.score(text_terms(t, wanted, seen)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, schema)
