"""Quality rules: robust multivariate outliers among vectors of text statistics.

Every text gives a few counts. Their transformed rates are a vector, and for each language and source a
minimum-covariance-determinant estimate says where the bulk of the vectors lies: from several starts around the
coordinate-wise median, concentration steps keep, again and again, the half of the rows with the smallest Mahalanobis
distance. After two steps the start of the least determinant goes on until its determinant stays. A text whose distance
from the bulk passes a chi-square quantile is rejected.

The covariance is regularised by a least variance of every feature, so a feature that is constant in the bulk neither
makes it singular nor decides alone; steps from regularised distances never raise the regularised determinant.

The estimate covers all rows. A step is one grouped sum of counts and cross products, which adds up before it is
shuffled, so a group with a third of all rows costs no more than another; the half is found from counts of rows in fine
bins of distance, so it is the half up to a bin. Only a few numbers a group are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, release, text_of

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes(range(0x80, 0xC0)) + WHITE
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(0x80, 0x100))
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
#: The transformed vector.
FEATURES = ("length", "symbols", "dup_lines", "repeats", "upper", "marks", "variety")
#: The least standard deviation that a feature counts with, so that one that hardly varies in the bulk doesn't decide alone.
FLOOR = (0.06, 0.12, 0.12, 0.12, 0.12, 0.12, 0.06)


def chi2_below(x: float, p: int) -> float:
    """The share of a chi-square distribution with ``p`` degrees of freedom below ``x``."""
    a, y = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if y > 0 else 0.0


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, p) < share else (low, mid)
    return high


def consistency(share: float, p: int) -> float:
    """By how much the covariance of the inner ``share`` of a normal sample of ``p`` dimensions is too small."""
    return share / chi2_below(chi2_quantile(share, p), p + 2) if share < 1 else 1.0


#: The chi-square quantile at 0.9999 with one degree of freedom for each feature.
CUTOFF = chi2_quantile(0.9999, len(FEATURES))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that stand twice or more in the text, each word once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    step = 1
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        h = h[:-step] * np.uint64(m) + h[step:]
        step *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    at = np.flatnonzero(found).tolist()
    keys = [tuple(words[i : i + WINDOW]) for i in at]  # equal hashes are compared in full
    times = Counter(keys)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, key in zip(at, keys, strict=True):
        if times[key] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, _NOT_CHARS))
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        len(text.translate(None, _LETTERS + WHITE)),
        len(set(words)),
    )


def prefix_for(docs: DataFrame) -> str:
    """A prefix for working columns that no column of ``docs`` has."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def statistics(docs: DataFrame, prefix: str, keep: list[str], text_col: str = "text", rows: int = 512) -> DataFrame:
    """The columns ``keep`` and COUNTS (named with ``prefix``) of every text; null texts count as empty."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + c, T.LongType()) for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = np.array([counts(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, found.T)], names=[f.name for f in fields])

    return docs.select(*keep, text_of(text_col).cast("binary").alias(f"{prefix}text")).mapInArrow(run, T.StructType(fields))


def vector(prefix: str) -> list[Column]:
    """FEATURES as columns over COUNTS. A few imagined ordinary words keep short texts from standing out by chance."""
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}
    words = c["n_words"]
    rate = lambda x, of, weight: F.sqrt(x / (of + F.lit(float(weight))))
    return [
        F.log((c["word_chars"] + 110.0) / (words + 20.0)),
        rate(c["n_symbols"], words, 20),
        rate(c["n_dup_lines"], c["n_lines"], 4),
        rate(c["n_repeat_words"], words, 20),
        rate(c["n_upper"], c["word_chars"], 100),
        rate(c["n_marks"], words, 20),
        F.log(c["n_distinct"] + 20.0) / F.log(words + 21.0),
    ]


def base_failed(prefix: str) -> Column:
    return (F.col(f"{prefix}n_words") < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * F.col(f"{prefix}n_words"))


def cell(level: Column, lang_col: str, source_col: str) -> Column:
    """The name of a row's group: language and source at level 0, language at level 1, everything at level 2."""
    return F.when(level == 0, F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s")))).when(level == 1, F.to_json(F.struct(F.col(lang_col).cast("string").alias("only")))).otherwise("all")


class Mcd:
    """Estimates by cell: ``cells`` says which cell a language and source belong to, ``bulk`` where a cell's bulk lies."""

    def __init__(self, cells: DataFrame, bulk: DataFrame, lang_col: str, source_col: str):
        self.cells, self.bulk, self.lang_col, self.source_col = cells, bulk, lang_col, source_col

    def distance(self, stats: DataFrame, prefix: str, name: str) -> DataFrame:
        """``stats`` with the squared Mahalanobis distance of each row as column ``name``; 0 where a row's cell has no
        estimate, as when ``stats`` holds languages or sources that the fit has not seen."""
        full, level, cell_name = f"{prefix}full", f"{prefix}level", f"{prefix}cell"
        out = stats.withColumn(full, cell(F.lit(0), self.lang_col, self.source_col))
        out = out.join(self.cells.select(F.col("full").alias(full), F.col("cell").alias(cell_name)), full, "left")
        out = out.join(self.bulk.select(F.col("cell").alias(cell_name), F.col("mu").alias(f"{prefix}mu"), F.col("inv").alias(f"{prefix}inv")), cell_name, "left")
        d2 = squared(vector(prefix), F.col(f"{prefix}mu"), F.col(f"{prefix}inv"))
        return out.withColumn(name, F.coalesce(d2, F.lit(0.0))).drop(full, level, cell_name, f"{prefix}mu", f"{prefix}inv")


def squared(x: list[Column], mu: Column, inv: Column) -> Column:
    """The squared distance of ``x`` from ``mu``; ``inv``: the inverse covariance, row by row."""
    p = len(x)
    d = [v - mu[i] for i, v in enumerate(x)]
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + inv[i * p + j] * d[j] * (1.0 if i == j else 2.0)
        total = total + row * d[i]
    return total


def _estimate(sums: Iterator) -> Iterator:
    """Mean, inverse covariance and log-determinant of each cell and start, from the count, sums and cross products of
    ``n`` of its ``all`` rows."""
    import pandas as pd

    p = len(FEATURES)
    low = np.tril_indices(p)
    factors: dict[float, float] = {}
    for pdf in sums:
        out = []
        for cell_, start, n, all_, s, c in zip(*(pdf[k] for k in ("cell", "start", "n", "all", "s", "c")), strict=True):
            mu = np.array(s) / n
            cov = np.zeros((p, p))
            cov[low] = np.array(c) / n
            cov = cov + cov.T - np.diag(cov.diagonal()) - np.outer(mu, mu)
            share = round(n / all_, 3)
            factor = factors.setdefault(share, consistency(share, p))
            cov = factor * cov + np.diag(np.square(FLOOR))
            out.append((cell_, start, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["cell", "start", "mu", "inv", "det"])


_MODEL = "cell string, start int, mu array<double>, inv array<double>, det double"


def _quantiles(rows: DataFrame, x: list[Column], shares: tuple[float, ...]) -> DataFrame:
    """cell and q, for each share an array of that quantile by coordinate, from counts in bins of an eighth of FLOOR."""
    binned = rows.select("cell", F.posexplode(F.array(*[F.floor(v / F.lit(w / 8)) for v, w in zip(x, FLOOR, strict=True)])).alias("k", "bin"))
    binned = binned.groupBy("cell", "k", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("cell", "k").orderBy("bin"))
    all_ = F.sum("n").over(W.partitionBy("cell", "k"))
    by = binned.select("cell", "k", "bin", upto.alias("upto"), all_.alias("all")).groupBy("cell", "k")
    by = by.agg(*[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias(f"b{i}") for i, share in enumerate(shares)])
    width = F.array(*[F.lit(w / 8) for w in FLOOR])
    middle = lambda i: F.transform(F.array_sort(F.collect_list(F.struct("k", f"b{i}"))), lambda s: (s[f"b{i}"] + 0.5) * F.element_at(width, (s["k"] + 1).cast("int")))
    return by.groupBy("cell").agg(F.array(*[middle(i) for i in range(len(shares))]).alias("q"))


def _starts(rows: DataFrame, x: list[Column], scratch: Scratch) -> DataFrame:
    """Three first models a cell around the medians: with equal scales, with scales from quartiles, and with the shape of
    the directions in which the rows lie (their spatial signs)."""
    import pandas as pd

    p = len(FEATURES)
    q = scratch.keep(_quantiles(rows, x, (0.25, 0.5, 0.75)))
    scale = lambda i: F.greatest((F.col("q")[2][i] - F.col("q")[0][i]) / 1.349, F.lit(FLOOR[i]))
    sign = rows.join(q, "cell").select("cell", F.array(*[(x[i] - F.col("q")[1][i]) / scale(i) for i in range(p)]).alias("u"))
    norm = F.greatest(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-12))
    sign = sign.select("cell", "u", norm.alias("r"))
    shape = sign.groupBy("cell").agg(F.array(*[F.avg(F.col("u")[i] * F.col("u")[j] / F.col("r")) for i in range(p) for j in range(i + 1)]).alias("c"))

    def first(batches: Iterator) -> Iterator:
        low = np.tril_indices(p)
        for pdf in batches:
            out = []
            for cell_, quartiles, c in zip(pdf["cell"], pdf["q"], pdf["c"], strict=True):
                down, mid, up = (np.array(list(v), float) for v in quartiles)
                scale = np.maximum((up - down) / 1.349, FLOOR)
                signs = np.zeros((p, p))
                signs[low] = np.array(c)
                signs = p * (signs + signs.T - np.diag(signs.diagonal()))
                for start, cov in enumerate((9 * np.diag(np.square(FLOOR)), np.diag(scale**2), scale[:, None] * signs * scale + np.diag(np.square(FLOOR)))):
                    out.append((cell_, start, mid.tolist(), np.linalg.inv(cov).ravel().tolist(), np.inf))
            yield pd.DataFrame(out, columns=["cell", "start", "mu", "inv", "det"])

    return q.join(shape, "cell").mapInPandas(first, _MODEL)


def _step(rows: DataFrame, x: list[Column], models: DataFrame) -> DataFrame:
    """One concentration step of every model: the estimate from the half of its cell's rows that is nearest to it."""
    p = len(FEATURES)
    far = rows.join(models.select("cell", "start", "mu", "inv"), "cell").select("cell", "start", "x", squared(x, F.col("mu"), F.col("inv")).alias("d2"))
    far = far.select("cell", "start", "x", F.floor(16 * F.log2(F.greatest("d2", F.lit(0.0)) + 1e-6)).alias("bin"))
    bins = far.groupBy("cell", "start", "bin").agg(F.count("*").alias("n"))
    one = W.partitionBy("cell", "start")
    bins = bins.select("cell", "start", "bin", F.sum("n").over(one.orderBy("bin")).alias("upto"), F.sum("n").over(one).alias("all"))
    enough = F.when(2 * F.col("upto") >= F.least(F.col("all") + p + 1, 2 * F.col("all")), F.col("bin"))
    half = bins.groupBy("cell", "start").agg(F.min(enough).alias("last"), F.max("all").alias("all"))
    sums = far.join(half, ["cell", "start"]).filter(F.col("bin") <= F.col("last")).groupBy("cell", "start").agg(
        F.count("*").alias("n"),
        F.max("all").alias("all"),
        F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(p) for j in range(i + 1)]).alias("c"),
    )
    return sums.mapInPandas(_estimate, _MODEL)


def fit(stats: DataFrame, prefix: str, lang_col: str = "lang", source_col: str = "source", min_rows: int = 50, steps: int = 10) -> Mcd:
    """Minimum-covariance-determinant estimates over all rows of ``stats``.

    A language and source with fewer than ``min_rows`` rows share the cell of their language, and where that has too few
    all such rows share one. Null languages and sources are groups of their own. An empty table gives no cells. ``steps``
    bounds the concentration steps of a start; they end once no determinant falls by more than a hundredth. Of starts
    with equal determinants the first is taken.
    """
    scratch = Scratch(stats.sparkSession)
    groups = stats.groupBy(cell(F.lit(0), lang_col, source_col).alias("full"), cell(F.lit(1), lang_col, source_col).alias("lang")).agg(F.count("*").alias("n"))
    small = groups.filter(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("m"))
    cells = groups.join(small, "lang", "left").select("full", F.when(F.col("n") >= min_rows, F.col("full")).when(F.col("m") >= min_rows, F.col("lang")).otherwise("all").alias("cell"))
    cells = scratch.keep(cells)
    rows = stats.withColumn("full", cell(F.lit(0), lang_col, source_col)).join(cells, "full").select("cell", F.array(*vector(prefix)).alias("x"))
    rows = scratch.keep(rows)
    x = [F.col("x")[i] for i in range(len(FEATURES))]
    now = scratch.keep(_starts(rows, x, scratch))
    for k in range(steps):
        after = _step(rows, x, now)
        if k == 1:  # two steps tell which start leads to the least determinant
            after = after.groupBy("cell").agg(F.min_by(F.struct("start", "mu", "inv", "det"), F.struct("det", "start")).alias("m")).select("cell", "m.*")
        after = scratch.keep(after)
        fell = now.select("cell", "start", F.col("det").alias("before")).join(after, ["cell", "start"]).filter(F.col("det") < F.col("before") - 0.01)
        settled = k > 1 and fell.isEmpty()
        now = after
        if settled:
            break
    return Mcd(cells, now.select("cell", "mu", "inv"), lang_col, source_col)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row a text: ``id_col``, the base counts, base_failed, distance (squared) and kept.

    kept is false where the base rules fail or the distance passes ``cutoff``. Null texts are empty (and fail);
    repeated ids are judged row by row; an empty table gives an empty result.
    """
    prefix = prefix_for(docs)
    stats = Scratch(docs.sparkSession).keep(statistics(docs, prefix, [id_col, lang_col, source_col], text_col))
    out = fit(stats, prefix, lang_col, source_col).distance(stats, prefix, "distance")
    return out.select(
        F.col(id_col),
        *[F.col(prefix + c).alias(c) for c in COUNTS[:5]],
        base_failed(prefix).alias("base_failed"),
        "distance",
        (~base_failed(prefix) & (F.col("distance") <= cutoff)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The rows are written once with their counts, so
    that no text is counted twice."""
    prefix = prefix_for(docs)
    stats = Scratch(docs.sparkSession).keep(statistics(docs, prefix, docs.columns, text_col))
    out = fit(stats, prefix, lang_col, source_col).distance(stats, prefix, f"{prefix}d2")
    return out.filter(~base_failed(prefix) & (F.col(f"{prefix}d2") <= cutoff)).select(*docs.columns)
