"""SimHash near-duplicates with a hierarchical index in Gray order.

Equal fingerprints are one entry. Two fingerprints that differ in three bits at most agree in one of four blocks of 16
bits, and, that block given, in one of four blocks of 12 bits of the rest; these 28 shared bits are the top node under
which both are indexed. Below it the fingerprints are sorted by Gray rank, so that neighbours share most bits, and every
eight entries get an upper node with the bits that all of them share. A search goes down with the differences gathered so
far and prunes a whole node once they pass three; a node whose entries are all linked to the searching one is pruned too,
so a group of many near copies costs no more than its links. Each top node gives stars, not pairs, and the stars meet in
distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, components, free_name, release, text_of

SHINGLE, SEED, REACH, FAN = 3, 42, 3, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 512, fp_col: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (or the columns ``keep``) and ``fp_col`` (the 64 bits as a BIGINT) of every text; null texts are empty."""
    keep = [id_col] if keep is None else keep
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(fp_col, T.LongType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                fps = np.array([fingerprint(t) for t in batch.column(n).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps)], names=schema.names)

    return docs.select(*[F.col(c) for c in keep], text_of(text_col).cast("binary").alias(free_name(docs, "_text"))).mapInArrow(run, schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray sequence."""
    out = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Fingerprints under their top nodes. ``tops``: the top node of each entry, equal ones together."""

    def __init__(self, tops: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), tops))
        self.order, self.fps = order, fps[order]
        group = np.concatenate([[0], np.cumsum(np.diff(tops[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
        self.levels: list[dict] = []
        low = high = self.fps
        self.parents: list[np.ndarray] = []
        while True:
            self.levels.append({"mask": ~(low ^ high), "bits": low, "group": group})
            first = np.concatenate([[True], np.diff(group) != 0]) if len(group) else np.zeros(0, bool)
            if first.all():
                break
            begin = np.flatnonzero(first)
            place = np.arange(len(group)) - np.repeat(begin, np.diff([*begin, len(group)]))
            starts = np.flatnonzero(place % FAN == 0)
            parent = np.cumsum(place % FAN == 0) - 1
            self.parents.append(parent)
            low, high, group = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), group[starts]
        self.spans = [np.searchsorted(p, np.arange(p[-1] + 2)) for p in self.parents]  # of each node, its children
        for k, parent in enumerate(self.parents):  # bits that a node adds to what its upper node has tested
            self.levels[k]["fresh"] = self.levels[k]["mask"] & ~self.levels[k + 1]["mask"][parent]
        self.levels[-1]["fresh"] = self.levels[-1]["mask"]
        self.root = np.arange(len(self.fps))
        for parent in self.parents:
            self.root = parent[self.root]

    def labels(self, at_once: int = 1 << 15) -> np.ndarray:
        """For each entry, in the order it was given, the least position in Gray order that it is linked with."""
        n = len(self.fps)
        label = np.arange(n)
        if n > 1:
            near = np.flatnonzero((np.diff(self.levels[0]["group"]) == 0) & (np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= REACH))
            label = _joined(label, near, near + 1)
        for at in range(0, n, at_once):
            a, b = self._search(np.arange(at, min(n, at + at_once)), label)
            label = _joined(label, a, b)
        out = np.empty(n, np.int64)
        out[self.order] = label
        return out

    def _search(self, asking: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = [label]  # the label that all entries of a node have, or -1
        for span in self.spans:
            lo, hi = np.minimum.reduceat(one[-1], span[:-1]), np.maximum.reduceat(one[-1], span[:-1])
            one.append(np.where(lo == hi, lo, -1))
        nodes = self.root[asking]
        diff = np.zeros(len(asking), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            if k < len(self.levels) - 1:
                span = self.spans[k]
                begin, size = span[nodes], span[nodes + 1] - span[nodes]
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                nodes = np.repeat(begin, size) + offset
                asking, diff = np.repeat(asking, size), np.repeat(diff, size)
            level = self.levels[k]
            diff = diff + np.bitwise_count((self.fps[asking] ^ level["bits"][nodes]) & level["fresh"][nodes])
            keep = (diff <= REACH) & (one[k][nodes] != label[asking])
            asking, nodes, diff = asking[keep], nodes[keep], diff[keep]
        return asking, nodes


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking entries ``a`` and ``b``: the least of each component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
        label = up[label]
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between entries with one top node; the rows of a top node come together."""
    names = ["a", "b"]

    def links(top: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        same = top[1:] == top[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        top, fp, rep = top[several], fp[several].view(np.uint64), rep[several]
        index = GrayIndex(top, fp)
        label = index.labels()
        to = rep[index.order][label] if len(label) else rep
        out = to != rep
        return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(to[out])], names=names)

    held: list[list[np.ndarray]] = []
    n, enough = 0, 1 << 18
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        n += batch.num_rows
        if n >= enough:
            top, fp, rep = map(np.concatenate, zip(*held, strict=True))
            cut = int(np.searchsorted(top, top[-1]))  # the last top node may go on
            if cut:
                yield links(top[:cut], fp[:cut], rep[:cut])
            held, n = [[top[cut:], fp[cut:], rep[cut:]]], n - cut
            enough = max(1 << 18, 2 * n)  # so that what is held is put together a few times only
    if n:
        yield links(*map(np.concatenate, zip(*held, strict=True)))


def top_nodes() -> Column:
    """The sixteen top nodes of a fingerprint: which blocks with their 28 bits (top), and the 36 bits below it (rest)."""
    tops = []
    for i in range(4):
        turned = f"(shiftleft(fp, {16 * i}) | shiftrightunsigned(fp, {64 - 16 * i}))" if i else "fp"
        for j in range(4):
            block = f"shiftleft(shiftrightunsigned({turned}, 48), 12)"
            chosen = f"(shiftrightunsigned({turned}, {36 - 12 * j}) & 4095)"
            above = f"shiftleft(shiftrightunsigned({turned} & {(1 << 48) - 1}L, {48 - 12 * j}), {36 - 12 * j})"
            below = f"({turned} & {(1 << (36 - 12 * j)) - 1}L)"
            tops.append(f"named_struct('top', {(i * 4 + j) << 28}L | {block} | {chosen}, 'rest', {above} | {below})")
    return F.expr(f"array({', '.join(tops)})")


def split_nodes(tops: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``tops`` with every node of more than ``most`` entries split: two entries that differ in three bits at most agree in
    one of four blocks of the bits below the node, so these make four finer nodes. After two splits 44 bits are shared,
    and a node has 2^20 distinct entries at most."""
    done = None
    for widths in ((9, 9, 9, 9), (7, 7, 7, 6)):
        hot = tops.groupBy("top").count().filter(F.col("count") > most).select("top")
        hot = scratch.keep(hot)
        if hot.isEmpty():
            break
        cold = tops.join(hot, "top", "left_anti").select("top", "rest", "fp", "rep")
        done = cold if done is None else done.unionByName(cold)
        total, before, finer = sum(widths), 0, []
        for k, w in enumerate(widths):
            low = total - before - w
            chosen = f"(shiftrightunsigned(rest, {low}) & {(1 << w) - 1}L)"
            rest = f"shiftleft(shiftrightunsigned(rest, {low + w}), {low}) | (rest & {(1 << low) - 1}L)"
            finer.append(f"named_struct('top', xxhash64(top, {k}, {chosen}), 'rest', {rest})")
            before += w
        tops = tops.join(hot, "top", "left_semi").select(F.expr(f"inline(array({', '.join(finer)}))"), "fp", "rep")
    return tops if done is None else done.unionByName(tops)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_node: int = 200_000) -> DataFrame:
    """``id_col``, fp and component_id: the smallest id reachable over fingerprints that differ in three bits at most.

    One row a row of ``docs``. Null texts are empty and have fingerprint zero, which links like any other; rows with a
    null id get their fingerprint, link nothing by themselves and carry the component of their fingerprint, if any;
    repeated ids keep their rows; an empty table gives an empty result. Ids are integers. ``most_in_node``: entries of a
    top node beyond which it is split.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col))
    entries = scratch.keep(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")))
    tops = split_nodes(entries.filter("rep IS NOT NULL").select(F.inline(top_nodes()), "fp", "rep"), most_in_node, scratch)
    stars = tops.select("top", "fp", "rep").repartition("top").sortWithinPartitions("top").mapInArrow(_stars, "a long, b long")
    found = components(stars, scratch)
    linked = entries.join(found, entries["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(linked, "fp").select(F.col(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Rows with a null id stay.

    Where an id comes twice its rows are judged by their own fingerprints; of several rows of one component and its
    smallest id the one with the least fingerprint, then hash of all columns, stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(near_duplicates(docs, id_col, text_col))
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col))
    again = scratch.keep(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col))
    if again.isEmpty():
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    once = docs.join(again, id_col, "left_anti").join(gone, id_col, "left_anti").select(*docs.columns)
    fp, component, place = (free_name(docs, c) for c in ("_fp", "_component", "_place"))
    rows = fingerprints(docs.join(again, id_col, "left_semi").select(*docs.columns), text_col=text_col, fp_col=fp, keep=docs.columns)
    of = found.join(again, id_col, "left_semi").filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col), F.col("fp").alias(fp), F.col("component_id").alias(component)).distinct()
    order = W.partitionBy(component).orderBy(fp, F.xxhash64(*docs.columns))
    first = rows.join(of, [id_col, fp]).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return once.unionByName(first.select(*docs.columns))
