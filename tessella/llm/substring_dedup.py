"""Substring dedup by suffix automata of reference shards.

A word goes if it lies in a window of twenty words that also starts earlier: in a document with a smaller id, or earlier
in the same one. Streaming every document past automata of the whole corpus would be quadratic, so the reference is cut
into shards by anchors. An anchor is a run of eight words whose hash is the least of a window's thirteen; equal windows
have equal anchors. The shard of an anchor that comes twice or more holds its contexts, the twelve words on either side
with the anchor as one symbol. A shard's task streams the contexts, earliest first, through the shard's automaton for
their matching statistics, removes the spans that match over a window or more, and adds what was new. A shard has a fixed
bound. The few anchors that come more often than that are spread over their windows: one grouped minimum, summed up before
it is shuffled, finds where each window starts first.

Which anchors come twice is one grouped count. Tasks learn it from a Bloom filter while it is small enough to send, and
from a join beyond; what the filter lets through by chance matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, free_name, release, text_of

WINDOW, ANCHOR = 20, 8
SIDE = WINDOW - ANCHOR
_PIECE = re.compile(rb"[^ \t-\r]+[ \t-\r]*")
#: Contexts that a task remembers having sent.
SENT = 1 << 17
#: Stands for a null id, which comes after all others.
LAST_ID = (1 << 63) - 1


#: Bytes that a word's hash is reckoned over in one go; a longer word is hashed by itself.
_RUN = 1 << 16
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(256)], np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_RUN + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Words:
    """The words of a text by their places in it: where each begins and ends, in bytes."""

    def __init__(self, text: bytes):
        self.text = text
        data = np.frombuffer(text, np.uint8)
        blank = np.ones(len(data) + 2, np.int8)
        blank[1:-1] = _BLANK[data]
        turn = np.diff(blank)
        self.begin, self.end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        odd = self.begin[1:] - self.end[:-1] != 1
        odd |= data[self.end[:-1]] != 32
        self.odd = np.concatenate([[0], np.cumsum(odd)])  # words up to each that something else than one space follows

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        """A hash of each word that depends on its bytes alone."""
        out = np.zeros(len(self), np.uint64)
        at = 0
        while at < len(self):
            low = int(self.begin[at])
            to = int(np.searchsorted(self.end, low + _RUN, "right"))
            if to == at:
                out[at] = xxhash.xxh3_64_intdigest(self.text[low : self.end[at]])
                at += 1
                continue
            high = int(self.end[to - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUE[np.frombuffer(self.text, np.uint8, high - low, low)] * _UP[: high - low], out=sums[1:])
            begin = self.begin[at:to] - low
            out[at:to] = (sums[self.end[at:to] - low] - sums[begin]) * _DOWN[begin]
            at = to
        out ^= out >> np.uint64(32)
        return out

    def joined(self, a: int, b: int) -> bytes:
        """Words ``a`` up to ``b`` with one space between."""
        found = self.text[self.begin[a] : self.end[b - 1]]
        return found if self.odd[a] == self.odd[b - 1] else b" ".join(found.split())


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors; every window of twenty words holds one, chosen by its words alone."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()
    step = 1
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        h = h[:-step] * np.uint64(m) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _sliding(h, SIDE + 1, np.minimum)
    padded = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    at = np.flatnonzero(_sliding(padded, SIDE + 1, np.maximum) == h)
    return at, h[at].view(np.int64)


def _sliding(x: np.ndarray, size: int, f) -> np.ndarray:
    """``f`` over every run of ``size`` values."""
    done = 1
    out = x
    while 2 * done <= size:
        out = f(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return f(out[: len(out) - rest], out[rest:]) if rest else out


class Bloom:
    """A Bloom filter of BIGINT keys in slices that are filled apart from each other."""

    SLICES, PROBES = 64, 4

    def __init__(self, slices: dict[int, bytes], words: int):
        self.bits = np.zeros((self.SLICES, words), np.uint64)
        for s, data in slices.items():
            self.bits[s] = np.frombuffer(data, np.uint64)

    @classmethod
    def places(cls, keys: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k = keys.view(np.uint64)
        a, b = k >> np.uint64(6), (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7) | np.uint64(1)
        for i in range(cls.PROBES):
            bit = (a + np.uint64(i) * b) % np.uint64(words * 64)
            yield (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    @classmethod
    def build(cls, keys: DataFrame, n: int) -> Bloom:
        """Of the column ``a``; each slice is one task's and only its bits are sent."""
        words = max(16, (n * 12) // (64 * cls.SLICES) + 1)

        def fill(key, pdf):
            import pandas as pd

            bits = np.zeros(words, np.uint64)
            for word, bit in cls.places(pdf["a"].to_numpy(), words):
                np.bitwise_or.at(bits, word, bit)
            return pd.DataFrame({"s": [key[0]], "bits": [bits.tobytes()]})

        rows = keys.select("a", F.expr(f"a & {cls.SLICES - 1}L").alias("s")).groupBy("s").applyInPandas(fill, "s long, bits binary").collect()
        return cls({r["s"]: r["bits"] for r in rows}, words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        s = (keys & (self.SLICES - 1)).astype(np.int64)
        for word, bit in self.places(keys, self.bits.shape[1]):
            found &= self.bits[s, word] & bit != 0
        return found


class SuffixAutomaton:
    """A suffix automaton of several sequences of symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """A copy of state ``q`` for the strings that ``p`` and ``symbol`` reach."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, symbols: list) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for symbol in symbols:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
                continue
            new = self._new(length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in following[p]:
                following[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = following[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
            last = new

    def matching(self, symbols: list) -> list[int]:
        """For each place the length of the longest match that ends there."""
        following, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for symbol in symbols:
            q = following[state].get(symbol)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = following[state].get(symbol)
            if q is not None:
                state, n = q, n + 1
            out.append(n)
        return out


def shard_spans(contexts: list[tuple[tuple, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For each context (place of its anchor as a sortable tuple, words left of the anchor, text), earliest first, the
    spans of words (from, to; from the anchor) in windows that an earlier context has."""
    automaton, out = None, []
    for k, (_, left, text) in enumerate(contexts):
        words = text.split(b" ")
        symbols = [*words[:left], b" ".join(words[left : left + ANCHOR]), *words[left + ANCHOR :]]
        spans: list[tuple[int, int]] = []
        fresh = True
        if k:
            if automaton is None:
                automaton = SuffixAutomaton()
                automaton.add(first)
            ends = [e for e, n in enumerate(automaton.matching(symbols)) if n >= SIDE + 1]
            for e in ends:
                a = e - SIDE - left
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], a + WINDOW)
                else:
                    spans.append((a, a + WINDOW))
            fresh = len(ends) < len(symbols) - SIDE
            if fresh:
                automaton.add(symbols)
        else:
            first = symbols
        out.append(spans)
    return out


def _shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from contexts whose rows come with equal anchors together."""
    out: list[tuple[int, bytes, int, int]] = []

    def work(rows: list[tuple]) -> None:
        texts: dict[int, tuple[int, bytes]] = {}
        first: dict[int, tuple] = {}
        for c, left, id_, th, at, text in rows:
            if text is not None:
                texts[c] = (left, text)
            if c not in first or (id_, th, at) < first[c]:
                first[c] = (id_, th, at)
        if len(rows) == 1:
            return
        order = sorted(first, key=first.__getitem__)
        spans = dict(zip(order, shard_spans([(first[c], *texts[c]) for c in order]), strict=True))
        for c, left, id_, th, at, _ in rows:
            if (id_, th, at) == first[c]:
                out.extend((id_, th, at + a, at + b) for a, b in spans[c])
            else:
                n = texts[c][1].count(b" ") + 1
                out.append((id_, th, at - left, at - left + n))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "th", "from", "to"])
        out.clear()
        return batch

    now, rows = None, []
    for batch in batches:
        a, *rest = (batch.column(k).to_pylist() for k in range(7))
        for key, row in zip(a, zip(*rest, strict=True), strict=True):
            if key != now:
                if rows:
                    work(rows)
                now, rows = key, []
            rows.append(row)
        if len(out) > 20_000:
            yield flush()
    if rows:
        work(rows)
    yield flush()


#: Windows that a task holds at most.
MOST_COMMON = 50_000
WINDOW_NAMES = ["w1", "w2", "id", "th", "from", "to", "done"]
WINDOW_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_())
WINDOW_SCHEMA = "w1 long, w2 long, id long, th binary, from int, to int, done boolean"


def _hot_spans(windows: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """Spans of windows (w1 and w2: their hash) that start earlier too, for anchors too common for a shard. Rows that are
    done are spans already.

    A grouped minimum says where each window starts first. The windows that come more often than ``limit`` are few, as
    many as the rows divided by the limit at most; each task holds them and settles them by itself, a run of them as one
    span. The others, none of which is common any more, are joined.
    """
    windows = scratch.keep(windows)
    fresh = windows.filter("NOT done")
    first = scratch.keep(fresh.groupBy("w1", "w2").agg(F.min(F.struct("id", "th", F.col("from").alias("at"))).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    limit = max(limit, windows.count() // MOST_COMMON)
    rows = first.filter(F.col("n") > limit).select("w1", "w2", "first.*").toLocalIterator()
    common = {(r["w1"], r["w2"]): (r["id"], r["th"], r["at"]) for r in rows}

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for w1, w2, id_, th, at, to, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = common.get((w1, w2))
                if done:
                    out.append([w1, w2, id_, th, at, to, True])
                elif known is None:
                    out.append([w1, w2, id_, th, at, at + WINDOW, False])
                elif (id_, th, at) > known:
                    last = out[-1] if out else None
                    if last and last[6] and last[2] == id_ and last[3] == th and last[4] <= at <= last[5]:
                        last[5] = at + WINDOW
                    else:
                        out.append([w1, w2, id_, th, at, at + WINDOW, True])
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, WINDOW_KINDS, strict=True)], names=WINDOW_NAMES)

    settled = windows.mapInArrow(settle, WINDOW_SCHEMA)
    rest = settled.filter("NOT done").join(first.filter(F.col("n") <= limit), ["w1", "w2"])
    rest = rest.filter(F.struct("id", "th", F.col("from").alias("at")) > F.col("first"))
    columns = ["id", "th", "from", "to"]
    return settled.filter("done").select(*columns).unionAll(rest.select(*columns))


def text_key(docs: DataFrame, id_: Column, text: Column) -> Column:
    """What tells apart texts of one id: 128 bits of the text; nothing where every id comes once."""
    once = docs.select(id_.alias("id")).groupBy("id").count().filter("count > 1").isEmpty()
    return F.lit(b"").cast("binary") if once else F.unhex(F.md5(text.cast("binary")))


def removed_spans(docs: DataFrame, scratch: Scratch, most_in_shard: int = 4000, most_mb: float = 128.0) -> DataFrame:
    """id, th and spans (of word numbers, from and to) of the texts of ``docs`` (id, th BINARY, text) that lose words."""

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = [anchors(Words(t))[1] for t in whole.slice(at, 1024).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["a"])

    counts = docs.select("text").mapInArrow(list_anchors, "a long").groupBy("a").agg(F.count("*").alias("n"))
    repeated = scratch.keep(counts.filter("n > 1"))
    total = repeated.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    limit = max(most_in_shard, total["n"] // 4_000_000)  # so that there are at most four million hot anchors
    hot = np.sort(np.array([r["a"] for r in repeated.filter(F.col("n") > limit).select("a").toLocalIterator()], np.int64))
    bloom = Bloom.build(repeated, total["k"]) if total["k"] * 1.5 < most_mb * 1e6 else None

    def candidates(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, a = anchors(words)
        if bloom is not None and len(a):
            found = bloom.holds(a)
            at, a = at[found], a[found]
        if not len(a) or not len(hot):
            return at, a, np.zeros(len(a), bool)
        k = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
        return at, a, hot[k] == a

    names = ["a", "c", "left", "id", "th", "at", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sent: list[int | None] = [None] * SENT  # contexts whose text the task has sent already, each in the one place that its hash allows
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                rows = []
                batch = whole.slice(begin, 512)
                for id_, th, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = Words(text)
                    n = len(words)
                    at, a, is_hot = candidates(words)
                    for p, key in zip(at[~is_hot].tolist(), a[~is_hot].tolist(), strict=True):
                        left = min(p, SIDE)
                        context = words.joined(p - left, min(n, p + ANCHOR + SIDE))
                        c = xxhash.xxh3_64_intdigest(context, left) - (1 << 63)
                        known = sent[c % SENT] == c
                        sent[c % SENT] = c
                        rows.append((key, c, left, id_, th, p, None if known else context))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                rows = []
                batch = whole.slice(begin, 512)
                for id_, th, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = Words(text)
                    at, _, is_hot = candidates(words)
                    if not is_hot.any():
                        continue
                    starts = np.unique((at[is_hot][:, None] - np.arange(SIDE + 1)).ravel())
                    seen: set = set()
                    again: list[list[int]] = []  # runs of windows that the text itself has before; only new ones are compared
                    for s in starts[(starts >= 0) & (starts <= len(words) - WINDOW)].tolist():
                        h = xxhash.xxh3_128_intdigest(words.joined(s, s + WINDOW))
                        if h not in seen:
                            seen.add(h)
                            rows.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), id_, th, s, s + WINDOW, False))
                        elif again and s <= again[-1][1]:
                            again[-1][1] = s + WINDOW
                        else:
                            again.append([s, s + WINDOW])
                    rows += [(None, None, id_, th, a, b, True) for a, b in again]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, WINDOW_KINDS, strict=True)], names=WINDOW_NAMES)

    source = docs.select("id", "th", "text")
    rows = source.mapInArrow(contexts, "a long, c long, left int, id long, th binary, at int, text binary")
    if bloom is None:
        rows = rows.join(repeated.select("a"), "a", "left_semi")
    spans = rows.repartition("a").sortWithinPartitions("a").mapInArrow(_shard_task, "id long, th binary, from int, to int")
    if len(hot):
        spans = spans.unionAll(_hot_spans(source.mapInArrow(hot_windows, WINDOW_SCHEMA), scratch, limit))
    return spans.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_shard: int = 4000) -> DataFrame:
    """All columns of ``docs`` and last _n_words, _n_removed, _kept (the words that stay, joined by one space) and _text
    (the same with the white space between them as it was; unchanged where nothing goes); see free_name.

    Null texts have no words. Null ids come after all others. Rows of one id and text are one document, and none of them
    is earlier than the others; rows of one id with different texts are ordered by a 128-bit hash of the text. Texts under twenty
    words stay whole. An empty table gives an empty result.
    """
    prefix = "_s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scratch = Scratch(docs.sparkSession)
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    th = text_key(docs, id_, text_of(text_col))
    spans = removed_spans(docs.select(id_.alias("id"), th.alias("th"), text_of(text_col).cast("binary").alias("text")), scratch, most_in_shard)
    spans = spans.select(F.col("id").alias(f"{prefix}id"), F.col("th").alias(f"{prefix}th"), F.col("spans").alias(f"{prefix}spans"))
    keyed = docs.withColumns({f"{prefix}id": id_, f"{prefix}th": th})
    joined = keyed.join(spans, [f"{prefix}id", f"{prefix}th"], "left").select(*docs.columns, f"{prefix}spans")
    added = {"_n_words": T.LongType(), "_n_removed": T.LongType(), "_kept": T.StringType(), "_text": T.StringType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(free_name(docs, c), kind) for c, kind in added.items()]])
    where, n = docs.columns.index(text_col), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = []
                for text, spans in zip(batch.column(where).to_pylist(), batch.column(n).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    if not spans:
                        found.append((len(words), 0, b" ".join(words).decode(), text))
                        continue
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["from"] for s in spans], 1)
                    np.add.at(edge, [s["to"] for s in spans], -1)
                    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    pieces = _PIECE.findall(text.encode())
                    kept = b" ".join([words[i] for i in stays]).decode()
                    found.append((len(words), len(words) - len(stays), kept, b"".join([pieces[i] for i in stays]).decode().rstrip(" \t\n\r\x0b\x0c")))
                cols = list(zip(*found, strict=True)) if found else [[]] * 4
                new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=schema.names)

    return joined.mapInArrow(cut, schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut out of its texts; a column ``n_chars_col`` follows."""
    out = dedup(docs, id_col, text_col)
    text = out.columns[-1]
    columns = [F.col(text).alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == n_chars_col else F.col(c) for c in docs.columns]
    return out.select(*columns)
