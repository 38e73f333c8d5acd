"""Benchmark decontamination by template canonicalisation.

Words become templates: a number stands as NUM, a unit after a number as UNIT, a capitalised word inside a sentence as
NAME, any other as itself in lower case without the marks around it. Windows of eight template words of every benchmark
item are hashed; a text's windows look theirs up, and what is found is compared in full. Windows of one item in one
alignment must fill the placeholders consistently: the same value of the item always with the same value of the text. So
a question asked anew with other numbers and names is found, and a chance likeness of placeholders is not. Windows of more
than half placeholders are not looked up as templates. All windows are also looked up as they stand, by their words in
lower case without the marks around them, so what a text quotes word for word is found whatever it is made of.

An item is in a text if the accepted windows cover at least half of its words, or if they hold RUN words of it in a row
word for word. An item of under four words, which would be met by chance in any text, is in a text that has it as a line
of its own. The benchmark's windows are held by every task, in shards of a fixed size; a benchmark of more shards
takes as many passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, free_name, release

WINDOW, LEAST = 8, 4
#: Words in a row that are a quotation by themselves, as in the usual check by 13-grams.
RUN = 13
UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons gram grams kilogram kilograms
    ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
    months year years cent cents dollar dollars euro euros pound pounds usd eur percent % degree degrees km/h mph kmh hz khz mhz ghz w kw
    v a b kb mb gb tb""".split()
)
_CORE = re.compile(r"\w.*\w|\w|%", re.DOTALL)
_NUMBER = re.compile(r"\d[\d.,:/]*\Z")
NAME, ENDS, NUMBER, UNIT, NOTHING = 1, 2, 4, 8, 16
_FLAGS = 31
_SLOT = {k: np.uint64(xxhash.xxh3_64_intdigest(b"\0slot", k) & ~_FLAGS) for k in (NAME, NUMBER, UNIT)}


def core(word: str) -> str:
    """A word without the marks around it; empty if it is nothing but marks."""
    m = _CORE.search(word)
    return m[0] if m else ""


class _Words(dict):
    """Of each word (bytes) its hash with its kind in the lowest bits; a full table starts anew."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        c = core(text)
        kind = ENDS * (text.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":"))
        if not c:
            kind |= NOTHING
        elif _NUMBER.match(c):
            kind |= NUMBER
        elif c[0].isupper() and c[1:] == c[1:].lower() and c[0].isalpha():
            kind |= NAME
        low = c.lower()
        kind |= UNIT * (low in UNITS)
        value = xxhash.xxh3_64_intdigest(low.encode()) & ~_FLAGS | kind
        if len(self) >= 100_000:
            self.clear()
        self[word] = value
        return value


def templates(words: list[bytes], known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word that is more than marks: its place, its template symbol, whether that is a placeholder, and its hash."""
    v = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    kind = (v & np.uint64(_FLAGS)).astype(np.int64)
    begins = np.concatenate([[True], kind[:-1] & ENDS > 0])[: len(v)]  # the first word of a sentence is no name
    real = np.flatnonzero(kind & NOTHING == 0)
    v, kind, begins = v[real], kind[real], begins[real]
    number = kind & NUMBER > 0
    unit = (kind & UNIT > 0) & np.concatenate([[False], number[:-1]])[: len(v)]
    name = (kind & NAME > 0) & ~begins & ~unit
    plain = v & ~np.uint64(_FLAGS)
    symbol = plain.copy()
    for which, k in ((name, NAME), (number, NUMBER), (unit, UNIT)):
        symbol[which] = _SLOT[k]
    return real, symbol, name | number | unit, plain


def window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(symbols) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += symbols[k : len(symbols) - size + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * size)
    return out ^ out >> np.uint64(29)


class _Windows:
    """Hashes of windows with the item and the place that each is from."""

    def __init__(self, hashes: list[np.ndarray], places: list[np.ndarray], items: list[int]):
        all_ = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(all_, kind="stable")
        self.hashes = all_[order]
        self.items = np.repeat(np.array(items, np.int32), [len(x) for x in places])[order]
        self.places = np.concatenate([np.zeros(0, np.int32), *places])[order].astype(np.int32)
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Place in the text, item and place in the item of each window that is known."""
        at = np.flatnonzero(self.first[(h >> np.uint64(44)).astype(np.int64)])
        begin = np.searchsorted(self.hashes, h[at])
        at, begin = at[begin < len(self.hashes)], begin[begin < len(self.hashes)]
        same = self.hashes[begin] == h[at]
        for p, k in zip(at[same].tolist(), begin[same].tolist(), strict=True):
            while k < len(self.hashes) and self.hashes[k] == h[p]:
                yield p, int(self.items[k]), int(self.places[k])
                k += 1


class Benchmark:
    """The windows of some benchmark items: (item id, text) each."""

    def __init__(self, items: list[tuple]):
        self.items = []
        self.words = _Words()
        self.short: dict[tuple[str, ...], list] = {}  # items of under LEAST words, by these
        shaped, verbatim, some, all_ = [], [], [], []
        for id_, text in items:
            words = (text or "").encode().split()
            real, symbols, slots, own = templates(words, self.words)
            size = min(WINDOW, len(symbols))
            if size < LEAST:
                if size:
                    self.short.setdefault(tuple(core(words[i].decode("utf-8", "replace")).lower() for i in real), []).append(id_)
                continue
            self.items.append((id_, symbols, slots, [core(words[i].decode("utf-8", "replace")).lower() for i in real], size, own))
            plain = np.convolve(~slots, np.ones(size, np.int64), "valid")
            some.append(np.flatnonzero(2 * plain >= size))  # half of a window's words at least are themselves
            all_.append(np.arange(len(plain)))
            shaped.append(window_hashes(symbols, size)[some[-1]])
            verbatim.append(window_hashes(own, size))
        self.sizes = sorted({x[4] for x in self.items})
        self.shaped = _Windows(shaped, some, range(len(self.items)))
        self.verbatim = _Windows(verbatim, all_, range(len(self.items)))

    def find(self, text: bytes, share: float) -> list[tuple]:
        """(item id, share of its words that is covered) of the items in ``text``, in the items' order."""
        short = self._short_lines(text) if self.short else []
        words = text.split()
        if not self.items or not words:
            return short
        real, symbols, _, plain = templates(words, self.words)
        covered: dict[int, np.ndarray] = {}
        quoted: set[int] = set()
        for (item, shift), places in self._lined(self.verbatim, plain).items():
            own, size = self.items[item][5], self.items[item][4]
            here = np.zeros(len(own), bool)
            for at in places:
                if np.array_equal(own[at : at + size], plain[at + shift : at + shift + size]):
                    here[at : at + size] = True
            if here.any():
                covered[item] = covered[item] | here if item in covered else here
                edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                if (edges[1::2] - edges[::2]).max() >= RUN:
                    quoted.add(item)
        for (item, shift), places in self._lined(self.shaped, symbols).items():
            _, own, slots, values, size, _ = self.items[item]
            filled: dict[str, str] = {}
            for at in places:
                if not np.array_equal(own[at : at + size], symbols[at + shift : at + shift + size]):
                    continue
                new = {}
                for i in (np.flatnonzero(slots[at : at + size]) + at).tolist():
                    here = core(words[real[i + shift]].decode("utf-8", "replace")).lower()
                    if filled.get(values[i], new.get(values[i], here)) != here:
                        break
                    new[values[i]] = here
                else:
                    filled.update(new)
                    covered.setdefault(item, np.zeros(len(own), bool))[at : at + size] = True
        return short + [(self.items[k][0], float(c.mean())) for k, c in sorted(covered.items()) if c.mean() >= share or k in quoted]

    def _short_lines(self, text: bytes) -> list[tuple]:
        """The short items that are a line of the text."""
        lines = {tuple(filter(None, (core(w.decode("utf-8", "replace")).lower() for w in words))) for line in text.split(b"\n") if len(words := line.split()) <= 2 * LEAST}
        return [(id_, 1.0) for line in sorted(lines & self.short.keys()) for id_ in self.short[line]]

    def _lined(self, known: _Windows, symbols: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The places in an item that the text has, by item and alignment."""
        lined: dict[tuple[int, int], list[int]] = {}
        if not len(known.hashes):
            return lined
        for size in self.sizes:
            for p, item, at in known.hits(window_hashes(symbols, size)):
                if self.items[item][4] == size:
                    lined.setdefault((item, p - at), []).append(at)
        return lined


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.5, most_items: int = 50_000
) -> DataFrame:
    """All columns of ``docs`` and last _items (see free_name): the items found in the text, with the share of their words, by item id.

    Null texts hold no item; items that are null or have no word are not looked for; repeated rows keep theirs; with an empty benchmark nothing is found. ``most_items``: items that a task holds at once.
    """
    id_type = benchmark.schema[item_col].dataType
    found_type = T.ArrayType(T.StructType([T.StructField("item", id_type), T.StructField("share", T.DoubleType())]))
    out = docs.withColumn(free_name(docs, "_items"), F.array().cast(found_type))
    known = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    known = Scratch(docs.sparkSession).keep(known)
    shards = max(1, -(-known.count() // most_items))
    for shard in range(shards):
        rows = known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).orderBy("i", "t").collect()  # about most_items
        task = Benchmark([tuple(r) for r in rows])
        n, where = len(out.columns), out.columns.index(text_col)
        schema = out.schema

        def run(batches: Iterator[pa.RecordBatch], task=task, n=n, where=where) -> Iterator[pa.RecordBatch]:
            release()
            for whole in batches:
                for begin in range(0, whole.num_rows, 512):
                    batch = whole.slice(begin, 512)
                    found = [task.find(t.encode(), share) if t else [] for t in batch.column(where).to_pylist()]
                    before = batch.column(n - 1).to_pylist()
                    all_ = [b + [{"item": i, "share": s} for i, s in f] for b, f in zip(before, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(all_, batch.schema.types[-1])], schema=batch.schema)

        out = out.mapInArrow(run, schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found."""
    found = contamination(docs, benchmark, **options)
    return found.filter(F.size(found.columns[-1]) == 0).select(*docs.columns)
