"""BPE encoding and decoding by dynamic programming over prefixes.

In a byte pair encoding every prefix of a pre-token has exactly one last token: the token that ends there, starts where
another prefix ends, and stands beside that prefix's last token as merging itself would leave the two. A suffix-matching
automaton (Aho-Corasick over the vocabulary) yields every token that is a suffix of the prefix; the pair test picks the
one; the back-pointers give the ids. The tokenizer's file says the vocabulary and the merges; the tokenizers library
itself is not used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import CHUNK, held, no_collector, text_of

#: The byte-level pattern that cuts a text into pre-tokens (fixed by the tokenizer's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one tokenizer file. ``keep``: chunks in a generation of those whose ids are remembered."""

    def __init__(self, path: str, keep: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.bytes[i] = as_bytes(s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merge: dict[tuple[int, int], int] = {}
        self.made = [-1] * len(self.bytes)  # the rank of the merge that makes a token; -1: none
        self.parts = [(i, i) for i in range(len(self.bytes))]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            if self.made[i] >= 0:
                raise ValueError(f"two merges make the token {i}: prefixes have no unique last token")
            self.merge[vocab[a], vocab[b]] = self.made[i] = rank
            self.parts[i] = vocab[a], vocab[b]
        self.size = list(map(len, self.bytes))
        self.suffixes = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in vocab.values():
            self.suffixes.add_word(self.bytes[i].decode("latin-1"), i)
        self.suffixes.make_automaton()
        self._pretoken = regex.compile(PATTERN)
        self._keep = keep
        self.forget()

    def forget(self) -> None:
        """Start with nothing remembered."""
        self.known = _Known(self.encode_chunk, self._keep)
        self.pretokens = _Known(self.encode_pretoken, self._keep // 4)
        self.fitting: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together leaves just these two tokens.

        Undo the merges that made them, latest first, and keep the two pieces that touch: x on the left of the border,
        y on the right. They would have joined across it if their own merge ranks before the merge that took either
        away; of equal ranks the leftmost goes first.
        """
        merge, made, parts = self.merge, self.made, self.parts
        x, y, x_gone, y_gone = a, b, 1 << 40, 1 << 40
        while True:
            rank = merge.get((x, y))
            if rank is not None and rank < x_gone and rank <= y_gone:
                return False
            if made[x] > made[y]:
                x_gone, x = made[x], parts[x][1]
            elif made[y] >= 0:
                y_gone, y = made[y], parts[y][0]
            else:
                return True

    def encode_pretoken(self, pretoken: str) -> list[int]:
        data = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1")  # a letter for each byte
        n, size, fitting = len(data), self.size, self.fitting
        last = [0]
        done = 0  # prefixes whose last token is known; one more with each place of the text
        for end, token in self.suffixes.iter(data):
            if end < done:
                continue
            at = done + 1 - size[token]
            if at:
                pair = last[at] << 32 | token
                fit = fitting.get(pair)
                if fit is None:
                    if len(fitting) >= 2 * self._keep:
                        fitting.clear()
                    fit = fitting[pair] = self.fits(last[at], token)
                if not fit:
                    continue
            done += 1
            last.append(token)
        ids = []
        while n:
            ids.append(last[n])
            n -= size[last[n]]
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        word = chunk[:-1] if chunk[-1] in ",.;:!?" else chunk
        if word.isalpha() or word[1:].isalpha() and word[0] == " ":  # a word and perhaps a mark: no need for the pattern
            return tuple(self.pretokens[word]) if word is chunk else (*self.pretokens[word], *self.pretokens[chunk[-1]])
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, self._pretoken.findall(chunk))))

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; special strings in it become their own ids."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = enumerate(self._special.split(text))
        return [i for k, s in parts for i in ([self.special[s]] if k % 2 else self._plain(s))]

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, CHUNK.findall(text))))

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    """Ids by string, worked out when first asked for. Long strings are not kept. Of the others two generations of
    ``most`` are: when the younger is full it becomes the older, and what is asked for again moves on."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.older.get(key)
        if ids is None:
            ids = self.work(key)
        if len(key) <= 40:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


def load(path: str, keep: int = 150_000) -> Bpe:
    """The tokenizer in ``path``, read once in each Python worker and held there until another operator runs."""
    return held(f"bpe {path} {keep}", lambda: Bpe(path, keep))


def _list_array(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1])))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False, rows: int = 256, keep: int = 150_000, forget: bool = True) -> DataFrame:
    """``id_col``, ids ARRAY<INT> and, if asked for, ``decoded``: those ids turned into text again.

    Null texts are empty (no ids); repeated and null ids keep their rows; texts of any length are encoded whole;
    other columns are not read. ``rows``: texts that are held in Python at once. ``keep``: see Bpe. ``forget``: a task remembers
    for itself, so that workers that idle hold no more than the tables; otherwise tasks of a worker share what they know.
    """
    fields = [docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decode_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path, keep)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                with no_collector():
                    ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
                out = [batch.column(0), _list_array(ids)]
                if decode_too:
                    out.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])
        if forget:
            bpe.forget()

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", rows: int = 256) -> DataFrame:
    """``id_col`` and ``decoded``: the text of each array of ids; null arrays give an empty text."""
    schema = T.StructType([tokens.schema[id_col], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, schema)
