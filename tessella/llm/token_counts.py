"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, before white space that follows another character, and no pre-token crosses these. Where
a text has no white space for long, it is also cut between ASCII letters and digits, which no pre-token joins. The pieces
not met before are encoded in batches of about the same number of bytes and their lengths are remembered, within a bound;
a very long text neither fills memory nor holds up its batch. Only two numbers a row leave Python. One pre-token that is
very long by itself has no safe boundary inside and is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import CHUNK, held, text_of

#: Pieces longer than this, in characters, are cut between letters and digits too.
LONG = 4096
_BORDER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def load(path: str):
    """The tokenizer in ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces_of(text: str) -> list[str]:
    """``text`` cut at safe boundaries."""
    out = CHUNK.findall(text)
    if len(text) <= LONG or max(map(len, out)) <= LONG:
        return out
    return list(chain.from_iterable(_cut(p) if len(p) > LONG else (p,) for p in out))


def _cut(piece: str) -> Iterator[str]:
    begin = 0
    for m in _BORDER.finditer(piece):
        if m.start() - begin >= LONG:
            yield piece[begin : m.start()]
            begin = m.start()
    yield piece[begin:]


def lengths(pieces: Iterable[str], tokenizer, batch_bytes: int) -> dict[str, int]:
    """The number of tokens of each piece, encoded in batches of about ``batch_bytes``."""
    found: dict[str, int] = {}
    batch: list[str] = []
    held = 0
    for piece in chain(pieces, [None]):
        if batch and (piece is None or held >= batch_bytes):
            found.update(zip(batch, map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
            batch, held = [], 0
        if piece is not None:
            batch.append(piece)
            held += len(piece.encode())
    return found


class Counter:
    """Counts tokens. ``keep``: pieces in a generation of those whose length is remembered; when the younger one is full
    it becomes the older. ``short``: the longest piece that is remembered, in characters."""

    def __init__(self, tokenizer, batch_bytes: int, keep: int, short: int = 40):
        self.tokenizer, self.batch_bytes, self.keep, self.short = tokenizer, batch_bytes, keep, short
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, texts: Iterable[str]) -> list[int]:
        cut = [pieces_of(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        found = {p: self.older[p] for p in new if p in self.older}
        found |= lengths(new.difference(found), self.tokenizer, self.batch_bytes)
        long = [p for p in found if len(p) > self.short]
        self.known.update(found)
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in long:
            del self.known[p]
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        return out


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18, keep: int = 200_000, rows: int = 512
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens of every text, as the tokenizers library counts them without special tokens.

    Null texts count as empty (0 bytes, 0 tokens); null and repeated ids keep their rows; other columns are not read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"token counts {tokenizer_path} {batch_bytes} {keep}", lambda: Counter(load(tokenizer_path), batch_bytes, keep))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n = pa.array(counter.count(batch.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=[id_col, "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, schema)
