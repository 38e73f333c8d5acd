"""Token counts and BPE against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'ll", "1", "22", "!", "\x1c", "\xa0", "\u3000", "\x85", "<|endoftext|>", "ﬁ", "漢", "😀", "zzzz", "\u200b", "\r\n", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=1500):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, " " * 3000, "<|endoftext|>" * 50, "word " * 20000, "é" * 3000]


def test_encoding_is_the_librarys(library):
    own = bpe.load(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pair_test_is_merging():
    own = bpe.load(PATH)
    rnd = random.Random(2)

    def merged(data):
        ids = [own.bytes.index(bytes([b])) for b in data]
        while True:
            best = min(((own.merge[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in own.merge), default=None)
            if best is None:
                return ids
            ids[best[1] : best[1] + 2] = [own.made.index(best[0])]

    for _ in range(300):
        a, b = rnd.randrange(3000), rnd.randrange(3000)
        assert own.fits(a, b) == (merged(own.bytes[a] + own.bytes[b]) == [a, b])


def test_cache_bounds_change_nothing(library):
    small = bpe.Bpe(PATH, keep=7)
    counter = token_counts.Counter(library, 64, 3)
    for t in texts(200):
        want = library.encode(t, add_special_tokens=False).ids
        assert small.encode(t) == want
        assert counter.count([t, t]) == [len(want)] * 2


def test_queries_on_odd_tables(spark, library):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (None, None, None), (3, "", "y"), (4, "é<|endoftext|> 漢", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, PATH).collect()) == want
    back = bpe.encode(df, PATH, decode_too=True)
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    again = bpe.decode(back, PATH)
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in again.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for f in (token_counts.token_counts, bpe.encode):
        assert f(df.limit(0), PATH).count() == 0
