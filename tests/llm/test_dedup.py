"""Near-dedup, substring dedup, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import decontamination, quality, registry, simhash, substring_dedup
from tessella.llm.common import Scratch, components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(prints):
    """prints: (id, fingerprint)."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints():
    for t in ["", "  ", "A", "a b", "a b c", "É Hello\x0bWorld again again again", "x " * 500, "a\u00a0b c d"]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for c in centre for _ in range(40)]).astype(np.uint64)
    tops = fps >> np.uint64(62)
    label = simhash.GrayIndex(tops, fps).labels(at_once=50)
    want = np.arange(len(fps))
    a, b = np.nonzero((np.bitwise_count(fps[:, None] ^ fps) <= 3) & (tops[:, None] == tops))
    want = simhash._joined(want, a, b)
    assert len(np.unique(label)) == len(np.unique(want))
    assert all(len(np.unique(label[want == w])) == 1 for w in np.unique(want))


def test_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, " \n"), (9003, "one two"), (9003, "one two"), (9004, "One Two")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    prints = {(i, slow_fingerprint(t)) for i, t in rows}
    want = slow_components(sorted(prints))
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((i, slow_fingerprint(t), want[i]) for i, t in rows)
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i in want if want[i] == i}) and kept.columns == docs.columns
    null = spark.createDataFrame([(None, "a b c d"), (None, "x")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(null).collect()} == {None} and simhash.drop_near_duplicates(null).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(300)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    want = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert got == want


def slow_removed(rows):
    """rows: (id, text), ids unique."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        out[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest())
    return out


def odd_texts():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(70)]
    rows = []
    for i in range(120):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 90))]
        if i % 3 == 0:
            cut = rnd.randint(0, 30)
            text[len(text) // 2 : len(text) // 2] = passage[cut : cut + rnd.randint(15, 60)]
        rows.append((i, " ".join(text)))
    return [*rows, (500, "the " * 300), (501, "a b c " * 40), (502, None), (503, rows[3][1]), (504, "x\x0by\x1cz " * 30)]


@pytest.mark.parametrize(("most", "mb"), [(4000, 128.0), (5, 128.0), (4000, 0.0), (5, 0.0)])
def test_substring_dedup(spark, most, mb):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    scratch = Scratch(spark)
    keyed = df.select(F.col("doc_id").alias("id"), F.lit(b"").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = {r["id"]: r["spans"] for r in substring_dedup.removed_spans(keyed, scratch, most, mb).collect()}
    want = slow_removed(rows)
    for i, t in rows:
        words = (t or "").encode().split()
        gone = {k for s in spans.get(i, []) for k in range(s["from"], s["to"])}
        assert (len(words), len(gone)) == want[i][:2]


def test_substring_dedup_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.op8_substring_dedup(spark, sf).collect()} == want


def test_substring_dedup_on_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "x"), (1, text, "y"), (None, f"{text}\nend", None), (2, f"start {text}\nend", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string")
    out = substring_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "_kept", "_n_words", "_n_removed", "__kept", "_text"]
    got = sorted((r["doc_id"] or 99, r["_n_removed"], r["_text"]) for r in out.collect())
    assert got == [(1, 0, text), (1, 0, text), (2, 30, "start end"), (99, 31, "")]
    cut = substring_dedup.drop_repeats(df.withColumn("n_chars", F.length("text")))
    assert {r["doc_id"]: r["n_chars"] for r in cut.collect()}[2] == len("start end")
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_automaton():
    rnd = random.Random(9)
    seqs = [[rnd.choice("abc") for _ in range(rnd.randint(1, 15))] for _ in range(6)]
    a = substring_dedup.SuffixAutomaton()
    for s in seqs:
        a.add(s)
    known = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rnd.choice("abcd") for _ in range(300)]
    for end, n in enumerate(a.matching(text), 1):
        assert n == max((k for k in range(1, end + 1) if tuple(text[end - k : end]) in known), default=0)


ITEM = "A train with Anna goes 120 km in 3 hours from Berlin to Paris, how fast is the train with Anna going on this way?"


def test_templates():
    b = decontamination.Benchmark([("q", ITEM)])
    other = ITEM.replace("Anna", "Bella").replace("120", "450").replace("3 hours", "7 minutes").replace("Berlin", "Rome")
    assert b.find(ITEM.encode(), 0.5) == [("q", 1.0)]
    assert b.find(f"Some words before. {other} And after.".encode(), 0.5) == [("q", 1.0)]
    mixed = other.replace("Bella going", "Carla going")  # Anna can't be both
    assert b.find(mixed.encode(), 0.0)[0][1] < 1.0
    assert b.find(b"nothing of the kind is said in these words at all", 0.0) == []
    short = decontamination.Benchmark([("x", "One two."), ("y", None), ("z", "...")])
    assert short.find(b"one two", 0.5) == [("x", 1.0)] == short.find(b"said:\n One, TWO \nand more", 0.5)
    assert short.find(b"and then one two of them", 0.5) == [] == short.find(b"", 0.5)


def test_verbatim_items_are_found():
    items = [("sum", "Compute 12 + 35 - 7 * 4 + 18"), ("names", "Who wrote Pride And Prejudice, Jane Austen or Charlotte Brontë?")]
    b = decontamination.Benchmark(items)
    for id_, text in items:
        assert b.find(f"somewhere in between stands {text} and it goes on".encode(), 0.5) == [(id_, 1.0)]
    assert b.find(b"Compute 99 + 36 - 8 * 5 + 19", 0.0) == [] and b.find("Who wrote War And Peace, Leo Tolstoy or Fyodor Dostoevsky?".encode(), 0.5) == []
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    b = decontamination.Benchmark([("long", " ".join(words))])
    assert b.find(" ".join(["before", *words[20:45], "after"]).encode(), 0.5) == [("long", 25 / 59)]
    assert b.find(" ".join(["before", *words[20:32], "after"]).encode(), 0.5) == []


def test_contamination(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: set(r["items"]) for r in registry.op5_decontamination(spark, d).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    exact = {r["doc_id"]: {i for i, t in items if t in r["text"]} for r in docs.collect()}
    assert all(exact[i] <= got[i] for i in exact) and sum(bool(got[i]) and not exact[i] for i in got) <= 3
    few = decontamination.contamination(docs.withColumn("_items", F.lit(1)), bench, most_items=7)
    assert {r["doc_id"]: {x["item"] for x in r["__items"]} for r in few.collect()} == got
    odd = spark.createDataFrame([(1, None), (1, items[0][1]), (None, "")], "doc_id bigint, text string")
    assert decontamination.drop_contaminated(odd, bench).count() == 2
    assert decontamination.drop_contaminated(odd, bench.limit(0)).count() == 3
    assert decontamination.drop_contaminated(odd.limit(0), bench).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    first = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if first[i] == i]
    removed = slow_removed(rows)
    texts = {}
    out = corpus_pipeline.run(spark, sf)
    own = registry.bpe.load(registry.BYTE_BPE)
    for r in out.collect():
        texts[r["doc_id"]] = own.decode(r["ids"])
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    bench = decontamination.Benchmark([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    for i, t in rows:
        if i in texts:
            assert hashlib.sha256(b" ".join(texts[i].encode().split())).hexdigest() == removed[i][2]
            assert not bench.find(texts[i].encode(), 0.5)
    lost = {i for i, _ in rows} - set(texts)
    assert set(texts) <= {i for i, _ in rows} and all(bench.find(dict(rows)[i].encode(), 0.4) for i in lost)
    state = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        state = stage(spark, state, sf)
        assert state.columns == docs.columns and state.dtypes == docs.dtypes, k
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_hot_top_nodes_are_split(spark):
    """With a bound of a few entries all nodes are split twice, and no link is lost."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(30)})
    entries = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp bigint, rep bigint")
    scratch = Scratch(spark)
    tops = entries.select(F.inline(simhash.top_nodes()), "fp", "rep")
    for most in (10**9, 2, 0):
        rows = simhash.split_nodes(tops, most, scratch)
        stars = rows.select("top", "fp", "rep").repartition("top").sortWithinPartitions("top").mapInArrow(simhash._stars, "a long, b long")
        found = {r["node"]: r["component"] for r in components(stars, scratch).collect()}
        want = slow_components(list(enumerate(fps)))
        assert {i: found.get(i, i) for i in want} == want, most


def test_rows_of_a_repeated_id_are_judged_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "a"), (5, long, "b"), (5, "quite another text that nobody else has written", "c"), (5, "quite another text that nobody else has written", "d"), (7, "third", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert got == sorted([rows[0][:2], rows[2][:2], rows[4][:2]])
