import collections
import hashlib
import importlib.util
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from motionframe.llm import exact_dedup, near_dedup, suffix_dedup
from motionframe.llm.components import components
from motionframe.llm.shingles import shingle_sets
from motionframe.llm.suffix_array import repeated, suffix_array
from tests.llm.helpers import WHITE, documents, edited, linked_components, near_components, prose, saved, shingles


def test_hashing_keeps_little_memory():
    spec = importlib.util.find_spec("motionframe.llm.shingles")
    fresh = importlib.util.module_from_spec(spec)  # as in a new worker
    spec.loader.exec_module(fresh)
    texts = pa.array([prose(1, 50), prose(2, 300), "a b c"])
    tracemalloc.start()
    try:
        sets = fresh.shingle_sets(texts)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 2e6 and all((a == b).all() for a, b in zip(sets, shingle_sets(texts), strict=True))
    long = pa.array([prose(3, 60_000)])  # more powers than are held by now
    assert len(fresh.shingle_sets(long)[0]) == len(shingles(long[0].as_py()))


def test_near_dedup_hashes_small_parts(monkeypatch):
    asked = []
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda texts: asked.append(sum(len(t.as_py()) for t in texts)) or shingle_sets(texts))

    class Docs:
        mapInArrow = staticmethod(lambda task, schema: task)

    whole = [prose(i, 300) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(whole), pa.array(range(1000))], names=["doc_id", "text", "text_key"])
    got = pa.Table.from_batches(near_dedup.signatures(Docs)(iter([batch])))
    assert got.column("doc_id").to_pylist() == list(range(1000)) and got.column("n").to_pylist() == [len(shingles(t)) for t in whole]
    assert sum(asked) == sum(map(len, whole)) > 3 * max(asked) and max(asked) < 300_000


def test_op8(spark, tmp_path):
    texts = ["a b", "a  b", "a\t\nb", "A b", None, "", "c"] + ["hot copy"] * 200 + [prose(i % 7, 40) for i in range(30)] + ["\xa0", "x" * 100_000]
    got = {r.doc_id: r for r in exact_dedup.op8_exact_dedup(spark, saved(spark, tmp_path, documents(spark, texts).repartition(9))).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[WHITE.sub(" ", t or "")].append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (ids[0], len(ids), i == ids[0], hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize(("slots", "tracked"), [(1, 8), (4, 8), (50, 64)])
def test_op8_with_few_counters(spark, slots, tracked):
    texts = [f"t{i % k}" for k in (2, 5, 40) for i in range(80)]
    got = exact_dedup.exact_dedup(documents(spark, texts).repartition(6), heavy_slots=slots, tracked=tracked).collect()
    times = collections.Counter(texts)
    assert all(r.group_size == times[texts[r.doc_id]] and r.keep_id == texts.index(texts[r.doc_id]) for r in got)


def test_op8_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 3, 4, False)] * 2 + [(3, 3, 4, True)] * 2 + [(None, None, 1, True)], key=str)
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


def test_shingle_sets():
    texts = ["A b c d e f", "a b c d e f", "a b", "A  B", "", " \n", "a", "é É x y z", "one two three four five one two three four five one two three four five", prose(1, 3000)]
    sets = shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all() and not np.intersect1d(sets[2], sets[6]).size
    assert [len(s) for s in shingle_sets(pa.array(["x"] + texts, pa.large_string()).slice(1))] == [len(s) for s in sets]
    assert len(shingle_sets(pa.array(["ab", "cd"]))[0]) == 1


def near_texts(seed, groups, size):
    out = []
    for g in range(groups):
        base = prose(1000 * seed + g, 60 + 40 * (g % 5))
        out += [edited(base, 100 * g + k, k % 6) for k in range(size)]
    return out


@pytest.mark.parametrize("node", [128, 6])
def test_op2(spark, tmp_path, monkeypatch, node):
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "BLOCK", 2 * node)
    monkeypatch.setattr(near_dedup, "STAR_BLOCK", 2 * node)
    passage = prose(77, 40)
    texts = near_texts(1, 12, 7) + [passage + " " + prose(500 + i, 150) for i in range(30)] + ["a b", "A b", "a", "", None, " ", "a b"] + [prose(9, 80)] * 25 + [prose(3, 20_000)]
    texts += [edited(prose(55, 120), i, i % 5) for i in range(60)]
    got = {r.doc_id: r for r in near_dedup.op2_near_dedup(spark, saved(spark, tmp_path, documents(spark, texts).repartition(5))).collect()}
    want = near_components(dict(enumerate(texts)))
    for i, t in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(t)), want[i], want[i] == i), t and t[:50]


def test_op2_nulls_repeats_and_no_rows(spark):
    same = prose(1, 30)
    docs = spark.createDataFrame([(None, same), (5, same), (5, same), (2, same), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 2, False), (5, 2, False), (2, 2, True), (9, 9, True)], key=str)
    assert near_dedup.near_dedup(docs.where("false")).count() == 0


def test_op2_unlike_texts_of_one_id_in_any_order(spark):
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(7, a), (7, b), (7, None), (3, b), (9, edited(a, 1, 1)), (12, edited(b, 2, 1)), (5, c), (8, c), (8, edited(prose(24, 80), 1, 1)), (4, prose(24, 80)), (6, ""), (20, a)]
    want = {(i, c, i == c) for i, c in [(7, 3), (3, 3), (9, 3), (12, 3), (20, 3), (5, 4), (8, 4), (4, 4), (6, 6)]}
    a, b, tail = prose(31, 100), prose(32, 100), " " + prose(33, 8)
    rows += [(101, a), (101, b), (102, a + tail), (103, b + tail), (104, a), (105, b)]
    want |= {(i, 101, i == 101) for i in range(101, 106)}
    for k in range(2):
        docs = spark.createDataFrame(rows[:: 1 - 2 * k], "doc_id long, text string")
        assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()} == want


def test_op2_chain_of_boilerplate_costs_its_neighbours(spark, monkeypatch):
    """Each document shares four fifths of its words with the next: nothing is linked, and no pairs of the whole chain arise."""
    made = {}
    real = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: made.setdefault(tag, real(df, tag)) if tag in ("stars", "other-pairs", "sets") else real(df, tag))
    blocks = [prose(900 + i, 40) for i in range(1204)]
    docs = documents(spark, [" ".join(blocks[i : i + 5]) for i in range(1200)])
    got = near_dedup.near_dedup(docs).collect()
    assert all(r.kept for r in got)
    assert made["stars"].count() + made["other-pairs"].count() < 4 * 1200 and made["sets"].count() <= 1200


def test_op2_loose_group(spark, monkeypatch):
    """A cloud of documents around similarities of the threshold: no pairs of the whole cloud arise, and no link is lost."""
    made = {}
    real = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: made.setdefault(tag, real(df, tag)) if tag in ("open-pairs", "stars", "members") else real(df, tag))
    base = prose(5151, 150)
    texts = [edited(base, i, 2 + i % 5) for i in range(260)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(documents(spark, texts)).collect()}
    assert got == near_components(dict(enumerate(texts)))
    assert made["open-pairs"].where("watched = 0").count() + made["stars"].count() < 8 * 260 and made["members"].count() <= 260


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(0, 200, 40)]
    got = near_dedup.intersections(sets, wide=64)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7000, i) for i in range(7001, 7100)]
    got = {r.v: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: c for i, c in linked_components([p for p in pairs if p[0] != p[1]], ids).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in [*range(24), 61, 200]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffix_array(s, 10**6).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
            for length in (2, 7):
                valid = np.zeros(n, bool)
                valid[: max(0, n - length + 1)] = rng.random(max(0, n - length + 1)) < 0.8
                times = collections.Counter(tuple(s[i : i + length]) for i in np.flatnonzero(valid))
                assert repeated(s, valid, length).tolist() == [bool(valid[i]) and times[tuple(s[i : i + length])] > 1 for i in range(n)]


def brute_removed(texts, window=200):
    data = [(t or "").encode() for t in texts]
    times = collections.Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if times[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        left = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("group", [128, 3])
def test_op10(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rnd = random.Random(5)
    letters = lambda n, of="xyz ": "".join(rnd.choice(of) for _ in range(n))
    base = letters(700, "abcdé ")
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 2000, "q" * 900, base, base, base[100:420], letters(1000), "k" * 150, "k" * 150]
    texts += [letters(rnd.randrange(200)) + base[(a := rnd.randrange(450)) : a + rnd.randrange(150, 260)] + letters(rnd.randrange(200)) for _ in range(60)]
    texts += [letters(50, "uv") + base[200:405] + letters(50, "uv") for _ in range(30)]
    got = {r.doc_id: r for r in suffix_dedup.op10_suffix_dedup(spark, saved(spark, tmp_path, documents(spark, texts).repartition(5))).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def test_op10_nulls_repeats_and_no_rows(spark):
    long = prose(1, 100)
    docs = spark.createDataFrame([(None, long), (1, prose(2, 100)), (1, prose(2, 100)), (2, prose(3, 60))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed == r.n_bytes) for r in suffix_dedup.suffix_dedup(docs).collect()), key=str)
    assert got == sorted([(None, False), (1, True), (1, True), (2, False)], key=str)
    assert suffix_dedup.suffix_dedup(docs.where("false")).count() == 0
