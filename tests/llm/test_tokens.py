import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from motionframe.llm import packing, pieces, token_output
from motionframe.llm.tokens import Encoder
from tests.llm.helpers import documents, prose, saved

ODD = ["", None, " ", "a", " a", "a ", "\n", "a\n", "\na", "a  b", "a \n b", "it's we'll", "<|endoftext|> x", "x <|endoftext|> y", "a<|ENDOFTEXT|>b <|startoftext|>", "漢字 é ß µ", "x" * 5000, "1 22 333", "\tz\x1cq", "▁lit", prose(1, 6000)]


def fuzz(n, seed):
    rnd = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "a", "é", "1", " 's", "'t", "\xa0", "\x1c", "́", "İ", "Σ", "ß", "漢", "🙂", "-", "\x85", "A.", "ab", "'ll"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(n)]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaceless"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_give_the_library_s_ids(name, spaceless):
    own, whole = Encoder(name, spaceless), library(name)
    for text in [t or "" for t in ODD] + fuzz(1500, 3):
        assert own.encode(text).tolist() == whole(text), repr(text[:60])


def test_words_are_forgotten_and_found_again():
    own, whole = Encoder("word_bpe_49k.json", True, most=100), library("word_bpe_49k.json")
    for text in [prose(i, 300) for i in range(5)] + fuzz(200, 4):
        assert own.encode(text).tolist() == whole(text), repr(text[:60])
        assert len(own.first) <= 100


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_output.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_output.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(tmp_path, bits):
    rng, path = np.random.default_rng(2), str(tmp_path / "f")
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 5, 300, 1, 0, 64, 129)]
    with pafs.LocalFileSystem().open_output_stream(path) as f:
        w = token_output.ShardWriter(f, bits, 64)
        for i, d in enumerate(docs):
            w.add(None if i == 3 else i, d)
        w.close()
    with pafs.LocalFileSystem().open_input_file(path) as f:
        r, whole = token_output.ShardReader(f), np.concatenate(docs)
        for a, b in [(0, 0), (0, 499), (63, 65), (64, 128), (200, 201), (498, 499)]:
            assert (r.ids(a, b) == whole[a:b]).all()
        assert r.valid.tolist() == [True] * 3 + [False] + [True] * 3
        assert [d.tolist() for _, d in r.documents(70)] == [d.tolist() for d in docs]


def test_op1(spark, tmp_path):
    texts = ODD + [prose(i, 50) for i in range(60)]
    shuffled = documents(spark, texts).orderBy("text").repartition(5)
    got = {r.doc_id: r for r in token_output.op1_token_output(spark, saved(spark, tmp_path, shuffled)).collect()}
    start, whole = 0, library("byte_bpe_50k.json")
    for i, t in enumerate(texts):
        ids = [*whole(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_without_rows_and_ids(spark):
    docs = documents(spark, ["a b", "c"])
    assert token_output.read_shards(spark, token_output.write_shards(docs.where("false"))).count() == 0
    nulls = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text").union(docs.select("doc_id", "text")).union(docs.select("doc_id", "text"))
    got = token_output.read_shards(spark, token_output.write_shards(nulls)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 0, 0, 1, 1]


def test_op1_deals_one_id_over_several_files(spark):
    docs = spark.createDataFrame([(7, prose(i, 20)) for i in range(60)] + [(None, prose(i, 20)) for i in range(60, 120)] + [(i, "x") for i in (1, 5, 9, 12)], "doc_id long, text string")
    shards = token_output.write_shards(docs, shards=8)
    assert len(shards.files) > 4 and max(d for _, d, _ in shards.files) < 45
    got = token_output.read_shards(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 60 + [1, 5] + [7] * 60 + [9, 12]
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:k]) for k in range(len(got))]


def check_packing(rows, texts):
    whole, by_doc, by_seq = library("word_bpe_49k.json"), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*whole(t), 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        assert [(r.length, r.ids_crc32) for r in own] == [(len(p := ids[r.start : r.start + 4096]), zlib.crc32(p.tobytes())) for r in own]
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 4096
    return len(by_seq)


@pytest.mark.parametrize("pool", [60_000, 15])
def test_op5(spark, pool):
    rnd = random.Random(4)
    texts = ODD + [prose(i, rnd.randrange(1, 900)) for i in range(150)] + [prose(1, 20)] * 30
    rows = packing.best_fit_packing(documents(spark, texts), pool_docs=pool).collect()
    n = check_packing(rows, texts)
    least = -(-sum(r.length for r in rows) // 4096)
    assert n <= least * (1.02 if pool > 1000 else 1.2) + 1
    assert packing.best_fit_packing(documents(spark, texts).where("false")).count() == 0


def test_op5_repeated_and_null_ids(spark):
    docs = documents(spark, [prose(1, 5000)]).select("doc_id", "text")
    rows = packing.best_fit_packing(docs.union(docs).union(docs.selectExpr("CAST(NULL AS long)", "text"))).collect()
    full = [r for r in rows if r.length == 4096]
    assert len({r.sequence_id for r in full}) == len(full) == len(rows) - 3


def test_op5_carries_the_ids_of_its_sequences(spark):
    texts = ODD + [prose(i, 30 + 40 * i) for i in range(40)] + [prose(1, 20)] * 5
    docs = documents(spark, texts).select("doc_id", "text")
    rows = packing.best_fit_packing(docs.union(docs.where("doc_id < 20")).repartition(3), pool_docs=20).collect()
    whole = library("word_bpe_49k.json")
    sequences, found = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        sequences[r.sequence_id] = sequences.get(r.sequence_id, []) + np.frombuffer(bytes(r.ids), "<u4").tolist()
    for r in rows:
        found.setdefault((r.doc_id, r.start), []).append(sequences[r.sequence_id][r.offset : r.offset + r.length])
    for i, t in enumerate(texts):
        ids = [*whole(t), 1]
        for s in range(0, len(ids), 4096):
            assert found.pop((i, s)) == [ids[s : s + 4096]] * (2 if i < 20 else 1)
    assert not found and max(map(len, sequences.values())) <= 4096


def test_local_search_empties_bins():
    lengths = [60, 30, 40, 70, 30, 50, 20]
    bins = [[0, 1], [2, 4], [3], [5], [6]]  # 90, 70, 70, 50, 20
    left = packing.local_search(bins, lengths, 100)
    assert sorted(i for b in left for i in b) == list(range(7)) and len(left) == 3
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 60))]
        out = packing.pack(sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in out)
        assert len(out) <= len(packing.best_fit(sizes, 100))


def least_bins(sizes, capacity):
    """The fewest bins, by trying every subset that can be the rest of a packing."""
    n, best = len(sizes), {0: (0, capacity)}  # subset to (bins, fill of the last one), the least
    for subset in range(1, 1 << n):
        options = []
        for i in range(n):
            if subset >> i & 1:
                bins, fill = best[subset ^ (1 << i)]
                options.append((bins, fill + sizes[i]) if fill + sizes[i] <= capacity else (bins + 1, sizes[i]))
        best[subset] = min(options)
    return best[(1 << n) - 1][0]


def test_packing_against_the_optimum():
    rnd, over = random.Random(8), 0
    for _ in range(60):
        sizes = [rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 10))]
        n, least = len(packing.pack(sizes, 100)), least_bins(sizes, 100)
        assert least <= n <= least + 1
        over += n - least
    assert over <= 3


def pieces_of(rows):
    return {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows}


def test_op9(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    texts = [t for t in ODD if t is None or len(t) < 8000] + fuzz(200, 8) + ["word " * 300]
    docs = documents(spark, texts)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = pieces_of(pieces.encode(docs, dropout=0.0).collect())
    assert all(plain[i] == sp.encode(t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    first = pieces_of(pieces.encode(docs).collect())
    assert first == pieces_of(pieces.encode(docs.repartition(7)).collect())
    assert first != pieces_of(pieces.encode(docs, seed=1).collect()) and first != plain
    spelt = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert spelt == {i: t or "" for i, t in enumerate(texts)}
    rows = pieces.op9_merge_dropout(spark, saved(spark, tmp_path, docs)).collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)
    assert pieces.encode(docs.where("false")).count() == 0


def test_agendas_in_step_equal_the_heap():
    m = pieces.model("piece_bpe_32k.model")
    rnd = random.Random(6)
    words = [" " + "".join(rnd.choice("thein gar oés\n漢") for _ in range(rnd.randrange(31))) for _ in range(800)]
    for rate in (0.0, 0.1, 0.5, 1.0):
        got = pieces.many_words(m, words, 3, 1, rate)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [pieces.one_word(m, w, 3, 1, rate) for w in words]
    assert pieces.one_word(m, " " + "ab" * 20_000, 1, 0, 0.1)


def test_dropout_is_drawn_for_each_word_of_each_document():
    m, word = pieces.model("piece_bpe_32k.model"), " international"
    own = pieces.Encoder("piece_bpe_32k.model", 3, 0.3)
    texts = [word[1:] + word * 60 for _ in range(40)] + ["x" * 50 + word * 3, "", "a  b\nthe thing " + "y" * 40]
    got = own.encode([*range(40), None, 41, 42], texts)
    for d, (t, ids) in enumerate(zip(texts, got, strict=True)):
        if d != 40:
            assert np.frombuffer(ids, "<u4").tolist() == [x for k, w in enumerate(own.words(t) if t else []) for x in pieces.one_word(m, w, 3, d, 0.3, k)]
    ways = [{tuple(pieces.one_word(m, word, 3, d, 0.3, k)) for k in range(61)} for d in range(40)]
    assert min(map(len, ways)) > 4 and len(set().union(*ways)) > 20 and len(set(got[:40])) == 40


def test_one_long_word_has_many_segmentations(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'internationalisation' AS text")
    rows = pieces.encode(docs).collect()
    assert len({bytes(r.ids) for r in rows}) > 200
    half = pieces.encode(docs, dropout=0.5)
    assert len({bytes(r.ids) for r in half.collect()}) > 1000
    assert {r.text for r in pieces.decode(half).collect()} == {"internationalisation"}


def test_agendas_forget_and_learn_again(monkeypatch):
    m, words = pieces.model("piece_bpe_32k.model"), [" international", " things", " and"] * 50
    monkeypatch.setattr(pieces, "NODES", 20)
    own = pieces.Agendas(m)
    for d in range(20):
        keys = pieces.word_keys(np.full(len(words), pieces.doc_key(5, d), np.uint64), np.arange(len(words)))
        got = own.segmented(words, keys, 0.4)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [pieces.one_word(m, w, 5, d, 0.4, k) for k, w in enumerate(words)]
