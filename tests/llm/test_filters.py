import datetime
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionframe.llm import pii, topk_search, toxicity, url_filter
from tests.llm.helpers import documents, prose, saved

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def fuzz(n, seed):
    rnd = random.Random(seed)
    bits = ["a", "@", ".", "-", "1", "9", " ", "+", "(", ")", "é", "🙂", "4", "0", "%", "_", "12", "255", "256", "\n", "'", '"', "x.y", "4111 1111 1111 1111"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_op4_base_spans(spark, tmp_path):
    texts = fuzz(1500, 2) + [None, "", "1" * 30_000, "a" * 50_000, "@" * 3000, "+1" * 4000, "1." * 4000, "a@b.c@d.e a@b.com%x@y.z", "é🙂 1.2.3.004 0000255.1.1.1 1.2.3.4.5.6.7.8", "+1 (017) 555-7713."]
    got = {r.doc_id: r for r in pii.op4_pii(spark, saved(spark, tmp_path, documents(spark, texts).repartition(4))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = base_spans(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in BASE)
        assert r.spans.split(",")[: len(want)] == (want or r.spans.split(",")[:0])


def test_op4_adds_what_the_labelers_agree_on(spark):
    secrets = [f'so token = "{hashlib.sha1(b"%d" % i).hexdigest()}" it is' for i in range(30)]
    plain = [f'he said "{"verylongwordwithoutdigits" * 2}" and left' for _ in range(30)]
    found = pii.find_pii(documents(spark, secrets + plain)).orderBy("doc_id").collect()
    assert all([s.kind for s in r.added] == (["secret"] if r.doc_id < 30 else []) for r in found)
    s = found[0].added[0]
    text = secrets[found[0].doc_id]
    assert text[s.start : s.end].strip('"') == hashlib.sha1(b"%d" % found[0].doc_id).hexdigest()


def test_op4_candidates_without_quotes_and_of_any_length(spark):
    key = hashlib.sha512(b"k").hexdigest() * 4
    texts = [f'api_key = "{key}" it is', "password: hunter2secret99xk31ab0 and on", "version 12345678901234 of it", "the token bus"] * 12
    found = pii.find_pii(documents(spark, texts)).collect()
    for r in found:
        spans = [texts[r.doc_id][s.start : s.end] for s in r.added if s.kind == "secret"]
        assert spans == ([[f'"{key}"'], ["hunter2secret99xk31ab0"], [], []][r.doc_id % 4])


def test_op4_added_spans_are_the_classifier_s(spark, tmp_path):
    """Brute force: candidates found by the patterns, each taken or not by its features."""
    texts = fuzz(400, 5) + [f'k token = "{hashlib.sha1(b"%d" % i).hexdigest()}" 4785380592391{i:03d} w' for i in range(40)]
    docs = documents(spark, texts)
    spans = {r.doc_id: r.spans for r in pii.proposed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    counts = {}
    for own in spans.values():
        for s in own:
            counts[s.kind, s.votes, s.flags] = counts.get((s.kind, s.votes, s.flags), 0) + 1
    rule = pii.trained([(*k, n) for k, n in counts.items()])
    for r in pii.find_pii(docs).collect():
        t, want = texts[r.doc_id], []
        for m in re.finditer(r"""["'][A-Za-z0-9+/_-]{16,}["']""", t):
            want.append(("secret", m.start(), m.end()))
        for m in re.finditer(r"[0-9](?:[ -]?[0-9]){12,}", t):
            d = re.sub("[^0-9]", "", m[0])
            if not (13 <= len(d) <= 19 and luhn(d)) and not re.search(r"[^\W\d]$", t[: m.start()]) and not re.match(r"[^\W\d]", t[m.end() :]):
                want.append(("number", m.start(), m.end()))
        by_place = {(s.kind, s.start, s.end): s for s in spans[r.doc_id] if not s.base}
        assert sorted(by_place) == sorted(want), t
        assert [tuple(s) for s in r.added] == sorted(k for k, s in by_place.items() if rule.takes(k[0], s.flags))


def test_op4_many_matches_in_a_text(spark):
    n = 100_000
    text = " ".join(f"é{i % 10}@b.co" for i in range(n))
    docs = documents(spark, [text])
    start = time.perf_counter()
    (r,) = pii.find_pii(docs).select(F.size("base").alias("n"), F.expr("base[99999].start").alias("last")).collect()
    assert (r.n, r.last) == (n, len(text) - 6)
    out = pii.redact(docs.limit(1)).select("text").collect()[0].text
    assert out == re.sub(BASE["email"], "[EMAIL]", text)
    assert time.perf_counter() - start < 60


def test_reliabilities_follow_the_votes():
    p = pii.reliabilities([("k", "1111", 50), ("k", "1121", 10), ("k", "0000", 60), ("k", "0200", 5), ("k", "1100", 1)])
    assert p["k", "1111"] > 0.95 and p["k", "1121"] > 0.9 and p["k", "0000"] < 0.05 and p["k", "0200"] < 0.1
    assert pii.reliabilities([]) == {}


def test_redaction(spark):
    texts = ["mail a.b@c.de now", "é 4111 1111 1111 1111!", "ip 1.2.3.4 and +1 (017) 555-7713", None, "plain", ""]
    docs = documents(spark, texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "mail [EMAIL] now", 1: "é [CARD]!", 2: "ip [IP] and [PHONE]", 3: None, 4: "plain", 5: ""}
    assert pii.redact(docs.where("false")).count() == 0 and pii.find_pii(docs.where("false")).count() == 0


BAD = ["grubbel", "snarv", "plock"]


def labelled(n, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = prose(i, rnd.randrange(20, 200)).split()
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "ing", "o,"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_op3_held_out_accuracy(spark, tmp_path):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, saved(spark, tmp_path, docs.repartition(4), labels=labels)).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for i, r in got.items() if i is not None and i < 900) == len(held)
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.95
    assert got[900].score == got[901].score < 0.5


def test_labels_of_the_held_out_rows_are_not_seen(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = lambda flip: spark.createDataFrame([(i, (1 - y) if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.train(docs, marks(False)) == toxicity.train(docs, marks(True))


def test_grammar():
    stems = {"fool": (toxicity.FIRST_STEM, 2.0), "idio*": (toxicity.FIRST_STEM + 1, 3.0)}
    lexicon, weight = toxicity.Lexicon(stems), dict(stems.values())

    def kinds(text):
        symbols = b"".join(map(lexicon.__getitem__, text.split()))
        return [(k, w) for c in symbols.split(b"\n") for _, k, w in toxicity.matches(c, weight)]

    assert kinds("a fool.") == [("plain", 2.0)] and kinds("You fool!") == [("aimed", 2.0)] and kinds("such an idiotic thing") == [("plain", 3.0)]
    assert kinds("never a fool") == [("negated", 2.0)] and kinds("never. A fool") == [("plain", 2.0)]
    assert kinds("he said a fool") == [("reported", 2.0)] and kinds("kill time") == [] and kinds("I will kill you") == [("threat", 1.0)]
    assert kinds("ein fool bist du") == [("aimed", 2.0)] and kinds("jamais un fool") == [("negated", 2.0)] and kinds("según ella un fool") == [("reported", 2.0)]
    assert kinds("you | fool |") == [("aimed", 2.0)] and kinds("you. | fool") == [("plain", 2.0)]  # a lone mark ends no clause
    assert [m[0] for m in toxicity.judged("a b. you fool! x\ny fool", lexicon, weight)[1]] == [3, 6]


def test_composition_equals_one_transducer_after_the_other():
    rnd = random.Random(4)
    a, b, c = toxicity.near(toxicity.TARGET, toxicity.AIMED), toxicity.near(toxicity.NEGATION, toxicity.NEGATED, 2), toxicity.since(toxicity.REPORT, toxicity.REPORTED)
    both = toxicity.composed(toxicity.composed(a, b), c)
    assert len(both.step) <= len(a.step) * len(b.step) * len(c.step)
    for _ in range(400):
        s = bytes(rnd.choice((0, 0, 0, 1, 2, 3, 4, 5)) for _ in range(rnd.randrange(30)))
        assert both.run(s) == c.run(bytes(b.run(bytes(a.run(s)))))


def test_grammar_by_enumeration():
    """Each hit's marks as a search over all symbols before and behind it says."""
    rnd, t = random.Random(9), toxicity
    byte = {**t.BYTES, t.INSULT: t.FIRST_STEM}
    for _ in range(600):
        s = [rnd.choice((0, 0, 0, 0, 1, 2, 3, 4, 5)) for _ in range(rnd.randrange(40))]
        want = []
        for i, x in enumerate(s):
            aimed = any(y == t.TARGET and 0 < abs(i - j) <= t.REACH for j, y in enumerate(s))
            negated = any(y == t.NEGATION and 0 < i - j <= t.REACH for j, y in enumerate(s))
            reported = t.REPORT in s[:i]
            if x == t.INSULT or (x == t.THREAT and aimed):
                want.append((i, "reported" if reported else "negated" if negated else "threat" if x == t.THREAT else "aimed" if aimed else "plain", 1.0))
        assert list(t.matches(bytes(byte[x] for x in s), {})) == want


def test_remembered_words_take_little_memory():
    lexicon = toxicity.Lexicon({"fool": (toxicity.FIRST_STEM, 2.0)})
    tracemalloc.start()
    try:
        for i in range(400_000):
            lexicon[f"word{i}."]
        lexicon.clear()
        for i in range(lexicon.most):
            lexicon[f"word{i}."]
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 16e6 and lexicon["fool."] == bytes([toxicity.FIRST_STEM]) + b"\n"


def test_a_clause_of_a_million_words_takes_linear_time():
    lexicon = toxicity.Lexicon({"fool": (toxicity.FIRST_STEM, 2.0)})
    start = time.perf_counter()
    x, found = toxicity.judged("you fool " * 500_000, lexicon, {toxicity.FIRST_STEM: 2.0})
    assert len(found) == 500_000 and np.isfinite(x).all() and time.perf_counter() - start < 8


def test_the_sample_is_bounded_and_its_offset_put_right(spark, monkeypatch):
    rows = labelled(400) + [(5, "other text of one id", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, shares = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic")
    assert shares == (1.0, 1.0) and len(whole) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    monkeypatch.setattr(toxicity, "MOST_BYTES", 50_000)
    few, shares = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic")
    assert sum(len(t.encode()) for t, _ in few) <= 50_000 and len(few) < len(whole) and max(shares) < 1
    one, half = toxicity.fit(whole), toxicity.fit(whole, (0.5, 1.0))
    assert one.weights[1:] == half.weights[1:] and abs(half.weights[0] - one.weights[0] - np.log(0.5)) < 1e-9


def test_op3_without_labels(spark):
    docs = documents(spark, ["a", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [(r.score, r.n_matches) for r in toxicity.toxicity(docs, model).collect()] == [(0.5, 0), (0.5, 0)]
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def brute_topk(vectors, k=10):
    import math

    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, a in q:
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in q if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_op6(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    f = lambda v: [float(np.float32(x)) for x in v]
    vectors = [(i, f(rng.normal(size=8) * (rng.random(8) < 0.6))) for i in range(330)] + [(1000 + i, f([0.5] * 8)) for i in range(20)]
    vectors += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, []), (None, f([1] * 8)), (2000, f([1, 2]))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, rank string, score int").repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in topk_search.op6_topk_search(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == brute_topk(vectors)
    few = topk_search.topk_search(df.where("vec_id < 4"), df.where("vec_id = 0"))
    assert few.count() == 3
    assert topk_search.topk_search(df.where("false"), df.where("false")).count() == 0


def test_op6_great_weights(spark):
    import numpy as np

    rows = [(0, [1.0, 2.0]), (1, [3e6, 1.0]), (2, [1.0, 1.0]), (3, [-3e6, 5.0]), (4, [0.5, 2e3]), (100, [2e6, -2.0]), (200, [2e6, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.topk_search(df, df.where("vec_id % 100 = 0"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == brute_topk(rows, 4) and got[0][0][1] == 1
    far = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk_search.topk_search(far, far).collect()
    assert topk_search.Rows(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[float(np.nextafter(0, 1)), -1e-9]])], names=["a", "b"])).weight.tolist() == [-1]


@pytest.mark.parametrize(("block", "held"), [(7, 2), (7, 16), (8192, 16)])
def test_op6_blocks(spark, monkeypatch, block, held):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk_search, "HELD_BLOCKS", held)
    rows = spark.createDataFrame([(i, [float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>").coalesce(1)
    got = [r.vec_id for r in topk_search.topk_search(rows, rows.where("vec_id = 4")).orderBy("rank").collect()]
    assert got == [9, 14, 19, 24, 29, 34, 39, 44, 49, 54]


def test_op7(spark):
    day = lambda s: datetime.date.fromisoformat(s)
    log = spark.createDataFrame(
        [("bad.org", day("2024-01-10"), "add", "spam"), ("bad.org", day("2024-02-01"), "remove", "spam"), ("bad.org", day("2024-03-01"), "add", "again"),
         ("x.bad.org", day("2024-01-20"), "add", "sub"), ("ok.org/ads", day("2024-01-01"), "add", "path"), (None, day("2024-01-01"), "add", "z"),
         ("same.org", day("2024-01-01"), "add", "a"), ("same.org", day("2024-01-01"), "remove", "a")],
        "entry string, day date, action string, category string",
    )
    cases = [
        ("http://bad.org/", "2024-01-09", None), ("http://bad.org/", "2024-01-10", "spam"), ("http://bad.org/", "2024-01-31", "spam"), ("http://bad.org/", "2024-02-01", None),
        ("http://BAD.org:80/a", "2024-04-01", "again"), ("https://u:p@x.bad.org/q", "2024-01-25", "sub"), ("http://x.bad.org", "2024-01-15", "spam"), ("http://notbad.org/", "2024-01-15", None),
        ("http://ok.org/ads/1", "2024-05-01", "path"), ("http://ok.org/adsx", "2024-05-01", None), ("http://same.org/", "2024-05-01", None), (None, "2024-05-01", None), ("junk", "2024-05-01", None), ("http://bad.org/", None, None),
    ]
    rows = [(i, u, d and day(d), "x") for i, (u, d, _) in enumerate(cases)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, day date, entry string")
    got = url_filter.url_filter(captures, log).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        assert (r.category, r.kept) == (cases[r.page_id][2], cases[r.page_id][2] is None), cases[r.page_id]
    assert url_filter.url_filter(captures, log.where("false")).where("kept").count() == len(got)
    assert url_filter.url_filter(captures.where("false"), log).count() == 0


def test_op7_hot_keys_and_long_urls(spark):
    rows = [(f"h{i}.hot.org", "s", datetime.date(2024, 1, 1 + i % 9)) for i in range(300)] + [("a.cold.net", "s", datetime.date(2024, 1, 2))]
    asked = spark.createDataFrame(rows, "host string, segment string, day date").withColumn("entry", F.explode(url_filter.keys_of(F.col("host"), F.col("segment"))))
    spans = spark.createDataFrame([(e, c, datetime.date(2024, 1, 1), datetime.date(2024, 1, 5)) for e, c in (("hot.org", "x"), ("hot.org", "y"), ("cold.net", "z"), ("h1.hot.org", "w"))], "entry string, category string, from_day date, to_day date")
    want = sorted(tuple(r) for r in asked.join(spans, "entry").select("host", "day", "entry", "category").collect())
    for hot_rows, hot_keys in ((100_000, 10_000), (20, 10_000), (20, 1), (200, 5)):
        got = url_filter.salted(asked, spans, hot_rows, hot_keys).select("host", "day", "entry", "category").collect()
        assert sorted(tuple(r) for r in got) == want
    long = "http://x.bad.org/" + "p" * 100_000 + "/" + "q" * 100_000
    pages = spark.createDataFrame([(1, long, "2024-01-02"), (2, "http://[::1]:80/a", "2024-01-02"), (None, "http://bad.org", "2024-01-02")], "page_id long, url string, day string")
    log = spark.createDataFrame([("bad.org", "2024-01-01", "add", "spam"), ("[::1]", "2024-01-01", "add", "local")], "entry string, day string, action string, category string")
    assert sorted([(r.page_id, r.category) for r in url_filter.url_filter(pages, log).collect()], key=str) == [(1, "spam"), (2, "local"), (None, "spam")]


def test_native_operators_run_no_python(spark):
    from motionframe.llm import exact_dedup

    docs = documents(spark, ["a", "b@c.de"])
    for df in (exact_dedup.exact_dedup(docs), pii.find_pii(docs), pii.redact(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert F
