import hashlib
import re

import corpus_pipeline
from motionframe.llm import near_dedup, packing, registry, tokens, toxicity
from tests.llm.helpers import WHITE, edited, near_components, prose, saved, shingles
from tests.llm.test_filters import base_spans, labelled
from tests.llm.test_tokens import check_packing


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def corpus(spark, path):
    marks = labelled(400)
    rows = [(i, t) for i, t, _ in marks]
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(1100 + i, rows[4][1].replace(" ", "  ")) for i in range(3)]
    near = prose(4242, 300)
    rows += [(1200 + i, edited(near, i, 1 + i % 2)) for i in range(8)]
    rows += [(1300, prose(1, 30) + " mail x.y@z.org and 10.20.30.40 end"), (1301, None), (1302, ""), (1303, prose(8, 9000))]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in marks], "doc_id long, quality int, toxic int")
    return rows, saved(spark, path, table(spark, rows).repartition(3), labels=labels)


def test_packing_remembers_fewer_words_than_op5(monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "best_fit_packing", lambda docs, **more: asked.append(more))
    dict(corpus_pipeline.STAGES)["packing"](None, None, "")
    assert asked[0]["words"] < tokens.WORDS


def test_stages_against_brute_force(spark, tmp_path):
    rows, sf = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]

    clean = stages["toxicity"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and texts == {i: t for i, t in rows if scores[i] < 0.5} and 250 < len(texts) < len(rows)

    first = {}
    for i in sorted(texts):
        first.setdefault(WHITE.sub(" ", texts[i] or ""), i)
    once = stages["exact_dedup"](spark, clean, sf)
    kept = {r.doc_id: r.text for r in once.collect()}
    assert once.columns == columns and kept == {i: texts[i] for i in first.values()} and len(kept) < len(texts)

    component = near_components(kept)
    one = stages["near_dedup"](spark, once, sf)
    left = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and left == {i: t for i, t in kept.items() if component[i] == i} and len(left) < len(kept)

    safe = stages["pii"](spark, one, sf)
    final = {r.doc_id: (r.text, r.n_chars) for r in safe.collect()}
    assert safe.columns == columns and safe.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and final.keys() == left.keys()
    for i, (t, n) in final.items():
        assert not base_spans(t) and n == len(t or "")
        if not re.search("[0-9@\"']", left[i] or ""):
            assert t == left[i]
    assert "[EMAIL]" in final[1300][0] and "[IP]" in final[1300][0]

    rows = corpus_pipeline.run(spark, sf).collect()
    ids = sorted(final)
    number = {d: k for k, d in enumerate(ids)}
    from pyspark.sql import Row

    again = [Row(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in rows]
    check_packing(again, [final[i][0] for i in ids])


def test_stages_take_nulls_repeats_and_no_rows(spark, tmp_path):
    _, sf = corpus(spark, tmp_path)
    odd = table(spark, [(None, "a"), (None, None), (1, "a"), (1, "a"), (2, ""), (3, "x" * 20_000)])
    for docs, n in ((odd, 5), (odd.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), sf)
        assert (docs.count() > n) if n else docs.count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows, sf = corpus(spark, tmp_path)
    docs = table(spark, rows[:60] + rows[-5:]).selectExpr("*", "0.25D AS score", "'m' AS matches", "1 AS score_", "true AS kept", "doc_id AS row", "text AS spans", "1L AS component_id", "'x' AS digest", "2 AS n")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {(r.score, r.matches, r.n) for r in docs.collect()} == {(0.25, "m", 2)}
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() >= docs.count()


def test_near_copies_from_80_percent_on_go(spark, tmp_path):
    texts = [t for g in range(12) for t in (prose(9000 + g, 200), edited(prose(9000 + g, 200), g, 3 + g % 4))]
    sets, pairs = [shingles(t) for t in texts], range(0, len(texts), 2)
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in pairs}
    assert sum(0.8 <= s < 0.85 for s in share.values()) > 2 and min(share.values()) < 0.8
    left = corpus_pipeline.one_of_each_group(spark, table(spark, list(enumerate(texts))), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == sorted([*pairs, *(i + 1 for i in pairs if share[i] < 0.8)])
    assert [near_dedup.trees_at(d, 0.8) for d in range(1, 5)] == [6, 10, 13, 18] and near_dedup.trees_at(4, 0.85) == 13


def test_every_operator_has_a_query():
    assert [sum(k.startswith(f"op{n}_") for k in registry.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(registry.SQL) <= set(registry.QUERIES) and hashlib
