"""One table of awkward rows for every operator: nulls, empty and very long texts, ties, repeated rows and ids, clashing names, no rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontaminate, html_extract, language, license_scan, lm, neardup, preference, quality, topk

LONG = "word another thing of many kinds " * 60_000  # 2 MB
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "some words without an id"), (None, None), (4, "the same text of a few words"), (4, "the same text of a few words"), (4, "the same id with another text"),
    (5, "the same text of a few words"), (6, LONG), (7, "..."), (8, "\x00 漢字 \U0001f600 é́ \r\n"), (9, "x"), (10, "MIT SPDX-License-Identifier: MIT"),
]
CLASHING = ("key", "high", "h", "gone", "keep", "node", "rep", "root", "label", "signature", "block", "group_id", "links", "n_tokens", "ids", "exact", "language", "declared", "cosine", "quality", "toxic", "findings", "verdict", "count", "n", "low", "rank", "item_id", "item", "Shifts", "features")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(i, t, None if i == 9 else "en", "s", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: F.lit("x") for c in CLASHING}).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_near_duplicates(docs):
    got = rows_of(neardup.groups(docs), "doc_id", "group_id", "links", "keep")
    alone = [(i, i, 0, True) for i in (1, 2, 3, 6, 7, 8, 9, 10)]
    assert got == sorted([*alone, (4, 4, 1, True), (5, 4, 1, False), (4, 4, 0, True)], key=repr)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1
    assert neardup.groups(docs.limit(0)).count() == neardup.keep_one(docs.limit(0)).count() == 0


def test_bpe(docs):
    for r in bpe.round_trip(docs).collect():
        assert (r.ids is None) == (r.n_tokens is None) == (r.exact is None)
    got = rows_of(bpe.round_trip(docs), "doc_id", "n_bytes", "exact")
    assert got == sorted([(i, None if t is None else len(t.encode()), None if t is None else True) for i, t in TEXTS], key=repr)
    assert bpe.round_trip(docs.limit(0)).count() == bpe.encode(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 1, 0, "x"), (9, 0, 1, "y"), (None, 1, 1, "z"), (6, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    none = [r for r in got if r.quality_score is None]
    assert len(none) == sum(not (t or "").strip() for _, t in TEXTS) and not any(r.keep for r in none)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert quality.keep_good(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_language(docs):
    model = language.fit(docs)
    assert model["names"] == ["en"]
    got = language.identify(docs, model).collect()
    assert len(got) == len(TEXTS)
    assert {r.doc_id for r in got if r.language is None} == {1, 2, 3, None, 7, 9} and not any(r.keep for r in got if r.language is None)
    assert language.keep_known(docs, model).columns == docs.columns
    empty = language.fit(docs.limit(0))
    assert empty["names"] == [] and language.keep_known(docs, empty).count() == len(TEXTS)


def test_decontamination(spark, docs):
    item = LONG[:300]
    bench = spark.createDataFrame([(1, item, 0, 0), (1, item, 0, 0), (None, item.upper(), 0, 0), (2, None, 0, 0), (3, "", 0, 0)], "item_id long, text string, doc_id int, key int")
    for most in (1 << 20, 0):
        found = decontaminate.find(docs, bench, most)
        assert rows_of(found.groupBy("doc_id", "item_id").agg((F.count("*") > 1000).alias("many")), "doc_id", "item_id", "many") == sorted([(6, 1, True), (6, None, True)], key=repr)
        kept = decontaminate.keep_clean(docs, bench, most)
        assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1
        assert decontaminate.find(docs.limit(0), bench, most).count() == decontaminate.find(docs, bench.limit(0), most).count() == 0
        assert decontaminate.keep_clean(docs, bench.limit(0), most).count() == len(TEXTS)


def test_lm(docs):
    few = docs.where("doc_id is null or doc_id <> 6")
    split = [(i, (t or "").lower().split()) for i, t in TEXTS if i != 6]
    count = lambda gram: sum(w[k : k + len(gram)] == gram for _, w in split for k in range(len(w) - len(gram) + 1))
    total = sum(len(w) for _, w in split)
    want = []
    for i, w in split:
        grams = [w[max(0, k - 2) : k + 1] for k in range(len(w))]
        score = sum(math.log(count(g) / (count(g[:-1]) if len(g) > 1 else total)) for g in grams)
        want.append((i, len(w), round(score, 6) + 0.0, round(score / len(w), 6) + 0.0 if w else None))
    got = [(r.doc_id, r.n_tokens, round(r.log_score, 6) + 0.0, None if r.mean_log_score is None else round(r.mean_log_score, 6) + 0.0) for r in lm.score(few).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lm.score(docs).count() == len(TEXTS)
    assert lm.score(docs.limit(0)).count() == 0


def test_licences(docs):
    got = rows_of(license_scan.scan(docs), "doc_id", "findings", "licences", "expressions", "verdict")
    none = [(i, 0, [], [], "none") for i, _ in TEXTS if i != 10]
    assert got == sorted([*none, (10, 1, ["mit"], ["mit"], "permissive")], key=repr)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_html(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASHING, F.lit(1).alias("nodes"), F.lit(1).alias("chosen"), F.lit(1).alias("text"))
    got = rows_of(html_extract.extract(pages, html_extract.fit(pages)), "page_id", "text", "nodes")
    assert got == sorted([(i, None if t is None else " ".join(t.split()), None if t is None else 0) for i, t in TEXTS], key=repr)
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


def test_preferences(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a b c"), (1, 1, "assistant", "a b c"), (1, 1, "assistant", "z"), (2, None, None, None), (2, 5, "assistant", None),
        (None, 1, "assistant", "x"), (3, 0, "user", "alone"), (4, 0, "assistant", LONG),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "last", "before", "chosen", "shared", "prompt")})
    got = {r.conv_id: r for r in preference.render(preference.pairs(table)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].prompt.endswith("a b c<|im_end|>\n") and got[1].chosen_completion == "<|im_start|>assistant\nz<|im_end|>\n" and got[1].rejected_completion == "<|im_start|>assistant\na b c<|im_end|>\n"
    assert got[2].prompt == "<|im_start|>\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and got[2].chosen_mask == got[2].rejected_mask == []
    assert got[4].prompt == "" and len(got[4].chosen_completion) > 2 * (len(LONG) // 2) and 2 * len(got[4].rejected_completion) > len(LONG) - 100
    assert preference.render(preference.pairs(table.limit(0))).count() == 0


def test_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0] * 3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "size", "q", "other", "lists", "scores", "rank")})
    got = rows_of(topk.search(table), "vec_id", "rank", "neighbour_id", "score")
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    asked = table.where("vec_id in (2, 4, 8)")
    assert rows_of(topk.search(table, asked), "vec_id", "rank", "neighbour_id") == [(2, 1, 1), (2, 2, 3)]
    assert topk.search(table.limit(0), asked).count() == topk.search(table, asked.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LONG[:200]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        for rows, most in ((docs, len(TEXTS)), (docs.limit(0), 0)):
            out = stage(spark, rows, str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
            left[name, most] = out.count()
            assert left[name, most] <= most
    assert left["near_dedup", len(TEXTS)] == left["decontamination", len(TEXTS)] == len(TEXTS) - 1
