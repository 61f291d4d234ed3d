"""That the queries do the whole job, where they once did less."""

from __future__ import annotations

import math
import os
import random
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lodestrata.llm import bpe, catalog, decontaminate, html_extract, language, license_scan, lm, neardup, preference, sampling, session  # noqa: E402


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- language model


def test_ngrams_seen_once_count(spark):
    got = {r.doc_id: r.log_score for r in lm.score(documents(spark, [(1, "a b c"), (2, "a b d"), (3, "x")])).collect()}
    # c: 1 of the 2 "a b"; b: 2 of the 2 "a"; a: 2 of the 7 tokens.
    assert got[1] == got[2] == pytest.approx(math.log(1 / 2) + math.log(2 / 2) + math.log(2 / 7))
    assert got[3] == pytest.approx(math.log(1 / 7))


def test_lm_equals_sql_without_a_cutoff(spark):
    assert "HAVING" not in catalog.OP6_SQL
    same_rows(spark, catalog.QUERIES["op6_lm_scores"], catalog.OP6_SQL)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders_count_all(spark, order):
    texts = ["a b c d e", "a b c d f", "b c d e a b c d", "q", "", "z y x w v"]
    split = [t.split() for t in texts]
    count = lambda gram: sum(w[i : i + len(gram)] == gram for w in split for i in range(len(w) - len(gram) + 1))
    got = {r.doc_id: r.log_score for r in lm.score(documents(spark, list(enumerate(texts))), order, block_bytes=8).collect()}
    for k, w in enumerate(split):
        grams = [w[max(0, i - order + 1) : i + 1] for i in range(len(w))]
        want = sum(math.log(count(g) / (count(g[:-1]) if len(g) > 1 else sum(map(len, split)))) for g in grams)
        assert got[k] == pytest.approx(want, abs=1e-9)


# --- near duplicates


def labels(signatures, trees=neardup.TREES):
    """All labels in order, in pieces, as one range of them arrives."""
    lanes, low = signatures[:, : neardup.LANES], signatures[:, neardup.LANES :]
    rows = []
    for t in range(trees):
        turned, second = np.roll(lanes, -t * neardup.STEP, axis=1), low[:, 3 * t : 3 * t + 3]
        rows += [(bytes([t, a[0], b[0], a[1], b[1], a[2], b[2]]) + a[3:].tobytes(), k) for k, (a, b) in enumerate(zip(turned, second, strict=True))]
    rows.sort()
    for k in range(0, len(rows), 700):
        label, node = zip(*rows[k : k + 700], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.binary()), pa.array(node, pa.int64())], names=["label", "node"])


def signed(lanes):
    """Signatures of these lanes; the second bytes are the first ones again."""
    return np.concatenate([lanes, lanes[:, neardup._LEADING]], axis=1)


def as_nodes(spark, lanes):
    return spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(signed(lanes))], "node long, signature binary")


def crowd_of(n, copies):
    """Signatures that all share half their lanes, and pairs (row, row) of them that share most."""
    rng = np.random.default_rng(n)
    lanes = rng.integers(0, 256, (n, neardup.LANES), dtype=np.uint8)
    lanes[:, ::3] = 7
    pairs = rng.choice(n, (copies, 2), replace=False)
    for a, b in pairs:
        own = rng.random(neardup.LANES) < 0.8
        lanes[b, own] = lanes[a, own]
    return lanes, pairs


def test_a_task_holds_a_bounded_part_of_a_crowd():
    """What a range's task holds, and compares at once, doesn't grow with a run; every row of the run is left for tiles."""
    lanes, _ = crowd_of(30_000, 3)
    lanes[:, :60] = 7
    held, out = [], []
    compared = neardup._streamed
    neardup._streamed = lambda lanes, node: held.append(len(node)) or compared(lanes, node)
    try:
        out = list(neardup._links(labels(signed(lanes), 10), 500))
    finally:
        neardup._streamed = compared
    assert max(held) <= neardup.TOGETHER + 700 + 500
    waiting = {}
    for x in out:
        for u, run in zip(x.column("u").to_pylist(), x.column("run").to_pylist(), strict=True):
            if run is not None:
                waiting.setdefault(run, []).append(u)
    hot = [x for x in waiting.values() if len(x) > 500]
    assert len(hot) >= 8 and all(sorted(x) == list(range(30_000)) for x in hot)


@pytest.mark.parametrize(("rows", "crowd"), [(neardup.ROWS, neardup.CROWD), (900, neardup.CROWD), (900, 50), (100, 10)])
def test_ranges_and_tiles_find_what_all_pairs_find(spark, rows, crowd):
    lanes, pairs = crowd_of(400, 40)
    assert {tuple(r) for r in neardup._forest(as_nodes(spark, lanes), rows, crowd).collect()} == {(max(a, b), min(a, b)) for a, b in pairs.tolist()}


def test_repeated_ids_with_other_texts_are_other_documents(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, "something else that nobody copied anywhere"), (2, text.upper()), (3, "again " + text), (3, "again " + text), (None, text)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2) for i, t in rows], "doc_id long, text string, _gone int, gone int, H int")
    got = sorted((r.doc_id, r.group_id, r.links, r.keep) for r in neardup.groups(docs).collect())
    assert got == [(1, 1, 0, True), (1, 1, 2, True), (2, 1, 2, False), (3, 1, 2, False)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("None", text)])


def test_pairs_apart_in_a_large_run_are_compared(spark):
    """Rows that share three lanes, and a pair of them that agrees on 100 of 120 lanes but not on the fourth."""
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 256, (200, neardup.LANES), dtype=np.uint8)
    lanes[:, :3] = 7
    lanes[:, 3] = np.arange(200)
    other = np.concatenate([[3], np.arange(neardup.STEP + 1, neardup.LANES, neardup.STEP)])  # no other tree brings them together
    lanes[150, other] = lanes[10, other] + 1
    same = np.setdiff1d(np.arange(neardup.LANES), other)
    lanes[150, same] = lanes[10, same]
    lanes[:, 3] = np.arange(200)
    for crowd in (neardup.CROWD, 20):  # compared where they lie, and in tiles
        assert [tuple(r) for r in neardup._forest(as_nodes(spark, lanes), neardup.ROWS, crowd).collect()] == [(150, 10)]


@pytest.mark.parametrize("n", [3, 300, 2500])
def test_blocks_link_what_all_pairs_link(n):
    rng = np.random.default_rng(n)
    lanes = rng.integers(0, 256, (n, neardup.LANES), dtype=np.uint8)
    for _ in range(n // 2):
        a, b = rng.integers(0, n, 2)
        copied = rng.random(neardup.LANES) < rng.uniform(0.3, 0.7)
        lanes[b, copied] = lanes[a, copied]
    i, j = np.triu_indices(n, 1)
    keep = np.concatenate([neardup.similar(lanes[i[k : k + 50_000]], lanes[j[k : k + 50_000]]) >= neardup.ACCEPT for k in range(0, len(i), 50_000)])
    assert neardup._roots(i[keep].tolist(), j[keep].tolist()) == neardup._roots(*(x.tolist() for x in neardup.linked(lanes)))


# --- decontamination


def test_both_ways_take_null_and_repeated_ids(spark):
    item, second = ("the quick brown fox jumps over lazy dogs and %s runs away from them again %s" % (x, x) for x in ("one", "seven"))
    clean = "nothing of the kind is said in here, not in any of these words at all, whatever one looks for"
    rows = [(None, f"x {item}"), (None, clean), (1, f"{second} y"), (1, clean), (1, f"{second} y"), (2, None), (3, f"z {item} {second}")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(None, item), (7, second), (7, item), (None, None)], "item_id long, text string")
    found, kept = ([sorted(map(str, f(docs, bench, most).collect())) for most in (1 << 20, 0)] for f in (decontaminate.find, decontaminate.keep_clean))
    assert found[0] == found[1] and any("doc_id=None, item_id=None" in x for x in found[0])
    assert kept[0] == kept[1] == sorted(str(r) for r in docs.collect() if r.text in (clean, None))
    assert decontaminate.keep_clean(docs, bench, 0).columns == docs.columns


# --- HTML


def test_upper_case_is_counted_over_the_whole_text():
    """Upper-case letters after the first 200 characters count, in the node and in those above it."""
    late, even = ("<div><p>" + x + "</p></div>" for x in ("a" * 300 + "B" * 100, "aaaB" * 100))
    a, b = (html_extract.Page(x).features() for x in (late, even))
    assert (a == b).all()


# --- licences


def test_long_expressions_are_evaluated():
    written = " and ".join(["mit", "apache-2.0"] * 200)
    assert len(written) > 2000
    assert license_scan.judge(f"SPDX-License-Identifier: {written}") == (1, ["apache-2.0", "mit"], [written], "permissive")


# --- BPE


def plain_merge(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_merging_equals_plain_merging():
    """Of pieces that are cut at forced pairs, in rounds and with a heap, against plain merging of the whole piece."""
    ranks = bpe.read_ranks()
    encoder = bpe.Encoder(ranks)
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"abcdeinorst  .,'x\xc3\xa9\xe6") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    pieces += [b"a" * n for n in (1, 2, 63, 64, 65, 66, 127, 300)] + [b" " * n for n in (2, 65, 200)] + [b"the" * 50, b"qzxj" * 40]
    got = [np.frombuffer(x, np.int32).tolist() for x in encoder.merged(pieces)]
    assert got == [plain_merge(x, ranks) for x in pieces]
    assert encoder.merged([]) == []
    cuts = sum(int(encoder.forced[a, b]) for x in pieces for a, b in zip(x, x[1:], strict=False))
    assert cuts > 1000


def test_very_long_runs_round_trip():
    encoder = bpe.Encoder(bpe.read_ranks())
    for text in (" " * 300_000, "a" * 300_000, "!" * 300_000, "\n" * 300_000, "漢" * 100_000, "ab漢" * 50_000, "x" + " " * 300_000 + "y"):
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert encoder.decode(ids) == text


def test_encoding_many_at_once_equals_one_at_a_time():
    encoder, other = bpe.Encoder(bpe.read_ranks()), bpe.Encoder(bpe.read_ranks())
    texts = ["", None, "one two", "one", None, "two " * 300_000, "three"]
    assert encoder.encode_all(texts) == [None if t is None else other.encode(t) for t in texts]
    assert encoder.encode_all([]) == []


# --- licences over lines


WRAPPED = {
    "/*\n * Licensed under the Apache License,\n *   Version 2.0 (the License)\n */": "apache-2.0",
    "# Permission is hereby granted, free\n# of charge, to any\n#\n# person obtaining a copy": "mit",
    "// Redistribution and use in source\r\n// and binary forms are permitted": "bsd-2-clause",
    "Redistribution and  use in source and\tbinary forms ...\n3. Neither the name\nof the holder": "bsd-3-clause",
    " * under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option)": "gpl-2.0-or-later",
    "-- the GNU Lesser General Public License as published\n-- by the Free Software Foundation; either version 2.1 of the\n-- License, or": "lgpl-2.1-or-later",
}


@pytest.mark.parametrize("text", WRAPPED)
def test_notices_may_be_wrapped(text):
    found, licences, _, _ = license_scan.judge(f"x = 1\n{text}\ny = 2")
    assert (found, licences) == (1, [WRAPPED[text]])
    ((start, end, _),) = license_scan.findings(text)
    plain = " ".join(text[start:end].lower().replace("*", " ").replace("#", " ").replace("//", " ").replace("--", " ").split())
    assert plain in license_scan.NOTICES


def test_every_notice_has_a_hint():
    assert all(any(h in p for h in license_scan._HINTS) for p in license_scan.NOTICES)


def test_a_tag_ends_the_expression_before_it():
    text = "SPDX-License-Identifier: MIT SPDX-License-Identifier: (GPL-2.0 OR MIT)\nmore"
    assert license_scan.judge(text) == (2, ["gpl-2.0", "mit"], ["mit", "(gpl-2.0 or mit)"], "permissive")


@pytest.mark.parametrize("piece", ["SPDX-License-Identifier: MIT ", "SPDX-License-Identifier:\n", "all rights reserved ", " \n", "\n * ", " " * 50, "cc0 (((", "licensed "])
def test_licence_work_is_linear(piece):
    began = time.process_time()
    license_scan.judge("cc0 " + piece * (2_000_000 // len(piece)))
    assert time.process_time() - began < 30


# --- preferences


def test_render_takes_nulls_and_clashing_names(spark):
    turn = "array<struct<role: string, text: string>>"
    rows = [(1, "p", 5, [("user", None), ("assistant", "x")], [("user", ""), None, (None, "y")]), (2, "p", 5, None, [("assistant", None)])]
    pairs = spark.createDataFrame(rows, f"`a.b` long, Prompt string, _shared int, chosen {turn}, rejected {turn}").withColumns({"good": F.lit(1), "shared": F.lit(2), "chosen_mask": F.lit(3)})
    made = preference.render(pairs)
    assert made.columns == ["a.b", "_shared", "good", "shared", "prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"]
    got = {r[0]: r[4:] for r in made.collect()}
    assert got[1] == (1, "<|im_start|>user\n<|im_end|>\n", "<|im_start|>assistant\nx<|im_end|>\n", [[22, 34]], "<|im_start|>\ny<|im_end|>\n", [])
    assert got[2] == (0, "", "", [], "<|im_start|>assistant\n<|im_end|>\n", [[22, 33]])


# --- languages


SCRIPTS = {
    "ru": "все люди рождаются свободными и равными в своём достоинстве и правах",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах",
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "ja": "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits",
}


def by_hand(text):
    """The bundle of a text, letter by letter."""
    out, codes = np.zeros(language.DIMENSIONS), [0 if c == " " else int(language._codes()[ord(c)]) for c in " ".join("".join(c if language._codes()[ord(c)] else " " for c in text.lower()).split(" "))]
    codes = [c for k, c in enumerate(codes) if k == 0 or c or codes[k - 1]]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            out += np.roll(language._LETTERS[a], 2) * np.roll(language._LETTERS[b], 1) * language._LETTERS[c]
    return out


def test_languages_of_any_script_by_direct_cosine(spark):
    rows = [(k * 10 + i, t[i * 3 :], name) for k, (name, t) in enumerate(SCRIPTS.items()) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model["names"] == sorted(SCRIPTS)
    unit = lambda v: v / np.linalg.norm(v)
    vectors = np.array([unit(sum(unit(by_hand(t)) for _, t, lang in rows if lang == name)) for name in model["names"]])
    assert np.allclose(model["vectors"], vectors, atol=1e-4)
    for r in language.identify(docs, model).collect():
        cosine = vectors @ unit(by_hand(rows[[x[0] for x in rows].index(r.doc_id)][1]))
        assert r.language == r.declared == model["names"][int(cosine.argmax())] and r.cosine == pytest.approx(cosine.max(), abs=1e-3) and r.keep
    letters = {c for t in SCRIPTS.values() for c in t.lower() if c != " "}
    assert len({int(language._codes()[ord(c)]) for c in letters}) > 0.85 * len(letters)


@pytest.mark.parametrize("dense", [0, 96])
def test_bundles_either_way(dense):
    was, language.DENSE = language.DENSE, dense
    try:
        texts = [SCRIPTS["ru"], "", "ab", SCRIPTS["ja"] + "\U0001f600 é 𐍈𐍉"]
        ((_, n, trigram, row),) = language.trigrams(pa.array(texts))
        assert np.allclose(language.bundles(trigram, row, n), [by_hand(t) for t in texts])
    finally:
        language.DENSE = was


# --- sampling


@pytest.mark.parametrize("most", [1, 5, 2000])
def test_strata_are_those_that_hash_lowest(spark, most):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'a' ELSE concat('b', id % 2) END AS kind", "1 AS n", "2 AS rank", "3 AS low")
    got = sampling.strata(rows, "doc_id", ["kind"], most)
    assert sorted(got.columns) == sorted(rows.columns)
    low = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).toPandas().sort_values("u")
    want = {(k, d) for k, g in low.groupby("kind") for d in g.doc_id[:most]}
    assert {(r.kind, r.doc_id) for r in got.collect()} == want


def test_repetitive_texts_are_searched_in_bounded_pieces(spark):
    index = decontaminate.Index([1], pa.array(["a" * 60 + "b" * 60]))
    was, decontaminate.HITS = decontaminate.HITS, 50
    try:
        sizes = [len(p) for p, _, _ in index.hits(*decontaminate.winnow(np.frombuffer(b"a" * 300, np.uint8), np.array([0, 300])))]
    finally:
        decontaminate.HITS = was
    assert max(sizes) < 100 and sum(sizes) > 2000
    rows = [(1, "a" * 300), (2, "b" * 70), (3, "ab" * 90), (4, "a" * 60 + "b" * 60), (4, "a" * 60 + "b" * 60)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, key int, high int, item_id int")
    bench = spark.createDataFrame([(9, "a" * 60 + "b" * 60, 1)], "item_id long, text string, key int")
    found = [sorted(tuple(r) for r in decontaminate.find(docs, bench, most).collect()) for most in (1 << 20, 0)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2, 4}
    assert found[0].count((4, 9, 0, 120, 0)) == 2
    for most in (1 << 20, 0):
        kept = decontaminate.keep_clean(docs, bench, most)
        assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]


# --- the folder for what is written


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_the_pipeline_leaves_only_its_last_rows(spark):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    folder = os.path.dirname(os.path.dirname(made.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == ["bpe"] and made.count() > 0
