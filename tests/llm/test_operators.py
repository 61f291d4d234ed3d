"""Each operator against brute force, exact round trips or held-out accuracy, and over awkward rows."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import bpe, decontaminate, html_extract, language, license_scan, lm, neardup, preference, quality, topk

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, keep string, h long"
SF = "/root/testdata/sf0.01"
LONG = "long text of many words " * 5000


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark):
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", "s", 0, "a", 1),
        (None, "some words without an id here", "en", "s", 5, "a", 1),
        (3, "repeated row of a few words", "en", "s", 5, "a", 1),
        (3, "repeated row of a few words", "en", "s", 5, "a", 1),
        (4, "repeated row of a few words", "de", "s", 5, "a", 1),
        (5, LONG, "en", "s", len(LONG), "a", 1),
        (6, "...", "en", "s", 3, "a", 1),
        (7, "漢字 \U0001f600 \x00 é", "zz", "s", 3, "a", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary):04d}x" for _ in range(n)]


# --- near duplicates


def jaccard(a, b):
    def shingles(t):
        w = re.findall(r"[0-9a-z]+", t.lower())
        return {tuple(w[i : i + neardup.SHINGLE]) for i in range(max(1, len(w) - neardup.SHINGLE + 1))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = words(rng, rng.randrange(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = base[:]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    base = words(rng, 150)  # a crowd of near copies
    for k in range(150):
        copy = base[:]
        copy[k] = "other"
        texts.append(" ".join(copy))
    found = {r.doc_id: r.group_id for r in neardup.groups(documents(spark, texts)).collect()}
    near = {(i, j): jaccard(texts[i], texts[j]) for i, j in itertools.combinations(range(len(texts)), 2)}
    true = [p for p, s in near.items() if s >= neardup.SIMILARITY]
    assert sum(found[i] == found[j] for i, j in true) >= 0.97 * len(true)
    parent = list(range(len(texts)))
    for i, j in (p for p, s in near.items() if s >= neardup.SIMILARITY - 0.15):
        a, b = parent[i], parent[j]
        parent = [min(a, b) if x in (a, b) else x for x in parent]
    assert all(parent[i] == parent[g] for i, g in found.items()), "unrelated documents share a group"


def test_exact_copies_and_awkward_rows(spark):
    got = neardup.groups(awkward(spark)).collect()
    assert sorted((r.doc_id, r.group_id, r.keep) for r in got) == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True), (7, 7, True)]
    kept = neardup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "5", "6", "7", "None"]
    assert neardup.groups(awkward(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges * 60:
        parent[a] = parent[b] = min(parent[a], parent[b])
    want = {x: r for x, r in parent.items() if x != r}
    assert {r.u: r.v for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


# --- HTML


def page(rng, marked, tag="div"):
    nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(rng, rng.randrange(4, 9)))
    paras = ["".join(f"{w} " for w in words(rng, rng.randrange(20, 60))).strip() + "." for _ in range(rng.randrange(2, 6))]
    body = "".join(f"<p>{p}</p>" for p in paras)
    main = "article" if marked else tag
    return f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav><ul>{nav}</ul></nav><div class='ad'>buy now</div><{main}>{body}</{main}><footer>legal &copy; us</footer></body></html>", "\n".join(paras)


def test_html_on_pages_held_out(spark):
    rng = random.Random(1)
    train = [page(rng, True)[0] for _ in range(120)]
    test = [page(rng, False) for _ in range(60)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(train)], "page_id long, url string, html string")
    model = html_extract.fit(pages)
    got = html_extract.extract(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(test)], pages.schema), model).collect()
    assert sum(r.text == test[r.page_id][1] for r in got) >= 0.95 * len(test)


def test_html_choices_never_contradict():
    rng = np.random.default_rng(0)
    p = html_extract.Page(page(random.Random(2), False)[0])
    for _ in range(30):
        odds = rng.normal(size=len(p.tags))
        chosen = p.choose(odds)
        assert all(chosen[k] for k in range(1, len(p.tags)) if chosen[p.parents[k]])
        total = odds[chosen].sum()
        for k in range(len(p.tags)):  # no single whole subtree does better
            inside = np.zeros(len(p.tags), bool)
            for j in range(len(p.tags)):
                inside[j] = j == k or (j > 0 and inside[p.parents[j]])
            assert odds[inside].sum() <= total + 1e-9


def test_html_awkward_rows(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "<p>a<p>b", 1), (None, "u", "<a href='", 1), (4, "u", "<div>" * 3000 + LONG, 1), (4, "u", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_extract.extract(pages, html_extract.fit(pages)).collect()
    assert len(got) == 6
    assert [r.text for r in got if r.page_id == 1] == [None]
    assert [r.text for r in got if r.page_id == 2] == [""]
    assert [r.text for r in got if r.page_id == 3] == ["a\nb"]
    assert html_extract.extract(pages.limit(0), None).count() == 0


# --- BPE


def test_bpe_equals_plain_merging_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks()
    encoder = bpe.Encoder(ranks)
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = "ab'sdtreve lm\n\t 　\xa0\x1c\r1 2.!?éß漢\U0001f600AB"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == plain.encode_ordinary(text), repr(text)
    forced = bpe.forced_pairs(ranks)
    assert not any(forced[t[i], t[i + 1]] for t in ranks for i in range(len(t) - 1))
    got = bpe.round_trip(awkward(spark)).collect()
    assert len(got) == 9 and all(r.exact for r in got if r.ids is not None)
    assert [(r.ids, r.n_tokens) for r in got if r.doc_id == 1] == [(None, None)]
    assert [(r.ids, r.n_tokens) for r in got if r.doc_id == 2] == [([], 0)]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(awkward(spark))).collect()}
    assert back[5] == LONG and back[1] is None and back[2] == ""


def test_bpe_decodes_unknown_ids_to_null(spark):
    rows = spark.createDataFrame([(1, [10**8]), (2, [None]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == {1: None, 2: None, 3: ""}


# --- quality


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where("pmod(doc_id, 4) > 0"))
    got = quality.classify(docs, model).join(labels.where("pmod(doc_id, 4) = 0"), "doc_id").collect()
    bad = [r for r in got if r.quality == 0 or r.toxic == 1]
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)
    assert sum(r.keep for r in clean) >= 0.97 * len(clean)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [rng.choice(20, 5, replace=False) for _ in range(200)]
    y = np.array([1.0 if 3 in r or 4 in r else -1.0 for r in rows])
    w, b = quality.dual_descent(rows, np.ones(20), y, np.full(200, 10.0), epochs=200)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, y, strict=True))


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 1, 0), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("doc_id = 5")):
        model = quality.fit(awkward(spark), given)
        got = quality.classify(awkward(spark), model).collect()
        assert len(got) == 9
        assert all(not r.keep and r.quality_score is None for r in got if r.doc_id in (1, 2))
        kept = quality.keep_good(awkward(spark), model)
        assert kept.columns == awkward(spark).columns and kept.count() == sum(r.keep for r in got)
    assert quality.classify(awkward(spark).limit(0), model).count() == 0


# --- decontamination


def naive_spans(text, item):
    reduce = lambda t: re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]", b"", t.lower().encode())
    a, b = reduce(text), reduce(item)
    out = set()
    for shift in range(-len(b), len(a)):
        run = 0
        for i in range(max(0, shift), min(len(a), shift + len(b)) + 1):
            if i < min(len(a), shift + len(b)) and a[i] == b[i - shift]:
                run += 1
                continue
            if run >= decontaminate.SPAN:
                out.add((i - run, i, i - run - shift))
            run = 0
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, 15)) for _ in range(6)] + ["short item", "a" * 300]
    texts = []
    for k in range(40):
        w = words(rng, rng.randrange(10, 60))
        item = items[k % 8]
        a = rng.randrange(0, max(1, len(item) // 2))
        w.insert(rng.randrange(len(w)), item[a : a + rng.randrange(30, 120)].upper().replace(" ", ", "))
        texts.append(" ".join(w))
    texts += [None, "", "a" * 200]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "k") for i, t in enumerate(items)] + [(98, None, "k"), (99, "", "k")], "item_id long, text string, doc_id string")
    want = {(d, i, *s) for d, t in enumerate(texts) if t for i, x in enumerate(items) for s in naive_spans(t, x)}
    assert len(want) > 10
    for most in (1 << 20, 0):
        assert {tuple(r) for r in decontaminate.find(docs, bench, most).collect()} == want
        kept = decontaminate.keep_clean(docs, bench, most)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_spans_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, LONG[:400]), (1, LONG[:400]), (None, LONG[:400])], "item_id long, text string")
    got = decontaminate.find(awkward(spark), bench).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 1), (5, None)}
    assert decontaminate.keep_clean(awkward(spark), bench).count() == 8


# --- language model


def naive_scores(texts):
    from collections import Counter
    from math import log

    split = [[w for w in re.split("[ \t\n\v\f\r]+", (t or "").lower()) if w] for t in texts]
    c = [Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(c[0].values())
    out = []
    for w in split:
        score = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or c[n - 1][gram]:
                    score += log(c[n - 1][gram] / (c[n - 2][gram[:-1]] if n > 1 else total)) + log(lm.ALPHA) * (min(i, 2) - n + 1)
                    break
        out.append((len(w), score))
    return out


def test_lm_against_counting(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c dd ee the of Été".split()) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", " \n ", "one", "a b " * 700]
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in lm.score(documents(spark, texts), block_bytes=600).collect()}
    for i, (n, score) in enumerate(naive_scores(texts)):
        assert got[i][0] == n and got[i][1] == pytest.approx(score, abs=1e-6)


def test_lm_awkward_rows(spark):
    assert lm.score(awkward(spark)).count() == 9
    assert lm.score(awkward(spark).limit(0)).count() == 0


def test_packing():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 600, 1000)
    assert (lm.unpack_counts(lm.pack_counts(counts), 1000) == counts).all()
    h = np.unique(rng.integers(0, 1 << 56, 1000, dtype=np.uint64))
    width, packed = lm.pack_hashes(h)
    assert (lm.unpack_hashes(packed, width, len(h)) == h).all()


# --- preferences


def test_preferences(spark):
    turn = "array<struct<role: string, text: string>>"
    ask, one, two = ("user", "hi"), ("assistant", "hello"), ("assistant", "go away")
    rows = [(1, [ask, one], [ask, two]), (2, [ask, one], [ask, one]), (3, [one], [two]), (4, [], [ask]), (5, [ask, one, ask, one], [ask, two, ask, one])]
    got = {r.id: r for r in preference.render(spark.createDataFrame(rows, f"id long, chosen {turn}, rejected {turn}")).collect()}
    shown = lambda *turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    for key, chosen, rejected in rows:
        n = next((i for i, (a, b) in enumerate(zip(chosen, rejected, strict=False)) if a != b), min(len(chosen), len(rejected)))
        r = got[key]
        assert (r.prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion) == (n, shown(*chosen[:n]), shown(*chosen[n:]), shown(*rejected[n:]))
        for text, mask, turns in ((r.chosen_completion, r.chosen_mask, chosen[n:]), (r.rejected_completion, r.rejected_mask, rejected[n:])):
            assert [text[a:b] for a, b in mask] == [f"{t}<|im_end|>\n" for role, t in turns if role == "assistant"]


def test_preferences_awkward_rows(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", "b c d", 1), (1, 1, "assistant", "b c d", 1), (1, 2, "user", None, 1), (2, 0, "user", "only", 1), (None, 0, "assistant", "x", 1), (3, None, None, None, 1), (3, 1, "assistant", "", 1), (4, 0, "assistant", "old", 1), (4, 1, "assistant", "new", 1)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen long")
    got = {r.conv_id: r for r in preference.render(preference.pairs(conversations)).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].rejected_completion == "<|im_start|>assistant\nb<|im_end|>\n"
    assert got[3].prompt_turns == 2 and got[3].chosen_completion == ""
    assert got[4].rejected_completion == "<|im_start|>assistant\nold<|im_end|>\n"
    assert preference.render(preference.pairs(conversations.limit(0))).count() == 0


# --- licences


@pytest.mark.parametrize(
    ("written", "allowed"),
    [("MIT", True), ("MIT OR GPL-3.0-only", True), ("MIT AND GPL-3.0-only", False), ("MIT OR MIT AND GPL-2.0", True), ("(MIT OR MIT) AND GPL-2.0", False), ("GPL-2.0 WITH Classpath-exception-2.0", True), ("foo OR MIT", True), ("foo AND MIT", None), ("foo AND GPL-3.0", False), ("((isc))", True)],
)
def test_expressions(written, allowed):
    assert license_scan.evaluate(written)[0] is allowed


@pytest.mark.parametrize("written", ["", "MIT AND", "AND MIT", "MIT MIT", "(MIT", "MIT)", "MIT WITH", "(MIT) WITH Classpath-exception-2.0", "MIT OR ()", "!"])
def test_malformed_expressions(written):
    with pytest.raises(ValueError):
        license_scan.evaluate(written)


def test_findings_against_plain_search():
    rng = random.Random(2)
    phrases = [*license_scan.NOTICES, *license_scan.TAGS]
    for _ in range(200):
        text = " ".join(rng.choice([rng.choice(phrases).upper(), rng.choice(phrases), "word", "x", "\n"]) for _ in range(20))
        low = text.lower()
        hits = {(m.start(), m.end()) for p in phrases for m in re.finditer(f"(?={re.escape(p)})", low) for m in [re.compile(re.escape(p)).match(low, m.start())]}
        hits = [(a, b) for a, b in hits if not (a and low[a - 1].isalnum()) and not (b < len(low) and low[b].isalnum() and low[b - 1] != ":")]
        want = []
        for a, b in sorted(hits, key=lambda x: (x[0] - x[1], x[0])):
            if all(b <= c or a >= d for c, d in want):
                want.append((a, b))
        assert [(a, b) for a, b, _ in license_scan.findings(text)] == sorted(want)


def test_license_scan(spark):
    texts = [None, "", "nothing", "# SPDX-License-Identifier: MIT OR GPL-2.0-only\nx", "Released under the MIT License. All rights reserved.", "SPDX-License-Identifier:", LONG + "licensed under CC BY 4.0"]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    assert [got[i].verdict for i in range(7)] == ["none", "none", "none", "permissive", "restrictive", "unknown", "permissive"]
    assert got[3].licences == ["gpl-2.0-only", "mit"]
    assert license_scan.scan(awkward(spark)).count() == 9
    assert license_scan.scan(awkward(spark).limit(0)).count() == 0


# --- language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where("pmod(doc_id, 3) > 0"))
    got = [r for r in language.identify(docs.where("pmod(doc_id, 3) = 0 and n_chars > 60"), model).collect()]
    assert sum(r.language == r.declared for r in got) >= 0.97 * len(got)
    assert sum(r.keep for r in got) >= 0.97 * len(got)


def test_bundles_are_sums_of_bound_vectors():
    text = "abra cad"
    (_, n, trigram, row), = language.trigrams(pa.array([text]))
    code = {c: language._codes()[ord(c)] for c in text}
    want = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        if b != " ":
            want += np.roll(language._LETTERS[code[a]], 2) * np.roll(language._LETTERS[code[b]], 1) * language._LETTERS[code[c]]
    assert np.allclose(language.bundles(trigram, row, n)[0], want)


def test_language_awkward_rows(spark):
    for given in (awkward(spark), awkward(spark).limit(0)):
        model = language.fit(given)
        got = language.identify(awkward(spark), model).collect()
        assert len(got) == 9
        kept = language.keep_known(awkward(spark), model)
        assert kept.columns == awkward(spark).columns and kept.count() == sum(r.keep for r in got)
    assert language.identify(awkward(spark).limit(0), model).count() == 0


# --- top-k


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(130, 8))
    v[7] = v[8] = v[9] * 2  # ties
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (3, [9e9] * 8, 1), (600, [1.0, 2.0], 1), (601, [2.0, 1.0], 1)]
    rows[3] = (3, [min(rows[3][1][0], 0.0) - 1, *rows[3][1][1:]], 1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in topk.search(table, k=5, shard=20).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.score)
    v = np.array([r[1] for r in rows[:130]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit @ unit.T
    assert set(got) == {*range(130), 600, 601}
    for i in range(130):
        want = sorted((round(-scores[i, j], 12), j) for j in range(130) if j != i)[:5]
        assert [round(-got[i][r][1], 12) for r in range(1, 6)] == pytest.approx([s for s, _ in want])
        assert [got[i][r][0] for r in range(1, 6)] == [j for _, j in want]
    assert got[600][1][0] == 601 and len(got[600]) == 1
    asked = topk.search(table, table.where("vec_id % 10 = 0"), k=5, shard=20).collect()
    assert sorted((r.vec_id, r.rank, r.neighbour_id, r.score) for r in asked) == sorted((i, r, *x) for i in got if i % 10 == 0 for r, x in got[i].items())
    assert topk.search(table, table.limit(0)).count() == 0
    assert topk.search(table.limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/../sf0.001/documents.parquet")
    sf, seen = "/root/testdata/sf0.001", [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).collect()
        docs_out = spark.createDataFrame(out, docs.schema)
        assert docs_out.columns == docs.columns, name
        assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
        docs = docs_out
        seen.append(len(out))
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    final = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in docs.collect()} and all(r.exact for r in final)


def test_stages_take_awkward_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = awkward(spark)
    spark.createDataFrame([(3, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert out.count() <= 9
            assert name == "bpe" or out.columns == docs.columns
