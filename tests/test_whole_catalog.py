"""That the queries do the whole job, where they once did less."""

from __future__ import annotations

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.plans import catalog


def test_sniffing_reads_past_2000_characters(spark, tmp_path):
    rows = [(2, "a" * 5000 + "\0"), (6, "a" * 9000 + "\0"), (10, "a" + "\u00e9" * 5000), (14, "b" * 8191 + "\U0001f600" * 9)]
    made = spark.createDataFrame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["binary_sniff"](spark, str(tmp_path)).orderBy("path").collect()
    assert [r.is_binary for r in got] == [True, False, False, False]


@pytest.mark.parametrize("character", ["\u00e9", "\u20ac", "\ud7ff", "\U0001f600", "\U0010ffff"])
def test_characters_cut_off_by_the_sniffed_bytes(spark, character):
    made = character.encode()
    at = text.SNIFFED_BYTES
    good = [b"a" * (at - k) + made + b"a" * 9 for k in range(6)]
    bad = [b"a" * (at - k) + made[:k] for k in range(1, len(made))] + [b"a" * (at - 1) + b"\xff" + b"a" * 9, b"a" * (at - 2) + b"\xa9\xa9" + b"a" * 9]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "id int, content binary")
    assert [r.b for r in rows.orderBy("id").select(text.is_binary(F.col("content")).alias("b")).collect()] == [False] * len(good) + [True] * len(bad)


@pytest.mark.parametrize("name", ["closure_union_all", "required_missing_all"])
def test_whole_queries_are_registered(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name])
