"""Licence scans: identifier tags and notice phrases, found by Aho-Corasick; expressions evaluated.

One automaton finds every tag (`SPDX-License-Identifier:` and the like) in a text, another every notice phrase, in
any case. Notices are sought in the text with white space, line ends and the comment marks that begin a line folded to one
space, so a notice may be wrapped over lines in any way. What follows a tag, to the end of the line or to the next tag on it,
is a licence expression of identifiers, AND, OR, WITH and parentheses. A shunting-yard parser evaluates it with WITH before
AND before OR, in three-valued logic: a permissive licence is allowed, a restrictive one isn't, an
unknown one is unknown; WITH an exception that permits linking, a restrictive licence is allowed.
Several findings in a document all bind it (AND). The BSD text counts as the licence of three clauses if
"neither the name" follows it, else of two.

Defined results: a null or empty text, or one without findings, has verdict 'none'. A malformed or empty
expression is kept as found; its verdict is 'unknown'. Of overlapping phrases the longest counts; of overlapping ones of one
length, the first; phrases inside words don't. An expression may have any length, and texts are read to
their end; the work grows with a text's length alone, however many tags and notices it has. An empty table gives no rows.
Repeated rows give repeated, equal rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.session import tuned

TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
PERMISSIVE = frozenset("mit mit-0 apache-2.0 bsd-2-clause bsd-3-clause isc zlib 0bsd unlicense cc0-1.0 cc-by-3.0 cc-by-4.0 bsl-1.0 python-2.0 psf-2.0 ncsa wtfpl".split())
RESTRICTIVE = frozenset("gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later mpl-2.0 epl-2.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc-by-nd-4.0 proprietary".split())
LINKING = frozenset("classpath-exception-2.0 gcc-exception-3.1 llvm-exception font-exception-2.0 linux-syscall-note".split())
BSD = "bsd"
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "apache license 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "gnu general public license as published by the free software foundation; either version 3 of the license, or": "gpl-3.0-or-later",
    "gnu general public license as published by the free software foundation, either version 3 of the license, or": "gpl-3.0-or-later",
    "gnu general public license as published by the free software foundation; either version 2 of the license, or": "gpl-2.0-or-later",
    "gnu general public license as published by the free software foundation, either version 2 of the license, or": "gpl-2.0-or-later",
    "gnu general public license as published by the free software foundation; version 2": "gpl-2.0",
    "gnu general public license as published by the free software foundation, version 2": "gpl-2.0",
    "gnu general public license as published by the free software foundation, version 3": "gpl-3.0",
    "gnu general public license, version 3": "gpl-3.0",
    "gnu general public license, version 2": "gpl-2.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu gpl v3": "gpl-3.0",
    "gnu gpl v2": "gpl-2.0",
    "gnu lesser general public license as published by the free software foundation; either version 3 of the license, or": "lgpl-3.0-or-later",
    "gnu lesser general public license as published by the free software foundation, either version 3 of the license, or": "lgpl-3.0-or-later",
    "gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or": "lgpl-2.1-or-later",
    "gnu library general public license as published by the free software foundation; either version 2 of the license, or": "lgpl-2.0-or-later",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu lesser general public license, version 2.1": "lgpl-2.1",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license, version 3": "lgpl-3.0",
    "gnu lesser general public license version 2.1": "lgpl-2.1",
    "gnu affero general public license": "agpl-3.0",
    "redistribution and use in source and binary forms": BSD,
    "licensed under the bsd 2-clause license": "bsd-2-clause",
    "licensed under the bsd 3-clause license": "bsd-3-clause",
    "mozilla public license, version 2.0": "mpl-2.0",
    "mozilla public license, v. 2.0": "mpl-2.0",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by-nc-sa 4.0": "cc-by-nc-sa-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under cc by-nd 4.0": "cc-by-nd-4.0",
    "licensed under cc by 4.0": "cc-by-4.0",
    "dedicated to the public domain under cc0": "cc0-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
SCHEMA = "doc_id long, findings long, licences array<string>, expressions array<string>, verdict string"
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_LINE = re.compile(r"[\r\n]")
_BLANK = re.compile(r"(?:[ \t\f\v]*+[\r\n]++[ \t\f\v]*+(?:(?://++|/\*++|\*++(?!/)|[#;>|%!]++|--++|(?:dnl|rem)\b)[ \t\f\v]*+)?+)++|[ \t\f\v]++")
#: Every notice has one of these words, so texts without them needn't be folded.
_HINTS = ("licen", "gpl", "permission", "redistribution", "unencumbered", "reserved", "public domain", "cc0")
_THREE_CLAUSES = "neither the name"
_RANK = {"or": 1, "and": 2, "with": 3}
_VERDICT = {True: "permissive", False: "restrictive", None: "unknown"}


def _licence(name: str) -> bool | None:
    plain = name.removesuffix("+")
    return True if plain in PERMISSIVE else False if plain in RESTRICTIVE else None


def _both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def _either(a: bool | None, b: bool | None) -> bool | None:
    return True if a or b else None if a is None or b is None else False


def evaluate(expression: str) -> tuple[bool | None, list[str]]:
    """(whether it permits use, licences and exceptions named); ValueError if it is malformed."""
    values: list[tuple[bool | None, str | None]] = []
    waiting: list[str] = []
    named: list[str] = []

    def apply() -> None:
        op = waiting.pop()
        if op == "(" or len(values) < 2:
            raise ValueError(expression)
        (b, right), (a, left) = values.pop(), values.pop()
        if op == "with":
            if left is None or right is None:
                raise ValueError(expression)
            values.append((True if a or (a is False and right in LINKING) else a if right in LINKING else _both(a, None), None))
        else:
            values.append((_both(a, b) if op == "and" else _either(a, b), None))

    operand = True  # whether one is due
    for token in _TOKEN.findall(expression.lower()):
        if token in _RANK and not operand:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                apply()
            waiting.append(token)
            operand = True
        elif token == "(" and operand:
            waiting.append(token)
        elif token == ")" and not operand:
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                raise ValueError(expression)
            waiting.pop()
            values[-1] = (values[-1][0], None)
        elif operand and token not in _RANK and token not in "()" and token[0].isalnum():
            values.append((_licence(token), token))
            named.append(token)
            operand = False
        else:
            raise ValueError(expression)
    while waiting:
        apply()
    if len(values) != 1 or operand:
        raise ValueError(expression)
    return values[0][0], named


@cache
def automaton(tags: bool) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, licence in dict.fromkeys(TAGS).items() if tags else NOTICES.items():
        made.add_word(phrase, (len(phrase), licence))
    made.make_automaton()
    return made


def folded(low: str) -> tuple[str, list[int], list[int]]:
    """The text with blanks folded; the places in it, and in the text, from which on both run side by side."""
    pieces, here, there, at, size = [], [0], [0], 0, 0
    for blank in _BLANK.finditer(low):
        a, b = blank.span()
        if b - a == 1 and low[a] == " ":
            continue
        pieces.append(low[at:a])
        size += a - at + 1
        here.append(size)
        there.append(b)
        at = b
    pieces.append(low[at:])
    return " ".join(pieces), here, there


def _hits(low: str, tags: bool) -> list[tuple[int, int, str | None]]:
    hits = []
    for last, (size, licence) in automaton(tags).iter(low):
        start, end = last + 1 - size, last + 1
        before = start > 0 and low[start - 1].isalnum()
        after = licence is not None and end < len(low) and low[end].isalnum()
        if not before and not after:
            hits.append((start, end, licence))
    return hits


def findings(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, licence; None for a tag) in the lower-case text, the longest of those that overlap, in order."""
    low = text.lower()
    hits = _hits(low, True)
    if any(x in low for x in _HINTS):
        plain, here, there = folded(low)
        place = lambda x: there[k := bisect(here, x) - 1] + x - here[k]
        last = plain.rfind(_THREE_CLAUSES)
        for start, end, licence in _hits(plain, False):
            named = licence if licence != BSD else "bsd-3-clause" if last >= end else "bsd-2-clause"
            hits.append((place(start), place(end - 1) + 1, named))
    hits.sort(key=lambda x: (x[0] - x[1], x[0]))
    starts: list[int] = []
    chosen: dict[int, tuple[int, int, str | None]] = {}
    for hit in hits:
        k = bisect(starts, hit[0])
        clear_before = k == 0 or chosen[starts[k - 1]][1] <= hit[0]
        clear_after = k == len(starts) or starts[k] >= hit[1]
        if clear_before and clear_after:
            starts.insert(k, hit[0])
            chosen[hit[0]] = hit
    return [chosen[x] for x in starts]


def judge(text: str | None) -> tuple[int, list[str], list[str], str]:
    found = findings(text) if text else []
    if not found:
        return 0, [], [], "none"
    low, verdict, licences, expressions = text.lower(), True, set(), []
    tags = [start for start, _, licence in found if licence is None]
    stops = sorted([*tags, *(x.start() for x in _LINE.finditer(low))]) if tags else []
    for _, end, licence in found:
        if licence is not None:
            licences.add(licence)
            verdict = _both(verdict, _licence(licence))
            continue
        k = bisect(stops, end - 1)
        written = low[end : stops[k] if k < len(stops) else len(low)].strip().removesuffix("*/").removesuffix("-->").strip()
        expressions.append(written)
        try:
            allowed, named = evaluate(written)
            licences.update(named)
        except ValueError:
            allowed = None
        verdict = _both(verdict, allowed)
    return len(found), sorted(licences), expressions, _VERDICT[verdict]


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, findings, licences, expressions, verdict) of every document."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, licences, expressions, verdict = zip(*map(judge, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64()), pa.array(licences, pa.list_(pa.string())), pa.array(expressions, pa.list_(pa.string())), pa.array(verdict, pa.string())],
                names=["doc_id", "findings", "licences", "expressions", "verdict"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
