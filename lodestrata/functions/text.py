"""Text of files as column expressions: blocks, fences, line numbers, encodings, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFFED_BYTES = 8192
#: The start of a UTF-8 character at the end of bytes, in hexadecimal.
CUT_OFF = "^(?:..)*?((?:F0[9AB].|F[1-3][89AB].|F48.)(?:[89AB].)?|E0[AB].|E[1-9A-CEF][89AB].|ED[89].|C[2-9A-F]|D.|E.|F[0-4])$"
LANGUAGES = {"bash": "sh", "json": "json", "markdown": "md markdown", "python": "py", "toml": "toml", "yaml": "yml yaml"}


def suffix(path: Column) -> Column:
    """The last suffix of a name, with its dot; '' if it has none. A leading dot begins no suffix."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)


def language(path: Column) -> Column:
    """What a file's suffix says, in any case; null for others."""
    chain, end = F, F.lower(suffix(path))
    for name, ends in LANGUAGES.items():
        chain = chain.when(end.isin(*[f".{e}" for e in ends.split()]), name)
    return chain


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL or aren't UTF-8; a character cut off at their end counts as neither."""
    head = F.substring(content, 1, SNIFFED_BYTES)
    last = F.regexp_extract(F.hex(F.substring(head, SNIFFED_BYTES - 2, 3)), CUT_OFF, 1)
    whole = F.when(F.octet_length(content) > SNIFFED_BYTES, F.substring(head, F.lit(1), SNIFFED_BYTES - F.length(last) / 2)).otherwise(head)
    return (F.position(F.lit(b"\x00"), head) > 0) | ~F.is_valid_utf8(whole.cast("string"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def base64(text: Column) -> Column:
    """Base64 of the UTF-8 bytes, without line breaks."""
    return F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", "")


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\n+\z", "")


def encoded(text: Column, encoding: str) -> Column:
    return base64(text) if encoding == "base64" else text


def markdown_block(path: Column, lang: Column, binary: Column, content: Column, encoding: str = "fence-safe") -> Column:
    """A heading and a fenced body for each file."""
    head = F.concat(F.lit("\n### "), path, F.lit("\n\n"))
    body = encoded(trimmed(content), encoding)
    ticks = F.lit("```") if encoding == "verbatim" else fence(body)
    note = "\n_Content is base64-encoded UTF-8._\n" if encoding == "base64" else ""
    named = F.lit("base64") if encoding == "base64" else F.coalesce(lang, F.lit(""))
    shown = F.concat(head, F.lit(note + "\n"), ticks, named, F.lit("\n"), body, F.lit("\n"), ticks, F.lit("\n"))
    return F.when(binary, F.concat(head, F.lit("_Binary file (content omitted)._\n"))).otherwise(shown)


def plain_block(path: Column, binary: Column, content: Column, encoding: str = "verbatim") -> Column:
    head = F.concat(F.lit("\n" + "=" * 80 + "\n"), path, F.lit("\n"))
    shown = F.concat(head, F.lit("-" * 80 + "\n"), encoded(trimmed(content), encoding), F.lit("\n"))
    return F.when(binary, F.concat(head, F.lit("[BINARY CONTENT OMITTED]\n"))).otherwise(shown)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What ends a line: any of the universal newlines, or line feeds alone.
UNIVERSAL, LINE_FEED = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]", "\n"


def lines(text: Column) -> Column:
    """The lines of a text, as universal newlines divide it; a final newline begins no line."""
    split = F.split(text, UNIVERSAL)
    return bound(split, lambda rows: F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows))


def numbered(text: Column, ends: str = UNIVERSAL) -> Column:
    """Each line after its number, as wide as the last number; a final newline stays. Where line feeds alone end lines, an empty text has one line."""

    def shown(rows: Column) -> Column:
        width = F.length(F.greatest(F.size(rows), F.lit(1)).cast("string"))
        return F.array_join(F.transform(rows, lambda line, k: F.concat(F.lpad((k + 1).cast("string"), width, F.lit(" ")), F.lit(": "), line)), "\n")

    rows = lines(text) if ends == UNIVERSAL else F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), ends)
    return F.concat(bound(rows, shown), F.when(text.endswith("\n"), "\n").otherwise(""))


def in_order(values: Column) -> Column:
    """The distinct values of an array in the order in which they first occur; nulls count as a value."""
    return F.array_distinct(values)


def headings(text: Column, most: int = 200) -> Column:
    """array<struct<level, text>> of the first ATX headings; code fences aren't looked at."""
    pattern = r"^(#{1,6})\s+(.+?)\s*$"
    found = F.filter(lines(text), lambda line: line.rlike(pattern))
    made = F.transform(found, lambda line: F.struct(F.length(F.regexp_extract(line, pattern, 1)).alias("level"), F.regexp_extract(line, pattern, 2).alias("text")))
    return F.slice(made, 1, most)
