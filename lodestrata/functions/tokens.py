"""Token counts under named encodings.

`words` is an approximation in the JVM, of letters, digits, marks and runs of space. Others are counted
exactly, in Arrow batches: a name that was registered with a vocabulary file of ranks, the path of such a
file, or a name that the token library knows (it keeps those vocabularies in a cache of its own, or fetches them).
"""

from __future__ import annotations

import base64
import os
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

APPROXIMATE = "words"
PIECES = r"([A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9\s]|\s+)"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Vocabulary files by name.
ENCODINGS: dict[str, str] = {}


def register(name: str, path: str) -> None:
    """From now on, counts under that name are by the ranks in that file; workers read it, so all must see it."""
    if name == APPROXIMATE:
        raise ValueError(f"{name} is built in")
    if not os.path.isfile(path):
        raise ValueError(f"no such vocabulary: {path}")
    ENCODINGS[name] = path


def resolved(encoding: str) -> str:
    """What workers, which know no registered names, can count by: the file of a name, or the name itself."""
    found = ENCODINGS.get(encoding, encoding)
    if found != APPROXIMATE and not os.path.isfile(found):
        import tiktoken

        if found not in tiktoken.list_encoding_names():
            raise ValueError(f"no such encoding: {encoding}")
    return found


@cache
def _encoding(path: str):
    import tiktoken

    if not os.path.isfile(path):
        return tiktoken.get_encoding(path)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, encoding: str = APPROXIMATE) -> int:
    """On the driver, for prefixes and whole artifacts."""
    import re

    return len(re.findall(PIECES, text, re.ASCII)) if encoding == APPROXIMATE else len(_encoding(resolved(encoding)).encode_ordinary(text))


def count_column(text: Column, encoding: str = APPROXIMATE) -> Column:
    if encoding == APPROXIMATE:
        return F.size(F.regexp_extract_all(text, F.lit(PIECES), F.lit(1))).cast("long")

    known = resolved(encoding)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        encoder = _encoding(known)
        return texts.map(lambda t: None if t is None else len(encoder.encode_ordinary(t)))

    return counted(text)
