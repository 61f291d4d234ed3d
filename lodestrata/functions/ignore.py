r"""Ordered ignore rules, include globs and representation rules as column expressions.

Rules are configuration: they're parsed on the driver and become one folded `CASE`, so that Spark
evaluates them inside whole-stage code. Paths are POSIX paths relative to the root.

A pattern without a slash tests the last name of a path; a leading slash anchors it at the root;
any other pattern with a slash may begin at every directory. `*` and `?` don't cross slashes, `**`
crosses any number of directories, none included. A pattern that ends in a slash is for directories and
what they hold. Of all rules that match, the last decides, and `!` makes it re-include. A directory
that is ignored hides everything below it, whatever later rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Never of interest: caches, environments, build products, logs, system files.
DEFAULTS = tuple(
    ".DS_Store .git/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .runtime/ .skeleton/ .tox/ .venv/ "
    "*.bak *.egg-info/ *.log *.log.* *.pyc *.tmp Thumbs.db __pycache__/ build/ dist/".split()
)
#: Read from the root only, in this order.
STANDARD_FILES = (".repomixignore", ".ignore", ".gitignore", ".git/info/exclude")
REPRESENTATIONS = ("meta", "summary", "content")


class RuleError(ValueError):
    """A rule that isn't understood; never skipped."""


def parse_line(raw: str, negation: bool = True) -> tuple[str, bool] | None:
    """(pattern, negated) of a line of an ignore file; None for blank lines and comments."""
    line = raw.rstrip("\r\n")
    if line.startswith("#"):
        return None
    body = line.rstrip(" ")
    if len(body) < len(line):
        slashes = len(body) - len(body.rstrip("\\"))
        if slashes % 2:
            body = body[:-1] + " "
    if not body:
        return None
    literal = body[:2] in ("\\#", "\\!")
    if literal:
        body = body[1:]
    negated = negation and not literal and body[0] == "!"
    if negated:
        body = body[1:]
    if not body:
        raise RuleError("a rule needs a pattern after '!'")
    if "\\" in body:
        raise RuleError(f"backslashes only escape a leading # or !, or a trailing space: {raw!r}")
    return body, negated


def _segment(glob: str) -> str:
    """A regular expression for one path segment, in the syntax that Java and RE2 share."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", k + 1 + glob.startswith("!", k))) > 0:
            inside = re.sub(r"([\\\[&~^])", r"\\\1", glob[k:end].removeprefix("!"))
            out.append(f"[^/{inside}]" if glob[k] == "!" else f"[{inside}]")
            k = end + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c.isascii() else c)
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False
    source: str = "cli"

    @property
    def directories_only(self) -> bool:
        return self.pattern.endswith("/")

    @property
    def anchored(self) -> bool:
        return self.pattern.startswith("/")

    def regex(self, is_dir: bool) -> str:
        """For '/' + path; the root itself is ''."""
        body = self.pattern.rstrip("/") if self.directories_only else self.pattern
        anchored, body = body.startswith("/"), body.lstrip("/") if body.startswith("/") else body
        anywhere = "(?:/[^/]+)*"
        if "/" not in body and not anchored:
            core = f"{anywhere}/{_segment(body)}"
        else:
            core = ("" if anchored else anywhere) + "".join(anywhere if part == "**" else f"/{_segment(part)}" for part in body.split("/"))
        if self.directories_only:
            core += anywhere if is_dir else "(?:/[^/]+)+"
        return f"^{core}$"

    def matches(self, path: str, is_dir: bool) -> bool:
        return re.search(self.regex(is_dir), "" if path in ("", ".") else "/" + path) is not None


def compile_rules(lines: Iterable[str | tuple[str, str]], negation: bool = True) -> list[Rule]:
    rules = []
    for line in lines:
        text, source = line if isinstance(line, tuple) else (line, "cli")
        if (found := parse_line(text, negation)) is not None:
            rules.append(Rule(*found, source))
    return rules


def excluded(rules: Sequence[Rule], path: str, is_dir: bool) -> bool:
    """The last matching rule's word on one path, on the driver, without regard to directories above it."""
    return next((not r.negated for r in reversed(rules) if r.matches(path, is_dir)), False)


def _rooted(path: Column) -> Column:
    return F.when(path.isin("", "."), F.lit("")).otherwise(F.concat(F.lit("/"), path))


def _match(rule: Rule, path: Column, is_dir: Column | bool) -> Column:
    if isinstance(is_dir, bool) or not rule.directories_only:
        return _rooted(path).rlike(rule.regex(is_dir if isinstance(is_dir, bool) else False))
    return F.when(is_dir, _rooted(path).rlike(rule.regex(True))).otherwise(_rooted(path).rlike(rule.regex(False)))


def _last(rules: Sequence[Rule], path: Column, is_dir: Column | bool, value, default: Column) -> Column:
    chain = None
    for rule in reversed(rules):
        test = _match(rule, path, is_dir)
        chain = F.when(test, value(rule)) if chain is None else chain.when(test, value(rule))
    return default if chain is None else chain.otherwise(default)


def excluded_column(rules: Sequence[Rule], path: Column, is_dir: Column | bool) -> Column:
    """Whether the last matching rule excludes a path by itself."""
    return _last(rules, path, is_dir, lambda r: F.lit(not r.negated), F.lit(False))


def deciding_column(rules: Sequence[Rule], path: Column, is_dir: Column | bool) -> Column:
    """struct(pattern, source) of the last matching rule, if it excludes; null otherwise."""
    shape = "struct<pattern: string, source: string>"
    kept = F.lit(None).cast(shape)
    value = lambda r: kept if r.negated else F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.source).alias("source"))
    return _last(rules, path, is_dir, value, kept)


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def pruned_column(rules: Sequence[Rule], path: Column) -> Column:
    """The topmost excluded directory above a path; null if there is none."""
    return F.try_element_at(F.filter(ancestors(path), lambda d: excluded_column(rules, d, True)), F.lit(1))


def hidden_column(rules: Sequence[Rule], path: Column, is_dir: Column | bool) -> Column:
    """Whether a walk from the root never shows the path."""
    return F.exists(ancestors(path), lambda d: excluded_column(rules, d, True)) | excluded_column(rules, path, is_dir)


def included_column(globs: Sequence[str], path: Column) -> Column:
    """Whether any include glob names the file; all are included where there are no globs."""
    rules = compile_rules(globs, negation=False)
    if not rules:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [_match(r, path, False) for r in rules])


def representation_rules(meta: Sequence[str] = (), summary: Sequence[str] = (), content: Sequence[str] = ()) -> list[tuple[Rule, str]]:
    """Later ones win: those for meta first, then summary, then content."""
    return [(rule, kind) for kind, globs in zip(REPRESENTATIONS, (meta, summary, content), strict=True) for rule in compile_rules(globs, negation=False)]


def representation_column(rules: Sequence[tuple[Rule, str]], path: Column, is_binary: Column, content: bool = True) -> Column:
    """meta, summary or content: the last rule's word, or else meta for binary files, summary for Python, meta for the rest."""
    chain = None
    for rule, kind in reversed(rules):
        test = _match(rule, path, False)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    usual = F.when(is_binary | F.lit(not content), "meta").when(path.endswith(".py"), "summary").otherwise("meta")
    return usual if chain is None else chain.otherwise(usual)
