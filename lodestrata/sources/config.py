"""The configuration file: strict, and searched for from a directory upwards."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path, PurePosixPath

from lodestrata.functions import outline, pysource
from lodestrata.plans import pack as packing
from lodestrata.plans import skeleton

NAMES = (".lodestrata.yaml", ".lodestrata.yml")
RENAMED = {"respect_standard_ignores": "standard_ignores", "fit_to_max_output": "fit", "summary_config": "bounds", "pyright_langserver_cmd": "langserver"}


class ConfigError(ValueError):
    """A key or value that isn't known."""


def _strict(kind: type, given: dict, where: str) -> dict:
    if not isinstance(given, dict):
        raise ConfigError(f"{where} must be a mapping")
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ConfigError(f"{where} has unknown keys: {', '.join(sorted(unknown))}")
    return given


@dataclass
class Source:
    path: str
    output: str | None = None
    level: str | None = None
    formats: list[str] | None = None
    exclude: list[str] | None = None
    symlinks: str | None = None
    workers: int | None = None

    def __post_init__(self) -> None:
        if not self.path.strip():
            raise ConfigError("a source needs a path")
        if self.output is not None:
            inside = PurePosixPath(self.output.replace("\\", "/").strip("/"))
            if not inside.parts or ".." in inside.parts:
                raise ConfigError(f"a source's output must lie below the output: {self.output!r}")
            self.output = inside.as_posix()


@dataclass
class Config:
    output: str = ".skeleton"
    sources: list[Source] = field(default_factory=list)
    level: str = "modules"
    formats: list[str] = field(default_factory=lambda: ["yaml"])
    exclude: list[str] = field(default_factory=lambda: list(skeleton.DEFAULT_EXCLUDE))
    symlinks: str = "forbid"
    workers: int = 0
    pack: packing.Options | None = None

    def __post_init__(self) -> None:
        if self.level not in pysource.LEVELS or set(self.formats) - set(skeleton.FORMATS):
            raise ConfigError("an unknown level or format")


def parse(text: str) -> Config:
    import yaml

    given = dict(_strict(Config, yaml.safe_load(text) or {}, "the configuration"))
    given["sources"] = [Source(**_strict(Source, s, "a source")) for s in given.get("sources") or []]
    if given.get("pack") is not None:
        options = {RENAMED.get(k, k): v for k, v in dict(given["pack"]).items() if k != "workers"}
        if "prefix" in options:
            options["minimal_prefix"] = options.pop("prefix") == "minimal"
        for name in ("no_structure", "no_files"):
            if name in options:
                options[name.removeprefix("no_")] = not options.pop(name)
        if "bounds" in options:
            options["bounds"] = outline.Bounds(**_strict(outline.Bounds, options["bounds"], "summary_config"))
        given["pack"] = packing.Options(**_strict(packing.Options, options, "pack"))
        given["pack"].check()
    return Config(**given)


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text(encoding="utf-8"))


def find(start: str | Path) -> Path | None:
    """The nearest configuration file, from a directory upwards."""
    here = Path(start).resolve()
    return next((d / n for d in (here, *here.parents) for n in NAMES if (d / n).is_file()), None)


def dump(config: Config) -> str:
    import yaml

    shown = {k: v for k, v in asdict(config).items() if v not in (None, [])}
    shown["sources"] = [{k: v for k, v in asdict(s).items() if v is not None} for s in config.sources]
    if config.pack is None:
        shown.pop("pack", None)
    return yaml.safe_dump(shown, sort_keys=False, allow_unicode=True)
