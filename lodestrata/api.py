"""The public names."""

from lodestrata.plans.pack import Options, Result, pack
from lodestrata.plans.skeleton import Skeleton, generate, validate, write
from lodestrata.sources.config import Config, find, load

__all__ = ["Config", "Options", "Result", "Skeleton", "find", "generate", "load", "pack", "validate", "write"]
