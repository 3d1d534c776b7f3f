"""Path predicates: skipped folders, tests, noise, source files, safe relative paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import glob_regex


@dataclass(frozen=True)
class PathRules:
    """What a profile counts as skipped, test, noise and source."""

    skipped: tuple[str, ...] = ("node_modules", "vendor", "dist", ".git")
    skipped_at_root: tuple[str, ...] = ("build",)
    test_dirs: tuple[str, ...] = ("test", "tests", "spec")
    test_globs: tuple[str, ...] = ("test_*", "*_test.*", "*.spec.*")
    locks: tuple[str, ...] = ("package-lock.json", "poetry.lock", "yarn.lock")
    docs: tuple[str, ...] = ("md", "rst", "txt")
    sources: tuple[str, ...] = ("py", "js", "ts", "go", "java", "sol")


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _any(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def is_skipped(path: Column, rules: PathRules) -> Column:
    root = F.get(directories(path), F.lit(0)).isin(*rules.skipped_at_root)
    return F.arrays_overlap(directories(path), _any(rules.skipped)) | F.coalesce(root, F.lit(False))


def is_test(path: Column, rules: PathRules) -> Column:
    name = F.lower(basename(path))
    globbed = F.lit(False)
    for glob in rules.test_globs:
        globbed = globbed | name.rlike(glob_regex(glob))
    return F.arrays_overlap(directories(path), _any(rules.test_dirs)) | globbed


def is_noise(path: Column, rules: PathRules) -> Column:
    return is_skipped(path, rules) | is_test(path, rules) | basename(path).isin(*rules.locks) | extension(path).isin(*rules.docs)


def is_source(path: Column, rules: PathRules) -> Column:
    return extension(path).isin(*rules.sources)


def is_unsafe(path: Column) -> Column:
    """Empty, absolute, or climbing."""
    return (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def relative(path: Column, strip_sides: bool = False) -> Column:
    """Without a leading ./; diffs' paths also without a/ or b/."""
    out = F.regexp_replace(path, r"^\./", "")
    return F.regexp_replace(out, r"^[ab]/", "") if strip_sides else out
