"""Names, paths and keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the parts of a source key.
KEY_SEPARATOR = "\u001e"


def local_of(name: str) -> str:
    """The local part of an expanded name."""
    return name.rpartition("}")[2]


def uri_of(name: str) -> str:
    return name[1:].rpartition("}")[0] if name.startswith("{") else ""


def path_key(path: list[str]) -> str:
    """A path as text: every step with its length in bytes before it."""
    return "|".join(f"{len(p.encode())}:{p}" for p in path)


def path_key_column(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)), "|")


def locals_column(path: Column) -> Column:
    return F.transform(path, lambda p: F.regexp_replace(p, r"^\{.*\}", ""))


def friendly_path(path: str | list[str], argument: str = "path") -> list[str]:
    """The steps of a path that a user writes: a list, or text with / or > between the steps."""
    from ..errors import XmlStructureError

    steps = re.split(r"[/>]", path) if isinstance(path, str) else list(path)
    if not all(isinstance(s, str) for s in steps):
        raise XmlStructureError(f"{argument} must be text")
    steps = [s.strip() for s in steps]
    steps = [s for s in steps if s]
    if not steps:
        raise XmlStructureError(f"{argument} must not be empty")
    return steps


def ends_with(path: list[str], suffix: list[str]) -> bool:
    return len(suffix) <= len(path) and path[len(path) - len(suffix) :] == suffix


def starts_with(path: list[str], prefix: list[str]) -> bool:
    return path[: len(prefix)] == prefix


def make_unique(names: list[str], separator: str) -> list[str]:
    """The first of equal names stays; later ones get separator and the first number that makes them new."""
    taken, seen, counts, out = set(names), set(), {}, []
    for name in names:
        if name not in seen:
            seen.add(name)
            out.append(name)
            continue
        n = counts.get(name, 0) + 1
        while f"{name}{separator}{n}" in taken:
            n += 1
        counts[name] = n
        taken.add(f"{name}{separator}{n}")
        out.append(f"{name}{separator}{n}")
    return out


def default_column(label: str) -> str:
    return label.replace("@", "").replace("/", "_") or "value"
