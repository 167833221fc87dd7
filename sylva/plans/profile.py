"""Profiles: short descriptions of a rectangle that people write, as objects, JSON or YAML."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import XmlProfileError, XmlStructureError
from ..functions.naming import friendly_path
from ..functions.types import SPARK
from .spec import XmlRectSpec, rectangle_spec

LAYOUTS = ("safe", "wide", "long")
KEYS = ("version", "rows", "id", "fields", "types", "namespace", "layout")
#: What the compiler's arguments are called in a profile.
REWORDED = (("one_row_per", "rows"), ("identify_by", "id"), ("representation", "layout"))


@dataclass(frozen=True)
class XmlProfile:
    rows: str
    id: str | None = None
    fields: dict[str, str] | list[str] | None = None
    types: dict[str, str] | None = None
    namespace: str | None = None
    layout: str = "safe"
    version: int = 1

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in KEYS}

    def __repr__(self) -> str:
        lines = [f"<xml_profile> rows: {self.rows}", f"  id: {self.id or 'generated'}", f"  layout: {self.layout}"]
        if self.namespace:
            lines.append(f"  namespace: {self.namespace}")
        pairs = self.fields.items() if isinstance(self.fields, dict) else ((f, f) for f in self.fields or ())
        lines += [f"  {name} <- {source}" for name, source in pairs]
        lines += [f"  {name}: {kind}" for name, kind in (self.types or {}).items()]
        return "\n".join(lines)


def _path(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise XmlProfileError(f"{name} must be one non-empty path")
    try:
        return "/".join(friendly_path(value, name))
    except XmlStructureError as error:
        raise XmlProfileError(str(error)) from error


def xml_profile(rows: str, id: str | bool | None = None, fields=None, types=None, namespace: str | None = None, layout: str = "safe") -> XmlProfile:  # noqa: A002
    """A checked profile. id: a source; None or False for generated ones."""
    if id is True:
        raise XmlProfileError("id must be a source, None or False")
    if layout not in LAYOUTS:
        raise XmlProfileError(f"layout must be one of {', '.join(LAYOUTS)}")
    if namespace is not None and (not isinstance(namespace, str) or not namespace):
        raise XmlProfileError("namespace must be one non-empty URI")
    if isinstance(fields, str):
        fields = [fields]
    if fields is not None:
        names, sources = (list(fields), list(fields.values())) if isinstance(fields, dict) else ([], list(fields))
        if not sources or any(not isinstance(x, str) or not x for x in [*names, *sources]):
            raise XmlProfileError("fields must be all named or all unnamed, and not empty")
        if len(set(sources)) < len(sources):
            raise XmlProfileError("fields must be unique")
        sources = [_path(x, "fields") for x in sources]
        fields = dict(zip(names, sources, strict=True)) if names else sources
    if types is not None:
        if not isinstance(types, dict) or any(not isinstance(k, str) or not k for k in types):
            raise XmlProfileError("types must map sources to types")
        unknown = [k for k in types.values() if k not in SPARK]
        if unknown:
            raise XmlProfileError(f"unknown type '{unknown[0]}'; supported: {', '.join(SPARK)}")
        types = dict(types) or None
    return XmlProfile(_path(rows, "rows"), _path(id, "id") if id not in (None, False) else None, fields, types, namespace, layout)


def as_xml_profile(x: object) -> XmlProfile:
    """A profile from a mapping with the known keys and no others."""
    if isinstance(x, XmlProfile):
        return x
    if not isinstance(x, dict) or any(not isinstance(k, str) for k in x):
        raise XmlProfileError("a profile must be a mapping with unique names")
    unknown = [k for k in x if k not in KEYS]
    if unknown:
        raise XmlProfileError(f"unknown profile key '{unknown[0]}'")
    if x.get("rows") is None:
        raise XmlProfileError("a profile needs rows")
    if x.get("version", 1) != 1 or isinstance(x.get("version", 1), bool):
        raise XmlProfileError(f"profile version {x.get('version')!r} is not supported")
    return xml_profile(x["rows"], x.get("id"), x.get("fields"), x.get("types"), x.get("namespace"), x.get("layout") or "safe")


def _format(file: str, format: str) -> str:  # noqa: A002
    if format not in ("auto", "json", "yaml"):
        raise XmlProfileError("format must be auto, json or yaml")
    if format != "auto":
        return format
    suffix = Path(file).suffix.lower()
    found = {".json": "json", ".yaml": "yaml", ".yml": "yaml"}.get(suffix)
    if not found:
        raise XmlProfileError(f"the format of '{file}' can't be told from its extension")
    return found


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise XmlProfileError("YAML profiles need the package PyYAML") from error
    return yaml


def _unique_pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise XmlProfileError("a profile must have unique names")
    return out


def write_xml_profile(profile: XmlProfile | dict, file: str, format: str = "auto", overwrite: bool = False) -> str:  # noqa: A002
    """Writes a profile; an existing file stays unless overwrite is set. Returns the file's full path."""
    profile = as_xml_profile(profile)
    kind, path = _format(file, format), Path(file)
    if not path.parent.is_dir():
        raise XmlProfileError(f"folder '{path.parent}' doesn't exist")
    if path.exists() and not overwrite:
        raise XmlProfileError(f"'{file}' exists already")
    text = json.dumps(profile.to_dict(), indent=2, ensure_ascii=False) + "\n" if kind == "json" else _yaml().safe_dump(profile.to_dict(), sort_keys=False, allow_unicode=True)
    path.write_text(text, encoding="utf-8")
    return str(path.resolve())


def read_xml_profile(file: str, format: str = "auto") -> XmlProfile:  # noqa: A002
    kind = _format(file, format)
    if not Path(file).is_file():
        raise XmlProfileError(f"'{file}' doesn't exist")
    text = Path(file).read_text(encoding="utf-8")
    try:
        found = json.loads(text, object_pairs_hook=_unique_pairs) if kind == "json" else _yaml().safe_load(text)
    except XmlProfileError:
        raise
    except Exception as error:
        raise XmlProfileError(f"'{file}' isn't valid {kind.upper()}: {error}") from error
    return as_xml_profile(found)


def compile_xml_profile(spark: SparkSession, profile: XmlProfile | dict, sample: str | DataFrame, whitespace: str = "drop_blank") -> XmlRectSpec:
    """The specification that a profile means for a sample (a file or a canonical table)."""
    profile = as_xml_profile(profile)
    try:
        spec = rectangle_spec(spark, sample, profile.rows, profile.namespace, profile.id if profile.id is not None else False, profile.fields, profile.types, "auto" if profile.layout == "safe" else profile.layout, whitespace)
    except (XmlStructureError, XmlProfileError) as error:
        text = str(error)
        for a, b in REWORDED:
            text = text.replace(a, b)
        raise XmlProfileError(text) from error
    return replace(spec, profile=profile)
