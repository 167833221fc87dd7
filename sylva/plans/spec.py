"""Specifications: what a rectangle is to hold, compiled against a sample document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import XmlProfileError, XmlStructureError, XmlTypeError
from ..functions.naming import default_column, ends_with, friendly_path, make_unique
from ..functions.types import SPARK, misfit
from ..operators.structure import XmlStructure, inspect_xml
from ..operators.values import long_values, value_catalog
from ..schema import WIDE_COLUMNS

REPRESENTATIONS = ("auto", "wide", "long")


@dataclass(frozen=True)
class Source:
    """One source of values, as the catalog has it."""

    key: str
    label: str
    field: str
    entity: str
    value_kind: str
    records_observed: int
    max_per_record: int
    under_repetition: bool

    @property
    def scalar(self) -> bool:
        return self.max_per_record == 1 and not self.under_repetition


@dataclass(frozen=True)
class SpecField:
    source: Source
    name: str
    type: str = "character"


@dataclass(frozen=True)
class XmlRectSpec:
    """A compiled rectangle. Reusable for other documents of the same kind."""

    source: str
    whitespace: str
    record_path: tuple[str, ...]
    record_name: str
    records_observed: int
    identifier: Source | None
    representation: str
    repeated_paths: tuple[tuple[str, ...], ...]
    fields: tuple[SpecField, ...]
    catalog: tuple[Source, ...] = field(repr=False, default=())
    profile: object | None = field(repr=False, default=None)
    version: int = 1

    def __repr__(self) -> str:
        identifier = self.identifier.label if self.identifier else "generated"
        lines = [f"<xml_rect_spec> {self.representation}, one row per {self.record_name}" if self.representation == "wide" else f"<xml_rect_spec> long, records {self.record_name}", f"  identifier: {identifier}"]
        lines += [f"  {f.name} <- {f.source.label} ({f.type})" for f in self.fields]
        return "\n".join(lines)


def read_catalog(values: DataFrame) -> list[Source]:
    """The catalog on the driver, in first-seen order; it grows with the vocabulary, not the documents."""
    rows = value_catalog(values).orderBy("first_document", "first_order").collect()
    return [Source(r.source_key, r.source_label, r.field, r.entity, r.value_kind, r.records_observed, r.max_per_record, r.under_repetition) for r in rows]


def find_source(catalog: list[Source], selector: str, argument: str = "fields") -> Source:
    """The one source whose label ends with the steps; an @ may be left out."""
    steps = friendly_path(selector, argument)
    named = any(s.startswith("@") for s in steps)

    def fits(label: str) -> bool:
        parts = label.split("/")
        return ends_with(parts, steps) or (not named and ends_with([p.removeprefix("@") for p in parts], steps))

    found = [s for s in catalog if fits(s.label)]
    if not found:
        raise XmlStructureError(f"{argument} '{selector}' matches no value source")
    if len(found) > 1:
        raise XmlStructureError(f"{argument} '{selector}' is ambiguous: {', '.join(f'{s.label} ({s.value_kind})' for s in found)}")
    return found[0]


def select_fields(catalog: list[Source], fields: dict[str, str] | list[str] | None) -> list[tuple[Source, str | None]]:
    """(source, the user's name or None) of every selected source."""
    if fields is None:
        return [(s, None) for s in catalog]
    pairs = list(fields.items()) if isinstance(fields, dict) else [(None, f) for f in ([fields] if isinstance(fields, str) else fields)]
    out = [(find_source(catalog, selector), name) for name, selector in pairs]
    seen: set[str] = set()
    for source, _ in out:
        if source.key in seen:
            raise XmlStructureError(f"fields selects '{source.label}' more than once")
        seen.add(source.key)
    return out


def output_names(selected: list[tuple[Source, str | None]], representation: str) -> list[str]:
    if representation == "long":
        return [name or source.field for source, name in selected]
    given = [name for _, name in selected if name]
    if len(set(given)) < len(given):
        raise XmlProfileError("two fields have the same name")
    reserved = [n for n in given if n in WIDE_COLUMNS]
    if reserved:
        raise XmlProfileError(f"'{reserved[0]}' is a reserved column name")
    # Names that users gave and reserved ones are taken before automatic ones are told apart.
    taken = [*WIDE_COLUMNS, *given]
    automatic = make_unique(taken + [default_column(source.label) for source, name in selected if not name], "_")[len(taken) :]
    rest = iter(automatic)
    return [name or next(rest) for _, name in selected]


def valid_identifiers(values: DataFrame, candidates: list[Source], records: int) -> set[str]:
    """Keys of the sources with exactly one value in every record, never empty, and unique in each document. One job for all."""
    if not candidates:
        return set()
    some = values.where(F.col("source_key").isin([s.key for s in candidates]))
    by_value = some.groupBy("source_key", "document_id", "value").agg(F.count("*").alias("n"), F.count_distinct("record_node_id").alias("records"))
    seen = by_value.groupBy("source_key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min(F.length("value")).alias("shortest"), F.max(F.col("value").isNull()).alias("missing"))
    return {r.source_key for r in seen.collect() if r.n == records and r.most == 1 and (r.shortest or 0) > 0 and not r.missing} & {s.key for s in candidates if s.records_observed == records and s.max_per_record == 1}


def choose_identifier(values: DataFrame, catalog: list[Source], records: int, identify_by: str | bool | None) -> Source | None:
    if identify_by is False:
        return None
    if identify_by is True:
        raise XmlProfileError("identify_by must be a source, None or False")
    if identify_by is not None:
        source = find_source(catalog, identify_by, "identify_by")
        if source.key not in valid_identifiers(values, [source], records):
            raise XmlStructureError(f"identify_by '{identify_by}' needs exactly one non-empty, unique value in every record")
        return source
    named = [s for s in catalog if not s.under_repetition and s.label.split("/")[-1].removeprefix("@") == "id"]
    valid = valid_identifiers(values, named, records)
    found = [s for s in named if s.key in valid]
    attributes = [s for s in found if s.value_kind == "attribute"]
    if len(attributes) == 1:
        return attributes[0]
    return found[0] if len(found) == 1 else None


def field_types(catalog: list[Source], selected: list[tuple[Source, str | None]], names: list[str], types: dict[str, str] | None, representation: str) -> list[str]:
    """A type for each selected source. types: by output name or source."""
    out = ["character"] * len(selected)
    declared: set[int] = set()
    for key, kind in (types or {}).items():
        if kind not in SPARK:
            raise XmlProfileError(f"unknown type '{kind}'; supported: {', '.join(SPARK)}")
        if key in names:
            at = names.index(key)
        else:
            source = find_source(catalog, key, "types")
            at = next((i for i, (s, _) in enumerate(selected) if s.key == source.key), -1)
            if at < 0:
                raise XmlProfileError(f"types names '{key}', which isn't selected")
        if at in declared:
            raise XmlProfileError(f"types declares '{selected[at][0].label}' more than once")
        declared.add(at)
        out[at] = kind
    if representation == "long" and any(k != "character" for k in out):
        raise XmlProfileError("types other than character need the wide representation")
    return out


def check_types(values: DataFrame, fields: list[SpecField]) -> None:
    """Raises XmlTypeError for the first value, in document order, that doesn't fit its declared type."""
    typed = [f for f in fields if f.type != "character"]
    if not typed:
        return
    bad = None
    for f in typed:
        one = (F.col("source_key") == f.source.key) & misfit(F.col("value"), f.type)
        bad = one if bad is None else bad | one
    first = values.where(bad).orderBy("document_id", "node_order").select("source_key", "value").limit(1).collect()
    if first:
        f = next(f for f in typed if f.source.key == first[0].source_key)
        raise XmlTypeError(f.source.label, f.name, f.type, first[0].value)


def make_rectangle(structure: XmlStructure, one_row_per: str | list[str], namespace: str | None = None, identify_by: str | bool | None = None, fields=None, types: dict[str, str] | None = None, representation: str = "auto") -> XmlRectSpec:
    """Compiles a specification against an inspected sample."""
    if representation not in REPRESENTATIONS:
        raise XmlProfileError(f"representation must be one of {', '.join(REPRESENTATIONS)}")
    record = structure.find(one_row_per, "one_row_per", namespace)
    repeated = structure.repeated_below(record)
    values = long_values(structure.nodes, record.path, [p.path for p in repeated]).persist()
    try:
        catalog = read_catalog(values)
        if not catalog:
            raise XmlStructureError(f"'{record.display_path}' has no values")
        selected = select_fields(catalog, fields)
        unsafe = [s for s, _ in selected if not s.scalar]
        if representation == "wide" and unsafe:
            raise XmlStructureError(f"the wide representation would flatten repeated sources: {', '.join(s.label for s in unsafe)}")
        if representation == "auto":
            representation = "long" if unsafe else "wide"
        names = output_names(selected, representation)
        kinds = field_types(catalog, selected, names, types, representation)
        chosen = [SpecField(s, n, k) for (s, _), n, k in zip(selected, names, kinds, strict=True)]
        check_types(values, chosen)
        identifier = choose_identifier(values, catalog, record.occurrences, identify_by)
    finally:
        values.unpersist()
    return XmlRectSpec(structure.source, structure.whitespace, record.path, record.local_path[-1], record.occurrences, identifier, representation, tuple(p.path for p in repeated), tuple(chosen), tuple(catalog))


def rectangle_spec(spark: SparkSession, sample: str | DataFrame, one_row_per: str, namespace: str | None = None, identify_by=None, fields=None, types=None, representation: str = "auto", whitespace: str = "drop_blank") -> XmlRectSpec:
    """Inspects a sample (a file, or a canonical table) and compiles a specification."""
    structure = inspect_xml(sample) if isinstance(sample, DataFrame) else inspect_xml(spark, sample, whitespace)
    try:
        return make_rectangle(structure, one_row_per, namespace, identify_by, fields, types, representation)
    finally:
        if not isinstance(sample, DataFrame):
            structure.nodes.unpersist()


propose_rectangle = rectangle_spec


def review_rectangle(spark: SparkSession, spec: XmlRectSpec) -> DataFrame:
    """A row for each field of a specification."""
    rows = [(f.name, f.source.label, f.type, f.source.value_kind, f.source.entity, f.source.under_repetition, f.source.max_per_record) for f in spec.fields]
    return spark.createDataFrame(rows, "output_name string, source string, declared_type string, value_kind string, entity string, under_repetition boolean, max_per_record long")
