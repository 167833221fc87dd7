"""Proposals: evidence about rows, identifiers, fields and types, for a person to decide on. Never an executable profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import XmlProposalError
from ..functions.naming import ends_with
from ..functions.types import inferred, observations
from ..operators.structure import PathInfo, XmlStructure, inspect_xml
from ..operators.values import long_values
from ..sources.xsd import XsdInspection, inspect_xsd, match_declarations
from .profile import XmlProfile, xml_profile
from .spec import Source, read_catalog, valid_identifiers


@dataclass(frozen=True)
class RowCandidate:
    path: str
    namespace_uri: str
    occurrences: int
    depth: int
    priority: str
    evidence: str
    reason: str


@dataclass(frozen=True)
class IdCandidate:
    source: str
    value_kind: str
    priority: str
    reason: str


@dataclass(frozen=True)
class FieldCandidate:
    source: str
    value_kind: str
    entity: str
    records_observed: int
    coverage: float
    max_per_record: int
    under_repetition: bool
    wide_safe: bool
    sample_type: str
    sample_confidence: str
    sample_reason: str
    xsd_match: str = "none"
    xsd_selector: str | None = None
    xsd_type: str | None = None
    xsd_analytical_type: str | None = None
    xsd_required: bool | None = None
    xsd_repeated: bool | None = None


@dataclass
class XmlProposal:
    source: str
    whitespace: str
    row_selection: str
    selected_rows: str | None
    selected_namespace: str | None
    row_candidates: list[RowCandidate]
    id_candidates: list[IdCandidate] = field(default_factory=list)
    field_candidates: list[FieldCandidate] = field(default_factory=list)
    xsd: XsdInspection | None = None
    profile_template: XmlProfile | None = None
    version: int = 1

    def __repr__(self) -> str:
        lines = [f"<xml_profile_proposal> {self.source}", f"  rows: {self.selected_rows or 'a choice is required'} ({self.row_selection})"]
        lines += [f"    {c.path} [{c.priority}] {c.occurrences}" for c in self.row_candidates]
        lines += [f"  id: {c.source} [{c.priority}]" for c in self.id_candidates]
        lines += [f"  field: {c.source} {c.sample_type}/{c.sample_confidence} {c.coverage:.0%}" for c in self.field_candidates]
        return "\n".join(lines)


def row_candidates(structure: XmlStructure, xsd: XsdInspection | None) -> list[tuple[RowCandidate, PathInfo]]:
    """Complex paths that repeat in the sample or by the schema; else the root."""
    declared = [d.selector.split("/") for d in (xsd.declarations if xsd else ()) if d.kind == "element" and d.repeated]
    found = []
    for p in structure.paths:
        by_xsd = any(ends_with(p.local_path, d) for d in declared)
        if p.complex and (p.repeated or by_xsd):
            found.append((p, "sample+xsd" if p.repeated and by_xsd else "sample" if p.repeated else "xsd"))
    if not found:
        reason = "nothing with elements inside repeats, in the sample or by the schema, so the root is all that is left"
        return [(RowCandidate(p.display_path, p.namespace_uri, p.occurrences, p.depth, "single_document", "sample", reason), p) for p in structure.paths if p.depth == 1]
    least = min(p.depth for p, _ in found)
    out = []
    for p, evidence in found:
        first = p.depth == least
        where = "no other candidate lies less deep" if first else "another candidate lies less deep"
        out.append((RowCandidate(p.display_path, p.namespace_uri, p.occurrences, p.depth, "primary" if first else "alternative", evidence, f"repeats and has elements inside, by {evidence}; {where}"), p))
    return sorted(out, key=lambda x: (x[0].priority != "primary", x[0].depth, -x[0].occurrences, x[0].path))


def id_candidates(values: DataFrame, catalog: list[Source], records: int) -> list[IdCandidate]:
    """Valid identifiers, those named like one first."""
    scalar = [s for s in catalog if not s.under_repetition]
    valid = valid_identifiers(values, scalar, records)
    out = []
    for s in scalar:
        if s.key not in valid:
            continue
        name, attribute = s.label.split("/")[-1].removeprefix("@").lower(), s.value_kind == "attribute"
        named = name == "id" or name.endswith(("_id", "-id"))
        if name == "id" and attribute:
            out.append(IdCandidate(s.label, s.value_kind, "strong", "an attribute named id, once in every record and never the same"))
        elif named:
            out.append(IdCandidate(s.label, s.value_kind, "strong", "its name ends like an identifier's; once in every record and never the same"))
        else:
            what = "an attribute" if attribute else "a value"
            out.append(IdCandidate(s.label, s.value_kind, "plausible" if attribute else "possible", f"{what} that every record has once and no two share; whether it identifies them is for the user to say"))
    return sorted(out, key=lambda c: ("strong", "plausible", "possible").index(c.priority))


def field_candidates(values: DataFrame, catalog: list[Source], records: int, xsd: XsdInspection | None) -> list[FieldCandidate]:
    """A row for each source with its coverage and the type that its values suggest. All sources in one aggregation."""
    seen = {r.source_key: r.asDict() for r in values.groupBy("source_key").agg(*(v.alias(k) for k, v in observations(F.col("value")).items())).collect()}
    out = []
    for s in catalog:
        kind, sure, reason = inferred(seen[s.key])
        match, d = match_declarations(s.label, s.value_kind, xsd.declarations) if xsd else ("none", None)
        more = (d.selector, d.type, d.analytical_type, d.required, d.repeated) if d else (None,) * 5
        out.append(FieldCandidate(s.label, s.value_kind, s.entity, s.records_observed, s.records_observed / records, s.max_per_record, s.under_repetition, s.scalar, kind, sure, reason, match, *more))
    return out


def propose_xml_profile(spark: SparkSession, sample: str | DataFrame, rows: str | None = None, namespace: str | None = None, xsd: str | XsdInspection | None = None, whitespace: str = "drop_blank", rows_only: bool = False) -> XmlProposal:
    """Evidence from a sample (a file or a canonical table) and, if given, a schema.

    rows_only: only what rows may be, which takes one aggregation over the nodes' paths; nothing is said of identifiers and fields.
    """
    if isinstance(xsd, str):
        xsd = inspect_xsd(xsd)
    if namespace is not None and rows is None:
        raise XmlProposalError("namespace needs rows")
    structure = inspect_xml(sample) if isinstance(sample, DataFrame) else inspect_xml(spark, sample, whitespace)
    candidates = row_candidates(structure, xsd)
    if rows is not None:
        record, how = structure.find(rows, "rows", namespace), "user"
    else:
        first = [p for c, p in candidates if c.priority in ("primary", "single_document")]
        record, how = (first[0], "heuristic_for_review") if len(first) == 1 else (None, "choice_required")
    out = XmlProposal(structure.source, whitespace, how, record.display_path if record else None, record.namespace_uri or None if record else None, [c for c, _ in candidates], xsd=xsd)
    if record is None or rows_only:
        return out
    values = long_values(structure.nodes, record.path, [p.path for p in structure.repeated_below(record)]).persist()
    try:
        catalog = read_catalog(values)
        out.id_candidates = id_candidates(values, catalog, record.occurrences)
        out.field_candidates = field_candidates(values, catalog, record.occurrences, xsd)
    finally:
        values.unpersist()
    out.profile_template = xml_profile(record.display_path, False, namespace=out.selected_namespace)
    return out


def review_xml_proposal(spark: SparkSession, proposal: XmlProposal, what: str = "rows") -> DataFrame:
    """One kind of candidates as a table."""
    kinds = {
        "rows": (proposal.row_candidates, "path string, namespace_uri string, occurrences long, depth int, priority string, evidence string, reason string"),
        "ids": (proposal.id_candidates, "source string, value_kind string, priority string, reason string"),
        "fields": (proposal.field_candidates, "source string, value_kind string, entity string, records_observed long, coverage double, max_per_record long, under_repetition boolean, wide_safe boolean, sample_type string, sample_confidence string, sample_reason string, xsd_match string, xsd_selector string, xsd_type string, xsd_analytical_type string, xsd_required boolean, xsd_repeated boolean"),
        "xsd": (list(proposal.xsd.declarations) if proposal.xsd else [], "selector string, kind string, name string, type string, builtin_type string, analytical_type string, type_source string, min_occurs string, max_occurs string, repeated boolean, required boolean"),
    }
    if what not in kinds:
        raise XmlProposalError(f"what must be one of {', '.join(kinds)}")
    rows, schema = kinds[what]
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rows], schema)
