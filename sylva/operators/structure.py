"""The structure of documents: their paths, and which of them look like records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import XmlStructureError
from ..functions.naming import ends_with, friendly_path, local_of, locals_column, path_key, path_key_column, starts_with, uri_of
from ..sources.nodes import expanded_name, parse_files, with_paths


@dataclass(frozen=True)
class PathInfo:
    """One path of elements, over all documents."""

    path: tuple[str, ...]
    occurrences: int
    max_per_parent: int
    complex: bool

    @property
    def key(self) -> str:
        return path_key(list(self.path))

    @property
    def local_path(self) -> list[str]:
        return [local_of(p) for p in self.path]

    @property
    def display_path(self) -> str:
        return "/".join(self.local_path)

    @property
    def namespace_uri(self) -> str:
        return uri_of(self.path[-1])

    @property
    def depth(self) -> int:
        return len(self.path)

    @property
    def repeated(self) -> bool:
        return self.max_per_parent > 1


def structure_index(nodes: DataFrame) -> DataFrame:
    """A row for every element: names, paths, its number and its equals' count under the parent, whether it has element children."""
    elements = with_paths(nodes).where("node_type = 'element'")
    equals = Window.partitionBy("document_id", "parent_id", F.element_at("path", -1))
    out = elements.withColumn("sibling_count", F.count("*").over(equals).cast("int")).withColumn("expanded_name", expanded_name(F.col("local_name"), F.col("namespace_uri")))
    parents = elements.select("document_id", F.col("parent_id").alias("node_id")).distinct().withColumn("has_element_children", F.lit(True))
    out = out.join(parents, ["document_id", "node_id"], "left").withColumn("has_element_children", F.coalesce("has_element_children", F.lit(False)))
    return out.select(
        "document_id", "node_id", "parent_id", "depth", "qualified_name", "local_name", "namespace_uri", "expanded_name", path_key_column(F.col("path")).alias("path_key"),
        F.array_join(locals_column(F.col("path")), "/").alias("display_path"), "sibling_occurrence", "sibling_count", (F.col("sibling_count") > 1).alias("locally_repeated"),
        "has_element_children", F.col("path").alias("expanded_path"), locals_column(F.col("path")).alias("local_path"),
    )


def path_summary(nodes: DataFrame) -> DataFrame:
    """path, occurrences, max_per_parent of every path: one aggregation, summed in each task first."""
    elements = with_paths(nodes).where("node_type = 'element'")
    return elements.groupBy("path").agg(F.count("*").alias("occurrences"), F.max("sibling_occurrence").alias("max_per_parent"))


def path_table(nodes: DataFrame) -> DataFrame:
    """The dictionary of paths as a table: path_key, display_path, local_name, namespace_uri, depth, occurrences, max_per_parent, repeated, complex."""
    paths = path_summary(nodes)
    parents = paths.where(F.size("path") > 1).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct().withColumn("complex", F.lit(True))
    out = paths.join(parents, "path", "left")
    last = F.element_at("path", -1)
    return out.select(
        path_key_column(F.col("path")).alias("path_key"), F.array_join(locals_column(F.col("path")), "/").alias("display_path"), F.element_at(locals_column(F.col("path")), -1).alias("local_name"),
        F.regexp_extract(last, r"^\{(.*)\}", 1).alias("namespace_uri"), F.size("path").alias("depth"), "occurrences", "max_per_parent",
        (F.col("max_per_parent") > 1).alias("repeated"), F.coalesce("complex", F.lit(False)).alias("complex"),
    )


def read_paths(nodes: DataFrame) -> list[PathInfo]:
    """The dictionary of paths on the driver, in the order of their keys; it grows with the vocabulary, not the documents."""
    rows = path_summary(nodes).collect()
    inner = {tuple(r.path[:-1]) for r in rows}
    return sorted((PathInfo(tuple(r.path), r.occurrences, r.max_per_parent, tuple(r.path) in inner) for r in rows), key=lambda p: p.key)


def likely_records(paths: list[PathInfo]) -> list[PathInfo]:
    """Repeated complex paths at the least depth; else the roots."""
    found = [p for p in paths if p.repeated and p.complex]
    depth = min((p.depth for p in found), default=1)
    return [p for p in found or paths if p.depth == depth]


@dataclass
class XmlStructure:
    """What inspection has found; nodes are those it read, cached by whoever made it."""

    source: str
    whitespace: str
    nodes: DataFrame
    paths: list[PathInfo]
    likely: list[PathInfo] = field(default_factory=list)

    def __repr__(self) -> str:
        lines = [f"<xml_structure> {self.source}", f"  {len(self.paths)} element paths", "  likely records:"]
        lines += [f"    {p.display_path} ({p.occurrences})" for p in self.likely]
        lines.append("  repeated paths:")
        lines += [f"    {p.display_path} (up to {p.max_per_parent})" for p in self.paths if p.repeated]
        return "\n".join(lines)

    def find(self, path: str | list[str], argument: str = "one_row_per", namespace: str | None = None) -> PathInfo:
        """The one path that ends with the given steps."""
        steps = friendly_path(path, argument)
        found = [p for p in self.paths if ends_with(p.local_path, steps) and (namespace is None or p.namespace_uri == namespace)]
        if not found:
            raise XmlStructureError(f"{argument} '{'/'.join(steps)}' matches no element path")
        if len(found) > 1:
            listed = ", ".join(p.display_path + (f" {{{p.namespace_uri}}}" if p.namespace_uri else "") for p in found)
            raise XmlStructureError(f"{argument} '{'/'.join(steps)}' is ambiguous: {listed}")
        return found[0]

    def repeated_below(self, record: PathInfo) -> list[PathInfo]:
        return [p for p in self.paths if p.repeated and p.depth > record.depth and starts_with(list(p.path), list(record.path))]


def inspect_xml(spark_or_nodes: SparkSession | DataFrame, file: str | None = None, whitespace: str = "drop_blank") -> XmlStructure:
    """The structure of files (with a session), or of a canonical table."""
    if isinstance(spark_or_nodes, DataFrame):
        nodes, source = with_paths(spark_or_nodes), "nodes"
    else:
        nodes, source = parse_files(spark_or_nodes, file, whitespace=whitespace).persist(), str(file)
    paths = read_paths(nodes)
    return XmlStructure(source, whitespace, nodes, paths, likely_records(paths))
