"""The analyst table: one atomic table of a document, without a profile.

Entities are the roots, the paths that repeat, and those of alternating siblings. An entity's row has its own fields
and those of the entity right above. All documents of the input share one dictionary of columns, so the table of one
document is what it would be alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import XmlStructureError
from ..functions.dictionaries import dictionary
from ..functions.naming import locals_column, make_unique
from ..functions.types import converted, inferred, lexical, observations
from ..plans.analyst_names import MISC, Namespaces, entity_aliases, is_untyped, key_score, namespaces
from ..schema import ANALYST_COLUMNS
from ..sources.nodes import check_whitespace, parse_files, parsed_nodes, with_paths
from ..sources.publish import Place
from ..sources.workspace import room_for_python, workspace
from .analyst_plain import Facts, facts, packed, source_path, unpacked
from .analyst_plain import rows as plain_rows
from .structure import path_summary
from .validate import validate_xml_nodes

DATA_KINDS = ("document", "element", "attribute", "text", "cdata")


@dataclass(frozen=True)
class AnalystColumn:
    """One source of values and the columns that hold it."""

    entity_path: tuple[str, ...]
    signature: str
    kinds: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass
class AnalystTable:
    """table, and what is known of it besides."""

    table: DataFrame
    entity_paths: dict[tuple[str, ...], int]
    aliases: dict[tuple[str, ...], str]
    namespaces: str | None
    column_sources: list[AnalystColumn]
    key_columns: dict[str, str]
    _nodes: DataFrame
    _fields: DataFrame
    _cells: DataFrame
    _data: list[str]
    _kept: Place

    def release(self) -> None:
        """Deletes the nodes and fields that are kept in the shared folder; the table can't be read any more. Else they go with the process."""
        self._kept.remove()

    def amplification(self) -> DataFrame:
        """How often each column's values are repeated on the rows below their owners."""
        own = self._fields.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("field_kind"), F.count("*").alias("owner_rows"), F.sum(_bytes()).alias("owner_bytes"), F.min("owner_depth").alias("owner_depth"))
        out = self._cells.groupBy("column").agg(F.count("*").alias("emitted_rows"), F.sum(_bytes()).alias("emitted_bytes"), F.max("depth").alias("deepest"))
        both = own.join(out, "column")
        return both.select(
            "column", "field_kind", "owner_rows", "emitted_rows", F.greatest(F.lit(0), F.col("emitted_rows") - F.col("owner_rows")).alias("context_rows"),
            "owner_bytes", "emitted_bytes", F.greatest(F.lit(0), F.col("emitted_bytes") - F.col("owner_bytes")).alias("context_bytes"),
            (F.col("emitted_rows") / F.col("owner_rows")).alias("row_amplification"),
            F.when(F.col("owner_bytes") > 0, F.col("emitted_bytes") / F.col("owner_bytes")).alias("byte_amplification"),
            F.greatest(F.lit(0), F.col("deepest") - F.col("owner_depth")).alias("max_propagation_depth"),
        )

    def amplification_summary(self) -> dict:
        a = self.amplification()
        sums = [F.sum(c).alias(c) for c in ("owner_rows", "emitted_rows", "context_rows", "owner_bytes", "emitted_bytes", "context_bytes")]
        row = a.agg(F.count("*").alias("columns"), *sums, F.max("row_amplification").alias("max_field_row_amplification"), F.max("byte_amplification").alias("max_field_byte_amplification"), F.max("max_propagation_depth").alias("max_propagation_depth")).first().asDict()
        row = {k: v or 0 for k, v in row.items()}
        return row | {"byte_amplification": row["emitted_bytes"] / row["owner_bytes"] if row["owner_bytes"] else None}

    def audit(self) -> dict:
        """Counts of what the source holds and of what the table shows."""
        kind = F.col("node_type")
        nodes = self._nodes.agg(F.count("*").alias("canonical_nodes"), F.count_if(kind == "attribute").alias("canonical_attributes"), F.count_if(kind.isin("text", "cdata")).alias("canonical_text_nodes"), F.count_if(~kind.isin(*DATA_KINDS)).alias("misc_nodes")).first().asDict()
        fields = self._fields.agg(F.count_if(F.col("kind") == "attribute").alias("projected_attributes"), F.coalesce(F.sum(F.when(F.col("kind").isin("value", "text_content"), F.col("texts"))), F.lit(0)).alias("projected_text_nodes"), F.count_if(F.col("kind") == "presence").alias("empty_elements_projected")).first().asDict()
        rows = self.table.where(F.col("xml_entity") != MISC).count()
        return nodes | fields | {"expected_entity_rows": sum(self.entity_paths.values()), "emitted_entity_rows": rows}


def stored(df: DataFrame, place: Place) -> DataFrame:
    """df as a table in the shared folder: it names few paths many times, which Parquet writes once; a cache would hold each anew."""
    df.write.parquet(str(place.at))
    return df.sparkSession.read.schema(df.schema).parquet(str(place.at))


def _bytes() -> Column:
    """Bytes of a cell as text; a presence counts as TRUE."""
    return F.coalesce(F.octet_length("value"), F.lit(0))


class PlainAnalystTable(AnalystTable):
    """The table of plain documents. What is asked of it beyond its rows comes of their nodes, which are made then."""

    def __init__(self, make, *known):
        super().__init__(*known[:6], None, None, None, *known[6:])
        self._make, self._made = make, None

    def _general(self) -> AnalystTable:
        self._made = self._made or self._make()
        return self._made

    def release(self) -> None:
        super().release()
        if self._made is not None:
            self._made.release()

    def amplification(self) -> DataFrame:
        return self._general().amplification()

    def audit(self) -> dict:
        return self._general().audit()


def alternating_paths(elements: DataFrame) -> list[tuple[str, ...]]:
    """Parents whose element children alternate between one path and others, and the paths of those children.

    The children are counted by path first: only parents with as many of the first child's path as of all others are
    looked at child by child, in order, without gathering them in a row.
    """
    siblings = ["document_id", "parent_id"]
    children = elements.where(F.size("path") > 1).select(*siblings, "path", "node_order")
    counts = children.groupBy(*siblings, "path").agg(F.count("*").alias("n"), F.min("node_order").alias("at"))
    sums = counts.groupBy(*siblings).agg(F.sum("n").alias("all"), F.min_by(F.struct("path", "n"), "at").alias("lead"), F.count_if(F.col("n") == 1).alias("once"))
    likely = sums.where((F.col("all") >= 4) & (F.col("all") == 2 * F.col("lead.n")) & (F.col("once") > 0)).select(*siblings, F.col("lead.path").alias("lead"))
    lead = F.col("path") == F.col("lead")
    before = F.lag(lead).over(Window.partitionBy(*siblings).orderBy("node_order"))
    checked = children.join(likely.hint("merge"), siblings).withColumn("alternates", F.coalesce(lead != before, lead))
    found = checked.groupBy(*siblings).agg(F.min("alternates").alias("alternates")).where("alternates").select(*siblings)
    paths = children.join(found.hint("merge"), siblings, "left_semi").select("path").distinct().collect()
    below = {tuple(r.path) for r in paths}
    return sorted(below | {p[:-1] for p in below})


def entity_paths(nodes: DataFrame) -> tuple[dict[tuple[str, ...], int], list[tuple[str, ...]]]:
    """The entities' paths in first-seen order, with their counts; and all paths."""
    elements = nodes.where("node_type = 'element'")
    paths = {tuple(r.path): r for r in path_summary(nodes).collect()}
    first = {tuple(r.path): (r.first.document_id, r.first.node_order) for r in elements.groupBy("path").agg(F.min(F.struct("document_id", "node_order")).alias("first")).collect()}
    found = {p for p, r in paths.items() if len(p) == 1 or r.max_per_parent > 1}
    if len(paths) > 1:
        found |= set(alternating_paths(elements))
    return {p: paths[p].occurrences for p in sorted(found & set(paths), key=first.__getitem__)}, sorted(paths)


def owned(nodes: DataFrame, entities: list[tuple[str, ...]], paths: list[tuple[str, ...]]) -> DataFrame:
    """nodes with entity_depth, entity_path, entity_node_id: the nearest entity around each; and the depth of the one above an element.

    What is nearest depends on the path alone, so the nodes are joined to the dictionary of paths.
    """
    known = set(entities)

    def depth(path: tuple[str, ...]) -> int | None:
        return next((d for d in range(len(path), 0, -1) if path[:d] in known), None)

    owners = dictionary(nodes.sparkSession, [(list(p), depth(p), depth(p[:-1])) for p in paths], "path array<string>, entity_depth int, above int")
    rows = nodes.join(owners, "path", "left")
    return rows.withColumn("entity_path", F.slice("path", F.lit(1), F.col("entity_depth"))).withColumn("entity_node_id", F.element_at("anc_ids", F.col("entity_depth")))


def mixed_paths(nodes: DataFrame, paths: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The paths of elements that may hold both text and elements: some hold text, some elements."""
    parents = {p[:-1] for p in paths}
    texts = nodes.where(F.col("node_type").isin("text", "cdata")).select("path").distinct().collect()
    return sorted(p for r in texts if (p := tuple(r.path)) in parents)


def field_rows(rows: DataFrame, mixed_at: list[tuple[str, ...]]) -> DataFrame:
    """A row for each field: its owner, kind, relative path, attribute's name, order, value and text nodes.

    rows: nodes with their owners. What an element holds directly is summed up by parent; the text of a whole subtree
    only for elements that have both text and elements in them, which are at the paths of mixed_at.
    """
    kind = F.col("node_type")
    relative = F.slice("path", F.col("entity_depth") + 1, F.size("path") - F.col("entity_depth"))
    name = F.when(F.coalesce("namespace_uri", F.lit("")) == "", F.col("local_name")).otherwise(F.concat(F.lit("{"), "namespace_uri", F.lit("}"), "local_name"))
    shared = ["document_id", "entity_node_id", "entity_path", relative.alias("relative"), "node_order"]
    owner_depth = F.col("entity_depth").alias("owner_depth")
    attributes = rows.where(kind == "attribute").select(*shared, owner_depth, name.alias("name"), F.lit("attribute").alias("kind"), "value", F.lit(0).cast("long").alias("texts"))
    text = kind.isin("text", "cdata")
    inside = rows.where(kind.isin("element", "attribute", "text", "cdata")).groupBy("document_id", F.col("parent_id").alias("node_id")).agg(
        F.max(kind == "element").alias("has_elements"), F.max(kind == "attribute").alias("has_attributes"), F.count_if(text).alias("texts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("node_order", "value")))), lambda x: x["value"]), "").alias("value"),
    )
    elements = rows.where(kind == "element").join(inside.hint("merge"), ["document_id", "node_id"], "left").drop(rows["value"])
    has_elements, has_attributes, texts = F.coalesce("has_elements", F.lit(False)), F.coalesce("has_attributes", F.lit(False)), F.coalesce("texts", F.lit(0))
    which = F.when((texts > 0) & ~has_elements, "value").when((texts > 0) & has_elements, "text_content").when(~has_elements & ~has_attributes, "presence")
    elements = elements.withColumn("kind", which).where("kind IS NOT NULL").withColumn("texts", texts)
    simple = elements.where("kind != 'text_content'").select(*shared, owner_depth, F.lit(None).cast("string").alias("name"), "kind", F.when(F.col("kind") == "presence", "TRUE").otherwise(F.col("value")).alias("value"), "texts")
    out = attributes.unionByName(simple)
    if not mixed_at:
        return out
    at = dictionary(rows.sparkSession, [(list(p),) for p in mixed_at], "above array<string>")
    mixed = elements.where("kind = 'text_content'").select(*shared, owner_depth, "node_id", "kind", "texts")
    upwards = F.posexplode("anc_ids").alias("depth", "node_id")
    below = rows.where(text).select("document_id", "path", F.struct("node_order", "value").alias("part"), upwards).withColumn("above", F.slice("path", F.lit(1), F.col("depth") + 1))
    below = below.join(at, "above", "left_semi").join(mixed.select("document_id", "node_id"), ["document_id", "node_id"], "left_semi")
    whole = below.groupBy("document_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["value"]), "").alias("value"))
    contents = mixed.join(whole, ["document_id", "node_id"]).select("document_id", "entity_node_id", "entity_path", "relative", "node_order", "owner_depth", F.lit(None).cast("string").alias("name"), "kind", "value", "texts")
    return out.unionByName(contents)


def _signature() -> Column:
    return F.concat_ws("\u001e", F.when(F.col("kind") == "attribute", "attribute").when(F.col("kind") == "text_content", "text_content").otherwise("element"), F.array_join("relative", "\u001f"), F.coalesce("name", F.lit("")))


def _base_name(spaces: Namespaces, alias: str, row) -> str:
    steps = [spaces.element(p) for p in row.relative]
    if row.kind == "attribute":
        steps.append(f"attr_{spaces.attribute(row.name)}")
    elif row.kind == "text_content":
        steps.append("text_content")
    elif row.presence:
        steps.append("present")
    elif not steps:
        steps.append("value")
    return "__".join([alias, *steps])


def _catalog(fields: DataFrame, spaces: Namespaces, aliases: dict[tuple[str, ...], str]) -> list[AnalystColumn]:
    """The columns of all sources: names in the order in which sources are first met, attributes before the rest."""
    place = F.struct((F.col("kind") != "attribute").alias("late"), "document_id", "node_order")
    rows = fields.groupBy("entity_path", "signature", F.when(F.col("kind") == "presence", True).otherwise(False).alias("presence")).agg(
        F.min(F.struct(place.alias("place"), "relative", "name", "kind")).alias("first"), F.max("occurrence").alias("most"), F.collect_set("kind").alias("kinds")
    )
    return _columns(rows.collect(), spaces, aliases)


def _columns(rows: list, spaces: Namespaces, aliases: dict[tuple[str, ...], str]) -> list[AnalystColumn]:
    """The same from rows of sources: entity_path, signature, presence, first, most, kinds."""
    found = sorted(rows, key=lambda r: tuple(r.first.place))

    class Named:
        def __init__(self, r):
            self.relative, self.name, self.kind, self.presence = r.first.relative, r.first.name, r.first.kind, r.presence

    names = make_unique([_base_name(spaces, aliases[tuple(r.entity_path)], Named(r)) for r in found], "__field")
    out = []
    for r, n in zip(found, names, strict=True):
        columns = (n,) if r.most == 1 else tuple(f"{n}__{i}" for i in range(1, r.most + 1))
        out.append(((r.first.place.document_id, r.first.place.node_order), AnalystColumn(tuple(r.entity_path), r.signature + ("\u001epresence" if r.presence else ""), tuple(sorted(r.kinds)), columns)))
    return [c for _, c in sorted(out, key=lambda x: x[0])]


def xml_analyst_table(nodes: DataFrame, infer_types: bool = True, include_misc: bool = True, validate: bool = True) -> AnalystTable:
    """The analyst table of a canonical table."""
    if validate:
        validate_xml_nodes(nodes)
    kept = workspace(nodes.sparkSession, "analyst")
    nodes = stored(with_paths(nodes).drop("sibling_order"), kept.child("nodes"))
    kinds = nodes.where(F.col("node_type").isin("element", "attribute"))
    names = kinds.groupBy("node_type", "namespace_uri", "prefix", "local_name").agg(F.min(F.struct("document_id", "node_order")).alias("first")).collect()
    spaces = namespaces(sorted(names, key=lambda r: tuple(r.first)))
    entities, paths = entity_paths(nodes)
    if not entities:
        raise XmlStructureError("the nodes have no elements")
    aliases = dict(zip(entities, entity_aliases([[spaces.element(p) for p in path] for path in entities]), strict=True))
    rows = owned(nodes, list(entities), paths)
    fields = field_rows(rows, mixed_paths(nodes, paths)).withColumn("signature", _signature())
    fields = fields.withColumn("signature", F.when(F.col("kind") == "presence", F.concat("signature", F.lit("\u001epresence"))).otherwise(F.col("signature")))
    slot = Window.partitionBy("document_id", "entity_node_id", "signature").orderBy("node_order")
    fields = stored(fields.withColumn("occurrence", F.row_number().over(slot)), kept.child("fields"))
    catalog = _catalog(fields.withColumn("signature", F.regexp_replace("signature", "\u001epresence$", "")), spaces, aliases)
    spark = nodes.sparkSession
    known = [(list(c.entity_path), c.signature, i, column) for c in catalog for i, column in enumerate(c.columns, 1)]
    columns = dictionary(spark, known, "entity_path array<string>, signature string, occurrence int, column string")
    fields = fields.join(columns, ["entity_path", "signature", "occurrence"])
    data = [column for c in catalog for column in c.columns]
    presence = {column for c in catalog if c.kinds == ("presence",) for column in c.columns}
    whole = [column for c in catalog if "text_content" in c.kinds for column in c.columns]

    own = fields.groupBy("document_id", F.col("entity_node_id").alias("owner")).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("own"))
    names_of = F.create_map(*(F.lit(x) for p, a in aliases.items() for x in ("\u001f".join(p), a)))
    alias = F.element_at(names_of, F.array_join("entity_path", "\u001f"))
    elements = rows.where("node_type = 'element' AND size(path) = entity_depth")
    order = Window.partitionBy("xml_document_id", "xml_entity").orderBy("xml_node_id")
    parent = F.element_at("anc_ids", F.col("above"))
    head = elements.select(
        F.col("document_id").alias("xml_document_id"), alias.alias("xml_entity"), F.format_string("e%09d", "node_id").alias("xml_entity_id"),
        F.when(F.col("above").isNotNull(), F.element_at(names_of, F.array_join(F.slice("path", F.lit(1), F.col("above")), "\u001f"))).alias("xml_parent_entity"),
        F.when(parent.isNotNull(), F.format_string("e%09d", parent)).alias("xml_parent_entity_id"), F.col("node_id").alias("xml_node_id"), F.col("parent_id").alias("xml_parent_node_id"),
        F.col("depth").alias("xml_depth"), F.array_join(locals_column(F.col("path")), "/").alias("xml_source_path"), F.col("namespace_uri").alias("xml_namespace_uri"),
        parent.alias("_parent"), F.col("node_id").alias("_own"),
    ).withColumn("xml_occurrence", F.row_number().over(order))
    misc_kinds = ~F.col("node_type").isin(*DATA_KINDS)
    misc = []
    if include_misc and nodes.where(misc_kinds).limit(1).count():
        misc = [f"{MISC}__type", f"{MISC}__name", f"{MISC}__value"]
        order = Window.partitionBy("document_id").orderBy("node_id")
        path = F.array_join(locals_column(F.col("path")), "/")
        owner = F.col("entity_node_id")
        extra = rows.where(misc_kinds).select(
            F.col("document_id").alias("xml_document_id"), F.lit(MISC).alias("xml_entity"), F.format_string("m%09d", "node_id").alias("xml_entity_id"), alias.alias("xml_parent_entity"),
            F.when(owner.isNotNull(), F.format_string("e%09d", owner)).alias("xml_parent_entity_id"), F.col("node_id").alias("xml_node_id"), F.col("parent_id").alias("xml_parent_node_id"),
            F.col("depth").alias("xml_depth"), F.concat(F.when(F.size("path") > 0, F.concat(path, F.lit("/"))).otherwise(F.lit("")), F.lit("#"), "node_type").alias("xml_source_path"),
            F.col("namespace_uri").alias("xml_namespace_uri"), owner.alias("_parent"), F.lit(None).cast("int").alias("_own"), F.row_number().over(order).alias("xml_occurrence"),
            F.col("node_type").alias(misc[0]), F.col("qualified_name").alias(misc[1]), F.col("value").alias(misc[2]),
        )
        head = head.unionByName(extra, allowMissingColumns=True)
    joined = head.join(own.select(F.col("document_id").alias("xml_document_id"), F.col("owner").alias("_own"), "own").hint("merge"), ["xml_document_id", "_own"], "left")
    joined = joined.join(own.select(F.col("document_id").alias("xml_document_id"), F.col("owner").alias("_parent"), F.col("own").alias("context")).hint("merge"), ["xml_document_id", "_parent"], "left")
    if whole:
        joined = joined.withColumn("context", F.map_filter("context", lambda k, _: ~k.isin(whole)))

    types = _types(fields, [c for c in data if c not in presence and not is_untyped(c)]) if infer_types else {}
    types |= dict.fromkeys(presence, "logical")
    cells = {}
    for c in data:
        text = F.coalesce(F.element_at("own", F.lit(c)), F.element_at("context", F.lit(c)))
        cells[c] = converted(text, types[c]) if c in types else text
    keys = _keys(fields, aliases, data, types)
    key_value, key_column = _key_columns(keys, types, lambda c: F.element_at("own", F.lit(c)))
    table = joined.withColumn("xml_key_value", key_value).withColumn("xml_key_column", F.when(F.col("xml_key_value").isNotNull(), key_column)).withColumn("xml_namespaces", F.lit(spaces.description))
    table = table.select(*ANALYST_COLUMNS, *(v.alias(k) for k, v in cells.items()), *misc)
    long = joined.select(F.col("xml_depth").alias("depth"), F.explode(F.map_concat(F.coalesce("own", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.map_filter(F.coalesce("context", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.col("own").isNull() | ~F.map_contains_key(F.col("own"), k)))).alias("column", "value")).where(F.col("xml_entity") != MISC)
    return AnalystTable(table, entities, aliases, spaces.description, catalog, keys, nodes, fields, long, data, kept)


def _key_columns(keys: dict[str, str], types: dict[str, str], own) -> tuple[Column, Column]:
    """xml_key_value and, where it is null or not, the name of the entity's key column. own: the text of a column that an entity's row has itself."""
    name = F.element_at(F.create_map(*(F.lit(x) for e, c in keys.items() for x in (e, c))), F.col("xml_entity")) if keys else F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for e, c in keys.items():
        shown = converted(own(c), types[c]).cast("string") if c in types else own(c)
        value = F.when(F.col("xml_entity") == e, shown).otherwise(value)
    return F.when(value != "", value), name


def xml_analyst_sources(sources: DataFrame, whitespace: str = "drop_blank", infer_types: bool = True, include_misc: bool = True) -> AnalystTable:
    """The analyst table of documents. sources: document_id, and content as string or binary.

    Sources are kept in the shared folder. Plain documents are read twice, without a table of their nodes; of others, and of all
    beside them, the nodes are made.
    """
    drop_blank = check_whitespace(whitespace) == "drop_blank"
    spark = sources.sparkSession
    kept = workspace(spark, "analyst")
    kind = sources.schema["content"].dataType.simpleString()
    whole = stored(sources.select("document_id", "content"), kept.child("whole"))
    room_for_python(spark)
    sources = stored(packed(whole), kept.child("sources"))
    kept.child("whole").remove()

    def general() -> AnalystTable:
        return xml_analyst_table(parsed_nodes(unpacked(sources, kind), whitespace), infer_types, include_misc, validate=False)

    room_for_python(spark)
    seen = Facts(stored(facts(sources, drop_blank), kept.child("facts")))
    if not seen.plain:
        return general()
    entities = seen.entities()
    if not entities:
        raise XmlStructureError("the nodes have no elements")
    spaces = namespaces(seen.names())
    aliases = dict(zip(entities, entity_aliases([[spaces.element(p) for p in path] for path in entities]), strict=True))
    found = seen.sources(entities)
    catalog = _columns(found, spaces, aliases)
    names = {(c.entity_path, c.signature): c.columns[0] for c in catalog}
    columns = {(f.path, f.attribute, f.presence): names[f.entity_path, f.signature + ("\u001epresence" if f.presence else "")] for f in found}
    data = [column for c in catalog for column in c.columns]
    presence = {column for (*_, of), column in columns.items() if of}
    room_for_python(spark)
    values = seen.values(spark, columns)
    types = _types(values, [c for c in data if c not in presence and not is_untyped(c)]) if infer_types else {}
    types |= dict.fromkeys(presence, "logical")

    wide = plain_rows(sources, list(entities), columns, drop_blank)
    place = {column: f"c{i}" for i, column in enumerate(columns.values())}
    scores, fit = _scores(aliases, data), {}
    if scores:
        plain = {(e, c): s for (e, c), s in scores.items() if c not in types}
        flags = {r["column"] for r in values.where(F.col("value") != "").groupBy("column").agg(F.min(F.lower(lexical(F.col("value"))).isin("true", "false")).alias("flag")).where("flag").collect()} if plain else set()
        owner = {columns[f.path, f.attribute, f.presence]: aliases[f.entity_path] for f in found}
        counts = {columns[f.path, f.name, f.presence]: (f.n, f.most) for f in seen.fields}
        fit = {(e, c): counts[c][0] for e, c in plain if owner[c] == e and counts[c][1] == 1 and c not in flags}
        typed = {(e, c): s for (e, c), s in scores.items() if c in types and owner[c] == e}
        if typed:  # equal only as they are shown
            paths = F.array(*(F.array(*map(F.lit, p)) for p in entities))
            of = F.array(*(F.struct(F.lit(c).alias("column"), F.col(place[c]).alias("value"), F.lit(list(aliases.values()).index(e)).alias("of")) for e, c in typed))
            some = wide.select("document_id", "entity", F.element_at(paths, F.col("entity") + 1).alias("entity_path"), F.explode(of).alias("x")).where("x.of = entity AND x.value IS NOT NULL")
            fit |= _key_counts(some.select("document_id", "entity_path", "x.column", "x.value"), typed, aliases, types)
    keys = _ranked(scores, fit, aliases, data)

    def of_entity(values: list) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), F.col("entity") + 1)

    above = [next((aliases[p[:d]] for d in range(len(p) - 1, 0, -1) if p[:d] in aliases), None) for p in entities]
    head = wide.withColumnsRenamed({"document_id": "xml_document_id", "node_id": "xml_node_id", "parent_id": "xml_parent_node_id", "depth": "xml_depth", "occurrence": "xml_occurrence"}).withColumns({
        "xml_entity": of_entity(list(aliases.values())), "xml_entity_id": F.format_string("e%09d", "xml_node_id"), "xml_parent_entity": of_entity(above),
        "xml_parent_entity_id": F.when(F.col("above").isNotNull(), F.format_string("e%09d", "above")), "xml_source_path": of_entity([source_path(p) for p in entities]),
        "xml_namespace_uri": F.lit(""), "xml_namespaces": F.lit(spaces.description),
    })
    key_value, key_column = _key_columns(keys, types, lambda c: F.col(place[c]))
    table = head.withColumn("xml_key_value", key_value).withColumn("xml_key_column", F.when(F.col("xml_key_value").isNotNull(), key_column))
    cells = [(converted(F.col(place[c]), types[c]) if c in types else F.col(place[c])).alias(c) for c in data]
    return PlainAnalystTable(general, table.select(*ANALYST_COLUMNS, *cells), entities, aliases, spaces.description, catalog, keys, data, kept)


def _types(fields: DataFrame, columns: list[str]) -> dict[str, str]:
    """Types other than character that are sure, by column: one job for all columns."""
    if not columns:
        return {}
    seen = fields.where(F.col("column").isin(columns)).groupBy("column").agg(*(v.alias(k) for k, v in observations(F.col("value")).items())).collect()
    found = {r["column"]: inferred(r.asDict()) for r in seen}
    return {c: t for c, (t, sure, _) in found.items() if t != "character" and sure == "high"}


def _keys(fields: DataFrame, aliases: dict[tuple[str, ...], str], data: list[str], types: dict[str, str]) -> dict[str, str]:
    """The source key column of each entity that has one: present, unique among the rows that have it, not all true or false."""
    scores = _scores(aliases, data)
    if not scores:
        return {}
    return _ranked(scores, _key_counts(fields, scores, aliases, types), aliases, data)


def _scores(aliases: dict[tuple[str, ...], str], data: list[str]) -> dict[tuple[str, str], int]:
    """How well columns suit as keys of entities, where they do at all."""
    return {(e, c): s for e in aliases.values() for c in data if (s := key_score(e, c)) < 99}


def _key_counts(fields: DataFrame, scores: dict[tuple[str, str], int], aliases: dict[tuple[str, ...], str], types: dict[str, str]) -> dict[tuple[str, str], int]:
    """How many rows have a value of the columns that can be keys: unique, not all true or false."""
    names_of = F.create_map(*(F.lit(x) for p, a in aliases.items() for x in ("\u001f".join(p), a)))
    some = fields.where(F.col("column").isin(sorted({c for _, c in scores})) & (F.col("value") != "")).withColumn("entity", F.element_at(names_of, F.array_join("entity_path", "\u001f")))
    value = F.col("value")
    for kind in sorted(set(types.values())):
        of_kind = [c for c in types if types[c] == kind]
        value = F.when(F.col("column").isin(of_kind), converted(F.col("value"), kind).cast("string")).otherwise(value)
    counts = some.withColumn("shown", value).groupBy("entity", "column", "document_id", "shown").count()
    seen = counts.groupBy("entity", "column").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.min(F.lower(lexical(F.col("shown"))).isin("true", "false")).alias("boolean")).collect()
    return {(r.entity, r["column"]): r.n for r in seen if r.most == 1 and not r.boolean}


def _ranked(scores: dict[tuple[str, str], int], fit: dict[tuple[str, str], int], aliases: dict[tuple[str, ...], str], data: list[str]) -> dict[str, str]:
    out = {}
    for e in aliases.values():
        ranked = sorted((scores[e, c], -fit[e, c], data.index(c), c) for (x, c) in scores if x == e and (e, c) in fit)
        if ranked:
            out[e] = ranked[0][3]
    return out


def rectangle_xml_analyst(spark: SparkSession, file: str | list[str], whitespace: str = "drop_blank", infer_types: bool = True, include_misc: bool = True) -> AnalystTable:
    """Scans files and makes their analyst table."""
    return xml_analyst_table(parse_files(spark, file, whitespace=whitespace), infer_types, include_misc, validate=False)


def _chain(df: DataFrame, entity: str | None) -> int:
    """How many entities at most are above one: by the names of entities and of their parents, of which there are few."""
    above: dict[str, set[str]] = {}
    for r in df.where(F.col("xml_parent_entity").isNotNull()).select("xml_entity", "xml_parent_entity").distinct().collect():
        above.setdefault(r.xml_entity, set()).add(r.xml_parent_entity)

    def height(name: str, seen: tuple[str, ...] = ()) -> int:
        return 1 + max((height(p, (*seen, name)) for p in above.get(name, ()) if p not in seen and p != name), default=-1)

    return max((height(n) for n in ([entity] if entity is not None else above)), default=0)


def xml_analyst_expand_context(table: AnalystTable | DataFrame, entity: str | None = None, levels: int | None = None) -> DataFrame:
    """Fills empty cells from the columns of entities further up, the nearest first.

    Each level is a join of the table with itself by the parent's id; there are as many as entities' names can stand
    above each other, so the plan is made at once and no level is run twice.
    """
    df = table.table if isinstance(table, AnalystTable) else table
    twice = df.groupBy("xml_document_id", "xml_entity_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise XmlStructureError(f"xml_entity_id '{twice[0].xml_entity_id}' occurs twice")
    data = [c for c in df.columns if not c.startswith("xml_")]
    keys = df.select("xml_document_id", F.col("xml_entity_id").alias("_id"), F.col("xml_entity").alias("_entity"), F.col("xml_parent_entity_id").alias("_next"), F.struct(*data).alias("_row")) if data else None
    lost = df.where(F.col("xml_parent_entity_id").isNotNull()).join(df.select("xml_document_id", F.col("xml_entity_id").alias("xml_parent_entity_id")), ["xml_document_id", "xml_parent_entity_id"], "left_anti").limit(1).collect()
    if lost:
        raise XmlStructureError(f"unknown parent entity '{lost[0].xml_parent_entity_id}'")
    out = df if entity is None else df.where(F.col("xml_entity") == entity)
    if keys is None:
        return out
    columns = out.columns
    names = [r.xml_entity for r in df.select("xml_entity").distinct().collect()]
    out = out.withColumn("_up", F.col("xml_parent_entity_id"))
    for _ in range(_chain(df, entity) if levels is None else levels):
        near = keys.select(F.col("xml_document_id"), F.col("_id").alias("_up"), "_entity", "_next", "_row")
        out = out.join(near, ["xml_document_id", "_up"], "left")
        filled = []
        for c in columns:
            owners = [n for n in names if c.startswith(f"{n}__")] if c in data else []
            filled.append(F.coalesce(F.col(c), F.when(F.col("_entity").isin(owners), F.col("_row")[c])).alias(c) if owners else F.col(c))
        out = out.select(*filled, F.col("_next").alias("_up"))
    return out.select(*columns)


