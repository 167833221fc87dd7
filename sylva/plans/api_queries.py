"""Queries over the driver's tables for what queries.py doesn't reach: files, streams, reviews, refusals, schemas."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyst import xml_analyst_table
from ..operators.rectangle import rectangle, rectangle_xml, rectangle_xml_parallel, xml_rectangle, xml_rectangle_parallel
from ..operators.structure import inspect_xml, structure_index
from ..operators.validate import validate_xml_nodes, violations, xml_node_children
from ..schema import xml_nodes_schema
from ..sources.nodes import parsed_nodes, xml_stream_nodes, xml_text_to_nodes_memory, xml_to_nodes_memory, xml_to_nodes_stream
from ..sources.workspace import workspace, write_documents
from ..sources.xsd import inspect_xsd
from ..streaming.rectangles import rectangle_xml_analyst_csv, rectangle_xml_analyst_parquet, rectangle_xml_csv, xml_stream_rectangle, xml_stream_rectangle_parallel
from .profile import as_xml_profile, read_xml_profile, write_xml_profile, xml_profile
from .propose import propose_xml_profile, review_xml_proposal
from .queries import analyst, by_profile, cents, compiled, customer_documents, flat_customers, joined, nation_documents, nodes_of, order_documents, order_spec, read, xml
from .spec import make_rectangle, rectangle_spec, review_rectangle

CUSTOMERS_XSD = """<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema"><x:element name="cs"><x:complexType><x:sequence>
<x:element name="c" maxOccurs="unbounded"><x:complexType><x:sequence><x:element name="name" type="x:string"/><x:element name="balance" type="x:long"/>
<x:element name="ratio" type="x:decimal"/><x:element name="good" type="x:boolean"/><x:element name="day" type="x:date"/>
<x:element name="code"><x:simpleType><x:restriction base="x:string"/></x:simpleType></x:element><x:element name="note" type="remark" minOccurs="0"/>
</x:sequence><x:attribute name="id" type="x:int" use="required"/></x:complexType></x:element></x:sequence></x:complexType></x:element></x:schema>"""


def text_nodes(spark, sf_dir):
    regions = read(spark, sf_dir, "region").agg(joined(F.col("r_regionkey"), xml('<region key="{key}">{name}</region>', key=F.col("r_regionkey"), name=F.col("r_name"))).alias("all")).first()[0]
    return xml_text_to_nodes_memory(spark, f"<regions>{regions}</regions>", "regions").select("document_id", "node_id", "parent_id", "depth", "node_type", "local_name", "value")


def nodes_schema(spark, sf_dir):
    empty = xml_nodes_schema(spark)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, empty.count()) for f in empty.schema], "name string, kind string, nullable boolean, n long")


def nation_files(spark: SparkSession, sf_dir: str) -> list[str]:
    return write_documents(nation_documents(spark, sf_dir), workspace(spark, "files"))


def customer_file(spark: SparkSession, sf_dir: str) -> str:
    return write_documents(flat_customers(spark, sf_dir), workspace(spark, "files"))[0]


def nodes_of_files(spark, sf_dir):
    files = nation_files(spark, sf_dir)
    ways = {"memory": xml_to_nodes_memory(spark, files), "stream": xml_to_nodes_stream(spark, files, chunk_rows=50)}
    one = ways["memory"].withColumn("way", F.lit("memory")).unionByName(ways["stream"].withColumn("way", F.lit("stream")))
    return one.groupBy("way", "document_id").agg(F.count("*").alias("nodes"), F.count("value").alias("given"))


def stream_nodes(spark, sf_dir):
    seen: Counter = Counter()

    def count(frame) -> None:
        seen.update(frame.node_type)
        seen["rows"] += len(frame)

    stats = xml_stream_nodes(spark, customer_file(spark, sf_dir), count, whitespace="drop_blank", chunk_rows=1000)
    return spark.createDataFrame([(stats["document_id"], stats["node_count"], stats["chunk_count"], seen["rows"], seen["attribute"])], "document_id string, node_count long, chunk_count long, seen long, attributes long")


def rectangle_files(spark, sf_dir):
    files, sources = nation_files(spark, sf_dir), nation_documents(spark, sf_dir)
    profile = xml_profile("customer", "@id", {"name": "name", "balance": "balance"}, {"balance": "integer"})
    spec = compiled(spark, sources, profile)
    ways = {
        "files": rectangle_xml(spark, files, profile), "files, parallel": rectangle_xml_parallel(spark, files, spec, workers=2),
        "nodes": xml_rectangle(nodes_of(sources), spec), "nodes, parallel": xml_rectangle_parallel(nodes_of(sources), spec, workers=2, strategy="parallel_chunks", chunk_records=8),
    }
    out = None
    for way, rows in ways.items():
        rows = rows.select(F.lit(way).alias("way"), F.regexp_replace("document_id", r"\.xml$", "").alias("document_id"), "record_id", "name", "balance")
        out = rows if out is None else out.unionByName(rows)
    return out


def stream_callbacks(spark, sf_dir):
    file = customer_file(spark, sf_dir)
    spec = rectangle_spec(spark, file, "c", identify_by="@id", fields={"balance": "balance"}, types={"balance": "integer"})
    rows = []
    for way, stream in (("plain", xml_stream_rectangle), ("parallel", xml_stream_rectangle_parallel)):
        sums: list = []
        stats = stream(spark, file, spec, lambda frame, to=sums: to.append((len(frame), int(frame.balance.astype("int64").sum()))), batch_rows=400)
        rows.append((way, stats["record_count"], stats["result_rows"], stats["result_chunks"], stats["max_record_nodes"], stats["id_check"], max(n for n, _ in sums), sum(x for _, x in sums)))
    return spark.createDataFrame(rows, "way string, records long, result_rows long, chunks long, most_nodes long, id_check string, largest long, balance long")


def typed_empty(spark, sf_dir):
    sources, spec = order_spec(spark, sf_dir)
    rows = rectangle(nodes_of(nation_documents(spark, sf_dir)), spec)
    return spark.createDataFrame([(c, kind, rows.count()) for c, kind in rows.dtypes], "name string, kind string, n long")


def likely_records(spark, sf_dir):
    rows = []
    for what, sources in (("orders", order_documents(spark, sf_dir)), ("nations", nation_documents(spark, sf_dir))):
        rows += [(what, p.display_path, p.occurrences) for p in inspect_xml(nodes_of(sources).persist()).likely]
    return spark.createDataFrame(rows, "documents string, path string, occurrences long")


def structure_elements(spark, sf_dir):
    out = structure_index(nodes_of(nation_documents(spark, sf_dir)))
    return out.groupBy("display_path", "path_key").agg(F.count("*").alias("n"), F.count_if("locally_repeated").alias("repeated"), F.max("sibling_count").alias("most"), F.count_if("has_element_children").alias("with_children"), F.max("depth").alias("depth"))


def default_names(spark, sf_dir):
    row = xml('<c><who><name>{name}</name></who><a_b>{key}</a_b><a><b kind="{segment}">{nation}</b></a></c>', name=F.col("c_name"), key=F.col("c_custkey"), segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"))
    return by_profile(spark, customer_documents(spark, sf_dir, row), "c", False).select("document_id", "who_name", "a_b", "a_b_1", "a_b_kind")


def inferred_id(spark, sf_dir):
    sources = order_documents(spark, sf_dir)
    spec = rectangle_spec(spark, parsed_nodes(sources.orderBy("document_id").limit(1), "drop_blank").persist(), "order", fields={"state": "@status"})
    return rectangle(nodes_of(sources), spec).select("record_id", "state")


def reviewed_spec(spark, sf_dir):
    return review_rectangle(spark, order_spec(spark, sf_dir)[1]).drop("max_per_record")


def profile_files(spark, sf_dir):
    """A profile from a mapping, written, read again and applied; each way with its name."""
    sources = customer_documents(spark, sf_dir, xml('<c id="{key}"><name>{name}</name><cents>{cents}</cents></c>', key=F.col("c_custkey"), name=F.col("c_name"), cents=cents("c_acctbal")))
    profile = as_xml_profile({"rows": "c", "id": "@id", "fields": {"who": "name", "cents": "cents"}, "types": {"cents": "integer"}})
    out = None
    with tempfile.TemporaryDirectory(prefix="sylva-profile-") as folder:
        for name in ("p.json", "p.yaml"):
            try:
                again = read_xml_profile(write_xml_profile(profile, str(Path(folder) / name)))
            except Exception as error:
                if "PyYAML" not in str(error):
                    raise
                again = profile
            rows = rectangle(nodes_of(sources), compiled(spark, sources, again)).select(F.lit(name).alias("file"), "record_id", "who", "cents")
            out = rows if out is None else out.unionByName(rows)
    return out


def printed(spark, sf_dir):
    """What objects say of themselves, line by line."""
    spec = order_spec(spark, sf_dir)[1]
    lines = [("profile", i, x) for i, x in enumerate(repr(spec.profile).split("\n"))] + [("specification", i, x) for i, x in enumerate(repr(spec).split("\n"))]
    lines += [("mapping", i, f"{k}={v}") for i, (k, v) in enumerate(spec.profile.to_dict().items()) if not isinstance(v, dict)]
    return spark.createDataFrame(lines, "what string, line int, text string")


def node_violations(spark, sf_dir):
    """What the validator finds in tables that are broken in known ways: suppliers with values, lost names of customers in debt."""
    nodes = nodes_of(nation_documents(spark, sf_dir)).drop("path", "anc_ids", "sibling_occurrence")
    valued = nodes.withColumn("value", F.when((F.col("node_type") == "element") & (F.col("local_name") == "supplier"), "x").otherwise(F.col("value")))
    shallow = nodes.withColumn("depth", F.when(F.col("local_name") == "customer", F.col("depth") + 1).otherwise(F.col("depth")))
    orphans = nodes.withColumn("parent_id", F.when(F.col("local_name") == "title", -5).otherwise(F.col("parent_id")))
    parts = [violations(t).groupBy("message").agg(F.count("*").alias("n")).withColumn("table", F.lit(name)) for name, t in (("valued", valued), ("shallow", shallow), ("orphans", orphans))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table").agg(F.max("n").alias("n"))
    return out


def proposal_choice(spark, sf_dir):
    proposal = propose_xml_profile(spark, nodes_of(nation_documents(spark, sf_dir)).persist())
    return review_xml_proposal(spark, proposal, "rows").select("path", "occurrences", "priority", "evidence").withColumn("selection", F.lit(proposal.row_selection))


def with_xsd(spark: SparkSession, use: Callable):
    with tempfile.TemporaryDirectory(prefix="sylva-xsd-") as folder:
        path = Path(folder) / "customers.xsd"
        path.write_text(CUSTOMERS_XSD)
        return use(str(path))


def xsd_declarations(spark, sf_dir):
    def declared(path):
        return [(d.selector, d.kind, d.type, d.analytical_type, d.type_source, d.repeated, d.required) for d in inspect_xsd(path).declarations]

    return spark.createDataFrame(with_xsd(spark, declared), "selector string, kind string, type string, analytical_type string, type_source string, repeated boolean, required boolean")


def xsd_fields(spark, sf_dir):
    sample = nodes_of(flat_customers(spark, sf_dir)).persist()
    proposal = with_xsd(spark, lambda path: propose_xml_profile(spark, sample, xsd=path))
    out = review_xml_proposal(spark, proposal, "fields").select("source", "records_observed", "xsd_match", "xsd_selector", "xsd_analytical_type", "xsd_required")
    return out.withColumn("evidence", F.lit(proposal.row_candidates[0].evidence))


def sink_analyst_csv(spark, sf_dir):
    folder = workspace(spark, "sink")
    rectangle_xml_analyst_csv(spark, nation_files(spark, sf_dir), str(folder.child("new/nations.csv")), include_misc=False)
    out = spark.read.csv(str(folder.child("new/nations.csv")), header=True, nullValue="\\N")
    return out.where("xml_entity = 'customer'").select("xml_document_id", "xml_parent_entity", F.col("xml_occurrence").cast("int").alias("xml_occurrence"), "customer__attr_id", "customer__name", F.col("customer__balance").cast("long").alias("balance"), "nation__attr_name")


def sink_analyst_parquet(spark, sf_dir):
    folder = workspace(spark, "sink")
    rectangle_xml_analyst_parquet(spark, nation_files(spark, sf_dir), str(folder.child("nations.parquet")), include_misc=False)
    return spark.read.parquet(str(folder.child("nations.parquet"))).where("xml_entity = 'supplier'").select("xml_document_id", "xml_occurrence", F.col("supplier__attr_code").cast("string").alias("code"), "supplier__title", "nation__attr_name")


def analyst_namespaces(spark, sf_dir):
    row = xml('<d:c xmlns:d="urn:d" xmlns:e="urn:e" e:id="{key}"><d:name>{name}</d:name><e:name>{segment}</e:name></d:c>', key=F.col("c_custkey"), name=F.col("c_name"), segment=F.col("c_mktsegment"))
    table = analyst(spark, customer_documents(spark, sf_dir, row)).table
    return table.select("xml_document_id", "xml_entity", "xml_key_column", "xml_key_value", "xml_namespaces", F.col("d_c__d_name").alias("name"), F.col("d_c__e_name").alias("segment"))


def analyst_audit(spark, sf_dir):
    made = xml_analyst_table(nodes_of(nation_documents(spark, sf_dir)), include_misc=False, validate=False)
    found = made.audit() | {k: v for k, v in made.amplification_summary().items() if k in ("columns", "owner_rows", "emitted_rows", "context_rows")}
    made.release()
    return spark.createDataFrame(sorted((k, int(v)) for k, v in found.items()), "what string, n long")


def refusals(spark, sf_dir):
    """The class of the error that each use which makes no sense ends with; none if there is none."""
    orders, nations = "<os><o id='1'><x>1</x><y/><y/></o><o id='2'><x>b</x></o></os>", nation_documents(spark, sf_dir)
    nodes = xml_text_to_nodes_memory(spark, orders, whitespace="drop_blank")
    structure = inspect_xml(nodes)
    spec = make_rectangle(structure, "o", fields={"x": "x"}, identify_by="@id")
    twice = xml_text_to_nodes_memory(spark, orders.replace("'2'", "'1'"), whitespace="drop_blank")
    folder = workspace(spark, "refused")
    file = write_documents(nations, folder)[0]
    output = folder.child("out.csv")
    output.write(b"there")

    def callback(_):
        raise KeyError("mine")

    no_record = folder.child("none.xml")
    no_record.write(b"<os/>")
    marked = folder.child("marked.xml")
    marked.write(b"<a><b>gone</b><b>here</b></a>")
    cases: dict[str, Callable] = {
        "whitespace": lambda: xml_text_to_nodes_memory(spark, orders, whitespace="trim"),
        "no text": lambda: xml_text_to_nodes_memory(spark, ""),
        "malformed": lambda: xml_text_to_nodes_memory(spark, "<a>").collect(),
        "chunk rows": lambda: xml_to_nodes_stream(spark, file, chunk_rows=0),
        "rows": lambda: make_rectangle(structure, "p"),
        "ambiguous": lambda: make_rectangle(inspect_xml(xml_text_to_nodes_memory(spark, "<r><a><z k='1'/></a><b><z k='2'/></b></r>")), "z"),
        "flattened": lambda: rectangle_spec(spark, xml_text_to_nodes_memory(spark, "<r><a><z>1</z><z>2</z></a><a><z>3</z></a></r>"), "a", representation="wide"),
        "id": lambda: make_rectangle(structure, "o", identify_by="x/none"),
        "duplicate id": lambda: xml_rectangle(twice, spec),
        "duplicate id, lazily": lambda: xml_rectangle(twice, spec, check=False).collect(),
        "type": lambda: make_rectangle(structure, "o", fields={"x": "x"}, types={"x": "integer"}),
        "type, lazily": lambda: rectangle(nodes_of(nations), compiled(spark, nations, xml_profile("customer", "@id", {"name": "name"}, {"name": "integer"}))),
        "unknown type": lambda: xml_profile("o", types={"x": "money"}),
        "profile key": lambda: as_xml_profile({"rows": "o", "colour": "red"}),
        "profile file": lambda: read_xml_profile("nothing.json"),
        "strategy": lambda: xml_rectangle(nodes, spec, parallel=True, strategy="fastest"),
        "stream of a profile": lambda: xml_stream_rectangle(spark, file, xml_profile("customer"), callback),
        "callback": lambda: xml_stream_nodes(spark, file, callback),
        "no record": lambda: xml_stream_rectangle(spark, str(no_record.at), spec, callback),
        "output exists": lambda: rectangle_xml_csv(spark, file, spec, str(output.at)),
        "output is input": lambda: rectangle_xml_csv(spark, file, spec, file, overwrite=True),
        "output's folder": lambda: rectangle_xml_csv(spark, file, spec, str(folder.child("none/out.csv").at)),
        "id check": lambda: xml_stream_rectangle(spark, file, spec, callback, id_check="disk"),
        "sentinel": lambda: rectangle_xml_analyst_csv(spark, str(marked.at), str(folder.child("a.csv").at), na="gone"),
        "nodes": lambda: validate_xml_nodes(nodes.drop("value")),
        "gap": lambda: validate_xml_nodes(nodes.where("node_id != 3")),
        "child of nothing": lambda: xml_node_children(nodes, 999),
        "schema": lambda: with_xsd(spark, lambda path: (Path(path).write_text("<a/>"), inspect_xsd(path))),
        "proposal": lambda: propose_xml_profile(spark, nodes, namespace="urn:x"),
    }
    rows = []
    for name, use in cases.items():
        try:
            use()
            rows.append((name, "none"))
        except Exception as error:
            known = type(error).__module__.startswith("sylva") or type(error).__module__ == "builtins"
            rows.append((name, type(error).__name__ if known else "of the query"))
    return spark.createDataFrame(rows, "use string, error string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    text_nodes, nodes_schema, nodes_of_files, stream_nodes, rectangle_files, stream_callbacks, typed_empty, likely_records, structure_elements, default_names, inferred_id, reviewed_spec,
    profile_files, printed, node_violations, proposal_choice, xsd_declarations, xsd_fields, sink_analyst_csv, sink_analyst_parquet, analyst_namespaces, analyst_audit, refusals,
)}

_CENTS = "CAST(round(c_acctbal * 100) AS INTEGER)"

ORACLES = {
    "text_nodes": """WITH r AS (SELECT *, CAST(3 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS INTEGER) AS k FROM region)
        SELECT 'regions' AS document_id, 1 AS node_id, CAST(NULL AS INTEGER) AS parent_id, 0 AS depth, 'document' AS node_type, CAST(NULL AS VARCHAR) AS local_name, CAST(NULL AS VARCHAR) AS value
        UNION ALL SELECT 'regions', 2, 1, 1, 'element', 'regions', NULL UNION ALL SELECT 'regions', k + 3, 2, 2, 'element', 'region', NULL FROM r
        UNION ALL SELECT 'regions', k + 4, k + 3, 3, 'attribute', 'key', CAST(r_regionkey AS VARCHAR) FROM r UNION ALL SELECT 'regions', k + 5, k + 3, 3, 'text', NULL, r_name FROM r""",
    "nodes_schema": """SELECT *, 0 AS n FROM (VALUES ('document_id', 'string', false), ('node_id', 'int', false), ('parent_id', 'int', true), ('node_order', 'int', false), ('sibling_order', 'int', true), ('depth', 'int', false),
        ('node_type', 'string', false), ('qualified_name', 'string', true), ('local_name', 'string', true), ('prefix', 'string', true), ('namespace_uri', 'string', true), ('value', 'string', true)) v(name, kind, nullable)""",
    "nodes_of_files": """SELECT way, n_nationkey || '.xml' AS document_id, 3 + 6 * c + 4 * s AS nodes, 1 + 3 * c + 2 * s AS given FROM (VALUES ('memory'), ('stream')) w(way),
        (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)""",
    "stream_nodes": """SELECT 'customers.xml' AS document_id, n AS node_count, CAST(ceil(n / 1000) AS BIGINT) AS chunk_count, n AS seen, c AS attributes
        FROM (SELECT 2 + 14 * count(*) + 2 * count(*) FILTER (c_custkey % 2 = 0) AS n, count(*) AS c FROM customer)""",
    "rectangle_files": f"""SELECT way, CAST(c_nationkey AS VARCHAR) AS document_id, 'C-' || c_custkey AS record_id, c_name AS name, {_CENTS} AS balance FROM customer, (VALUES ('files'), ('files, parallel'), ('nodes'), ('nodes, parallel')) w(way)""",
    "stream_callbacks": f"""SELECT way, n AS records, n AS result_rows, CAST(ceil(n / 400) AS BIGINT) AS chunks, 14 + 2 * e AS most_nodes, 'memory' AS id_check, least(n, 400) AS largest, b AS balance
        FROM (VALUES ('plain'), ('parallel')) w(way), (SELECT count(*) AS n, max(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS e, sum({_CENTS})::BIGINT AS b FROM customer)""",
    "typed_empty": """SELECT *, 0 AS n FROM (VALUES ('document_id', 'string'), ('record_index', 'int'), ('record_id', 'string'), ('record_node_id', 'int'), ('status', 'string'), ('cents', 'int'), ('order_date', 'date'), ('priority', 'string')) v(name, kind)""",
    "likely_records": """SELECT 'orders' AS documents, 'orders/order' AS path, count(*) AS occurrences FROM orders UNION ALL SELECT 'nations', 'nation/customer', count(*) FROM customer UNION ALL SELECT 'nations', 'nation/supplier', count(*) FROM supplier""",
    "structure_elements": """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1),
        cn AS (SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS r, max(n)::INTEGER AS m FROM c), sn AS (SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS r, max(n)::INTEGER AS m FROM s)
        SELECT 'nation' AS display_path, '6:nation' AS path_key, count(*) AS n, 0 AS repeated, 1 AS most, count(*) FILTER (n_nationkey IN (SELECT c_nationkey FROM c) OR n_nationkey IN (SELECT s_nationkey FROM s)) AS with_children, 1 AS depth FROM nation
        UNION ALL SELECT 'nation/customer', '6:nation|8:customer', n, r, m, n, 2 FROM cn UNION ALL SELECT 'nation/customer/name', '6:nation|8:customer|4:name', n, 0, 1, 0, 3 FROM cn UNION ALL SELECT 'nation/customer/balance', '6:nation|8:customer|7:balance', n, 0, 1, 0, 3 FROM cn
        UNION ALL SELECT 'nation/supplier', '6:nation|8:supplier', n, r, m, n, 2 FROM sn UNION ALL SELECT 'nation/supplier/title', '6:nation|8:supplier|5:title', n, 0, 1, 0, 3 FROM sn""",
    "default_names": "SELECT CAST(c_custkey AS VARCHAR) AS document_id, c_name AS who_name, CAST(c_custkey AS VARCHAR) AS a_b, CAST(c_nationkey AS VARCHAR) AS a_b_1, c_mktsegment AS a_b_kind FROM customer",
    "inferred_id": "SELECT 'O-' || o_orderkey AS record_id, o_orderstatus AS state FROM orders",
    "reviewed_spec": """SELECT * FROM (VALUES ('status', '@status', 'character', 'attribute', 'order', false), ('cents', 'total', 'integer', 'text', 'order', false), ('order_date', 'date', 'date', 'text', 'order', false), ('priority', 'priority', 'character', 'text', 'order', false))
        v(output_name, source, declared_type, value_kind, entity, under_repetition)""",
    "profile_files": f"SELECT file, CAST(c_custkey AS VARCHAR) AS record_id, c_name AS who, {_CENTS} AS cents FROM customer, (VALUES ('p.json'), ('p.yaml')) f(file)",
    "printed": """SELECT * FROM (VALUES ('profile', 0, '<xml_profile> rows: order'), ('profile', 1, '  id: @id'), ('profile', 2, '  layout: safe'), ('profile', 3, '  status <- @status'), ('profile', 4, '  cents <- total'), ('profile', 5, '  order_date <- date'), ('profile', 6, '  priority <- priority'), ('profile', 7, '  cents: integer'), ('profile', 8, '  order_date: date'),
        ('specification', 0, '<xml_rect_spec> wide, one row per order'), ('specification', 1, '  identifier: @id'), ('specification', 2, '  status <- @status (character)'), ('specification', 3, '  cents <- total (integer)'), ('specification', 4, '  order_date <- date (date)'), ('specification', 5, '  priority <- priority (character)'),
        ('mapping', 0, 'version=1'), ('mapping', 1, 'rows=order'), ('mapping', 2, 'id=@id'), ('mapping', 5, 'namespace=None'), ('mapping', 6, 'layout=safe')) v(what, line, text)""",
    "node_violations": """SELECT 'valued' AS "table", count(*) AS n FROM supplier UNION ALL SELECT 'shallow', 3 * count(*) + count(*) FROM customer UNION ALL SELECT 'orphans', count(*) FROM supplier""",
    "proposal_choice": """SELECT 'nation/customer' AS path, count(*) AS occurrences, 'primary' AS priority, 'sample' AS evidence, 'choice_required' AS selection FROM customer
        UNION ALL SELECT 'nation/supplier', count(*), 'primary', 'sample', 'choice_required' FROM supplier""",
    "xsd_declarations": """SELECT * FROM (VALUES ('cs', 'element', NULL, NULL, 'unresolved', false, true), ('cs/c', 'element', NULL, NULL, 'unresolved', true, true), ('cs/c/name', 'element', 'x:string', 'character', 'type_attribute', false, true),
        ('cs/c/balance', 'element', 'x:long', NULL, 'type_attribute', false, true), ('cs/c/ratio', 'element', 'x:decimal', 'double', 'type_attribute', false, true), ('cs/c/good', 'element', 'x:boolean', 'logical', 'type_attribute', false, true),
        ('cs/c/day', 'element', 'x:date', 'date', 'type_attribute', false, true), ('cs/c/code', 'element', 'x:string', 'character', 'inline_restriction', false, true), ('cs/c/note', 'element', 'remark', NULL, 'unresolved', false, false),
        ('cs/c/@id', 'attribute', 'x:int', 'integer', 'type_attribute', false, true)) v(selector, kind, type, analytical_type, type_source, repeated, required)""",
    "xsd_fields": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS e FROM customer)
        SELECT source, n AS records_observed, 'matched' AS xsd_match, 'cs/c/' || source AS xsd_selector, kind AS xsd_analytical_type, true AS xsd_required, 'sample+xsd' AS evidence
        FROM n, (VALUES ('@id', 'integer'), ('name', 'character'), ('balance', NULL), ('ratio', 'double'), ('good', 'logical'), ('day', 'date'), ('code', 'character')) v(source, kind)
        UNION ALL SELECT 'note', e, 'matched', 'cs/c/note', NULL, false, 'sample+xsd' FROM n""",
    "sink_analyst_csv": """SELECT c_nationkey || '.xml' AS xml_document_id, 'nation' AS xml_parent_entity, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS xml_occurrence, 'C-' || c_custkey AS customer__attr_id,
        c_name AS customer__name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, n_name AS nation__attr_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "sink_analyst_parquet": """SELECT s_nationkey || '.xml' AS xml_document_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS xml_occurrence, CAST(s_suppkey AS VARCHAR) AS code, s_name AS supplier__title, n_name AS nation__attr_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "analyst_namespaces": """SELECT CAST(c_custkey AS VARCHAR) AS xml_document_id, 'd_c' AS xml_entity, 'd_c__attr_e_id' AS xml_key_column, CAST(c_custkey AS VARCHAR) AS xml_key_value, 'd=urn:d; e=urn:e' AS xml_namespaces, c_name AS name, c_mktsegment AS segment FROM customer""",
    "analyst_audit": """WITH x AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s)
        SELECT 'canonical_nodes' AS what, 3 * n + 6 * c + 4 * s AS n FROM x UNION ALL SELECT 'canonical_attributes', n + c + s FROM x UNION ALL SELECT 'projected_attributes', n + c + s FROM x UNION ALL SELECT 'canonical_text_nodes', 2 * c + s FROM x
        UNION ALL SELECT 'projected_text_nodes', 2 * c + s FROM x UNION ALL SELECT 'misc_nodes', 0 FROM x UNION ALL SELECT 'empty_elements_projected', 0 FROM x UNION ALL SELECT 'expected_entity_rows', n + c + s FROM x UNION ALL SELECT 'emitted_entity_rows', n + c + s FROM x
        UNION ALL SELECT 'columns', 6 FROM x UNION ALL SELECT 'owner_rows', n + 3 * c + 2 * s FROM x UNION ALL SELECT 'emitted_rows', n + 4 * c + 3 * s FROM x UNION ALL SELECT 'context_rows', c + s FROM x""",
    "refusals": """SELECT * FROM (VALUES ('whitespace', 'ValueError'), ('no text', 'ValueError'), ('malformed', 'of the query'), ('chunk rows', 'ValueError'), ('rows', 'XmlStructureError'), ('ambiguous', 'XmlStructureError'), ('flattened', 'XmlStructureError'),
        ('id', 'XmlStructureError'), ('duplicate id', 'XmlStructureError'), ('duplicate id, lazily', 'of the query'), ('type', 'XmlTypeError'), ('type, lazily', 'XmlTypeError'), ('unknown type', 'XmlProfileError'), ('profile key', 'XmlProfileError'),
        ('profile file', 'XmlProfileError'), ('strategy', 'ValueError'), ('stream of a profile', 'XmlProfileError'), ('callback', 'XmlCallbackError'), ('no record', 'XmlStructureError'), ('output exists', 'FileExistsError'), ('output is input', 'ValueError'),
        ('output''s folder', 'FileNotFoundError'), ('id check', 'ValueError'), ('sentinel', 'ValueError'), ('nodes', 'XmlNodesError'), ('gap', 'XmlNodesError'), ('child of nothing', 'XmlNodesError'), ('schema', 'XmlProposalError'), ('proposal', 'XmlProposalError')) v(use, error)""",
}
