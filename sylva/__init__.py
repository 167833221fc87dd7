"""Sylva: XML trees to tables, on Spark.

Every name that users need is importable from here. Functions that read files take the session first.
"""

from .errors import XmlCallbackError, XmlError, XmlNodesError, XmlParseError, XmlProfileError, XmlProposalError, XmlStructureError, XmlTypeError
from .operators.analyst import AnalystTable, rectangle_xml_analyst, xml_analyst_expand_context, xml_analyst_table
from .operators.rectangle import rectangle_xml, rectangle_xml_parallel, xml_rectangle, xml_rectangle_parallel
from .operators.structure import XmlStructure, inspect_xml
from .operators.validate import validate_xml_nodes, xml_node_children
from .plans.profile import XmlProfile, as_xml_profile, compile_xml_profile, read_xml_profile, write_xml_profile, xml_profile
from .plans.propose import XmlProposal, propose_xml_profile, review_xml_proposal
from .plans.spec import XmlRectSpec, make_rectangle, rectangle_spec, review_rectangle
from .schema import xml_nodes_schema
from .sources.nodes import parsed_nodes, xml_stream_nodes, xml_text_to_nodes_memory, xml_to_nodes_memory, xml_to_nodes_stream
from .sources.xsd import XsdInspection, inspect_xsd
from .streaming.rectangles import (
    rectangle_xml_analyst_csv,
    rectangle_xml_analyst_parquet,
    rectangle_xml_csv,
    rectangle_xml_parquet,
    stream_rectangles,
    xml_stream_rectangle,
    xml_stream_rectangle_parallel,
)

__all__ = [name for name in dir() if not name.startswith("_")]
