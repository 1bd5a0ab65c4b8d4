"""filigree: property-graph analytics on Spark DataFrames."""

from .functions.expr import attr_contains, attr_equals, p_and, p_not, p_or
from .graph import Edge, Node, NodeRef, Path, PropertyGraph
from .operators.mutate import Handlers, ObservedDictionary
from .sources.lgf import parse_lgf, parse_lgf_file

__all__ = ["Edge", "Handlers", "Node", "NodeRef", "ObservedDictionary", "Path", "PropertyGraph", "attr_contains", "attr_equals", "p_and", "p_not", "p_or", "parse_lgf", "parse_lgf_file"]
