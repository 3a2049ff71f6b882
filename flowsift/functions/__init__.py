"""Column expressions: no actions, no shuffles, no Python workers."""

from flowsift.functions.flow import byte_ratio, flow_rate, pkt_rate, pkt_ratio
from flowsift.functions.text import (
    dataset_id,
    flag,
    label_name,
    parse_number,
    strip,
)
from flowsift.functions.types import display_type_of, normalise_type, type_of

__all__ = [
    "byte_ratio", "dataset_id", "display_type_of", "flag", "flow_rate", "label_name",
    "normalise_type", "parse_number", "pkt_rate", "pkt_ratio", "strip", "type_of",
]
