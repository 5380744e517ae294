"""Readers and writers for dictionaries, corpora, graph tables, questions and answers."""

from graphask.sources.graph_tables import (
    node_scan_source,
    props_from_columns,
    read_clustered_graph,
    read_edges,
    read_nodes,
    write_clustered_graph,
    write_edges,
    write_nodes,
)
from graphask.sources.questions import read_questions, stream_questions
from graphask.sources.sinks import read_answers, write_answers
from graphask.sources.text_files import (
    DICTIONARY_ORDER,
    label_sections,
    parse_dictionary,
    parse_templates,
    parse_vocabulary,
    read_dictionaries,
    read_dictionary,
    read_samples,
    read_templates,
    read_vocabulary,
    union_dictionaries,
)

__all__ = [
    "DICTIONARY_ORDER",
    "label_sections",
    "node_scan_source",
    "parse_dictionary",
    "parse_templates",
    "parse_vocabulary",
    "props_from_columns",
    "read_answers",
    "read_clustered_graph",
    "read_dictionaries",
    "read_dictionary",
    "read_edges",
    "read_nodes",
    "read_questions",
    "read_samples",
    "read_templates",
    "read_vocabulary",
    "stream_questions",
    "union_dictionaries",
    "write_answers",
    "write_clustered_graph",
    "write_edges",
    "write_nodes",
]
