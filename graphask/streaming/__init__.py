"""Structured Streaming jobs."""

from graphask.streaming.answer_stream import answer_stream
from graphask.streaming.dictionary_versions import DictionaryVersions, update_dictionary

__all__ = ["DictionaryVersions", "answer_stream", "update_dictionary"]
