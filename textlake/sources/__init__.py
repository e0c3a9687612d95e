"""Sources and sinks."""

from textlake.sources.files import read_jsonl, read_wordlist, write_jsonl, write_wordlist
from textlake.sources.tables import (RAW_DOCUMENT_SCHEMA, raw_documents, read_table,
                                     table_path)

__all__ = [
    "RAW_DOCUMENT_SCHEMA", "raw_documents", "read_jsonl", "read_table", "read_wordlist",
    "table_path", "write_jsonl", "write_wordlist",
]
