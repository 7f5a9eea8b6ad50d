from .discover import SUPPORTED, discover_sources, reader_kind, source_list
from .landing import land_table, load_gold, save_json, upsert_stage
from .metric_files import load_metrics, override_proposed
from .readers import (SourceError, read_documents, read_json_document, read_json_lines, read_raw, read_text_table,
                      read_xml, sniff_delimiter, union_ragged, with_row_order)
from .workbook import read_workbook

__all__ = [
    "SUPPORTED", "SourceError", "discover_sources", "land_table", "load_gold", "load_metrics", "override_proposed",
    "read_documents", "read_json_document", "read_json_lines", "read_raw", "read_text_table", "read_workbook",
    "read_xml", "reader_kind", "save_json", "sniff_delimiter", "source_list", "union_ragged", "upsert_stage",
    "with_row_order",
]
