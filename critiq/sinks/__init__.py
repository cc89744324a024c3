"""Writers for result tables, training sets and reports."""

from critiq.sinks.writers import (aspect_lines, markdown_lines, write_jsonl_splits, write_report,
                                  write_table, write_text_lines)

__all__ = ["aspect_lines", "markdown_lines", "write_jsonl_splits", "write_report", "write_table",
           "write_text_lines"]
