"""Reading and writing tables."""

from .readers import FORMATS, read_column_json, read_csv, read_excel, read_json, read_parquet, read_table, with_row_id
from .writers import csv_preview, json_rows, markdown_preview, write_csv, write_json

__all__ = [
    "FORMATS", "csv_preview", "json_rows", "markdown_preview", "read_column_json", "read_csv", "read_excel",
    "read_json", "read_parquet", "read_table", "with_row_id", "write_csv", "write_json",
]
