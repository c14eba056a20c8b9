"""Sources, sinks and movement (A1-A10)."""

from blockpipe.sources.io import (
    convert_files,
    dataset_key,
    export_csv,
    load_snapshot,
    move,
    normalize_dates,
    read_csv,
    read_export,
    read_saved,
    read_files,
    read_table,
    read_tables,
    save_snapshot,
    write_files,
    write_table,
)

__all__ = [
    "convert_files",
    "dataset_key",
    "export_csv",
    "load_snapshot",
    "move",
    "normalize_dates",
    "read_csv",
    "read_export",
    "read_saved",
    "read_files",
    "read_table",
    "read_tables",
    "save_snapshot",
    "write_files",
    "write_table",
]
