"""Sources and sinks: driver tables, the fact view, CSV files, model bundles."""

from ratelens.sources.tables import TABLES, read_table, fact_frame, fact, temporary, drop_temporary
from ratelens.sources.files import read_csv, write_csv, HR_SCHEMA

__all__ = ["TABLES", "read_table", "fact_frame", "fact", "temporary", "drop_temporary", "read_csv", "write_csv", "HR_SCHEMA"]
