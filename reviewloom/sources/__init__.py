"""Scans and sinks: tables, work lists, landed result pages."""

from reviewloom.sources.json_pages import (
    announced_pages,
    broken_page,
    explode_employers,
    landed_bodies,
    landed_status,
    load_employers,
    missing_pages,
    parse_pages,
    rejected_pages,
    usable_pages,
    project_employers,
    rejected_employers,
)
from reviewloom.sources.tables import (
    append_rows,
    empty_table,
    project_reviews,
    read_documents,
    read_shards,
    read_spread,
    read_table,
    read_work_list,
    write_table,
    write_work_list,
)

__all__ = [
    "announced_pages",
    "append_rows",
    "empty_table",
    "broken_page",
    "explode_employers",
    "landed_bodies",
    "landed_status",
    "load_employers",
    "missing_pages",
    "parse_pages",
    "rejected_pages",
    "usable_pages",
    "project_employers",
    "project_reviews",
    "read_documents",
    "read_shards",
    "read_spread",
    "read_table",
    "read_work_list",
    "rejected_employers",
    "write_table",
    "write_work_list",
]
