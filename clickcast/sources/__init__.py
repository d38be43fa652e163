"""Sources and sinks for click logs, extracts and score tables."""

from clickcast.sources.clicks import (
    CATEGORY_COLS,
    CLICK_SCHEMA,
    EXTRACT_SCHEMA,
    SCORING_SCHEMA,
    USER_COLS,
    clicks_from_events,
    pin_utc,
    read_clicks_csv,
    read_csv,
    read_score_files,
    score_file_schema,
    table,
    write_csv,
    write_score_files,
    write_submission,
)

__all__ = [
    "CATEGORY_COLS",
    "CLICK_SCHEMA",
    "EXTRACT_SCHEMA",
    "SCORING_SCHEMA",
    "USER_COLS",
    "clicks_from_events",
    "pin_utc",
    "read_clicks_csv",
    "read_csv",
    "read_score_files",
    "score_file_schema",
    "table",
    "write_csv",
    "write_score_files",
    "write_submission",
]
