"""Where events and lookup tables come from."""

from logweave.sources.dictionary import literal_table, read_dictionary
from logweave.sources.lines import (
    PRESETS, as_events, candidate_lines, candidate_payloads, detect_log_type, merge_seed, read_logs,
    split_messages,
)

__all__ = [
    "PRESETS", "as_events", "candidate_lines", "candidate_payloads", "detect_log_type", "literal_table", "merge_seed",
    "read_dictionary", "read_logs", "split_messages",
]
