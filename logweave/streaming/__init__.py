"""Chains on streams."""

from logweave.streaming.run import (
    RefreshingTable, VersionedTable, checkpoint_location, latest_totals, stream_chain, stream_totals, stream_versions,
)

__all__ = [
    "RefreshingTable", "VersionedTable", "checkpoint_location", "latest_totals", "stream_chain", "stream_totals", "stream_versions",
]
