"""Routing and writing of finished records."""

from logweave.sinks.route import export_json, read_routed, route, write_batch, write_routed

__all__ = ["export_json", "read_routed", "route", "write_batch", "write_routed"]
