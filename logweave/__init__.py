"""Log parsing, normalisation and enrichment as Spark DataFrame transformations."""

from logweave.frame import EventFrame, flatten, to_nested
from logweave.pipeline import Chain, branch, drop, stage

__all__ = ["Chain", "EventFrame", "branch", "drop", "flatten", "stage", "to_nested"]
