"""Fixed values that results must agree on: route names and failure tags."""

from __future__ import annotations

# Prefix of dataset names, and the tag that marks events of the monitored firewalls.
PRODUCT = "pfelk"

STREAM_TYPE = "logs"
FALLBACK_DATASET = f"{PRODUCT}.unknown"
FALLBACK_NAMESPACE = "generic"
FALLBACK_TAG = f"{PRODUCT}_routing_fallback"

def routed(name: str, namespace: str) -> dict[str, str]:
    """The three route fields a stage sets."""
    return {
        "[event][dataset]": f"{PRODUCT}.{name}",
        "[data_stream][dataset]": f"{PRODUCT}.{name}",
        "[data_stream][namespace]": namespace,
    }
