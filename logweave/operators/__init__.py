"""Event operators: extraction, mutation, lookups."""

from logweave.operators.extract import csv, date, dissect, json, kv
from logweave.operators.grok import grok
from logweave.operators.lookup import cidr, dns, geoip, interface_alias, translate
from logweave.operators.mutate import mutate
from logweave.operators.url import url_parts, user_agent_length

__all__ = [
    "cidr", "csv", "date", "dissect", "dns", "geoip", "grok", "interface_alias", "json", "kv",
    "mutate", "translate", "url_parts", "user_agent_length",
]
