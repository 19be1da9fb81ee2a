"""All queries of the library with their oracle SQL."""

from weft.functions import codecs, documents, features, frames, mining, phrases, scoring, text
from weft.operators import aggregates, audit, discovery, joins, protocol, sets, supplement, templates, transport, windows
from weft.plans import metrics, rollups
from weft.registry import QUERIES, SQL
from weft.sources import tables
from weft.streaming import gates, sessions

__all__ = ["QUERIES", "SQL", "aggregates", "audit", "codecs", "discovery", "documents", "features", "frames", "gates", "joins", "metrics", "mining", "phrases", "protocol", "rollups", "scoring", "sessions", "sets", "supplement", "tables", "templates", "text", "transport", "windows"]
