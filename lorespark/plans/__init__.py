"""Named queries; importing a module registers its own."""

from . import activity, alerts, briefing, context, gaps, graph, indexed, profiles, quality, readers, retrieval, selections, streams, temporal
from .catalog import CATALOG

__all__ = ["CATALOG", "activity", "alerts", "briefing", "context", "gaps", "graph", "indexed", "profiles", "quality", "readers", "retrieval", "selections", "streams", "temporal"]
