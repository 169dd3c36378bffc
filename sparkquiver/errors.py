"""Errors of graph operations."""


class GraphError(Exception):
    """Base of all errors of this package."""


class OutOfMemory(GraphError):
    """Kept for callers that name it; Spark reports memory errors itself."""


class DegreeLimitReached(GraphError):
    """A node side would exceed the configured degree limit."""


class EdgeIdExhausted(GraphError):
    """A node has handed out its last edge id."""


class BlockLimitReached(GraphError):
    """Kept for callers that name it; there are no storage blocks."""


class InvalidNode(GraphError):
    """A node does not exist or is removed."""


class EdgeAlreadyExists(GraphError):
    """A simple graph has the edge already, or a batch names it twice."""


class CorruptGraph(GraphError):
    """A validator found a violation."""


class ConcurrentMutation(GraphError):
    """Another writer is active."""


class UnsupportedOperation(GraphError):
    """The graph's mode or state does not offer the operation."""


class RepairRequired(GraphError):
    """Kept for callers that name it; removals never need a repair first."""


class GraphBusy(GraphError):
    """The graph is closing, or cannot close while snapshots, sessions or writers are open."""


class Cancelled(GraphError):
    """The cancel token of the call was set."""
