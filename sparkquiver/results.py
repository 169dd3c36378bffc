"""What graph operations return."""

from __future__ import annotations

from typing import NamedTuple


class NodeRemovalSummary(NamedTuple):
    removed_visible_edges: int
    related_live_nodes_touched: int
    left_repair_debt: bool


class RepairNodeSummary(NamedTuple):
    """``preventive_*`` are always false: there is no block layout to harden."""

    repaired_fwd: bool = False
    repaired_rev: bool = False
    preventive_fwd: bool = False
    preventive_rev: bool = False
    had_flagged_debt_fwd: bool = False
    had_flagged_debt_rev: bool = False
    left_repair_debt_fwd: bool = False
    left_repair_debt_rev: bool = False


class RepairFlushSummary(NamedTuple):
    repaired_nodes: int
    pass_count: int
    remaining_repair_fwd: int
    remaining_repair_rev: int
    remaining_structural_debt: bool


class DebtStats(NamedTuple):
    """Queues and groups do not exist here and count 0."""

    live_nodes: int
    removed_nodes: int
    nodes_with_repair_fwd: int
    nodes_with_repair_rev: int
    queued_repair_fwd: int
    queued_repair_rev: int
    grouped_fwd_nodes: int
    grouped_rev_nodes: int
    estimated_tombstone_fwd_nodes: int


class StorageStats(NamedTuple):
    """What the graph's folder holds, in place of an allocator's counters."""

    version: int
    segments: int
    files: int
    bytes: int


class EdgeRef(NamedTuple):
    edge_id: int
    destination: int
    relation: int
    flags: int


class Violation(NamedTuple):
    kind: str
    node: int | None
    dst: int | None
    edge_id: int | None
    expected: int | None
    actual: int | None
