"""Options of a store and their Parquet counterparts."""

from __future__ import annotations

from dataclasses import dataclass, field

from keyloom.errors import PageSizeMismatch
from keyloom.functions.layout import PAGE_SIZES
from keyloom.streaming.checkpoint import CheckpointConfig
from keyloom.streaming.group_commit import GroupCommitConfig


@dataclass(frozen=True)
class Options:
    page_size: int = 32 * 1024
    overflow_threshold: int = 16 * 1024
    write_buffer_size: int = 256 * 1024
    row_group_size: int = 64 << 20
    #: Deltas and drops, and segments of the log, above a base before a commit writes a new one.
    max_deltas: int = 16
    max_segments: int = 4096
    wal_enabled: bool = False
    #: A transaction of more bytes goes into a delta that the log names.
    wal_segment_size: int = 64 << 20
    #: Manifests and files stay this long though newer ones replace them, for readers without a snapshot.
    retention_s: float = 3600.0
    #: Marks of snapshots and commits older than this are of processes that died.
    hold_s: float = 7 * 86400.0
    group: GroupCommitConfig = field(default_factory=GroupCommitConfig)
    auto_checkpoint: bool = False
    checkpoint: CheckpointConfig = field(default_factory=CheckpointConfig)

    def __post_init__(self):
        if self.page_size not in PAGE_SIZES:
            raise PageSizeMismatch(f"page size {self.page_size} is none of {PAGE_SIZES}")

    def parquet(self) -> dict[str, str]:
        """Small pages give fine column indexes; the bloom filter answers point reads."""
        return {
            "parquet.page.size": str(max(self.page_size, 64 * 1024)), "parquet.block.size": str(self.row_group_size),
            "parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000",
        }


def nvme_optimized() -> Options:
    return Options(page_size=16 * 1024, write_buffer_size=1 << 20)


def large_value_optimized() -> Options:
    """Small row groups keep memory bounded when single values have many MB."""
    return Options(page_size=64 * 1024, overflow_threshold=1 << 20, write_buffer_size=4 << 20, row_group_size=16 << 20)


def with_auto_checkpoint(config: CheckpointConfig | None = None) -> Options:
    return Options(auto_checkpoint=True, checkpoint=config or CheckpointConfig())
