"""Parameters derived from the read length, in integer arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

MAX_READ_LENGTH = 512
MAX_BLOCKS = 254


@dataclass(frozen=True)
class ReadParams:
    """What follows from the fixed length of all reads."""

    length: int
    #: Seeds of the mapping and of the self-match: k-mer, step on the reference, step on the probe.
    map_k: int = 28
    map_ref_step: int = 5
    map_read_step: int = 2
    match_k: int = 36
    match_src_step: int = 5
    match_dest_step: int = 3
    match_min: int = 50
    bucket: int = 12

    def __post_init__(self):
        if not 1 <= self.length <= MAX_READ_LENGTH:
            raise ValueError(f"reads of {self.length} bases; supported are 1 to {MAX_READ_LENGTH}")

    @property
    def words(self) -> int:
        """64-bit words of a packed read."""
        return -(-self.length // 32)

    @property
    def max_offset(self) -> int:
        """Seeded overlaps have offsets below this."""
        return self.length * 65 // 100

    @property
    def overlap_k(self) -> int:
        return 32 if self.length >= 89 else 36 * self.length // 100

    @property
    def overlap_at(self) -> int:
        """Where in a prefix read the overlap seed stands."""
        return self.length - self.overlap_k - self.max_offset

    @property
    def max_mismatches(self) -> int:
        return self.length // 5
