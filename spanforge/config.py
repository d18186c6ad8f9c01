"""Settings of the analyses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Windows and thresholds, in nucleotides and counts. Windows are closed: [-upstream, +downstream]."""

    anchor_upstream: int = 10
    anchor_downstream: int = 1
    profile_upstream: int = 50
    profile_downstream: int = 50
    three_prime_upstream: int = 100
    three_prime_downstream: int = 100
    downstream_exon_min_offset: int = 5
    analysis_min_reads: int = 0
    premrna_upstream: int = 1000
    premrna_downstream: int = 100
    shared_min_reads: int = 10
    percentile_start: int = 1
    percentile_end: int = 99
    mapq_above: int = 20
    long_three_prime_half_width: int = 100
    long_branchpoint_half_width: int = 60
    intron_stretch: int = 6
    max_reads_per_condition: int = 300
    random_seed: int = 1
    bin_size: int = 1000

    def __post_init__(self) -> None:
        for name in ("anchor_upstream", "anchor_downstream", "profile_upstream", "profile_downstream", "three_prime_upstream", "three_prime_downstream", "premrna_upstream", "premrna_downstream", "intron_stretch"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.bin_size < 1 or self.max_reads_per_condition < 1:
            raise ValueError("bin_size and max_reads_per_condition must be positive")
        if not 0 <= self.percentile_start <= self.percentile_end <= 100:
            raise ValueError("percentiles must satisfy 0 <= start <= end <= 100")
        if self.downstream_exon_min_offset < 1:
            raise ValueError("downstream_exon_min_offset must be positive")

    @classmethod
    def with_anchor_window(cls, window: int, **others) -> EngineConfig:
        """One limit for both sides of the anchor window."""
        return cls(anchor_upstream=window, anchor_downstream=window, **others)
