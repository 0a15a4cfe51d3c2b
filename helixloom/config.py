"""Options of calling, with their documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    # The defaults that results depend on.
    min_mapq: int = 30
    min_base_quality: int = 10
    min_depth: int = 5
    min_alt_depth: int = 2
    min_alt_fraction: float = 0.20
    max_alt_fraction: float = 0.80
    dense_count: int = 5
    dense_window: int = 100
    max_noisy_fraction: float = 0.5
    max_event_ratio: float = 0.05
    end_clip: int = 30
    end_clip_flank: int = 100
    noisy_flank: int = 10
    max_noisy_length: int = 50_000
    max_noisy_reads: int = 1_000
    sample_reads_from: int = 10_000
    noisy_read_ratio: float = 0.2
    partial_ratio: float = 1.1
    min_hap_full_reads: int = 1
    min_hap_reads: int = 2
    min_sv_length: int = 30
    tsd: tuple[int, int] = (2, 100)
    polya_length: int = 10
    polya_ratio: float = 0.8
    somatic_distance: int = 5
    somatic_alt: int = 2
    somatic_te_alt: int = 1
    somatic_window: int = 1_000
    somatic_window_variants: int = 5
    strand_bias_p: float = 0.01
    dust_threshold: int = 5
    dust_window: int = 20
    mismatch: int = 6
    gap_open: tuple[int, int] = (6, 24)
    gap_extend: tuple[int, int] = (2, 1)
    match: int = 2
    error_rate: float = 0.001
    log10_error: float = -3.0
    log10_two: float = 0.301023
    max_qual: int = 60
    max_gq: int = 60
    te_kmer: int = 15
    window: int = 500_000
    #: Alleles of reads at sites that one phasing group takes; a deeper window is parted at positions.
    max_window_rows: int = 5_000_000
    reference_flank: int = 50_000
    is_ont: bool = False
    amb_bases: bool = False
    somatic: bool = False
    #: Whether calls name their alt reads.
    read_names: bool = False
    #: Whether regions give the alignments that reads are rewritten by.
    refine: bool = False


#: Presets of the two read technologies: the dense-event window differs, and only ONT reads are tested for strand bias and palindromes.
HIFI = Options()
ONT = replace(HIFI, dense_window=25, is_ont=True)
