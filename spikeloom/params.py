"""Thresholds and constants of the quality and physiology pipelines, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class QualityParams:
    """Fixed values of the reference's defaults, in seconds unless named otherwise."""

    ephys_sample_rate: float = 30000.0
    duplicate_spike_window_s: float = 0.000034
    n_raw_spikes_to_extract: int = 100
    tau_r: tuple[float, ...] = (0.002,)
    tau_c: float = 0.0001
    confidence: float = 0.9
    delta_time_chunk: float = 360.0
    presence_bin: float = 60.0
    drift_bin: float = 60.0
    min_prominence_share: float = 0.2
    n_channels_iso_dist: int = 4
    max_n_peaks: int = 2
    max_n_troughs: int = 1
    min_wv_duration: float = 100.0
    max_wv_duration: float = 1150.0
    min_spatial_decay: float = 0.01
    max_spatial_decay: float = 0.1
    min_spatial_decay_linear: float = -0.008
    max_wv_baseline_fraction: float = 0.3
    max_scnd_peak_to_trough: float = 0.8
    min_trough_to_peak2: float = 5.0
    min_width_first_peak: float = 4.0
    min_width_main_trough: float = 5.0
    max_peak1_to_peak2: float = 3.0
    max_main_peak_to_trough: float = 0.8
    min_isolation_distance: float = 20.0
    max_l_ratio: float = 0.3
    min_amplitude: float = 40.0
    max_rpv: float = 0.1
    max_perc_missing: float = 20.0
    min_num_spikes: int = 300
    max_drift: float = 100.0
    min_presence_ratio: float = 0.7
    min_snr: float = 5.0
    small_unit_spikes: int = 50
    split_good_and_mua_non_somatic: bool = False
    use_distance: bool = False
    use_drift: bool = False
    use_raw: bool = False
    linear_decay: bool = False
    rpv_method: str = "hill"

    def with_(self, **changes) -> QualityParams:
        return replace(self, **changes)

    def as_row(self) -> dict:
        """Name -> text, for the one-row parameter table."""
        return {k: str(v) for k, v in asdict(self).items()}

@dataclass(frozen=True)
class Ticks:
    """Times of a run in the recording's integer ticks; tick is seconds a tick, dedup None leaves duplicates in."""

    tick: float
    taus: tuple[int, ...]
    tau_c: int
    chunk: int
    presence_bin: int
    dedup: int | None = None


def unit_match_params() -> QualityParams:
    """The variant for matching units across recordings: many raw spikes a unit."""
    return QualityParams(n_raw_spikes_to_extract=1000, use_raw=True)


@dataclass(frozen=True)
class PhysiologyParams:
    acg_bin: float = 0.001
    acg_duration: float = 1.0
    long_isi: float = 2.0
    min_spikes: int = 100
    template_duration_threshold: float = 400.0
    post_spike_suppression_threshold: float = 40.0
    prop_isi_threshold: float = 0.1


def spike_width_samples(ms: float, fs: float) -> int:
    """ms at a sampling rate, rounded and forced odd."""
    n = int(ms * fs / 1000 + 0.5)
    return n if n % 2 else n + 1
