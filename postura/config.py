"""Numeric settings of the operators, gathered so that a caller can override any of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # keypoints and detections
    keypoint_conf: float = 0.3
    mean_conf_floor: float = 0.1
    mean_conf_default: float = 0.5
    detection_conf: float = 0.35
    object_stride: int = 10
    # posture rules
    bending_deg: float = 30.0
    upright_deg: float = 15.0
    severe_deg: float = 60.0
    sitting_hip_deg: float = 120.0
    walk_px: float = 15.0
    walk_frames: int = 3
    vote_frames: int = 5
    # bouts
    min_bout_s: float = 1.0
    rest_px: float = 5.0
    rest_s: float = 5.0
    min_records: int = 3
    # repetition
    freq_min_hz: float = 0.2
    freq_max_hz: float = 3.0
    prominence_deg: float = 5.0
    sample_fps: float = 5.0
    min_signal_s: float = 5.0
    # trips
    reversal_deg: float = 90.0
    trip_px: float = 50.0
    sustain_frames: int = 5
    # re-linking of tracklets
    max_gap_s: float = 120.0
    overlap_s: float = 2.0
    max_link_px: float = 400.0
    min_tracklet_frames: int = 3
    # association of objects with persons
    near_ratio: float = 0.6
    # upload limits
    max_file_mb: int = 2000
    # Width of the time slices a long series is split into (see operators/ordered.py).
    # Only the amount of work per task depends on it, never a result.
    chunk_s: float = 1800.0
    # Positions of one block of a joint series (see operators/long_series.py); never a result.
    series_rows: int = 8192


DEFAULTS = Thresholds()
