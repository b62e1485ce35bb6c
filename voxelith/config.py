"""Parameters of a scene build."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Intrinsics:
    fx: float = 577.870605
    fy: float = 577.870605
    cx: float = 319.5
    cy: float = 239.5


@dataclass(frozen=True)
class SceneConfig:
    frame_stride: int = 10
    point_stride: int = 10
    grid_stride: int = 10
    min_depth: float = 0.5
    max_depth: float = 6.0
    depth_scale: float = 1000.0
    min_points: int = 50
    object_downsample: int = 3
    dense_downsample: int = 10
    crop_mode: str = "patch"
    crop_expand: float = 0.3
    dilate_size: int = 25
    dilate_rounds: int = 5
    merge_radius: float = 0.01
    merge_mode: str = "pairwise"
    outlier_k: int = 100
    outlier_ratio: float = 1.0
    interpolation_k: int = 21
    sigma: float = 0.01
    zero_norm: float = 1e-3
    score_mid: float = 0.75
    score_step: float = 0.1
    overlay_alpha: float = 0.8
    overlay_bins: int = 200
    intrinsics: Intrinsics = Intrinsics()
