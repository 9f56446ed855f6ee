"""Limits and switches of a diff, with presets and validation."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Older names of settings.
ALIASES = {"rare_frequency_threshold": "rare_threshold", "low_info_cell_threshold": "low_info_threshold", "recursive_threshold": "recursive_align_threshold"}
NOISE_POLICIES = ("ReportFormattingOnly", "SuppressFormattingOnly")
LIMIT_POLICIES = ("FallbackToPositional", "ReturnPartialResult", "ReturnError")


@dataclass(frozen=True)
class DiffConfig:
    # before alignment
    preflight_min_rows: int = 5000
    preflight_in_order_mismatch_max: int = 32
    preflight_in_order_match_ratio_min: float = 0.995
    bailout_similarity_threshold: float = 0.05
    max_context_rows: int = 3
    # alignment
    max_align_rows: int = 500_000
    max_align_cols: int = 16_384
    max_block_gap: int = 10_000
    max_hash_repeat: int = 8
    rare_threshold: int = 5
    low_info_threshold: int = 2
    recursive_align_threshold: int = 200
    small_gap_threshold: int = 50
    max_recursion_depth: int = 10
    max_lcs_gap_size: int = 1500
    lcs_dp_work_limit: int = 20_000
    context_anchor_k1: int = 4
    context_anchor_k2: int = 8
    # moves
    max_move_iterations: int = 20
    enable_fuzzy_moves: bool = True
    fuzzy_similarity_threshold: float = 0.80
    max_fuzzy_block_rows: int = 32
    min_block_size_for_move: int = 3
    move_extraction_max_slice_len: int = 10_000
    move_extraction_max_candidates_per_sig: int = 16
    max_move_detection_rows: int = 200
    max_move_detection_cols: int = 256
    # meaning
    enable_m_semantic_diff: bool = True
    enable_formula_semantic_diff: bool = False
    enable_dax_semantic_diff: bool = False
    semantic_noise_policy: str = "ReportFormattingOnly"
    include_unchanged_cells: bool = False
    dense_row_replace_ratio: float = 0.90
    dense_row_replace_min_cols: int = 64
    dense_rect_replace_min_rows: int = 4
    # limits
    on_limit_exceeded: str = "FallbackToPositional"
    max_memory_mb: int | None = None
    timeout_seconds: float | None = None
    max_ops: int | None = None

    @classmethod
    def of(cls, **settings) -> DiffConfig:
        """A configuration from settings by name; older names are taken too, unknown ones are an error."""
        named = {ALIASES.get(k, k): v for k, v in settings.items()}
        unknown = set(named) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**named).validate()

    @classmethod
    def fastest(cls) -> DiffConfig:
        return cls(max_move_iterations=5, max_block_gap=1_000, small_gap_threshold=20, recursive_align_threshold=80, max_move_detection_rows=80, enable_fuzzy_moves=False, enable_m_semantic_diff=False)

    @classmethod
    def balanced(cls) -> DiffConfig:
        return cls()

    @classmethod
    def most_precise(cls) -> DiffConfig:
        return cls(
            max_move_iterations=30, max_block_gap=20_000, fuzzy_similarity_threshold=0.95, small_gap_threshold=80, recursive_align_threshold=400, max_move_detection_rows=400,
            enable_formula_semantic_diff=True, enable_dax_semantic_diff=True,
        )

    def validate(self) -> DiffConfig:
        for name in ("preflight_in_order_match_ratio_min", "bailout_similarity_threshold", "dense_row_replace_ratio", "fuzzy_similarity_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        for name in (
            "max_align_rows", "max_align_cols", "max_lcs_gap_size", "lcs_dp_work_limit", "move_extraction_max_slice_len", "rare_threshold",
            "move_extraction_max_candidates_per_sig", "context_anchor_k1", "context_anchor_k2", "max_move_detection_rows", "max_move_detection_cols",
            "max_context_rows", "min_block_size_for_move",
        ):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name, known in (("semantic_noise_policy", NOISE_POLICIES), ("on_limit_exceeded", LIMIT_POLICIES)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")
        return self

    def with_(self, **changes) -> DiffConfig:
        return replace(self, **changes).validate()
