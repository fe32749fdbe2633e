"""Options of a bundle run, with the default configuration's values."""

from __future__ import annotations

from dataclasses import dataclass

from sheaf.functions.constants import (
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    DEFAULT_IGNORE_PATTERNS,
    DEFAULT_MAX_FILE_SIZE,
    DEFAULT_MAX_TOKENS,
)


def require_non_negative(**values: int | None) -> None:
    for name, value in values.items():
        if value is not None and value < 0:
            raise ValueError(f"{name} must be non-negative")


@dataclass(frozen=True)
class BundleOptions:
    ignore_patterns: tuple[str, ...] = DEFAULT_IGNORE_PATTERNS
    max_file_size: int | None = DEFAULT_MAX_FILE_SIZE
    """None keeps files of any size."""
    max_files: int = 0
    """0 keeps every file."""
    strip_comments: bool = False
    max_line_bytes: int | None = None
    """Files with a line of so many bytes are not stripped; None strips every file."""
    chunk_size: int = DEFAULT_CHUNK_SIZE
    chunk_overlap: int = DEFAULT_CHUNK_OVERLAP
    max_tokens: int = DEFAULT_MAX_TOKENS
    root: str = "."

    def __post_init__(self) -> None:
        require_non_negative(
            max_file_size=self.max_file_size,
            max_files=self.max_files,
            max_line_bytes=self.max_line_bytes,
            chunk_size=self.chunk_size,
            chunk_overlap=self.chunk_overlap,
            max_tokens=self.max_tokens,
        )
