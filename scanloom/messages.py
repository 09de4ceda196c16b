"""What the engine says: its log, and summaries of what it is about to do."""

from __future__ import annotations

import logging


def set_log_level(level: str | int) -> None:
    """Of the engine's own messages; Spark's have their own level."""
    log = logging.getLogger("scanloom")
    log.setLevel(level.upper() if isinstance(level, str) else level)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())


def indexing_message(n_patterns: int, n_dictionary: int, n_pixels: int, keep_n: int, metric: str) -> str:
    """A search of a dictionary in numbers, one a line."""
    lines = {"metric": metric, "patterns": n_patterns, "dictionary": n_dictionary, "pixels": n_pixels, "comparisons": n_patterns * n_dictionary, "kept": min(keep_n, n_dictionary)}
    return "\n".join(f"{k}: {v:,}".replace(",", " ") if isinstance(v, int) else f"{k}: {v}" for k, v in lines.items())
