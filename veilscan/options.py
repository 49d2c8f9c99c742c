"""Scan settings, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

# Paths skipped unless the caller says otherwise.
SKIP_GLOBS = [
    "node_modules/**",
    ".venv/**",
    "venv/**",
    "env/**",
    "dist/**",
    "build/**",
    ".next/**",
    "__pycache__/**",
    "*.pyc",
    "*.pyo",
    "*.pyd",
    ".git/**",
    ".svn/**",
    ".hg/**",
    "*.lock",
    "*.min.js",
    "*.min.css",
    "*.map",
    ".DS_Store",
    "*.egg-info/**",
    ".pytest_cache/**",
    ".coverage",
    "htmlcov/**",
]
# What the settings add to the list above.
SKIP_GLOBS_SETTINGS = [*SKIP_GLOBS, "reports/**", "data/**"]

# Texts that look random but are harmless.
HARMLESS = [
    "iVBORw0KGgoAAAANSUhEUgAA",
    "data:image/png;base64",
    "0123456789abcdefABCDEF",
    "exampletoken123456789",
    "your_api_key_here",
    "replace_with_your_key",
]

MAX_TOKEN_LENGTH = 200


@dataclass(frozen=True)
class ScanOptions:
    entropy_threshold: float = 4.0
    min_token_length: int = 20
    confidence_threshold: float = 0.7
    history_depth: int = 100
    exclude_patterns: tuple[str, ...] = field(default_factory=lambda: tuple(SKIP_GLOBS_SETTINGS))
    harmless: tuple[str, ...] = tuple(HARMLESS)
    redact_all_spans: bool = False

    def __post_init__(self) -> None:
        checks = [
            (0.0 <= self.entropy_threshold <= 8.0, "entropy_threshold must lie in [0, 8]"),
            (self.min_token_length >= 1, "min_token_length must be at least 1"),
            (0.0 <= self.confidence_threshold <= 1.0, "confidence_threshold must lie in [0, 1]"),
            (self.history_depth >= 1, "history_depth must be at least 1"),
        ]
        for ok, message in checks:
            if not ok:
                raise ValueError(message)
        # An empty list means the scanner's own defaults.
        object.__setattr__(self, "exclude_patterns", tuple(self.exclude_patterns) or tuple(SKIP_GLOBS))
