"""Options of a graph home."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """``home`` holds a folder per graph. ``flush_rows`` buffered mutations are written at once; 0 writes only on demand."""

    home: str = "trigraph-home"
    prefix: str = ""
    views: str = "views"
    flush_rows: int = 10_000
    compact_files: int = 64

    @classmethod
    def of(cls, **options) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(options) - known):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**options)

    @property
    def root(self) -> str:
        return os.path.join(self.prefix, self.home) if self.prefix else self.home
