"""Which local paths may be read and written."""

from __future__ import annotations

import os

ALLOWED_DIR = "GRIDMILL_ALLOWED_DIR"


def checked_path(path: str) -> str:
    """The real path; raises where the environment names a folder and the path lies outside it."""
    real = os.path.realpath(path)
    allowed = os.environ.get(ALLOWED_DIR)
    if allowed:
        root = os.path.realpath(allowed)
        if os.path.commonpath([root, real]) != root:
            raise PermissionError(f"{path} lies outside {root}")
    return real
