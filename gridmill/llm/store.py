"""Shared storage for intermediate tables, as the rest of the library has it."""

from __future__ import annotations

from ..plans.store import materialise, new_path, shared_folder

__all__ = ["materialise", "new_path", "shared_folder"]
