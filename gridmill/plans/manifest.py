"""Evaluation manifests: ground truth for a set of documents, checked on the driver."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.paths import checked_path
from .profile import Profile, ProfileError, load, parse_object

# The schema's version, its labels and the decisions.
SCHEMA_VERSION = "1.0"
DECISIONS = ("accepted", "needs_review", "rejected")


class ManifestError(ValueError):
    """The manifest breaks its contract."""


@dataclass(frozen=True)
class Manifest:
    path: Path
    sha256: str
    label: str
    profile: Profile
    minimums: dict[str, float]
    cases: list[dict]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Expected cells (``case_id, row, field, value``) and decisions (``case_id, document, expected_decision``)."""
        cells = [(c["id"], i, f, None if r[f] is None else _text(r[f])) for c in self.cases for i, r in enumerate(c["expected_records"]) for f in self.profile.fields]
        cases = [(c["id"], str((self.path.parent / c["document"]).resolve()), c["expected_decision"]) for c in self.cases]
        return (
            spark.createDataFrame(cells, "case_id string, row long, field string, value string"),
            spark.createDataFrame(cases, "case_id string, document string, expected_decision string"),
        )


def _text(value: object) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def load_manifest(path: str, labels: tuple[str, ...] | None = None) -> Manifest:
    """Read and check a manifest; paths in it are relative to its folder."""
    file = Path(checked_path(path))
    try:
        raw = parse_object(file.read_text("utf-8"), file.name)
    except ProfileError as error:
        raise ManifestError(str(error)) from error
    if raw.get("evaluation_schema_version") != SCHEMA_VERSION:
        raise ManifestError(f"evaluation_schema_version must be {SCHEMA_VERSION!r}")
    if labels and raw.get("evidence_label") not in labels:
        raise ManifestError(f"evidence_label must be one of {', '.join(labels)}")
    cases = raw.get("cases")
    if not isinstance(cases, list) or not cases:
        raise ManifestError("cases must be a non-empty array")
    named = raw.get("profile")
    if isinstance(named, str) and named.endswith(".json"):
        named = str(file.parent / named)
    profile = load(named)
    ids, documents = set(), set()
    for i, c in enumerate(cases):
        if not isinstance(c, dict) or not isinstance(c.get("id"), str) or not c["id"].strip():
            raise ManifestError(f"cases[{i}] must be an object with an id")
        document = c.get("document")
        if not isinstance(document, str) or not document:
            raise ManifestError(f"{c['id']}: document must be a path")
        place = str((file.parent / document).resolve())
        if c["id"] in ids or place in documents:
            raise ManifestError(f"{c['id']}: ids and documents may not repeat")
        ids.add(c["id"])
        documents.add(place)
        if c.get("expected_decision") not in DECISIONS:
            raise ManifestError(f"{c['id']}: expected_decision must be one of {', '.join(DECISIONS)}")
        if not isinstance(c.get("expected_records"), list) or any(not isinstance(r, dict) or set(r) != set(profile.fields) for r in c["expected_records"]):
            raise ManifestError(f"{c['id']}: every expected record has exactly the profile's fields")
    minimums = raw.get("minimums", {})
    if not isinstance(minimums, dict):
        raise ManifestError("minimums must be an object")
    return Manifest(file, hashlib.sha256(file.read_bytes()).hexdigest(), str(raw.get("evidence_label")), profile, minimums, cases)
