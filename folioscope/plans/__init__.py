"""Named queries over the tables of a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from folioscope.plans import calibration, corpus, documents, files, matching, metrics, review, shapes, streams, text
from folioscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calibration", "corpus", "documents", "files", "matching", "metrics", "review", "shapes", "streams", "text"]
