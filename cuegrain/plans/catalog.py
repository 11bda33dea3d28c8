"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import avi, codecs, encodings, export, formats, headers, mended, overrides, playback, ranges, relations, scalars, scans, streams, tags, timeline  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
