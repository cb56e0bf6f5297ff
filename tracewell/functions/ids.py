"""Content-derived identifiers: the same content always has the same id."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_DIGITS = 24


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first digits of the SHA-256 of the parts as a JSON array of strings (nulls stay null)."""
    content = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit(None).cast("string")) for p in parts]))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(content, 256), 1, ID_DIGITS))


def driver_id(prefix: str, *parts: str | None) -> str:
    """The same on the driver, for texts without control characters."""
    content = json.dumps(list(parts), ensure_ascii=False, separators=(",", ":"))
    return f"{prefix}_{hashlib.sha256(content.encode()).hexdigest()[:ID_DIGITS]}"
