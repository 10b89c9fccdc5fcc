"""Content identities: SHA-256 of canonical JSON (sorted keys, no spaces, ASCII escapes)."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the schemas that identities start with.
SOURCE = "skyzone.source.v1"
PHOTOMETRY = "skyzone.photometry.v1"
EVIDENCE = "skyzone.property.evidence.v1"
CANDIDATES = "skyzone.candidates.release.v1"
OBSERVATIONS = "skyzone.observations.release.v1"
ASSOCIATION = "skyzone.association.v1"
ASSOCIATIONS = "skyzone.association.release.v1"
COMPONENT = "skyzone.association.component.v1"
COMPONENTS = "skyzone.association.component.release.v1"
DELTA = "skyzone.association.component.delta.v1"
DELTAS = "skyzone.association.component.delta.release.v1"
EQUIVALENCE = "skyzone.association.equivalence.v1"
EQUIVALENCES = "skyzone.association.equivalence.release.v1"


def canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def content_id(schema: str, value: Any) -> str:
    return f"{schema}:{digest(value)}"


def json_text(text: Column) -> Column:
    """A string column as a JSON string with ASCII escapes."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        short = {0x22: '\\"', 0x5C: "\\\\", 0x08: "\\b", 0x0C: "\\f", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
        out = F.when((code >= 0x20) & (code < 0x7F), c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
        for k, v in short.items():
            out = F.when(code == k, F.lit(v)).otherwise(out)
        return out

    plain = text.rlike(r"^[ !#-\[\]-~]*$")
    escaped = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def json_number_or_text(value: Column, kind: str) -> Column:
    return value.cast("string") if kind == "int" else json_text(value.cast("string"))


def source_id(namespace: str, native: Column, kind: str) -> Column:
    """Identity of a native id (``kind`` int or str) within a release namespace."""
    head = json.dumps([namespace, kind], separators=(",", ":"))[:-1]
    return F.concat(F.lit(f"{SOURCE}:"), F.sha2(F.concat(F.lit(f"{head},"), json_number_or_text(native, kind), F.lit("]")), 256))


def record_id(prefix: str, source: Column, mapping: dict) -> Column:
    """Identity of what a mapping says about a source."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat(F.lit("["), json_text(source), F.lit(f',"{digest(mapping)}"]')), 256))
