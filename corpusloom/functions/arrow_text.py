"""Cleaning of Arrow string columns; Arrow's patterns and lower case are those of the SQL twins (RE2, simple mappings)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.functions.text import CLEANING_RULES, PII_PATTERNS


def valid(column: pa.Array) -> pa.Array:
    """The column without null and with bytes that are no UTF-8 replaced, as the JVM reads them."""
    column = pc.fill_null(column, "")
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())


def cleaned(column: pa.Array) -> pa.Array:
    """``redact_pii(clean_text(column))`` of a valid column."""
    for pattern, repl in CLEANING_RULES:
        # A single space stays, so it need not be replaced.
        column = pc.replace_substring_regex(column, r"[ \t]{2,}|\t" if pattern == r"[ \t]+" else pattern, repl)
    column = pc.ascii_trim(column, " \t\n\r")
    for kind, pattern in PII_PATTERNS:
        column = pc.replace_substring_regex(column, pattern, f"<redacted:{kind}>")
    return column
