"""The analyser: how texts and field values become terms.

A term is a run of letters, digits and underscores; runs joined by one dot or one straight
apostrophe are one term. Texts are put in lower case, field values are not; the term of a field is
``name~term``. Everything is a built-in expression, so tokenising stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"
_PYTHON_TERM = re.compile(r"\w+(?:[.']\w+)*")


def tokens(text: Column, lower: bool = False) -> Column:
    """Terms of a text in order, with repetitions; an empty array for null."""
    text = F.lower(text) if lower else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(text: str, lower: bool = False) -> list[str]:
    """Terms of a query text, on the driver."""
    return _PYTHON_TERM.findall(text.lower() if lower else text)


def document_terms(text: Column, fields: Column) -> Column:
    """All distinct terms of a document, as they are stored at ingest."""
    own = F.transform(F.map_entries(fields), lambda e: F.transform(tokens(e["value"]), lambda t: F.concat(e["key"], F.lit("~"), t)))
    return F.array_distinct(F.concat(tokens(text, True), F.coalesce(F.flatten(own), F.array().cast("array<string>"))))
