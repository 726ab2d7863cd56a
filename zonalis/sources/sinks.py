"""Result sinks: records with whole numbers as ints, and CSV with five decimals."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(value: Any) -> Any:
    return int(value) if isinstance(value, float) and math.isfinite(value) and value.is_integer() else value


def to_records(df: DataFrame) -> list[dict]:
    """Rows as dicts, streamed a partition at a time; an empty result is an empty list."""
    return [{k: _plain(v) for k, v in row.asDict().items()} for row in df.toLocalIterator()]


def to_csv(df: DataFrame) -> str:
    """CSV with a header and floats to five decimals; an empty result is an empty text."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    first = True
    for row in df.toLocalIterator():
        if first:
            writer.writerow(df.columns)
            first = False
        writer.writerow(["" if v is None else f"{v:.5f}" if isinstance(v, float) else v for v in row])
    return out.getvalue()


def write_csv(df: DataFrame, path: str) -> None:
    """The same form, written by the executors."""
    floats = {c: F.format_string("%.5f", c) for c, kind in df.dtypes if kind in ("float", "double")}
    df.withColumns({c: F.when(F.col(c).isNotNull(), e) for c, e in floats.items()}).write.mode("overwrite").option("header", True).csv(path)


def cache_key(query: str, environment: list[dict], geometry: dict | None = None) -> str:
    """A key of the query and its environment, and of a geometry where one is given."""
    return hashlib.sha256(json.dumps([query, environment, geometry], sort_keys=True).encode()).hexdigest()
