"""The shape of a JSON schema body: what is left without prose, in sorted order."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from specgraph.functions.jsonwalk import compact

# Keys that do not count for the shape.
NO_SHAPE = frozenset(["description", "example", "examples", "title"])


def bare(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items() if k not in NO_SHAPE}
    return [bare(v) for v in value] if isinstance(value, list) else value


def shape_hash(body: str | None) -> str:
    """sha1 of the shape; empty for what is no JSON object."""
    try:
        value = json.loads(body or "")
    except ValueError:
        return ""
    return hashlib.sha1(compact(bare(value), sort=True).encode()).hexdigest() if isinstance(value, dict) else ""


@F.pandas_udf(StringType())
def shape(bodies: pd.Series) -> pd.Series:
    return bodies.map(shape_hash)
