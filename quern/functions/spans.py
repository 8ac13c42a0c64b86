"""Small vectorised helpers for what no built-in expression says: balanced JSON in prose, and changed word spans."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_MARK = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[\[\]{}]', re.DOTALL)
_PAIR = {"[": "]", "{": "}"}


def first_balanced(text: str | None) -> str | None:
    """The first stretch from an opening bracket to its own closing one, strings inside left alone."""
    for start in re.finditer(r"[\[{]", text or ""):
        waiting: list[str] = []
        for mark in _MARK.finditer(text, start.start()):
            x = mark[0]
            if x in _PAIR:
                waiting.append(_PAIR[x])
            elif x in ("]", "}"):
                if x != waiting.pop():
                    break
                if not waiting:
                    return text[start.start() : mark.end()]
    return None


@F.pandas_udf(StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_balanced)


@F.pandas_udf(ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())])))
def changed_spans(before: pd.Series, after: pd.Series) -> pd.Series:
    """The two largest replaced word spans between two texts, 80 characters of each side."""

    def changes(a: str | None, b: str | None) -> list[dict]:
        x, y = (a or "").split(), (b or "").split()
        found = [(max(i2 - i1, j2 - j1), " ".join(x[i1:i2]), " ".join(y[j1:j2])) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes() if tag == "replace"]
        return [{"before": o[:80], "after": n[:80]} for _, o, n in sorted(found, key=lambda z: -z[0])[:2]]

    return pd.Series([changes(a, b) for a, b in zip(before, after, strict=True)])
