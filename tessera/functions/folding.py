"""Unicode folding, which built-in functions lack: an Arrow batch at a time."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(_fold)


def folded_title(text: Column) -> Column:
    """Compatibility forms decomposed, marks dropped, case folded, other characters than letters and digits one space."""
    return F.trim(F.regexp_replace(_folded(text), r"[^\p{L}\p{N}]+", " "))
