"""Column names and types of the tables that operators exchange, and their checks.

``battles``  battle_id, prompt, model_a, model_b, completion_a, completion_b, language, human_pref
``codes``    row_id, feature_id, z          sparse: silent features have no row
``rows``     row_id and what is known of it  every row, also those without any code
Operators that divide by the number of rows take ``rows`` (or a count), never the codes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_COLUMNS = ("battle_id", "source", "language", "prompt", "model_a", "model_b", "completion_a", "completion_b")
LABEL = "human_pref"
CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in CORPUS_COLUMNS] + [T.StructField(LABEL, T.DoubleType())])
#: Accepted other names of pair columns.
ALIASES = {"response": "completion_a", "response_2": "completion_b", "model": "model_a", "model_2": "model_b", "label": LABEL}


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def canonical(df: DataFrame) -> DataFrame:
    """Aliases renamed where the canonical column is absent."""
    return df.withColumnsRenamed({a: c for a, c in ALIASES.items() if a in df.columns and c not in df.columns})


def has_preference(df: DataFrame) -> bool:
    return LABEL in df.columns and df.filter(F.col(LABEL).isNotNull() & ~F.isnan(LABEL)).limit(1).count() > 0


def label(c=LABEL):
    """A label with NaN as null."""
    c = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def strict_label(c=LABEL):
    """0, 0.5, 1 or null; any other value is an error."""
    y = label(c)
    return F.when(y.isNull() | y.isin(0.0, 0.5, 1.0), y).otherwise(F.raise_error(F.lit("labels must be 0, 0.5 or 1")).cast("double"))
