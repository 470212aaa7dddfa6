"""Type helpers: decimal widening, best-effort casts, type inference rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that read as TRUE when coercing to BOOLEAN
# (used by operators.ingest.coerce_value).
TRUE_STRINGS = ["true", "t", "1", "yes"]

# Attribute column type names.
TYPE_BOOLEAN = "BOOLEAN"
TYPE_BIGINT = "BIGINT"
TYPE_DOUBLE = "DOUBLE"
TYPE_VARCHAR = "VARCHAR"

SPARK_TYPE = {TYPE_BOOLEAN: "boolean", TYPE_BIGINT: "bigint",
              TYPE_DOUBLE: "double", TYPE_VARCHAR: "string"}


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every top-level DECIMAL column becomes DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)
