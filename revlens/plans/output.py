"""Output conventions shared by every registered query and its SQL oracle:
doubles rounded to 4 decimals, instants as epoch milliseconds (LONG), dates as
'YYYY-MM-DD' text, integers widened to LONG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.columns import round_half_away


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_half_away(c.cast("double"), 4) + 0.0   # -0.0 -> 0.0
        elif isinstance(t, T.TimestampType):
            c = F.unix_millis(c)
        elif isinstance(t, T.TimestampNTZType):
            c = F.unix_millis(c.cast("timestamp"))
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
