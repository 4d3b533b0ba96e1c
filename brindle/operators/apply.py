"""CROSS and OUTER APPLY of table-valued functions, and scalar functions of the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from brindle.errors import SymbolNotFound


class Functions:
    """The user's functions in a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register_table(self, name: str, handler: type, returns: str) -> None:
        """A class with eval(*args) that yields rows; an error in it fails the query. Nullable arguments are None."""
        self.spark.udtf.register(name, udtf(handler, returnType=returns))
        self.tables[name] = returns

    def register_scalar(self, name: str, f, returns: str, vectorized: bool = True) -> None:
        """A function of a row, or of pandas Series if vectorized."""
        from pyspark.sql.functions import pandas_udf
        from pyspark.sql.functions import udf

        self.spark.udf.register(name, pandas_udf(f, returns) if vectorized else udf(f, returns))

    def apply(self, df: DataFrame, name: str, args: list[str], outer: bool = False, view: str = "__applied") -> DataFrame:
        """df with the rows that the function gives for each row's arguments (SQL expressions).

        A row without any is left out, or with outer kept once with nulls.
        """
        if name not in self.tables:
            raise SymbolNotFound(name)
        df.createOrReplaceTempView(view)
        call = f"LATERAL {name}({', '.join(args)}) AS f"
        return self.spark.sql(f"SELECT * FROM {view} AS t " + (f"LEFT JOIN {call} ON true" if outer else f"JOIN {call}"))


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns as one column for each field, a_b for field b of a, at any depth."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    while any(isinstance(f.dataType, StructType) for f in df.schema):
        df = df.select(*(c for f in df.schema for c in ([F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f"`{f.name}`")])))
    return df
