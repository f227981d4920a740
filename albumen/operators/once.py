"""A barrier for columns that are costly and used many times."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """df as it is, with its columns computed once a row: the optimizer would else repeat an expression wherever
    a later one names it. A generator of one row is what it does not merge; no row moves."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")
