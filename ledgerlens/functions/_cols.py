from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"
