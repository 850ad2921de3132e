"""Registry of queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (function of Tables, DuckDB SQL or None)
REGISTRY: dict[str, tuple[Callable, str | None]] = {}


#: Tables whose rows are costly to work on.
TEXTS = ("documents", "pages")


class Tables:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        # A file of one row group is one task. Where a table of texts has fewer of them than half the cores, its rows are dealt out.
        if name in TEXTS and 2 * len(df.inputFiles()) <= cores and 2 * df.rdd.getNumPartitions() <= cores:
            return df.repartition(cores)
        return df


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its own name."""

    def register(f: Callable) -> Callable:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register
