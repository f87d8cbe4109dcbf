"""Raw table access: one lazy parquet scan per fixture table.

Scans are lazy, so column pruning and predicate pushdown from every operator
reach the parquet reader (`ReadSchema` / `PushedFilters` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from growthlens.fixed_values import FIXTURE_TABLES  # noqa: F401  (re-exported)

# The tables the canonical views are bound to.
BOUND_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


class Tables:
    """Lazy accessor ``tables.orders`` → DataFrame over ``{root}/orders.parquet``,
    or over the catalog table ``{database}.orders`` when ``database`` is given
    (tables bucketed by a join key let joins on it skip the shuffle).

    ``root`` may be any Hadoop-compatible URI (local dir, HDFS, S3, ABFS).
    """

    def __init__(self, spark: SparkSession, root: str = "", database: str | None = None):
        if not root and not database:
            raise ValueError("need a root directory or a catalog database")
        self.spark = spark
        self.database = database
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = (self.spark.table(f"{self.database}.{name}") if self.database
                                 else self.spark.read.parquet(self.path(name)))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in FIXTURE_TABLES:
            raise AttributeError(name)
        return self.table(name)

    def register_views(self, names=BOUND_TABLES) -> None:
        """Expose the raw tables to ``spark.sql`` as temp views (read-only)."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)


def load(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)
