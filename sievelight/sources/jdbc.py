"""Database tables over JDBC."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from py4j.protocol import Py4JJavaError

log = logging.getLogger(__name__)

# Catalog queries by the name after "jdbc:".
TABLE_LISTS = {
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = database()",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
}
QUERY_SHOWN = 60  # characters of a query in log lines


def mask(url: str) -> str:
    """The URL without user names and passwords, for messages."""
    without_user = re.sub(r"//[^/@]*@", "//", url)
    return re.sub(r"(?i)\b(user|password)=[^&;]*", r"\1=***", without_user)


@dataclass(frozen=True)
class Partitioning:
    """Parallel read of a table: equal ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    parts: int


@dataclass(frozen=True)
class Database:
    """Reads that fail give an empty table or False, with the reason in the log."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def read_options(
        self,
        table: str | None = None,
        query: str | None = None,
        fetch_size: int | None = None,
        partitioning: Partitioning | None = None,
    ) -> dict[str, str]:
        """Options of the JDBC source; a query wins over a table.

        Spark does not split a ``query``, so a partitioned read wraps it as a derived table.
        """
        if not (table or query):
            raise ValueError("give a table or a query")
        options = {"url": self.url, **self.options}
        if query and partitioning is None:
            options["query"] = query
        else:
            options["dbtable"] = f"({query}) wrapped" if query else table
        if fetch_size:
            options["fetchsize"] = str(fetch_size)
        if partitioning:
            options.update(
                partitionColumn=partitioning.column,
                lowerBound=str(partitioning.lower),
                upperBound=str(partitioning.upper),
                numPartitions=str(partitioning.parts),
            )
        return options

    def _load(self, **wanted) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.read_options(**wanted)).load()

    def probe(self, statement: str = "SELECT 1 AS one") -> bool:
        """Whether the database answers a one-row query."""
        try:
            self._load(query=statement).first()
            return True
        except (PySparkException, Py4JJavaError) as error:
            log.warning("no connection to %s: %s", mask(self.url), type(error).__name__)
            return False

    def read(
        self,
        table: str | None = None,
        query: str | None = None,
        fetch_size: int | None = None,
        partitioning: Partitioning | None = None,
    ) -> DataFrame:
        """Rows of a table or query. ``fetch_size`` sets the rows per round trip; with
        ``partitioning`` the executors read ranges in parallel and nothing passes the driver."""
        try:
            return self._load(
                table=table, query=query, fetch_size=fetch_size, partitioning=partitioning
            )
        except (PySparkException, Py4JJavaError) as error:
            shown = (query or table or "")[:QUERY_SHOWN]
            log.warning("query failed on %s: %s: %s", mask(self.url), shown, type(error).__name__)
            return self.spark.createDataFrame([], "struct<>")

    def list_tables(self, statement: str | None = None) -> DataFrame:
        """Table names by the catalog query of the database kind, or a given one."""
        kind = self.url.split(":")[1] if ":" in self.url else ""
        query = statement or TABLE_LISTS.get(kind)
        if query is None:
            raise ValueError(f"give the catalog query for {kind!r}")
        names = self.read(query=query)
        if not names.columns:
            return self.spark.createDataFrame([], "table_name string")
        return names.toDF("table_name")

    def table_schema(self, table: str) -> DataFrame:
        """``(name, type, nullable)`` per column, without reading rows."""
        fields = self.read(table=table).schema.fields
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in fields]
        return self.spark.createDataFrame(rows, "name string, type string, nullable boolean")


def with_source(df: DataFrame) -> DataFrame:
    """Mark rows read from a database."""
    return df.withColumn("_source", F.lit("database"))
