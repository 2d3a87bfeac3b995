"""Readers and writers: Parquet stores, JSON records, query-result JSON, HTML folders, zip archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one list of flat records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Query results in the SPARQL JSON format, one row a binding; absent variables are null."""
    fields = ", ".join(f"`{n}` STRUCT<type: STRING, value: STRING>" for n in names)
    raw = spark.read.schema(f"results STRUCT<bindings: ARRAY<STRUCT<{fields}>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("results.bindings").alias("b"))
    return rows.select(*[F.col(f"b.`{n}`.value").alias(n) for n in names])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(id, html) of all .html files below a folder; the id is the path below it without the suffix."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(name, folder.rstrip("/").removeprefix("file:") + "/", -1)
    return raw.select(F.regexp_replace(below, r"\.html$", "").alias("id"), F.col("value").alias("html"))


def read_zipped_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, html) of the .html members of zip archives, each archive read by one task."""

    def members(batches):
        for batch in batches:
            rows = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(n.removesuffix(".html"), z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".html")]
            yield pd.DataFrame(rows, columns=["id", "html"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "id string, html string")


class Store:
    """A folder of Parquet tables by key: what caches of query results, pages and matches need."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def has(self, key: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, key: str, df: DataFrame, overwrite: bool = False) -> None:
        """Existing tables are kept unless overwrite is set."""
        df.write.mode("overwrite" if overwrite else "ignore").parquet(self.path(key))

    def append(self, key: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(key))

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(key))

    def get_or(self, key: str, make, refresh: bool = False) -> DataFrame:
        """The stored table, made and stored first if it is missing or to be refreshed."""
        if refresh or not self.has(key):
            self.save(key, make(), overwrite=True)
        return self.load(key)


def to_json_rows(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, timestamps in ISO 8601, nulls written out."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("json"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event extracts with ids cleaned of their URL prefix."""
    df = spark.read.parquet(path)
    ids = [c for c in ("qid", "part_of_series", "country", "location", "colocated_with") if c in df.columns]
    return df.withColumns({c: T.parse_qid(F.col(c)) for c in ids})


# Series titles that no source holds, workshops first.
LITERAL_SERIES = (
    "Agent-based Modeling and Policy-Making (AMPM)",
    "Computational Linguistics and Intelligent Systems (CLINS)",
    "EICS Series",
    "Games and Learning (GaL)",
    "Federated Learning and Analytics (FedAnal)",
    "ECML-PKDD",
    "Data Science for Social Good (D4SG)",
    "International Conference on Semantic Computing (ICSC)",
    "International Conference on Social Informatics (SocInfo)",
    "International Conference on Web Intelligence (WI)",
    "Semantic Web for Health Care and Life Sciences (ESWC-Health)",
)


def literal_series(spark: SparkSession, titles=LITERAL_SERIES) -> DataFrame:
    """Proxy series, each with a key of its own."""
    return spark.createDataFrame([(f"Q0-{i}", t, t) for i, t in enumerate(titles)], "qid string, label string, title string")
