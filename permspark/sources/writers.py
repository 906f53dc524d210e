"""Sinks and stage checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without a checkpoint folder, by application.
_LOCAL: dict[str, str] = {}


def _stage_root(spark: SparkSession) -> str:
    """The application's folder below the shared checkpoint folder the cluster names.

    Only a local master without that setting falls back to a temporary folder, one for each application.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="permspark-")
        _LOCAL[app] = root
    return f"{root.rstrip('/')}/permspark/{app}"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the application's."""
    return f"{_stage_root(spark)}/{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Deletes the application's stage tables and files; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_stage(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a named stage table and hand back the stored copy (cuts the lineage)."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """Store an intermediate table that several later steps read.

    Downstream plans then start from a pruned columnar scan instead of repeating the work, and a lost
    executor re-reads files instead of recomputing the lineage. Tables live below the application's id
    in the shared checkpoint folder, so they can be dropped together (`drop_stages`) when their results are no longer read.
    """
    return save_stage(df, scratch_dir(df.sparkSession), "stage")


def load_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_csv(df: DataFrame, path: str, cols: list[str] | None = None, header: bool = True, sep: str = ",") -> None:
    """Selected columns, missing values as empty fields."""
    out = df.select(*cols) if cols else df
    (
        out.write.mode("overwrite")
        .option("header", header)
        .option("sep", sep)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def write_quoted(df: DataFrame, path: str, header: bool = False) -> None:
    """CSV with every field in quotes, so that fields may hold line ends, separators and blanks at their ends."""
    options = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": ""}
    df.write.mode("overwrite").options(**options).option("header", header).csv(path)


def write_tsv(df: DataFrame, path: str, cols: list[str] | None = None, header: bool = False) -> None:
    write_csv(df, path, cols, header=header, sep="\t")


def write_ids(df: DataFrame, path: str, col: str) -> None:
    df.select(df[col].cast("string")).write.mode("overwrite").text(path)


def write_sections(df: DataFrame, path: str, section: str) -> None:
    """One folder per section value, so that a reader of one section prunes the rest."""
    df.write.mode("overwrite").partitionBy(section).parquet(path)
