"""What the corpus operators share: the shared work folder, staged tables, and partition counts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB spelling of a run of the contract's white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A word of the contract.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []
#: Tables written so far, in order.
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (tests on one machine) a temporary folder is made.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="cartoflow-"))
    return _own_folder[0]


#: Rows of a narrow table that one file holds.
FILE_ROWS = 500_000


def staged(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: an executor lost later costs no recomputation of what came before,
    and every reader sees the same rows.  Where the caller knows that the (narrow) table has at
    most ``most_rows`` rows, it is written in files of about ``FILE_ROWS`` instead of one per
    partition: each file costs its writer several calls, and on a local disk several processes.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str, parts: int) -> tuple[str, DataFrame]:
    """Like ``staged``, dealt by ``key`` into ``parts`` parts, so that tables dealt alike are joined in place.

    Also returns the name in the session's catalogue, for the caller to drop; the files go with ``drop_staged``.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/staged/{table}"
    dealt = df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key)
    dealt.option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    _staged.append(path)
    return table, spark.table(table)


def drop_staged(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables staged after the first ``since``, except the last ``keep``: nothing may read them any more."""
    gone = _staged[since : len(_staged) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _staged.remove(name)


def staged_count() -> int:
    return len(_staged)


def settle(spark: SparkSession) -> None:
    """Lets go of what finished stages have shuffled."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
