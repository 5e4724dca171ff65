"""Edge lists and cluster lists as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "MULTICUT"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a text file: a header line, then `i j cost` a line. A wrong header or a malformed line raises.

    The file is read in parallel: lines other than the header are recognised wherever they are; blank lines are skipped.
    """
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    head = spark.read.text(files[0]).limit(1).collect() if files else []  # the first line of the first file
    if not head or head[0][0].strip() != HEADER:
        raise ValueError(f"{path}: the first line must be {HEADER}")
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.trim("value").isin("", HEADER)).select("value", parts.alias("p"))
    wrong = (F.size("p") != 3) | F.expr("try_cast(p[0] AS bigint) IS NULL OR try_cast(p[1] AS bigint) IS NULL OR try_cast(p[2] AS double) IS NULL")
    checked = body.select(F.when(wrong, F.raise_error(F.concat(F.lit("malformed edge: "), "value")).cast("array<string>")).otherwise(F.col("p")).alias("p"))
    return checked.select(F.col("p")[0].cast("bigint").alias("i"), F.col("p")[1].cast("bigint").alias("j"), F.col("p")[2].cast("double").alias("cost"))


def write_edges(edges: DataFrame, path: str) -> None:
    """A folder of text files that `read_edges` reads: the header alone in the first one, edges in as many as there are partitions."""
    spark = edges.sparkSession
    values = [F.col(c).cast("string") for c in ("i", "j", "cost")]
    body = edges.select(F.concat_ws(" ", *values).alias("value"))
    spark.createDataFrame([(HEADER,)], "value string").coalesce(1).union(body).write.text(path)


def cluster_lines(labels: DataFrame) -> DataFrame:
    """(cluster, line): for each cluster from 0 to the greatest its node ids in rising order, tab-separated; gaps are empty, negative clusters left out.

    A line is a string, so it holds a cluster of some hundred million nodes at most: `cluster_rows` has no such limit.
    """
    held = labels.where("cluster >= 0").groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    most = labels.agg(F.max("cluster")).first()[0]
    spine = labels.sparkSession.range(0, 0 if most is None else most + 1).withColumnRenamed("id", "cluster")
    return spine.join(held, "cluster", "left").select("cluster", F.coalesce(F.array_join(F.transform("nodes", lambda n: n.cast("string")), "\t"), F.lit("")).alias("line"))


def cluster_rows(labels: DataFrame) -> DataFrame:
    """(line): `cluster` and `node`, tab-separated, a line a node, in many files: for clusters of any size. Negative clusters are left out."""
    return labels.where("cluster >= 0").select(F.concat_ws("\t", F.col("cluster").cast("string"), F.col("node").cast("string")).alias("line"))


def write_clusters(labels: DataFrame, path: str, rows: bool = False) -> None:
    """The lines of `cluster_lines` in cluster order; or, with `rows`, those of `cluster_rows`, however large clusters are."""
    lines = cluster_rows(labels) if rows else cluster_lines(labels).orderBy("cluster").select("line")
    lines.write.text(path)
