"""Readers of the text formats, as DataFrames with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(f: array of fields) for each line with any."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).filter("line <> ''")
    return lines.select(F.split("line", " ").alias("f"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, block, row): trimmed lines; (file, block, row) is the order of files and of places in them, which Spark, taking large files first, doesn't read in."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _lines(spark: SparkSession, path: str, keep: str) -> DataFrame:
    """(at, line): the lines that meet the condition keep, trimmed, numbered in the order of files and of places in them."""
    return numbered(_placed(spark, path).filter(keep), "file", "block", "row", name="at").select("at", "line")


def _checked(rows: DataFrame, expected: int, what: str) -> DataFrame:
    found = rows.count()
    if found != expected:
        raise ValueError(f"{what}: the header says {expected} rows, the file has {found}")
    return rows


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key int, value int) of "key value" lines; lines that aren't two integers are left out."""
    rows = _fields(spark, path).filter("size(f) >= 2")
    return rows.select(F.expr("try_cast(f[0] AS int)").alias("key"), F.expr("try_cast(f[1] AS int)").alias("value")).dropna()


def _parts(spark: SparkSession, path: str) -> tuple[str, str]:
    """Where the header and the lines are: in the two folders that write_edges makes, or both in the file itself."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    split = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return (f"{path}/header", f"{path}/edges") if split else (path, path)


def _sizes(line: str | None, path: str) -> tuple[int, int]:
    """The nodes and edges that a header says."""
    if line is None:
        raise ValueError(f"{path}: there is no header")
    nodes, edges = map(int, line.split()[:2])
    return nodes, edges


def _header(spark: SparkSession, path: str) -> tuple[int, int]:
    lines = _placed(spark, _parts(spark, path)[0]).filter("line <> '' AND NOT startswith(line, '%')")
    return _sizes(lines.agg(F.min_by("line", F.struct("file", "block", "row"))).first()[0], path)


def read_weighted_edges(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((src, dst, weight), nodes) of a file whose first line is "nodes edges"; the count of edges is checked."""
    nodes, edges = _header(spark, path)
    rows = _fields(spark, _parts(spark, path)[1]).filter("size(f) = 3").select(F.col("f")[0].cast("int").alias("src"), F.col("f")[1].cast("int").alias("dst"), F.col("f")[2].cast("double").alias("weight"))
    return _checked(rows, edges, path), nodes


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((src, dst), nodes) of a file with header and lines of two or more fields, the first line being the header."""
    nodes, edges = _header(spark, path)
    head, lines = _parts(spark, path)
    rows = _placed(spark, lines).filter("line <> ''").select("line", F.struct("file", "block", "row").alias("at"))
    if head == lines:
        first = F.struct(*map(F.lit, rows.agg(F.min("at")).first()[0]))
        rows = rows.filter(F.col("at") > first.cast(rows.schema["at"].dataType))
    rows = rows.select(F.split("line", " ").alias("f"))
    return _checked(rows.select(F.col("f")[0].cast("int").alias("src"), F.col("f")[1].cast("int").alias("dst")), edges, path), nodes


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def read_mesh(spark: SparkSession, path: str, once: bool = False) -> tuple[DataFrame, int]:
    """((src, dst), nodes), 0-based, of a mesh file: comments of %, then "nodes edges", then line i with the 1-based neighbours of node i.

    A neighbour of 0 or less ends its line, a line that lists none still counts. once keeps each undirected edge once, as
    src <= dst. Lines get their numbers from a distributed sort, so a mesh may be larger than a task.
    """
    rows = _lines(spark, path, "NOT startswith(line, '%')")
    head, first = rows.filter("line <> ''").agg(F.min("at"), F.min_by("line", "at")).first()
    nodes, edges = _sizes(first, path)
    rows = rows.withColumn("src", F.col("at") - head - 1).filter(F.col("src").between(0, nodes - 1))
    listed = rows.select("src", F.posexplode(F.split("line", " ")).alias("place", "text")).filter("text <> ''")
    stop = F.min(F.when(F.col("text").cast("int") <= 0, F.col("place"))).over(Window.partitionBy("src"))
    out = listed.withColumn("stop", stop).filter("stop IS NULL OR place < stop").select(F.col("src").cast("int"), (F.col("text").cast("int") - 1).alias("dst"))
    if once:
        return out.filter("dst >= src"), nodes
    return _checked(out, edges, path), nodes


def read_coordinates(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(id, x, y, z) of "x y z" lines, numbered in file order; the count is checked if it is given."""
    f = F.split("line", " ")
    rows = _lines(spark, path, "line <> ''").select(F.col("at").alias("id"), *(f[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    return rows if expected is None else _checked(rows, expected, path)


@dataclass(frozen=True)
class RunConfig:
    """What a particle run is given: nine lines, in this order."""

    box: int
    steps: int
    rebuild_every: int
    cutoff: float
    mesh: str
    coordinates: str
    percent: float
    start: int
    update_every: int


def read_run_config(text: str) -> RunConfig:
    """From the text of a configuration: the first word of each of its first nine lines."""
    v = [line.split()[0] for line in text.splitlines() if line.split()][:9]
    if len(v) < 9:
        raise ValueError(f"nine lines are needed, {len(v)} are there")
    return RunConfig(int(v[0]), int(v[1]), int(v[2]), float(v[3]), v[4], v[5], float(v[6]), int(v[7]), int(v[8]))


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Write df as parquet, orc, json or csv."""
    df.write.format(kind).options(**options).save(path)


def write_edges(df: DataFrame, path: str, nodes: int) -> None:
    """Edges as lines of fields in path/edges, and the line "nodes edges" in path/header; the readers of edges take such a folder."""
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(f"{path}/edges")
    count = df.sparkSession.read.text(f"{path}/edges").count()
    df.sparkSession.range(1).select(F.lit(f"{nodes} {count}").alias("value")).write.text(f"{path}/header")
