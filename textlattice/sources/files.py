"""Sources: whole texts in any codec, path expansion, inventories and manifests of files."""

from __future__ import annotations

import codecs
import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_codec(encoding: str) -> str:
    """The codec's name if it maps text to bytes and back, else ValueError."""
    info = codecs.lookup(encoding)
    if not getattr(info, "_is_text_encoding", True):
        raise ValueError(f"not a text codec: {encoding}")
    return info.name


def _decode(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([c.decode(e) for c, e in zip(content, encoding)])


def whole_texts(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", pattern: str | None = None) -> DataFrame:
    """``(path, text)``, one row a file; every CR and LF stays."""
    name = check_codec(encoding)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).dropDuplicates(["path"])
    text = F.decode("content", "UTF-8") if name == "utf-8" else F.pandas_udf(_decode, "string")(F.col("content"), F.lit(name))
    return files.select("path", text.alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, sha256)`` of every file below a folder, by name relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace("path", "^.*?" + path.rstrip("/").replace(".", "\\.") + "/", "")
    return files.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Differences ``(path, problem)``: missing, unexpected, size, sha256."""
    j = found.toDF("path", "f_size", "f_sha").join(stated.toDF("path", "s_size", "s_sha"), "path", "full")
    problem = (
        F.when(F.col("f_size").isNull(), "missing").when(F.col("s_size").isNull(), "unexpected").when(F.col("f_size") != F.col("s_size"), "size").when(F.col("f_sha") != F.col("s_sha"), "sha256")
    )
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def version(*frames: DataFrame) -> str:
    """One SHA-256 of input tables, whatever the order of their rows."""
    parts = []
    for df in frames:
        row = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
        # Sums of hash words stay one row; rows never reach the driver.
        words = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
        parts.append(row.agg(F.concat_ws(":", F.count("*"), *words).alias("v")).first().v)
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def sample(df: DataFrame, n: int, order: str, text_col: str = "text", where=None) -> DataFrame:
    """The first ``n`` rows by ``order`` with a non-blank text."""
    if n < 1:
        raise ValueError("n must be positive")
    df = df.filter(F.coalesce(F.trim(F.col(text_col)), F.lit("")) != "")
    return (df.filter(where) if where is not None else df).orderBy(order).limit(n)


def surface_inventory(texts: DataFrame, probes: DataFrame | None = None, text_col: str = "text", longest: int = 256) -> DataFrame:
    """``(surface)``: distinct non-space runs and probes of at most ``longest`` characters, without NUL."""
    found = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?U)\S+"), F.lit(0))).alias("surface"))
    if probes is not None:
        found = found.union(probes.select("surface"))
    return found.filter((F.length("surface") <= longest) & ~F.contains("surface", F.lit("\0"))).distinct()


DEFAULT_WORKLOAD = ("Сәлем, әлем!", "Мен бүгін кітап оқыдым.", "Бұл 2026-жыл.", "Қалайсың?")


def workload(texts: DataFrame | None, spark: SparkSession, repeat: int = 1, max_chars: int | None = None, text_col: str = "text", order: str | None = None) -> DataFrame:
    """One row ``(text)`` per repetition: non-empty texts joined by line feeds, cut to ``max_chars``; a short default without texts."""
    if repeat < 1:
        raise ValueError("repeat must be positive")
    if texts is None:
        one = spark.createDataFrame([("\n".join(DEFAULT_WORKLOAD),)], "text string")
    else:
        key = F.col(order) if order else F.lit(0)
        rows = texts.filter(F.coalesce(text_col, F.lit("")) != "").select(F.struct(key.alias("o"), F.col(text_col).alias("t")).alias("p"))
        one = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))
    if max_chars is not None:
        one = one.select(F.substring("text", 1, max_chars).alias("text"))
    return one.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).select("run", "text")


def resource_folder(explicit: str | None = None, env: str = "TEXTLATTICE_RESOURCES", project: str = ".textlattice") -> str | None:
    """Where resources are: the stated folder, the environment's, the project's, the user's cache; the first that exists."""
    cache = os.path.join(os.path.expanduser("~"), ".cache", "textlattice")
    if explicit is not None:
        return explicit
    return next((p for p in (os.environ.get(env), os.path.abspath(project), cache) if p and os.path.isdir(p)), None)


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Writes a table under the digest of its rows and then names it by one rename of a pointer file."""
    spark, digest = df.sparkSession, version(df)
    target = f"{folder.rstrip('/')}/{digest}"
    df.write.mode("overwrite").parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    new, final = path(f"{folder}/.{name}.{digest}"), path(f"{folder}/{name}.current")
    out = fs.create(new, True)
    out.writeBytes(digest)
    out.close()
    fs.delete(final, False)
    fs.rename(new, final)
    return digest
