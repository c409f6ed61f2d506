"""Trees of files, and tables that hold one document per row, as ``files(path, name, text)``."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.config import AuditConfig
from keysift.operators.detect import file_name_rule
from keysift.operators.lines import decode_text, is_binary
from keysift.sources.walk import reachable, read_whole, walk


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffix(name: Column) -> Column:
    """From the last dot on; empty when that dot starts or ends the name."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def rel_path(path: Column, root: Column) -> Column:
    """Path below ``root``, or the path itself when it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def in_open_dirs(path: Column, config: AuditConfig) -> Column:
    """Whether no directory on the relative path is hidden, excluded or an Xcode bundle."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def closed(part: Column) -> Column:
        return (
            part.isin(*sorted(config.excluded_dirs)) | part.startswith(".")
            | part.endswith(".xcodeproj") | part.endswith(".xcworkspace")
        )

    return ~F.exists(dirs, closed)


def is_kept(name: Column, config: AuditConfig) -> Column:
    return ~(name.isin(*sorted(config.excluded_files)) | name.startswith(".DS_Store"))


def is_included(name: Column, config: AuditConfig) -> Column:
    """Whether the suffix, the exact name or a file name rule asks for the file to be scanned."""
    return (
        F.lower(path_suffix(name)).isin(*sorted(config.included_extensions))
        | name.isin(*sorted(config.exact_filenames))
        | file_name_rule(name).isNotNull()
    )


def is_target(path: Column, config: AuditConfig) -> Column:
    name = file_name(path)
    return reduce(and_, (in_open_dirs(path, config), is_kept(name, config), is_included(name, config)))


def with_text(files: DataFrame) -> DataFrame:
    """``text`` from ``content``; null for binary files."""
    return files.withColumn("text", F.when(~is_binary(F.col("content")), decode_text(F.col("content")))).drop("content")


def qualify(spark: SparkSession, root: str) -> tuple[str, bool, bool]:
    """The root as Spark reports paths under it, whether it exists and whether it is a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = path.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    exists = fs.exists(path)
    return path.toString(), exists, exists and not fs.getFileStatus(path).isDirectory()


def targets(files: DataFrame, root: str, config: AuditConfig, *columns: str | Column) -> DataFrame:
    """``path`` below the root, and the given columns, of the files of a file source that are to be scanned.

    The rules on paths are tested on file metadata, so Spark drops the other files when it plans the scan and
    never opens them.
    """
    # The metadata path is URL-encoded.
    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = _below(listed, F.lit(root))
    return files.filter(is_target(path, config)).select(path.alias("path"), *columns)


def listed_files(spark: SparkSession, root: str, config: AuditConfig) -> DataFrame:
    """The files to be scanned among those Spark lists, for storage that only Spark reaches; a failing read ends the job."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return targets(reader.load(root), root, config, "length", "content")


def tree_listing(
    spark: SparkSession, root: str, config: AuditConfig = AuditConfig(), written: list[str] | None = None
) -> DataFrame | None:
    """``(path, length, reason)`` of the files under ``root`` that are to be scanned, by one walk that all readers share.

    A folder that could not be listed is a row with a reason.  A root that is one file is taken as it is, a missing
    one has no files.  Nothing where ``pyarrow.fs`` does not reach the root.  ``written`` gets the paths of tables.
    """
    root, exists, single = qualify(spark, root)
    if not exists:
        return spark.createDataFrame([], "path STRING, length BIGINT, reason STRING")
    if not reachable(root):
        return None
    if single:
        return single_file(spark, root).withColumn("reason", F.lit(None).cast("string"))
    return walk(
        spark, root, lambda path: in_open_dirs(F.concat(path, F.lit("/")), config), lambda path: is_target(path, config), written
    )


def listed_root(spark: SparkSession, root: str) -> str:
    """The folder that the paths of a listing are below."""
    root, _, single = qualify(spark, root)
    return root.rsplit("/", 1)[0] if single else root


def list_files(
    spark: SparkSession, root: str, config: AuditConfig = AuditConfig(), longest: int | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """``(path, name, length, content, reason)`` of the files under ``root`` that are to be scanned.

    ``path`` is relative to the root; ``listing`` is that of ``tree_listing``, if it was made before.  Files of
    ``longest`` bytes or more are left to ``long_parts``.  Linked folders are not followed.  A file that cannot be
    read has null content and a reason; where only Spark reaches the storage, it ends the job.
    """
    listing = tree_listing(spark, root, config) if listing is None else listing
    if listing is None:  # then long files are read whole as well
        root, _, single = qualify(spark, root)
        files = (
            spark.read.format("binaryFile").load(root).withColumn("path", file_name(F.col("path"))) if single
            else listed_files(spark, root, config)
        ).withColumn("reason", F.lit(None).cast("string"))
    else:
        files = listing.filter(F.col("reason").isNull())
        if longest is not None:
            files = files.filter(F.col("length") < longest)
        files = read_whole(files, listed_root(spark, root))
    return files.select("path", file_name(F.col("path")).alias("name"), "length", "content", "reason")


def single_file(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of a root that is one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    length = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return spark.createDataFrame([(path.getName(), length)], "path STRING, length BIGINT")


def _below(path: Column, base: Column) -> Column:
    """Relative path, whatever number of slashes follows the scheme of either side."""
    def plain(p: Column) -> Column:
        return F.regexp_replace(p, r"^([A-Za-z][A-Za-z0-9+.\-]*):/+", "$1:/")

    return rel_path(plain(path), plain(base))


def read_files(
    spark: SparkSession, root: str, config: AuditConfig = AuditConfig(), longest: int | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    return with_text(list_files(spark, root, config, longest, listing).drop("length"))


def from_documents(documents: DataFrame, path: Column, text: Column) -> DataFrame:
    """A table with one document per row as files."""
    return documents.select(path.alias("path"), file_name(path).alias("name"), text.alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that came as fewer partitions than there are cores.

    A large input has more partitions than that already and is left where it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
