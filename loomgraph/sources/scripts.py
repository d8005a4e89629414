"""Reading trees of story scripts: files, kinds, limits, archives, lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import numbered

#: Limits of a project, all parameters of ``validate``.
MAX_FILE, MAX_FILES, MAX_TOTAL = 2 << 20, 300, 25 << 20
MAX_ENTRIES, MAX_UNPACKED = 2000, 200 << 20
#: Endings of media files.
MEDIA = ("png", "jpg", "jpeg", "webp", "gif", "svg", "bmp", "ogg", "mp3", "wav", "opus", "flac", "webm", "mp4")
TRANSLATION = r"(?i)(^|/)(game/)?tl/([^/]+)/.*\.rpy$"


def read_scripts(spark: SparkSession, path: str, project_id: str = "p") -> DataFrame:
    """Script files under ``path``: project_id, path, name, content, size, file_ord."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rpy")
    p = F.replace(F.col("_metadata.file_path"), F.lit("\\"), F.lit("/"))
    rows = files.select(F.lit(project_id).alias("project_id"), p.alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"), F.octet_length("value").cast("long").alias("size"))
    return file_order(rows)


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents as files of one project per source."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".rpy"))
    return documents.select("doc_id", F.col("source").alias("project_id"), F.concat("source", F.lit("/"), name).alias("path"), name.alias("name"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


def file_order(files: DataFrame) -> DataFrame:
    """``file_ord`` by path and name, in binary order, within each project."""
    return numbered(files, ["project_id"], ["path", "name"], "file_ord").withColumn("file_ord", F.col("file_ord").cast("int"))


def input_kind(path: Column) -> Column:
    """script, translation, media or other."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    ending = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(p.rlike(TRANSLATION), "translation").when(ending == "rpy", "script").when(ending.isin(*MEDIA), "media").otherwise("other")


def validate(files: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL, max_file: int = MAX_FILE) -> DataFrame:
    """The first rule each project breaks: no_scripts, too_many_files, too_large, file_too_large; else null."""
    script = input_kind(F.col("path")).isin("script", "translation")
    by = files.groupBy("project_id").agg(F.count_if(script).alias("n"), F.sum(F.when(script, F.col("size"))).alias("total"), F.max(F.when(script, F.col("size"))).alias("largest"))
    error = F.when(F.col("n") == 0, "no_scripts").when(F.col("n") > max_files, "too_many_files").when(F.col("total") > max_total, "too_large").when(F.col("largest") > max_file, "file_too_large")
    return by.select("project_id", error.alias("error"))


def read_archives(archives: DataFrame, endings: tuple[str, ...] = ("rpy", *MEDIA), max_entries: int = MAX_ENTRIES, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """Entries of zip files (``path``, ``content`` as read by the binaryFile source): archive, path, content, error.

    Entries with empty, ``.`` or ``..`` parts are left out. An archive with too many entries, too
    much content or a broken one has one row with the error.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, data in zip(b["path"], b["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                    entries = [e for e in z.infolist() if not e.is_dir() and e.filename.rsplit(".", 1)[-1].lower() in endings and all(p not in ("", ".", "..") for p in e.filename.replace("\\", "/").split("/"))]
                    if len(entries) > max_entries or sum(e.file_size for e in entries) > max_unpacked:
                        raise ValueError("too large")
                    for e in entries:
                        yield pd.DataFrame([(archive, e.filename.replace("\\", "/"), z.read(e), None)], columns=["archive", "path", "content", "error"])
                except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError) as e:
                    yield pd.DataFrame([(archive, None, None, str(e))], columns=["archive", "path", "content", "error"])

    return archives.select("path", "content").mapInPandas(unpack, "archive string, path string, content binary, error string")


def content_hash(files: DataFrame) -> DataFrame:
    """``cache_key``: path and SHA-256 of the content."""
    return files.withColumn("cache_key", F.concat("path", F.lit(":"), F.sha2("content", 256)))


def indent(line: Column) -> Column:
    """Columns before the first sign that isn't white space; a tab goes to the next multiple of 8."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    tabs = F.aggregate(F.split(lead, ""), F.lit(0), lambda a, c: F.when(c == "\t", a + 8 - a % 8).when(c == " ", a + 1).otherwise(a))
    return F.when(F.instr(lead, "\t") > 0, tabs).otherwise(F.length(lead)).cast("int")


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: all columns of a file but its content, line_no (from 0), text, indent."""
    rest = [c for c in files.columns if c not in ("content", "size")]
    rows = files.select(*rest, F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "text"))
    return rows.withColumn("indent", indent(F.col("text")))
