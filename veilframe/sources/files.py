"""Files of documents: listing, reading whole, and writing from executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), urlsplit(uri).path if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, content, sha256 of a file, or of all workbooks and decks below a folder; extension is lower case.

    A file is taken whatever its name is; sort by path where an order matters.
    """
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[xXpP][lLpP][sStT][xX]").load(path) if is_folder(path) else reader.load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.select("path", extension.alias("extension"), "content", F.sha2("content", 256).alias("sha256"))


def is_folder(path: str) -> bool:
    files, inner = store(path)
    return files.get_file_info(inner).type == fs.FileType.Directory


def exists(path: str) -> bool:
    files, inner = store(path)
    return files.get_file_info(inner).type != fs.FileType.NotFound


def write_file(path: str, content: bytes) -> None:
    write_pieces(path, [content])


def write_pieces(path: str, pieces: Iterable[bytes]) -> None:
    """Write under another name first, so that a file is there whole or not at all."""
    files, inner = store(path)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    with files.open_output_stream(inner + ".part", compression=None) as out:
        for content in pieces:
            out.write(content)
    files.move(inner + ".part", inner)


def entries(content: bytes) -> dict[str, bytes]:
    """A zip file's entries, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {x.filename: z.read(x) for x in z.infolist()}


def zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED, 6)
    return out.getvalue()


def target_names(files: DataFrame) -> DataFrame:
    """file (of column path) and target, the name of its outputs without what follows the stem.

    Files of one stem, whatever their folder or extension: the first by path has the stem, each other a digest of its path too.
    """
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    own = files.select(F.col("path").alias("file"), stem.alias("stem"))
    first = own.groupBy("stem").agg(F.min("file").alias("first"))
    digest = F.concat_ws("_", "stem", F.left(F.sha2("file", 256), F.lit(12)))
    return own.join(first, "stem").select("file", F.when(F.col("file") == F.col("first"), F.col("stem")).otherwise(digest).alias("target"))


def output_name(target: str, extension: str, folder: str) -> str:
    """Where a masked document goes: {target}_脱敏.{extension}."""
    return f"{folder.rstrip('/')}/{target}_脱敏.{extension}"


def log_name(target: str, folder: str) -> str:
    return f"{folder.rstrip('/')}/{target}_日志.json"
