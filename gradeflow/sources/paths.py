"""Names out of file paths."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def file_path() -> Column:
    """The path of the file a row comes from, with URL escapes undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def below(root: str, rest: str) -> str:
    """A pattern for paths under ``root``; ``rest`` is the pattern of what follows it.

    A full root must match from the start, so folders above it may have any name.
    """
    parsed = urlparse(root)
    place = (parsed.path if parsed.scheme else root).rstrip("/")
    if parsed.scheme or root.startswith("/"):
        return rf"^(?:[A-Za-z0-9+.-]+:)?(?://[^/]*)?\Q{place}\E{rest}"
    return rf"(?:^|/)\Q{place.removeprefix('./')}\E{rest}"


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reaches, in order; none where there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has ended: Spark adds ``_SUCCESS`` last."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
