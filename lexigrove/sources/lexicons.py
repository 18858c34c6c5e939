"""Lexicons of one's own: files of ``word<tab>label`` lines, for tags and entities.

A relative path lies below the folder that the session setting ``spark.lexigrove.resources`` names, if it is set. Files are read
by Spark, so any of its file systems will do, and files ending in .gz, .bz2 or .zst are decompressed. Lexicons become part of
the plan as a map, so their size is checked.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MOST_WORDS = 20_000


def resource_path(spark: SparkSession, path: str) -> str:
    base = spark.conf.get("spark.lexigrove.resources", None)
    absolute = path.startswith("/") or "://" in path
    return path if absolute or not base else f"{base.rstrip('/')}/{path}"


def read_lexicon(spark: SparkSession, *paths: str) -> dict[str, str]:
    """Labels by lower-cased word; of files and lines that repeat a word, the last holds. Empty lines and ``#`` lines are skipped."""
    out: dict[str, str] = {}
    for path in paths:
        rows = spark.read.text(resource_path(spark, path)).limit(MOST_WORDS + 1).collect()
        for line in (r[0].strip() for r in rows):
            if line and not line.startswith("#"):
                word, tab, label = line.partition("\t")
                if not tab or not label.strip():
                    raise ValueError(f"not a word, a tab and a label: {line!r} in {path}")
                out[word.strip().lower()] = label.strip()
        if len(rows) > MOST_WORDS or len(out) > MOST_WORDS:
            raise ValueError(f"a lexicon has {MOST_WORDS} words at most")
    return out
