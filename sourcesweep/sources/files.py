"""The files table: one row per source file, and the filters that pick files for a detector."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
SKIPPED_FOLDERS = ("node_modules", ".git", "vendor", "dist", "build", ".venv", "venv",
                   "__pycache__", ".next", ".cache")
MINIFIED = ".min."
MANIFEST_NAMES = ("package.json", "composer.json", "requirements.txt", "Gemfile", "pom.xml",
                  "build.gradle", "Cargo.toml", "Dockerfile")

# Stands in for a genuine U+FFFD while invalid bytes are being dropped.
_KEEP = "﷐﷑﷐"


def decode_lossy(raw: Column) -> Column:
    """Binary to text as UTF-8, dropping invalid bytes, without leaving the JVM."""
    text = raw.cast("string")
    marked = F.make_valid_utf8(F.replace(text, F.lit("�"), F.lit(_KEEP)))
    dropped = F.replace(marked, F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(dropped, F.lit(_KEEP), F.lit("�")))


def unify_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def suffix(name: Column) -> Column:
    """Final extension with its dot; empty for names like ``.profile`` or ``file.``."""
    return F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1)


def normalise_files(df: DataFrame) -> DataFrame:
    """Any ``(project, path, content)`` table -> the files table.

    ``path`` is relative to the project root and uses ``/``; ``content`` is text or binary.
    """
    content = F.col("content")
    if dict(df.dtypes)["content"] == "binary":
        content = decode_lossy(content)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("project", "path", name.alias("name"), suffix(name).alias("ext"),
                     unify_newlines(content).alias("content"))


def has_extension(extensions: Iterable[str]) -> Column:
    return F.col("ext").isin(*extensions)


def is_code_file(extensions: Iterable[str]) -> Column:
    """Extension test by name ending, which also accepts a file called just ``.py``."""
    extensions = list(extensions)
    return F.col("ext").isin(*extensions) | F.col("name").isin(*extensions)


def is_skipped() -> Column:
    """Third-party, generated and minified files, which analyzers leave out."""
    folders = "|".join(re.escape(d) for d in SKIPPED_FOLDERS)
    return F.col("path").rlike(f"(?:^|/)(?:{folders})/") | F.col("name").contains(MINIFIED)


def is_manifest() -> Column:
    return F.col("name").isin(*MANIFEST_NAMES)


def lines_of(content: Column) -> Column:
    """Array of lines; a trailing newline gives a last empty line."""
    return F.split(content, "\n", -1)
