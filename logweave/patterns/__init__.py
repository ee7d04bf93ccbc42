"""Named pattern libraries: ``NAME regex`` text files, read when a plan is made."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_HERE = Path(__file__).parent


def parse(text: str) -> dict[str, str]:
    """Read ``NAME regex`` lines; ``#`` starts a comment line; a later name replaces an earlier."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, _, regex = line.partition(" ")
            found[name] = regex.strip()
    return found


def load_folder(folder: str | Path) -> dict[str, str]:
    """All pattern files of a folder; hidden files and README.md are skipped."""
    found: dict[str, str] = {}
    for path in sorted(Path(folder).iterdir()):
        if path.is_file() and not path.name.startswith(".") and path.name != "README.md":
            found.update(parse(path.read_text(encoding="utf-8")))
    return found


def read_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """Pattern files below a folder of the cluster's file system, in the order of their paths, a later name replacing an earlier.

    Files and folders whose names begin with a dot or an underscore, and README.md, are skipped. Patterns are part of a plan, so they are read when the
    plan is made; a library of patterns is some hundred lines.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
        .filter("NOT endswith(file, '/README.md')").orderBy("file", "block", "line")
    )
    return parse("\n".join(r.value for r in lines.select("value").collect()))


@lru_cache(maxsize=1)
def library() -> dict[str, str]:
    """The built-in patterns."""
    return {
        name: regex
        for file in ("base.grok", "network.grok")
        for name, regex in parse((_HERE / file).read_text(encoding="utf-8")).items()
    }
