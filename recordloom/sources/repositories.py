"""What a repository says about anchored files: their content hashes and the names they moved to.

Repositories are asked on the driver, as their tool runs there; their answers are one row per file.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable
from hashlib import sha1
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(where: str, *args: str) -> str:
    """The tool's output, empty where it fails or is not there."""
    try:
        return subprocess.run(["git", "-C", where, *args], capture_output=True, text=True, check=False).stdout
    except OSError:
        return ""


def parse_renames(lines: DataFrame) -> DataFrame:
    """(old, new) from name-status ``lines`` (column value): letter R and a score, two paths, tabs between.

    Of several new names of a file the smallest counts; other lines count for nothing.
    """
    part = F.split("value", "\t")
    moved = lines.where(F.col("value").rlike(r"^R\d*\t[^\t]+\t[^\t]+$")).select(part[1].alias("old"), part[2].alias("new"))
    return moved.groupBy("old").agg(F.min("new").alias("new"))


def renames(spark: SparkSession, where: str, since: str | None = None) -> DataFrame:
    """(old, new) of files renamed in the working tree and since a commit.

    Without one the last ten commits are looked at, or all of a younger history; a folder that is no
    repository has none.
    """
    if since is None:
        since = next(
            (r for r in ("HEAD~10", _git(where, "rev-list", "--max-parents=0", "HEAD").split("\n")[0]) if r and _git(where, "rev-parse", "--verify", "-q", r)),
            None,
        )
    elif not _git(where, "rev-parse", "--verify", "-q", since):
        raise ValueError(f"unknown commit: {since}")
    said = _git(where, "diff", "--name-status", "-M", "HEAD") + (_git(where, "diff", "--name-status", "-M", since, "HEAD") if since else "")
    return parse_renames(spark.createDataFrame([(line,) for line in said.splitlines()], "value string"))


def hashes(where: str, files: Iterable[str]) -> list[tuple[str, str]]:
    """(file, content hash) of those of ``files`` that exist under a folder."""
    out = []
    for f in files:
        path = Path(where, f)
        if path.is_file():
            data = path.read_bytes()
            out.append((f, sha1(b"blob %d\x00" % len(data) + data).hexdigest()))
    return out


def files(spark: SparkSession, where: str, anchored: DataFrame) -> DataFrame:
    """(repo, file, current_sha) of the anchored files (repo, file) that exist.

    A blank repo is the folder itself, another one a folder beside it. Files are read once each.
    """
    names = [(r.repo, r.file) for r in anchored.select("repo", "file").distinct().toLocalIterator()]
    place = lambda repo: where if not repo else str(Path(where).resolve().parent / repo)
    rows = [(repo, f, sha) for repo, name in names for f, sha in hashes(place(repo), [name])]
    return spark.createDataFrame(rows, "repo string, file string, current_sha string")
