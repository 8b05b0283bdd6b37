"""Workspaces (lists of members) and git history read by subprocess."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"^[A-Za-z0-9._-]+$")


def load_workspace(path: str) -> list[dict]:
    """Members of a workspace file: unique names, existing folders, well-formed http blocks."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict) or data.get("version") != 1:
        raise ValueError("a workspace has version 1")
    seen: set[str] = set()
    for repo in data.get("repos") or []:
        name, where = repo.get("name", ""), repo.get("path", "")
        if not NAME.match(name) or name in seen:
            raise ValueError(f"bad or repeated member name {name!r}")
        if not (Path(path).parent / where).is_dir():
            raise ValueError(f"{name}: no folder {where!r}")
        http = repo.get("http") or {}
        if not isinstance(http, dict) or not all(isinstance(x, str) and x for x in http.get("base_env", [])):
            raise ValueError(f"{name}: bad http block")
        seen.add(name)
    return data.get("repos") or []


def git_commits(path: str) -> Iterator[tuple[str, datetime, list[str]]]:
    """(hash, committer time, paths) of all commits but merges, newest first; renames give the new name."""
    out = subprocess.run(["git", "-C", path, "log", "--no-merges", "--name-only", "-z", "--format=%x01%H %ct"], capture_output=True, check=True).stdout
    for block in out.decode("utf-8", "replace").split("\x01")[1:]:
        head, _, rest = block.partition("\x00")
        commit, when = head.strip().split(" ")
        yield commit, datetime.fromtimestamp(int(when), UTC).replace(tzinfo=None), sorted({p.strip("\n") for p in rest.split("\x00") if p.strip("\n")})


def commits_table(spark: SparkSession, members: list[dict]) -> DataFrame:
    """(repo, commit_hash, committed_at, paths) of local clones, one task per member."""
    schema = "repo string, commit_hash string, committed_at timestamp_ntz, paths array<string>"
    rows = spark.createDataFrame([(m["name"], str(m["path"])) for m in members], "name string, path string").repartition(max(1, len(members)), "name")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, path in zip(pdf["name"], pdf["path"], strict=True):
                got = list(git_commits(path))
                yield pd.DataFrame({"repo": name, "commit_hash": [c for c, _, _ in got], "committed_at": pd.to_datetime([t for _, t, _ in got]), "paths": [p for _, _, p in got]})

    from graphloom.plans.ship import ship

    ship(spark)
    return rows.mapInPandas(run, schema)
