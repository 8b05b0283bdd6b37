"""Source trees as tables: recursive scans with ignore rules, fingerprints, sniffers."""

from __future__ import annotations

import fnmatch
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions.paths import LANGUAGES, extension
from graphloom.plans.ship import ship

#: Folders that are never source.
IGNORED_DIRS = ("vendor", "node_modules", "third_party", ".git")


def scan_tree(spark: SparkSession, root: str, ignore_dirs: tuple[str, ...] = IGNORED_DIRS, ignore_rules: dict[str, list[str]] | None = None, read_ignore_files: bool = True) -> DataFrame:
    """(path, content, size, modified_at) of the regular files below ``root``.

    The rules of ``.git/info/exclude`` and of ``.gitignore`` files count unless
    ``read_ignore_files`` is false; they are read to the driver. ``ignore_rules`` maps a folder (relative, '' for the root) to the lines of its ignore
    file: later rules win, ``!`` takes back, a trailing ``/`` means folders, a rule with a
    slash is anchored at its folder.
    """
    ship(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = rows.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    if read_ignore_files:
        read = {} if ignore_rules is None else dict(ignore_rules)
        for name, text in sorted(ignore_files(spark, root).items()):
            folder = "" if name.startswith(".git/") else name.rpartition("/")[0]
            read[folder] = [*read.get(folder, []), *text.splitlines()]
        ignore_rules = read
    if ignore_dirs:
        rows = rows.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*ignore_dirs)))
    if ignore_rules:
        rows = rows.where(~ignored(ignore_rules)(F.col("path")))
    return rows


def ignore_files(spark: SparkSession, root: str) -> dict[str, str]:
    """Path and text of the ignore files below ``root``; Spark's readers pass over names with a dot in front."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out, found = fs.makeQualified(top).toString().rstrip("/") + "/", {}, fs.listFiles(top, True)
    while found.hasNext():
        at = found.next().getPath()
        name = at.toString().removeprefix(base)
        if name == ".git/info/exclude" or at.getName() == ".gitignore" and not name.startswith(".git/"):
            stream = fs.open(at)
            try:
                out[name] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return out


def rule_hits(rule: str, folder: str, path: str) -> bool:
    """Does one ignore rule of ``folder`` match the path or a folder above it?"""
    if folder and not path.startswith(folder + "/"):
        return False
    inner = path[len(folder) + 1 :] if folder else path
    rule, only_dir = rule.rstrip("/"), rule.endswith("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    parts = inner.split("/")
    for k in range(1, len(parts) + (0 if only_dir else 1)):
        name = "/".join(parts[:k])
        target = name if anchored else posixpath.basename(name)
        if fnmatch.fnmatchcase(target, rule.replace("**/", "*").replace("/**", "/*")):
            return True
    return False


def is_ignored(rules: dict[str, list[str]], path: str) -> bool:
    verdict = False
    for folder in sorted(rules, key=len):
        for line in rules[folder]:
            line = line.strip()
            if line and not line.startswith("#") and rule_hits(line.lstrip("!"), folder, path):
                verdict = not line.startswith("!")
    return verdict


def ignored(rules: dict[str, list[str]]):
    @F.pandas_udf("boolean")
    def verdict(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: is_ignored(rules, p))

    return verdict


def source_files(files: DataFrame) -> DataFrame:
    """Files whose extension has a language."""
    return files.where(extension(F.col("path")).isin(*LANGUAGES))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


#: What a line of an OpenAPI 3, a GraphQL and a proto text begins with.
CONTRACTS = {
    "openapi": r"^[\s{]*[\"']?openapi[\"']?\s*:\s*[\"']?3\.",
    "graphql": r"^\s*(type|schema|extend|interface|enum|input|union|scalar|directive)\b",
    "proto": r"^\s*(syntax\s*=|package\s+\w[\w.]*\s*;|import\s+\"|service\s+\w|message\s+\w|enum\s+\w)",
}
HEAD = 8192


def is_contract(kind: str, text: Column) -> Column:
    """Contract sniffers on the whole text, without its byte order mark; false for a null text."""
    return F.coalesce(F.regexp_replace(text, "^\ufeff", "").rlike("(?md)" + CONTRACTS[kind]), F.lit(False))


def looks_like(kind: str, text: Column) -> Column:
    """Contract sniffers for file discovery, which reads the first ``HEAD`` characters."""
    return is_contract(kind, F.left(text, F.lit(HEAD)))
