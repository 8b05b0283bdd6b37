"""Files that nobody wrote by hand in their repository.

A file is generated, minified, third-party or a data blob if one of these says so:

* its path or name (folders such as ``vendor`` or ``node_modules``, names such as
  ``x.pb.go``, ``x.min.js`` or ``zz_generated.x.go``), matched by whole path parts;
* the head comment of its text (a generator's or an importer's notice). Only comment lines
  before the first line of code count, so code that writes such notices is no case;
* the layout of its text (hardly any white space; mostly digits or one long literal);
* the names of its functions and types (nearly all of them one to three characters);
* its content: Merkle hashes are computed bottom-up over each repository's tree, files first,
  then each folder from its children's names and hashes, level by level; a subtree with the
  same hash in two unrelated repositories was copied there. A file has up to two leaves, its
  text and the names it declares, and a tree is hashed in each view, since a copy's text is
  not always there. A folder is hashed over the children that tell something and stands for
  all in it if these are at least half of its files, so a copied folder in which some file
  has neither text nor names is still found whole. Repositories that are alike as a whole
  are related, and what only they share is no copy.

Null paths are taken from the id, null names ignored; several lives or spellings of one
file are one row; a null text has no evidence. Files of the kind ``file`` only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import fragment_join, plan_fragments
from graphloom.plans.iterate import cut
from graphloom.plans.ship import ship

#: Conventional folders and file names, matched in lower case.
VENDOR_PATH = r"(^|/)(_?vendor(ed)?|third[-_]?party|3rdparty|node_modules|bower_components|jspm_packages|site-packages|dist-packages|pods|carthage|godeps)/|(^|/)external/[^/]+@v?\d|(^|/)deps/[^/]+-v?\d+(\.\d+)+/|(^|/)[a-z]\w*-\d+\.\d+\.\d+\.js$"
GENERATED_PATH = (
    r"(^|/)(generated|__generated__|generated-sources|generated-src|autogenerated)/"
    r"|\.pb\.(go|cc|h|swift|dart)$|_pb2(_grpc)?\.pyi?$|_pb\.(js|d\.ts|rb)$|\.(designer|generated|g|g\.i)\.[a-z]+$|(^|/)zz_generated[._]|_(gen|generated|autogen)\.[a-z]+$|(^|/)bindata(_[a-z0-9]+)?\.go$|(^|/)bindata_[^/]+\.go$"
)
MINIFIED_PATH = r"[.-]min\.(js|css|mjs|cjs)$|\.(bundle|umd|chunk|packed)\.js$|(^|/)dist/|(^|/)build/static/|(^|/)chunk-[0-9a-f]{6,}\.js$|\.[0-9a-f]{8,}\.js$"
DATA_PATH = r"\.wasm\.js$|[._-](blob|dump|base64|b64|datauri|hexdata)\.[a-z]+$"

GENERATED_HEAD = re.compile(
    r"code generated by|@generated\b|auto-?generated\b|(produced|generated|created|written) automatically|automatically (produced|generated|created|written)|machine[- ]generated"
    r"|(do not|don't) (edit|modify)( this file)?( by hand)?\s*[.!]?\s*(\*/|-->)?$|(manual )?changes will be (lost|overwritten)|automatisch (erzeugt|generiert)|généré automatiquement|generado automáticamente",
    re.I,
)
VENDOR_HEAD = re.compile(r"\bvendored\b.{0,20}\b(from|copy|version|release)|third[- ]party (code|source|library|module)|\bupstream (copy|version|release|source)|(copied|imported|taken|borrowed) (verbatim )?(out of|from) the \S+ (project|library|repository|package)|part of the \S+ (distribution|project|library|package)", re.I)
COMMENT = re.compile(r"\s*(//|/\*|\*|--|;|<!--|\"\"\"|'''|#(?!\s*(include|define|if|ifdef|ifndef|pragma|import)\b))")
SHORT_NAME = "^[a-z]([0-9][a-z]?|[a-z])?$"
LITERAL = re.compile(r"[A-Za-z0-9+/=_-]{200}")
LINE = re.compile(r"[^\n]+")


def head_reason(text: str) -> str | None:
    """What the comments before the first line of code say."""
    quote = None
    for found in LINE.finditer(text.lstrip("\ufeff \t\r\n")):  # stops at the first line of code
        line = found[0].rstrip("\r")
        if not line.strip():
            continue
        inside = quote is not None
        if not inside and not COMMENT.match(line):
            return None
        if GENERATED_HEAD.search(line):
            return "generated"
        if VENDOR_HEAD.search(line):
            return "third-party"
        for opens, closes in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
            if quote == closes and closes in line:
                quote = None
                break
            if not inside and line.lstrip().startswith(opens) and closes not in line.lstrip()[len(opens) :]:
                quote = closes
    return None


def layout_reason(text: str) -> str | None:
    """Minified code or data, by the shares of white space and digits."""
    n = len(text)
    if n < 80:
        return None
    digits = sum(map(text.count, "0123456789"))
    if digits > 0.28 * n:
        return "data"
    white = n - len("".join(text.split()))
    if white < 0.055 * n and len(text.encode("utf-8", "replace")) < 1.2 * n:
        return "data" if LITERAL.search(text) else "minified"
    return None


def content_hash(text: str) -> str | None:
    """Hash of the text without white space, null if it holds too little to be told from others."""
    squeezed = "".join(text.split())
    return hashlib.blake2b(squeezed.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(squeezed) >= 160 else None


def text_evidence(docs: DataFrame) -> DataFrame:
    """(repo, path, reason, content) of each code document."""
    ship(docs.sparkSession)
    kept = docs.where("source = 'code' and text is not null and repo is not null and path is not null").select("repo", "path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            reason = [head_reason(t) or layout_reason(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reason, pa.string()), pa.array([content_hash(t) for t in texts], pa.string())], names=["repo", "path", "reason", "content"])

    return kept.mapInArrow(run, "repo string, path string, reason string, content string")


def path_reason(path: Column) -> Column:
    low = F.lower(path)
    rules = (("third-party", VENDOR_PATH), ("generated", GENERATED_PATH), ("minified", MINIFIED_PATH), ("data", DATA_PATH))
    out = None
    for reason, pattern in rules:
        out = (F.when if out is None else out.when)(low.rlike(pattern), reason)
    return out


def files_of(nodes: DataFrame) -> DataFrame:
    """(repo, id, path): the distinct file nodes; the id has the right path."""
    from_id = F.regexp_extract("id", "^file:(.*)$", 1)
    path = F.when(from_id != "", from_id).otherwise(F.col("path"))
    return nodes.where("kind = 'file' and id is not null").groupBy("repo", "id").agg(F.max(path).alias("path"), F.max("name").alias("name"))


def name_evidence(nodes: DataFrame) -> DataFrame:
    """(repo, path, short, names, declared) from the names declared in each file; ``declared`` is a hash of their set."""
    path = F.regexp_extract("id", "^[a-z]+:([^#]+)#", 1)
    rows = nodes.where("kind in ('function', 'method', 'type') and name is not null").select("repo", path.alias("path"), "name").where("path <> ''").distinct()
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")  # noqa: E731 - order does not matter
    return rows.groupBy("repo", "path").agg(
        F.count_if(F.col("name").rlike(SHORT_NAME)).alias("short"),
        F.count("*").alias("names"),
        F.sha2(F.concat_ws(":", F.count("*"), total("name"), total(F.lit("b"), F.col("name"))), 256).alias("declared"),
    )


VIEWS = ("text", "declared")


def shared_subtrees(files: DataFrame, min_files: int = 2) -> DataFrame:
    """(repo, path) of files in subtrees that unrelated repositories have alike.

    ``files`` has (repo, path) and a leaf hash for each of ``VIEWS``, null where there is too
    little to tell. A folder's hash needs ``min_files`` files with a leaf below it.
    """
    level = F.size(F.split("path", "/"))
    leaf = [x for v in VIEWS for x in (F.col(v), F.col(v).isNotNull().cast("long").alias(f"{v}_n"))]
    rows = files.select("repo", "path", *leaf, F.lit(1).cast("long").alias("files"), level.alias("level"))
    top = rows.agg(F.max("level")).first()[0] or 0
    parent, name = F.regexp_replace("path", "/?[^/]*$", ""), F.regexp_extract("path", "[^/]*$", 0)
    found, below = [], None
    for at in range(top, 0, -1):
        here = rows.where(F.col("level") == at).drop("level")
        if below is not None:
            here = here.unionByName(below)
        found.append(here.withColumn("level", F.lit(at)))
        sums = []
        for v in VIEWS:
            part = lambda *c, v=v: F.sum(F.when(F.col(v).isNotNull(), F.xxhash64(*c, name, v).cast("decimal(38,0)"))).cast("string")
            sums += [F.when(F.count(v) > 0, F.sha2(F.concat_ws(":", F.count(v), part(), part(F.lit("b"))), 256)).alias(v), F.sum(f"{v}_n").alias(f"{v}_n")]
        below = here.groupBy("repo", parent.alias("path")).agg(*sums, F.sum("files").alias("files"))
        below = cut(below)  # or the plan of each level would hold those of all deeper ones
    if not found:
        return files.select("repo", "path").limit(0)
    trees = found[0]
    for more in found[1:]:
        trees = trees.unionByName(more)
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("hash"), F.col(f"{v}_n").alias("known")) for v in VIEWS])
    alike = trees.select("repo", "path", "files", F.inline(views)).where("hash is not null").where(((F.col("files") == 1) | (F.col("known") >= min_files)) & (2 * F.col("known") >= F.col("files")))
    # related repositories have the same tree as a whole
    roots = below.select("repo", F.inline(views)).select("repo", "view", F.col("hash").alias("root"))
    alike = cut(fragment_join(alike, roots, ["repo", "view"], F.col("path"), plan_fragments(alike, ["repo", "view"]), "left"))
    shared = cut(alike.groupBy("view", "hash").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1").select("view", "hash", "n"))
    if shared.isEmpty():
        return files.select("repo", "path").limit(0)
    # a content that very many repositories hold is spread over tasks
    copied = fragment_join(alike, shared.drop("n"), ["view", "hash"], F.struct("repo", "path"), plan_fragments(shared, ["view", "hash"], weight="n"), "left_semi")
    copied = copied.select("repo", F.col("path").alias("top")).distinct()
    # a file is copied if it or one of its folders is
    steps = F.transform(F.sequence(F.lit(1), level), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    above = files.select("repo", "path", F.explode(steps).alias("top"))
    inside = fragment_join(above, copied, ["repo", "top"], F.col("path"), plan_fragments(above, ["repo", "top"]), "left_semi")
    return inside.select("repo", "path").distinct()


def not_hand_written(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, id, path, reasons) of the file nodes with evidence; reasons in fixed order."""
    files = files_of(nodes)
    texts = text_evidence(docs).groupBy("repo", "path").agg(F.min("reason").alias("text_reason"), F.min("content").alias("content"))
    names = name_evidence(nodes)
    every = files.join(texts, ["repo", "path"], "left").join(names, ["repo", "path"], "left")
    short = (F.col("short") >= 2) & (F.col("short") >= 0.6 * F.col("names"))
    own = F.array(path_reason(F.col("path")), path_reason(F.col("name")), F.col("text_reason"), F.when(short, F.lit("minified")))
    every = every.select("repo", "id", "path", F.col("content").alias("text"), F.when(F.col("names") >= 4, F.col("declared")).alias("declared"), F.array_distinct(F.array_compact(own)).alias("own"))
    every = cut(every)
    copied = shared_subtrees(every.select("repo", "path", *VIEWS)).withColumn("copied", F.lit(True))
    reasons = F.array_union("own", F.when(F.col("copied"), F.array(F.lit("third-party"))).otherwise(F.array().cast("array<string>")))
    return every.join(copied, ["repo", "path"], "left").select("repo", "id", "path", reasons.alias("reasons")).where(F.size("reasons") > 0)
