"""Names to nodes: imports, callees, types, documentation mentions, file owners, incremental scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.paths import extension, family, id_path
from graphloom.functions.text import is_camel_type
from graphloom.plans.iterate import written

#: What a relative import may stand for, the first that exists wins.
SUFFIXES = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", ".go")
#: Extensions of languages in which a bare call in a method may mean the method's own type.
IMPLICIT_SELF = ("swift", "kt", "kts", "java", "cs", "rb", "cc", "cpp", "cxx", "hpp", "hh", "hxx")
#: Names of built-in functions, which no single definition of the member takes over.
BUILTINS = (
    "append", "cap", "clear", "close", "complex", "copy", "delete", "error", "imag", "len", "log", "make", "max", "min", "new", "panic", "print", "printf", "println", "real", "recover", "require",
)


def fold_dots(path: Column) -> Column:
    """``.`` and ``..`` segments worked out; a path that leaves the root is null."""
    step = lambda acc, s: (
        F.when(acc.isNull(), acc)
        .when((s == "") | (s == "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, spec, target): relative import specs to files or modules, the first existing candidate wins.

    ``imports`` (repo, path, spec), ``files`` (repo, path).
    """
    base = fold_dots(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("spec")))
    rows = imports.where(F.col("spec").startswith(".")).distinct().select("repo", "path", "spec", base.alias("base")).where("base is not null")
    rows = rows.select("repo", "path", "spec", F.posexplode(F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(F.col("base"), s))).alias("o", "target"))
    hit = rows.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"])
    return hit.groupBy("repo", "path", "spec").agg(F.min_by("target", "o").alias("target"))


def receiver(node_id: Column) -> Column:
    """The type a method belongs to, from its id (``method:PATH#RECEIVER.NAME``); empty for others."""
    return F.regexp_extract(node_id, r"^method:.*#([^#(]+)\.[^.#(]*(?:\(.*)?$", 1)


def split_callee(callee: Column) -> tuple[Column, Column]:
    """Qualifier and member of a callee name, parted at the last ``::``, else at the last dot."""
    colons, dots = r"(?s)^(.*)::(.*)$", r"(?s)^(.*)\.(.*)$"
    part = lambda k, bare: F.when(callee.contains("::"), F.regexp_extract(callee, colons, k)).when(callee.contains("."), F.regexp_extract(callee, dots, k)).otherwise(bare)
    return part(1, F.lit("")), part(2, callee)


CALL = ["repo", "src_id", "callee"]


def resolve_callees(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, src_id, callee, id, tier, provenance): callee names to functions and methods of the same member.

    ``calls`` (repo, src_id, callee). Each tier is one equi-join of the calls that no earlier
    tier settled, so names that are defined in very many places meet only where file, folder,
    receiver or import agree. 1: a bare name in the same file; 1b: in the caller's own type,
    where the language allows it; 2: in the same folder; 3: in an imported file or folder,
    which must end with the qualifier if there is one; 3b: a method whose type is a segment
    of the qualifier; 4: a bare name, no built-in's, that only one definition, a function, has.
    Several candidates in tiers 1, 2 and 3 are decided by the caller's own type, then by the
    only function among them, or not at all. A call to itself gives no row.
    """
    qualifier, member = split_callee(F.col("callee"))
    src = calls.select(*CALL).where("repo is not null and src_id is not null and callee is not null").distinct()
    src = src.select(*CALL, qualifier.alias("qualifier"), member.alias("name"), F.coalesce(id_path(F.col("src_id")), F.lit("")).alias("p"), receiver(F.col("src_id")).alias("own"))
    defs = written(nodes.where("kind in ('function', 'method') and name <> ''").select("repo", "name", "id", "kind", F.coalesce(id_path(F.col("id")), F.lit("")).alias("q"), receiver(F.col("id")).alias("recv")))
    # calls of names that nothing in the member defines end here
    src = written(src.join(defs.select("repo", "name").distinct(), ["repo", "name"], "left_semi")).withColumn("self", F.when(extension(F.col("p")).isin(*IMPLICIT_SELF), F.col("own")).otherwise(""))

    def settle(found: DataFrame, tier: str, by_rules: bool = True) -> DataFrame:
        """(CALL, id, tier) of calls with candidates (CALL, self, id, kind, recv); id is null where they can't be told apart."""
        got = found.select(*CALL, "self", "id", "kind", "recv").distinct().groupBy(*CALL)
        same, function = (F.col("self") != "") & (F.col("recv") == F.col("self")), F.col("kind") == "function"
        got = got.agg(F.count("*").alias("n"), F.min("id").alias("one"), F.count_if(same).alias("ns"), F.min(F.when(same, F.col("id"))).alias("s"), F.count_if(function).alias("nf"), F.min(F.when(function, F.col("id"))).alias("f"))
        pick = F.when(F.col("n") == 1, F.col("one"))
        if by_rules:
            pick = pick.when(F.col("ns") == 1, F.col("s")).when(F.col("nf") == 1, F.col("f"))
        return written(got.select(*CALL, pick.alias("id"), F.lit(tier).alias("tier")))  # read by all later tiers

    rest = lambda left, done: left.join(done.select(*CALL), CALL, "left_anti")
    bare = src.where("qualifier = ''")
    one = settle(bare.join(defs.withColumn("p", F.col("q")), ["repo", "name", "p"]), "1")
    left = rest(bare, one)
    own = settle(left.where("self <> ''").join(defs.withColumn("self", F.col("recv")), ["repo", "name", "self"]), "1b", by_rules=False)
    left = rest(left, own)
    two = settle(left.withColumn("dir", folder(F.col("p"))).join(defs.withColumn("dir", folder(F.col("q"))), ["repo", "name", "dir"]), "2")
    left = rest(left, two).unionByName(src.where("qualifier <> ''"))

    # imports as keys: a relative one is a folder or file, another one ends with a folder
    trimmed = F.regexp_replace(F.trim("name"), "^[\"'`]+|[\"'`]+$", "")
    specs = nodes.where("kind = 'import' and name <> ''").select("repo", F.coalesce(id_path(F.col("id")), F.col("path")).alias("p"), trimmed.alias("imp")).where("imp <> ''").distinct()
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, F.size(F.split(c, "/"))), "/"))
    near = specs.where(F.col("imp").startswith(".")).select("repo", "p", F.lit("r").alias("way"), fold_dots(F.concat(folder(F.col("p")), F.lit("/"), "imp")).alias("key"))
    far = specs.where(~F.col("imp").startswith(".")).select("repo", "p", F.lit("a").alias("way"), F.explode(F.array_distinct(F.concat(tails(F.col("imp")), tails(F.replace(F.col("imp"), F.lit("."), F.lit("/")))))).alias("key"))
    reach = near.unionByName(far).where("key <> ''").distinct()
    places = F.array(F.struct(F.lit("a").alias("way"), folder(F.col("q")).alias("key")), *[F.struct(F.lit("r").alias("way"), k.alias("key")) for k in (folder(F.col("q")), F.regexp_replace("q", r"\.[^./]*$", ""), F.col("q"))])
    placed = defs.select("*", F.inline(F.array_distinct(places)))
    slashed = F.replace(F.replace(F.col("qualifier"), F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    fits = (F.col("qualifier") == "") | (F.col("key") == slashed) | F.col("key").endswith(F.concat(F.lit("/"), slashed))
    three = settle(left.join(reach, ["repo", "p"]).where(fits).join(placed, ["repo", "name", "way", "key"]), "3")
    left = rest(left, three)

    parts = F.filter(F.split("qualifier", "[.:]"), lambda x: x != "")
    named = F.transform(parts, lambda x, i: F.when(x.isin("self", "this"), F.lit("")).when(x == "Self", F.when(i == 0, F.col("own")).otherwise("")).otherwise(x))
    segments = F.when(F.col("qualifier").isin("self", "this", "Self"), F.array("own")).otherwise(named)
    of_type = left.where("qualifier <> ''").withColumn("recv", F.explode(F.array_distinct(segments))).where("recv <> ''")
    typed = settle(of_type.join(defs.where("kind = 'method'"), ["repo", "name", "recv"]), "3b", by_rules=False)
    only = defs.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("kind").alias("kind")).where("n = 1 and kind = 'function'").drop("n", "kind")
    last = left.where("qualifier = ''").where(~F.col("callee").isin(*BUILTINS)).join(only, ["repo", "name"]).select(*CALL, "id", F.lit("4").alias("tier"))

    out = one
    for more in (own, two, three, typed, last):
        out = out.unionByName(more)
    return out.where("id is not null and id <> src_id").withColumn("provenance", F.when(F.col("tier") == "1", "EXTRACTED").otherwise("INFERRED"))


def resolve_types(uses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, src_id, type_name, id, provenance): type names to the only declaration in the language family.

    ``uses`` (repo, src_id, type_name).
    """
    decl = nodes.where("kind = 'type' and name <> ''").select("repo", F.col("name").alias("type_name"), "id", family(id_path(F.col("id"))).alias("fam"))
    only = decl.groupBy("repo", "type_name", "fam").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    rows = uses.distinct().withColumn("fam", family(id_path(F.col("src_id"))))
    hit = rows.join(only, ["repo", "type_name", "fam"])
    return hit.select("repo", "src_id", "type_name", "id", F.when(id_path(F.col("src_id")) == id_path(F.col("id")), "EXTRACTED").otherwise("INFERRED").alias("provenance"))


#: How a document names a file, and a decision record.
PATH_WORD = r"(?:^|[\s(])([A-Za-z0-9_./-]+\.(?:go|ts|tsx|mts|cts|js|jsx|mjs|cjs|py|swift|md))"
ADR = r"(?i)\bADR[- ]?(\d+)\b"


def doc_mentions(docs: DataFrame) -> DataFrame:
    """(repo, path, line, how, mention) of Markdown texts: backtick spans, CamelCase words, file paths and ADR numbers.

    ``docs`` (repo, path, text).
    """
    lines = docs.select("repo", "path", F.posexplode(F.split("text", "\r?\n")).alias("i", "t"))
    find = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
    kinds = (("code", F.transform(find("`([^`]+)`"), lambda x: F.trim(x))), ("type", F.filter(find(r"\b([A-Z][A-Za-z0-9]+)\b"), is_camel_type)), ("path", find(PATH_WORD)), ("adr", find(ADR)))

    def said(how: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(F.lit(how).alias("how"), w.alias("mention")))

    every = F.concat(*[said(*k) for k in kinds])
    return lines.select("repo", "path", (F.col("i") + 1).alias("line"), F.inline(every)).where("mention <> ''")


def link_docs(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, path, id, line): what each document mentions in its own member; the first line counts.

    Code spans are an id, a file path, or a name that only one node (but placeholders, imports,
    documents and headings) has; CamelCase words the only type of that name; paths and ADR
    numbers (``docs/adr/N.md``) files that exist. A document does not mention itself.
    """
    first = mentions.groupBy("repo", "path", "how", "mention").agg(F.min("line").alias("line"))
    ids = nodes.select("repo", F.col("id").alias("mention"), "id")
    only = lambda rows: rows.where("name <> ''").groupBy("repo", F.col("name").alias("mention")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    named, types = only(nodes.where("kind not in ('symbol', 'import', 'doc', 'heading')")), only(nodes.where("kind = 'type'"))
    files = nodes.where(F.col("id").startswith("file:")).select("repo", F.expr("substr(id, 6)").alias("mention"), "id")
    key, shape = ["repo", "mention"], ["repo", "path", "how", "mention", "line", "id"]
    code = first.where("how = 'code'")
    by_id = code.join(ids, key).select(*shape)
    by_path = code.where(F.col("mention").contains("/")).join(files, key).select(*shape)
    settled = by_id.unionByName(by_path).select("repo", "path", "mention").distinct()
    by_name = code.join(settled, ["repo", "path", "mention"], "left_anti").join(named, key).select(*shape)
    by_type = first.where("how = 'type'").join(types, key).select(*shape)
    records = first.where("how in ('path', 'adr')").withColumn("mention", F.when(F.col("how") == "adr", F.concat(F.lit("docs/adr/"), "mention", F.lit(".md"))).otherwise(F.col("mention")))
    hit = by_id.unionByName(by_path).unionByName(by_name).unionByName(by_type).unionByName(records.join(files, key).select(*shape))
    hit = hit.where(F.col("id") != F.concat(F.lit("file:"), "path"))
    return hit.groupBy("repo", "path", "id").agg(F.min("line").alias("line"))


def camel_mentions(docs: DataFrame) -> DataFrame:
    """(repo, path, word, n): CamelCase words of the texts that look like type names."""
    words = docs.select("repo", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9]+)\b"), F.lit(1))).alias("word"))
    return words.where(is_camel_type(F.col("word"))).groupBy("repo", "path", "word").agg(F.count("*").alias("n"))


def file_owner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, owner): the file of each node: the path in its id, else that of the nearest node that contains it.

    Climbs level by level while anything is found, so circles end; of several containers the
    least path counts. Null where nothing above has a path.
    """
    own = nodes.where("kind not in ('symbol', 'import')").select("repo", "id", id_path(F.col("id")).alias("owner"))
    known = own.where("owner is not null")
    open_ = written(own.where("owner is null").select("repo", "id", "repo", F.col("id").alias("up")).toDF("repo", "id", "up_repo", "up").distinct())
    above = edges.where("edge_type = 'contains'").select(F.col("dst_repo").alias("up_repo"), F.col("dst_id").alias("up"), F.col("src_repo").alias("r2"), F.col("src_id").alias("i2")).distinct()
    seen = open_
    while not open_.isEmpty():
        step = written(open_.join(above, ["up_repo", "up"]).select("repo", "id", F.col("r2").alias("up_repo"), F.col("i2").alias("up")).distinct())
        hit = step.withColumn("owner", id_path(F.col("up"))).where("owner is not null").groupBy("repo", "id").agg(F.min("owner").alias("owner"))
        known = known.unionByName(hit)
        open_ = written(step.join(hit, ["repo", "id"], "left_anti").join(seen, ["repo", "id", "up_repo", "up"], "left_anti"))
        seen = seen.unionByName(open_)
    return own.select("repo", "id").join(known, ["repo", "id"], "left")


def scan_changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(repo, path, action): skip, replace, add or delete, from fingerprints (repo, path, sha256) before and now."""
    both = stored.withColumnRenamed("sha256", "old").join(scanned.withColumnRenamed("sha256", "new"), ["repo", "path"], "full")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "skip").otherwise("replace")
    return both.select("repo", "path", action.alias("action"))
