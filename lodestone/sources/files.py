"""Source trees and document tables as file and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import lines_of, n_lines_of

# Language and category by file name, and by suffix.
NAMES = {
    "dockerfile": ("dockerfile", "iac"),
    "docker-compose.yml": ("compose", "iac"),
    "docker-compose.yaml": ("compose", "iac"),
    "jenkinsfile": ("jenkins", "iac"),
    ".gitlab-ci.yml": ("gitlabci", "iac"),
    ".env": ("dotenv", "config"),
    ".env.local": ("dotenv", "config"),
    ".env.production": ("dotenv", "config"),
    ".env.prod": ("dotenv", "config"),
    ".env.development": ("dotenv", "config"),
    ".env.dev": ("dotenv", "config"),
    ".env.test": ("dotenv", "config"),
    ".npmrc": ("npmrc", "config"),
    ".netrc": ("netrc", "config"),
}
SUFFIXES = {
    ".py": ("python", "code"),
    ".js": ("javascript", "code"),
    ".jsx": ("javascript", "code"),
    ".ts": ("typescript", "code"),
    ".tsx": ("typescript", "code"),
    ".java": ("java", "code"),
    ".go": ("go", "code"),
    ".c": ("c", "code"),
    ".h": ("c", "code"),
    ".cc": ("cpp", "code"),
    ".cpp": ("cpp", "code"),
    ".cxx": ("cpp", "code"),
    ".hpp": ("cpp", "code"),
    ".cs": ("csharp", "code"),
    ".rb": ("ruby", "code"),
    ".php": ("php", "code"),
    ".rs": ("rust", "code"),
    ".tf": ("terraform", "iac"),
    ".tfvars": ("terraform", "iac"),
    ".yaml": ("yaml", "config"),
    ".yml": ("yaml", "config"),
    ".json": ("json", "config"),
    ".toml": ("toml", "config"),
    ".xml": ("xml", "config"),
    ".ini": ("ini", "config"),
    ".env": ("dotenv", "config"),
}


def classified(files: DataFrame) -> DataFrame:
    """language and category by name, then a ``dockerfile`` prefix, then suffix; else unknown code."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)

    def about(language: str, category: str) -> Column:
        return F.struct(F.lit(language).alias("language"), F.lit(category).alias("category"))

    def told(table: dict[str, tuple[str, str]], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), about(*v))]), key)

    known = F.coalesce(told(NAMES, name), F.when(name.startswith("dockerfile"), about("dockerfile", "iac")), told(SUFFIXES, suffix), about("unknown", "code"))
    return files.withColumn("about_", known).withColumn("language", F.col("about_.language")).withColumn("category", F.col("about_.category")).drop("about_")


def skip_by_name(categories: tuple[str, ...], languages: tuple[str, ...] | None = None, binary_suffixes: tuple[str, ...] = (), scan_unknown: bool = True) -> Column:
    """The first reason to skip a classified file that its name gives; null if none does.

    Unknown types are of no category or language that could be excluded; ``languages`` (all if None) concern code only.
    """
    suffix = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^.+(\.[^.]+)$", 1))
    known = F.col("language") != "unknown"
    reason = F.when(suffix.isin([x.lower() for x in binary_suffixes]), "binary_ext")
    if not scan_unknown:
        reason = reason.when(~known, "unsupported_type")
    reason = reason.when(known & ~F.col("category").isin(list(categories)), "category_excluded")
    if languages is not None:
        reason = reason.when(known & (F.col("category") == "code") & ~F.col("language").isin(list(languages)), "language_excluded")
    return reason


def discover(
    spark: SparkSession,
    root: str,
    max_bytes: int = 1 << 20,
    excluded: tuple[str, ...] = (".git", "node_modules", "__pycache__"),
    categories: tuple[str, ...] = ("code", "iac", "config"),
    languages: tuple[str, ...] | None = None,
    binary_suffixes: tuple[str, ...] = (),
    scan_unknown: bool = True,
) -> DataFrame:
    """Files under ``root`` with the first reason to skip them, and text, digest and size of those that stay.

    Names and listed lengths come first: the content of files over ``max_bytes`` is never read. Text is UTF-8 with
    replacement; a NUL byte in the first 8192 marks a binary. Reads through Spark, so any file system works; Spark itself
    does not list files whose names start with a dot or an underscore.
    """
    home = F.regexp_replace(F.lit(root), r"^[a-z]+:/*(?=/)|/+$", "")
    names = skip_by_name(categories, languages, binary_suffixes, scan_unknown)

    def named(f: DataFrame) -> DataFrame:
        f = f.withColumn("path", F.regexp_replace(F.expr("substring_index(path, ':', -1)"), "^/+", "/")).withColumn("path", F.regexp_replace(F.replace(F.col("path"), home, F.lit("")), "^/+", ""))
        parts = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
        return classified(f.filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded]))))

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    about = ["path", "language", "category", "length", "skip_reason"]
    left_out = named(listed.select("path", "length")).withColumn("skip_reason", F.coalesce(names, F.when(F.col("length") > max_bytes, "too_large"))).filter("skip_reason is not null")
    left_out = left_out.select(*about, F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("text"))
    # the filter on length reaches the reader, which then opens no larger file
    read = named(listed.filter(F.col("length") <= max_bytes).select("path", "length", "content")).filter(names.isNull())
    read = read.withColumn("skip_reason", F.when(F.contains(F.substring("content", 1, 8192), F.lit(b"\0")), "binary"))
    kept = F.col("skip_reason").isNull()
    read = read.select(*about, F.when(kept, F.sha2("content", 256)).alias("sha256"), F.when(kept, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return left_out.unionByName(read)


def with_line_counts(files: DataFrame) -> DataFrame:
    return files.withColumn("n_lines", n_lines_of("text"))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(path, line_no, line) from line 1 on, and the columns named."""
    return files.select("path", *keep, F.posexplode(lines_of("text")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def line_range(table: DataFrame, path: str, lo: int, hi: int) -> DataFrame:
    return table.filter((F.col("path") == path) & F.col("line_no").between(lo, hi)).orderBy("line_no")


def canonical_path(path: str) -> Column:
    """Forward slashes, no leading ``./`` or ``/``; null if a part is ``..``."""
    p = F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"/+(\./+)*", "/")
    p = F.regexp_replace(p, r"^(\./|/)+", "")
    return F.when(~F.array_contains(F.split(p, "/"), ".."), p)
