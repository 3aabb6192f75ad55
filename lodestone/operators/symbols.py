"""Symbols, references and call edges of source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_$][\w$]*"
# Definitions by language; the name is group 1, the first pattern of a line wins.
DEFINITIONS = {
    "python": [r"^\s*def\s+([A-Za-z_]\w*)\s*\(", r"^\s*class\s+([A-Za-z_]\w*)\s*[\(:]"],
    "javascript": [
        r"^\s*function\s+([A-Za-z_$][\w$]*)\s*\(",
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
        r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(",
        r"^\s*class\s+([A-Za-z_$][\w$]*)",
    ],
    "java": [
        r"^\s*(?:public|private|protected|static|final|abstract|\s)+[\w<>\[\],\s]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?",
        r"^\s*(?:public|private|protected|\s)*class\s+([A-Za-z_]\w*)",
    ],
    "go": [r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", r"^\s*type\s+([A-Za-z_]\w*)\s+"],
    "c": [r"^[A-Za-z_][\w\s\*]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$"],
    "cpp": [r"^[A-Za-z_][\w\s\*:<>,&]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$", r"^\s*class\s+([A-Za-z_]\w*)"],
}
DEFINITIONS["typescript"] = [*DEFINITIONS["javascript"], r"^\s*(?:public|private|protected|\s)*([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*[:{]"]


def definitions(lines: DataFrame, patterns: dict[str, list[str]] = DEFINITIONS) -> DataFrame:
    """(path, name, start_line) from lines (path, language, line_no, line)."""
    return lines.withColumn("name", defined(patterns)).filter("name is not null").select("path", "name", F.col("line_no").alias("start_line"))


def defined(patterns: dict[str, list[str]]) -> Column:
    """The name that a line defines, or null."""
    name = F.lit(None).cast("string")
    for language, each in patterns.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in each])
        name = F.when(F.col("language") == language, found).otherwise(name)
    return name


def ranges(defs: DataFrame, files: DataFrame) -> DataFrame:
    """End of each symbol: the line before the next one, the last line for the last."""
    follow = F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line", "name"))
    return defs.withColumn("follow", follow).join(files.select("path", "n_lines"), "path").select("path", "name", "start_line", F.greatest("start_line", F.coalesce(F.col("follow") - 1, "n_lines")).cast("int").alias("end_line"))


def outline(lines: DataFrame) -> DataFrame:
    """One row for each file of lines (path, language, line_no, line): path, n_lines and its definitions (start_line, name), in one pass over the lines."""
    named = lines.select("path", "line_no", defined(DEFINITIONS).alias("name"))
    found = F.when(F.col("name").isNotNull(), F.struct(F.col("line_no").alias("start_line"), "name"))
    return named.groupBy("path").agg(F.max("line_no").alias("n_lines"), F.collect_list(found).alias("defs"))


def enclosing(points: DataFrame, symbols: DataFrame, span: int = 64) -> DataFrame:
    """Tightest symbol around each point (path, line_no), else the nearest that starts at most 3 lines below.

    Symbols are listed for every span of lines that they reach, so a point meets one row, however many symbols its file has and however many
    points share a line. Of equally tight symbols the first defined wins (then the least name).
    """
    last = F.greatest("start_line", "end_line")
    reach = symbols.select("path", "name", "start_line", "end_line", F.explode(F.sequence(F.floor((F.col("start_line") - 3) / span), F.floor(last / span))).alias("span_"))
    listed = reach.groupBy("path", "span_").agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("listed_"))
    at = F.col("line_no")

    def inside(s: Column) -> Column:
        return at.between(s["start_line"], s["end_line"])

    def order(s: Column) -> Column:
        size = F.when(inside(s), s["end_line"] - s["start_line"]).otherwise(s["start_line"] - at)
        return F.struct(F.when(inside(s), 0).otherwise(1).alias("k"), size.alias("size"), s["start_line"].alias("start"), s["name"].alias("name"))

    near = F.filter("listed_", lambda s: inside(s) | (s["start_line"] - at).between(1, 3))
    met = points.withColumn("span_", F.floor(at / span)).join(listed, ["path", "span_"], "left")
    return met.withColumn("symbol", F.array_min(F.transform(near, order))["name"]).select("path", "line_no", *[c for c in points.columns if c not in ("path", "line_no")], "symbol")


def tokens(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(IDENTIFIER), F.lit(0)))).alias("name"))


def file_references(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name): known symbol names that occur in a file."""
    return tokens(lines).select("path", "name").distinct().join(names.select("name").distinct(), "name", "left_semi")


def call_edges(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, caller): known names within a symbol's body, its own apart. Only tokens with a known name meet ranges."""
    known = tokens(lines).join(symbols.select("name").distinct(), "name", "left_semi").withColumnRenamed("name", "callee")
    s = symbols.select(F.col("path").alias("p"), F.col("name").alias("caller"), "start_line", "end_line")
    return known.join(s, (known.path == s.p) & known.line_no.between(s.start_line, s.end_line)).filter("callee <> caller").select("callee", "caller").distinct()
