"""Symbol ranges that nest, out of lines alone: a sweep of depth in each file, no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.symbols import DEFINITIONS, defined
from lodestone.plans.lineage import sound_unions

# Definitions of further languages; the name is group 1, the first pattern of a line wins.
MORE_DEFINITIONS = {
    "csharp": [r"^\s*(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|\s)+[\w<>\[\],\s\?]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?", r"^\s*(?:public|private|protected|internal|static|sealed|abstract|partial|\s)*(?:class|struct|interface|record)\s+([A-Za-z_]\w*)"],
    "php": [r"^\s*(?:public|private|protected|static|final|abstract|\s)*function\s+&?([A-Za-z_]\w*)\s*\(", r"^\s*(?:final\s+|abstract\s+)?(?:class|trait|interface)\s+([A-Za-z_]\w*)"],
    "rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+([A-Za-z_]\w*)", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"],
    "ruby": [r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", r"^\s*(?:class|module)\s+([A-Z]\w*)"],
}
BY_INDENT = ["python", "ruby"]
WORDED = [*BY_INDENT, "rust", "php", "go"]
# Words before a bracket that name no function.
CONTROL = ["if", "for", "foreach", "while", "switch", "catch", "return", "else", "do", "new", "throw", "sizeof", "using", "lock", "match", "await", "super", "this"]
#: Texts and comments of a line, which hold no braces of its code.
QUIET = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$|/\*.*?\*/|^\s*#.*$"""


def _braces(quiet: Column) -> Column:
    """The braces of a line without texts and comments that meet no other on it: closing ones, then opening ones."""
    out = F.regexp_replace(quiet, r"[^{}]", "")
    for _ in range(6):  # pairs go from the inside; what nests deeper on one line stays as it is
        out = F.replace(out, F.lit("{}"))
    return out


def _marks_of_braces(lines: DataFrame) -> DataFrame:
    """Definitions and ends of levels (path, level, line_no, last, name, open, n_lines) of files with braces; an end has no name.

    Files are dealt once; what lies ahead of a line is summed up on a sweep from the last line back.
    """
    quiet = F.regexp_replace("line", QUIET, "")
    call = ~F.col("language").isin(WORDED) & F.expr("ltrim(line) rlike '^[A-Za-z_$]\\\\w*\\\\s*\\\\('")
    name = F.when(F.col("language").isin(WORDED) | ~F.col("name").isin(CONTROL), F.col("name"))
    x = lines.select("path", "line_no", name.alias("name"), call.alias("call"), quiet.alias("quiet"))
    x = x.select("path", "line_no", "name", "call", _braces(F.col("quiet")).alias("b"), F.col("quiet").contains("{").alias("brace"), F.col("quiet").contains(";").alias("stop"))
    x = x.withColumn("down", F.length(F.replace("b", F.lit("{")))).withColumn("up", F.length("b") - F.col("down"))
    sweep = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("before", F.sum(F.col("up") - F.col("down")).over(sweep) - F.col("up") + F.col("down"))
    # a head goes on to the first line with a brace or a semicolon
    back = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    brace, stop = (F.min(F.when(F.col(c), F.col("line_no"))).over(back) for c in ("brace", "stop"))
    x = x.select("*", brace.alias("to_brace"), stop.alias("to_stop"), F.max("line_no").over(back).alias("n_lines"))
    bodied = F.coalesce(F.col("to_brace") <= F.coalesce("to_stop", "to_brace"), F.lit(False))
    level = F.col("before") - F.col("down")
    mark = "struct<level:bigint,last:int,name:string,open:boolean>"
    # a name with brackets and nothing before or behind is a call; languages with a word for functions need no such guess
    head = F.struct(level, F.lit(None), "name", bodied & ~(F.col("brace") & (F.length("b") == 0))).cast(mark)
    heads = F.when(F.col("name").isNotNull() & (bodied | ~F.col("call")), F.array(head)).otherwise(F.array().cast(f"array<{mark}>"))
    ends = F.when(F.col("down") > 0, F.transform(F.sequence(level, F.col("before") - 1), lambda v: F.struct(v, F.col("line_no"), F.lit(None), F.lit(None)).cast(mark))).otherwise(F.array().cast(f"array<{mark}>"))
    return x.select("path", "line_no", "n_lines", F.explode(F.concat(heads, ends)).alias("m")).select("path", "m.level", "line_no", "m.last", "m.name", "m.open", "n_lines")


def _closed_by_indent(lines: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by indent: a line ends the levels of its own indent and deeper that were open before it.

    The last line is the one before that is not blank, or the line itself where it is the word that closes.
    """
    sweep = Window.partitionBy("path").orderBy("line_no")
    x = lines.filter("trim(line) <> '' and not line rlike '^\\\\s*#'")
    x = x.withColumn("indent", F.length(F.regexp_extract("line", r"^\s*", 0)).cast("long"))
    x = x.withColumn("above", F.lag("indent").over(sweep)).withColumn("previous", F.lag("line_no").over(sweep))
    at = x.select("path", "line_no", F.col("indent").alias("level"))
    used = starts.join(at, ["path", "line_no"]).groupBy("path").agg(F.collect_set("level").alias("levels"))
    word = F.trim("line").rlike(r"^end\b") & (F.col("language") == "ruby")
    ended = F.filter("levels", lambda v: (v >= F.col("indent")) & (v <= F.col("above")))
    own = x.filter("above is not null").join(used, "path").select("path", F.explode(ended).alias("level"), "line_no", "indent", word.alias("word"), "previous")
    return at, own.select("path", "level", "line_no", F.when(F.col("word") & (F.col("level") == F.col("indent")), F.col("line_no")).otherwise(F.col("previous")).alias("last"))


def nested_ranges(lines: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, name, start_line, end_line) of every definition in lines (path, language, line_no, line), inner ones within outer ones.

    In languages with braces a range ends with the line that closes the level it was opened on, texts and comments of a line apart; a head that
    comes to a semicolon first has no body and is one line long; calls and control words are none. In Python and Ruby indent decides. What is never closed runs to the last line. A file is one task's window.
    """
    sound_unions(lines.sparkSession)
    lines = lines.withColumn("name", defined({**DEFINITIONS, **MORE_DEFINITIONS} if patterns is None else patterns))
    indented = F.col("language").isin(BY_INDENT)
    by_indent = lines.filter(indented)
    defs = by_indent.filter("name is not null").select("path", "name", "line_no")
    level, ends = _closed_by_indent(by_indent, defs)
    last = by_indent.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    none = F.lit(None)
    marks = defs.join(level, ["path", "line_no"]).select("path", "level", "line_no", none.cast("int").alias("last"), "name", F.lit(True).alias("open"))
    marks = marks.unionByName(ends.select("path", "level", "line_no", "last", none.cast("string").alias("name"), none.cast("boolean").alias("open")))
    later = Window.partitionBy("path", "level").orderBy(F.desc("line_no")).rangeBetween(Window.unboundedPreceding, -1)

    def found(marks: DataFrame) -> DataFrame:
        # from the last line back, so that what lies ahead is not gone through anew for every line
        return marks.withColumn("end", F.min(F.when(F.col("name").isNull(), F.struct("line_no", "last"))).over(later)).filter("name is not null")

    end = F.when(~F.col("open"), F.col("line_no")).otherwise(F.coalesce("end.last", "n_lines"))
    shown = [F.col("path"), F.col("name"), F.col("line_no").alias("start_line"), F.greatest("line_no", end).cast("int").alias("end_line")]
    return found(_marks_of_braces(lines.filter(~indented))).select(*shown).unionByName(found(marks).join(last, "path").select(*shown))
