"""Routes and parameters of handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Route patterns with the groups that hold verb and path, tried in this order.
DECORATOR = r"""(?i)@\w+\.(route|get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"](?:[^)]*methods\s*=\s*\[([^\]]*)\])?"""
SPRING = r"""(?i)@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?['"]([^'"]+)['"]"""
SPRING_METHOD = r"(?i)\bmethod\s*=\s*(\{[^}]*\}|[A-Za-z_.]+)"
EXPRESS = r"""(?i)\b(?:app|application|router|routes?|server|api|srv|bp|blueprint|r)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*['"](/[^'"]*)['"]"""
VERBS = r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
# Verbs, the most telling first.
PRIORITY = ["POST", "PUT", "PATCH", "DELETE", "GET", "HEAD", "OPTIONS"]
# Parameter accessors (name in group 1) and where they read from; the first that names a parameter wins.
PARAMETERS = [
    (r"""request\.args(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "query"),
    (r"""request\.form(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "body"),
    (r"""request\.values(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "query"),
    (r"""request\.cookies(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "cookie"),
    (r"""request\.GET(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "query"),
    (r"""request\.POST(?:\.get)?\s*[\(\[]\s*['"]([^'"]+)['"]""", "body"),
    (r"\breq\.query\.([A-Za-z_]\w*)", "query"),
    (r"\breq\.body\.([A-Za-z_]\w*)", "body"),
    (r"\breq\.params\.([A-Za-z_]\w*)", "path"),
    (r"@RequestParam(?:\([^)]*)?\s+\w+\s+([A-Za-z_]\w*)", "query"),
]
RAW_BODY = r"request\.data|request\.body|req\.rawBody"


def _best_verb(verbs: Column) -> Column:
    """The most telling of an array of verbs; GET for none."""
    upper = F.transform(verbs, F.upper)
    known = F.filter(F.array(*[F.lit(v) for v in PRIORITY]), lambda v: F.array_contains(upper, v))
    return F.coalesce(F.get(known, F.lit(0)), F.array_min(upper), F.lit("GET"))


def routes(symbols: DataFrame, lines: DataFrame, lookback: int = 4) -> DataFrame:
    """(path, name, start_line, method, route) of symbols with a route within ``lookback`` lines above, or on the line after."""
    near = lines.select(F.col("path").alias("p"), "line_no", "line")
    s = symbols.select("path", "name", "start_line")
    w = s.join(near, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("start_line") - lookback, F.col("start_line") + 1))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    w = w.groupBy("path", "name", "start_line").agg(F.array_join(ordered, "\n").alias("w"))

    def group(pattern: str, n: int) -> Column:
        return F.nullif(F.regexp_extract("w", pattern, n), F.lit(""))

    listed = F.regexp_extract_all(group(DECORATOR, 3), F.lit("['\"]([A-Za-z]+)['\"]"), F.lit(1))
    verb = F.upper(group(DECORATOR, 1))
    decorated = F.when(group(DECORATOR, 3).isNotNull(), _best_verb(listed)).when(verb == "ROUTE", "GET").otherwise(verb)
    kind = F.upper(group(SPRING, 1))
    spring = F.when(kind == "REQUEST", F.coalesce(_best_verb(F.regexp_extract_all(group(SPRING_METHOD, 1), F.lit(VERBS), F.lit(1))), F.lit("GET"))).otherwise(kind)
    method = F.when(group(DECORATOR, 2).isNotNull(), decorated).when(group(SPRING, 2).isNotNull(), spring).otherwise(F.upper(group(EXPRESS, 1)))
    route = F.coalesce(group(DECORATOR, 2), group(SPRING, 2), group(EXPRESS, 2))
    return w.withColumn("method", method).withColumn("route", route).filter("route is not null").drop("w")


def parameters(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, name, start_line, param, location) read in a symbol's body. Accessors are looked for within one line."""

    def named(i: int) -> Column:
        pattern, where = PARAMETERS[i]
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(i).alias("i"), n.alias("param"), F.lit(where).alias("location")))

    found = F.flatten(F.array(*[named(i) for i in range(len(PARAMETERS))]))
    read = lines.select(F.col("path").alias("p"), "line_no", F.explode(found).alias("x")).filter("x.param <> ''")
    s = symbols.select("path", "name", "start_line", "end_line")
    hits = s.join(read, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return hits.groupBy("path", "name", "start_line", F.col("x.param").alias("param")).agg(F.min_by("x.location", F.struct("x.i", "line_no")).alias("location"))


def raw_bodies(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols whose body reads the raw request body."""
    read = lines.filter(F.col("line").rlike(RAW_BODY)).select(F.col("path").alias("p"), "line_no")
    return symbols.join(read, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left_semi").select("path", "name", "start_line")
