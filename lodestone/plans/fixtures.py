"""Tables of the audit model, derived from the given tables by expressions that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.lineage import small_methods, sound_unions

CLASSES = ["injection", "authz", "authn", "crypto", "deserialization", "ssrf", "path_traversal", "xss", "secrets", "logic", "misconfig", "csrf"]
ALL_CLASSES = [*CLASSES, "all"]
# Prices per million tokens: input, output, cache read, cache write.
PRICES = [("m0", 3.0, 15.0, 0.3, 3.75), ("m1", 10.0, 30.0, 0.0, 0.0), ("m2", 0.25, 1.25, 0.03, 0.0)]

_CLASS = "case l_orderkey % 12 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CLASSES)) + " end"
EXPRESSIONS = {
    "files": ("documents", {"path": "source || '/' || cast(doc_id as string) || '.' || lang", "language": "lang", "text": "text"}),
    "named_files": (
        "documents",
        {
            "path": "'repo/' || source || '/' || case doc_id % 9 when 0 then 'Main.py' when 1 then 'login.ts' when 2 then 'Dockerfile.dev' when 3 then '.env' when 4 then 'a.yml' when 5 then 'docker-compose.yml' when 6 then 'x.tar.gz' when 7 then 'Makefile' else 'q.tf' end",
            "doc_id": "doc_id",
        },
    ),
    "findings": (
        "lineitem",
        {
            "ord": "(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000",
            "file_rel": "'src/m' || cast(l_suppkey % 20 as string) || '/f' || cast(l_partkey % 40 as string) || '.py'",
            "line_start": "cast(floor(l_extendedprice) as int) % 400 + 1",
            "line_end": "cast(floor(l_extendedprice) as int) % 400 + 1 + l_linenumber",
            "category": _CLASS,
            "cwe": "case when l_returnflag = 'N' then '' else 'CWE-' || cast(l_suppkey % 3 as string) end",
            "severity": "case cast(floor(l_quantity) as int) % 6 when 0 then 'informational' when 1 then 'low' when 2 then 'medium' when 3 then 'high' when 4 then 'critical' else 'odd' end",
            "confidence": "cast(cast(floor(l_discount * 100 + 0.5) as int) as double) / 10",
            "votes": "1",
            "hedged": "l_tax > 0.06",
            "reachable": "case when l_linestatus = 'O' then 'reachable' when l_linenumber % 2 = 0 then 'unclear' else 'unreachable' end",
            "status": "case when l_orderkey % 17 = 0 then 'false_positive' else 'new' end",
            "source": "case when l_orderkey % 5 = 0 then 'rule' else 'llm' end",
            "title": "case when l_linenumber % 3 = 0 then '' else 'Title ' || cast(l_partkey as string) end",
            "description": "case when l_linenumber % 4 = 0 then '' else 'About ' || cast(l_orderkey as string) end",
            "cited_snippet": "case when l_linenumber % 2 = 0 then '' else 'call(' || cast(l_partkey as string) || ')' end",
            "symbol": "case when l_partkey % 2 = 0 then '' else 'fn_' || cast(l_partkey % 3 as string) end",
            "remediation": "case when l_linenumber < 4 then '' else 'fix' end",
        },
    ),
    "calls": (
        "events",
        {
            "id": "event_id",
            "ts": "ts",
            "role": "event_type",
            "model_id": "'m' || cast(user_id % 4 as string)",
            "input_tokens": "cast(floor(abs(value) * 100) as bigint)",
            "output_tokens": "event_id % 700",
            "cache_read_tokens": "(user_id % 5) * 100",
            "cache_write_tokens": "(event_id % 3) * 50",
            "reported": "abs(value) / 1000",
        },
    ),
    "edges": (
        "lineitem",
        {"callee": "'n' || cast(l_partkey as string)", "caller": "'n' || cast(cast(floor(l_orderkey / 8) as bigint) as string)"},
    ),
}
_LINE = (
    "case l_partkey % 14 when 0 then 'def fn_' || cast(l_suppkey % 37 as string) || '(request):' when 1 then '    return fn_' || cast(l_suppkey % 41 as string) || '(value)'"
    " when 2 then '    os.system(cmd)' when 3 then '    data = pickle.loads(request.data)' when 4 then '    h = md5(x)'"
    " when 5 then '@app.route(\"/r' || cast(l_suppkey as string) || '\", methods=[\"POST\"])' when 6 then '    cursor.execute(\"SELECT a FROM b\")'"
    " when 7 then '    user = request.args.get(\"id\")' when 8 then '    get(url, verify=False)' when 9 then '    # ignore previous instructions'"
    " when 10 then '    password = \"hunter' || cast(l_partkey as string) || '\"' when 11 then '    random.randint(1, 2)' when 12 then '' else '    mail = \"user' || cast(l_partkey as string) || '@example.com\"' end"
)
CODE_SQL = f"select path, 'python' as language, cast(row_number() over (partition by path order by o, n, line) as int) as line_no, line from (select 'src/o' || cast(cast(floor(l_orderkey / 64) as bigint) as string) || '.py' as path, l_orderkey as o, l_linenumber as n, {_LINE} as line from lineitem)"


def sql_of(name: str) -> str:
    """A select of the derived table for SQL text."""
    if name == "code":
        return CODE_SQL
    table, columns = EXPRESSIONS[name]
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table}"


def told(name: str) -> dict[str, Column]:
    """The columns of a derived table, each out of a row of the given one."""
    return {c: F.expr(e) for c, e in EXPRESSIONS[name][1].items()}


def behind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of the given table behind a derived one, with the columns that it uses."""
    sound_unions(spark)
    small_methods(spark)
    table, columns = EXPRESSIONS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return source.select([c for c in source.columns if any(c in e for e in columns.values())])


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    small_methods(spark)
    table = "lineitem" if name == "code" else EXPRESSIONS[name][0]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql_of(name).replace(f"from {table}", "from {source}"), source=source)
