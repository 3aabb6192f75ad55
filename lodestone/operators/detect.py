"""Line detectors: weights, rules, surface, injection attempts, secrets."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import DIGEST_LENGTHS, as_col

# Path parts and content that raise a file's priority.
PATH_HINTS = ["auth", "login", "session", "token", "password", "crypto", "secret", "api", "controller", "route", "handler", "endpoint", "rpc", "graphql", "admin", "upload", "deserial", "parse", "exec", "command", "query", "sql"]
RISKY_CONTENT = r"\b(eval|exec|system|popen|subprocess|pickle\.loads|os\.system|Runtime\.exec|deserialize|unserialize|yaml\.load|child_process)\b"
# Rules as (id, cwe, severity, pattern).
RULES = [
    ("DANGEROUS_EVAL", "CWE-95", "high", r"\b(?:eval|exec)\s*\("),
    ("OS_SYSTEM", "CWE-78", "high", r"\b(?:os\.system|subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True|Runtime\.getRuntime\(\)\.exec|child_process\.exec)\b"),
    ("PICKLE_LOADS", "CWE-502", "high", r"\bpickle\.loads?\s*\("),
    ("YAML_LOAD", "CWE-502", "high", r"\byaml\.load\s*\((?![^)]*Loader\s*=\s*yaml\.SafeLoader)"),
    ("WEAK_HASH", "CWE-327", "medium", r"\b(?:hashlib\.)?(?:md5|sha1)\s*\("),
    ("WEAK_CIPHER", "CWE-327", "medium", r"\b(?:DES|ARC4|ECB)\b"),
    ("INSECURE_RANDOM", "CWE-330", "low", r"\b(?:random\.(?:random|randint|choice)|Math\.random)\s*\("),
    ("TLS_VERIFY_OFF", "CWE-295", "high", r"(?i)verify\s*=\s*False|rejectUnauthorized\s*:\s*false|CURLOPT_SSL_VERIFYPEER\s*,\s*0"),
    ("DEBUG_TRUE", "CWE-489", "low", r"(?i)\bdebug\s*=\s*True\b|app\.debug\s*=\s*True"),
    ("HARDCODED_TMP", "CWE-377", "low", r"['\"](?:/tmp/|/var/tmp/)[^'\"]*['\"]"),
]
# Labelled patterns of a code surface, first match of a kind wins.
SURFACE = {
    "source": [
        ("http_route", r"@(?:app|router|blueprint)\.(?:route|get|post|put|delete|patch)\b|@(?:Get|Post|Put|Delete|Patch)Mapping\b|app\.(?:get|post|put|delete|patch)\s*\("),
        ("flask_request", r"\brequest\.(?:args|form|json|data|values|files|cookies)\b"),
        ("django_request", r"\brequest\.(?:GET|POST|FILES|body|COOKIES)\b"),
        ("express_req", r"\breq\.(?:params|query|body|headers|cookies)\b"),
        ("cli_args", r"\b(?:sys\.argv|argparse|os\.environ|process\.argv)\b"),
        ("deserialization", r"\b(?:pickle\.loads|yaml\.load|marshal\.loads|ObjectInputStream|unserialize|JSON\.parse)\b"),
        ("file_upload", r"\b(?:MultipartFile|FileUpload|request\.files|multer)\b"),
        ("message_consumer", r"\b(?:on_message|@KafkaListener|@RabbitListener|consume)\b"),
        ("rpc_handler", r"\b(?:grpc|@GrpcMethod|rpc\s+\w+)\b"),
    ],
    "sink": [
        ("command_exec", r"\b(?:os\.system|subprocess\.(?:run|call|Popen)|exec|eval|Runtime\.exec|child_process\.(?:exec|spawn)|popen)\b"),
        ("sql", r"\b(?:execute|executemany|cursor\.execute|createQuery|rawQuery|\.query\s*\()\b|SELECT\s.+\sFROM\s"),
        ("filesystem", r"\b(?:open|fopen|readFile|writeFile|os\.remove|Path\()\b"),
        ("network", r"\b(?:requests\.(?:get|post)|urllib|http\.client|fetch|axios|socket\.)\b"),
        ("template", r"\b(?:render_template_string|Template\(|innerHTML|dangerouslySetInnerHTML)\b"),
        ("crypto_weak", r"\b(?:md5|sha1|DES|ECB|Random\(\))\b"),
    ],
    "sanitizer": [("escape", r"\b(?:escape|sanitize|clean|bleach|htmlspecialchars|parameterize|quote|prepared)\b")],
}
# Attempts to steer a model, in order.
INJECTIONS = [
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions",
    r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)",
    r"(?i)you\s+are\s+now\s+(?:a|an)\s+\w+",
    r"(?i)\bsystem\s*prompt\b",
    r"(?i)report\s+no\s+(?:vulnerabilit|bug|issue|finding)",
    r"(?i)do\s+not\s+(?:report|flag|find)\s+(?:any\s+)?(?:vulnerabilit|bug|issue)",
    r"(?i)(?:always|must)\s+(?:say|respond|output|answer)\s+",
    r"(?i)\bact\s+as\b.*\b(?:dan|jailbreak|developer\s+mode)\b",
    r"(?i)end\s+of\s+(?:instructions|prompt)\b",
    r"(?i)</?(?:system|instructions|assistant)>",
]
# Secrets as (label, pattern, group that holds the value), in order.
SECRETS = [
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    ("aws_secret_key", r"\b(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])\b", 0),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", 0),
    ("generic_api_key", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b", 0),
    ("bearer_token", r"\b[Bb]earer\s+[A-Za-z0-9\-._~+/]{20,}=*", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0),
    ("password_assign", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[:=]\s*['\"]([^'\"]{6,})['\"]", 1),
    ("connection_string", r"\b(?:mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\s'\"]+", 0),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
]
# What a match of a pattern holds at least one of; a look-up is quicker than the pattern.
NEEDED = {"aws_access_key": ("AKIA", "ASIA"), "private_key": ("-----BEGIN ",), "generic_api_key": ("_live_", "_test_"), "bearer_token": ("earer",), "jwt": ("eyJ",), "password_assign": ("=", ":"), "connection_string": ("://",), "email": ("@",)}
# The same for rules, by pattern; looked up in lower case.
RULE_NEEDS = {p: needs for (_, _, _, p), needs in zip(RULES, [("eval", "exec"), ("os.system", "subprocess.", "getruntime", "child_process."), ("pickle.",), ("yaml.",), ("md5", "sha1"), ("des", "arc4", "ecb"), ("random",), ("verify", "rejectunauthorized"), ("debug",), ("/tmp/",)])}
TOKEN = r"[A-Za-z0-9/+=_\-]{20,}"
HEX = re.compile("[0-9A-Fa-f]+").fullmatch


def priority_weight(path: str | Column, text: str | Column) -> Column:
    low = F.lower(as_col(path))
    hinted = reduce(lambda c, h: c | low.contains(h), PATH_HINTS, F.lit(False))
    return F.lit(1.0) + F.when(hinted, 0.5).otherwise(0.0) + F.when(as_col(text).rlike(RISKY_CONTENT), 1.0).otherwise(0.0)


def stripped(line: str | Column) -> Column:
    return F.regexp_replace(as_col(line), r"^\s+|\s+$", "")


def rule_hits(lines: DataFrame, rules: list[tuple[str, str, str, str]] = RULES) -> DataFrame:
    """One row for each rule and line that match. Patterns are literals, so each is compiled once, and tried only where the line holds what it needs."""

    def fits(pattern: str) -> Column:
        needs = [F.lower("line").contains(x) for x in RULE_NEEDS.get(pattern, ())]
        return reduce(lambda a, b: a | b, needs) & F.col("line").rlike(pattern) if needs else F.col("line").rlike(pattern)

    hits = [F.when(fits(p), F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("cwe"), F.lit(s).alias("severity"))) for i, c, s, p in rules]
    found = lines.select("path", "line_no", "line", F.explode(F.array(*hits)).alias("hit")).filter("hit is not null")
    return found.select("path", "line_no", "hit.*", F.substring(stripped("line"), 1, 200).alias("snippet"))


def table_rule_hits(lines: DataFrame, rules: DataFrame, at_once: int = 1000) -> DataFrame:
    """The same for rules in a table (rule_id, pattern), copied to the lines ``at_once`` rules at a time."""
    rules = rules.select("rule_id", "pattern").distinct()
    rounds = max(1, -(-rules.count() // at_once))
    rules = rules.withColumn("round", F.ntile(rounds).over(Window.orderBy("rule_id", "pattern"))) if rounds > 1 else rules.withColumn("round", F.lit(1))
    hits = [lines.join(F.broadcast(rules.filter(F.col("round") == i + 1)), F.expr("line rlike pattern")) for i in range(rounds)]
    return reduce(DataFrame.unionByName, hits).select("path", "line_no", "rule_id", F.substring(stripped("line"), 1, 200).alias("snippet"))


def surface_hits(lines: DataFrame) -> DataFrame:
    """At most one hit for each line and kind: the first label that matches."""
    kinds = [F.struct(F.lit(kind).alias("kind"), F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(label)) for label, p in labels]).alias("label")) for kind, labels in SURFACE.items()]
    return lines.withColumn("hit", F.explode(F.array(*kinds))).filter("hit.label is not null").select("path", "line_no", "hit.kind", "hit.label")


def trust_boundary_files(hits: DataFrame) -> DataFrame:
    return hits.filter("kind in ('source', 'sink')").select("path").distinct()


def injection_hits(lines: DataFrame, most: int = 20) -> DataFrame:
    """First pattern of each line, for the first ``most`` hit lines of a text."""
    which = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(i)) for i, p in enumerate(INJECTIONS)])
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return lines.withColumn("pattern_index", which).filter("pattern_index is not null").withColumn("nth", nth).filter(F.col("nth") <= most).select("path", "line_no", "pattern_index", F.substring(stripped("line"), 1, 160).alias("snippet"))


@lru_cache(1 << 14)
def _share(count: int, n: int) -> float:
    return count / n * (math.log(count / n) / math.log(2.0))


def _bits(token: str) -> float:
    """Shannon entropy of the characters, as ``functions.text.entropy`` has it."""
    return -sum([_share(token.count(c), len(token)) for c in dict.fromkeys(token)])


def _mask(line: str, threshold: float) -> tuple[str, int]:
    """One line, pattern by pattern, with only the spans of values replaced."""
    n = 0

    def swap(m: re.Match, label: str, group: int, least: float) -> str:
        nonlocal n
        value = m[group]
        if len(value) in DIGEST_LENGTHS and HEX(value) or least and _bits(value) < least:
            return m[0]
        n += 1
        mark = f"<{label.upper()}_{hashlib.sha256(value.encode()).hexdigest()[:6]}>".ljust(len(value), "*")
        return m[0][: m.start(group) - m.start()] + mark + m[0][m.end(group) - m.start() :]

    for label, pattern, group in SECRETS:
        if not any(x in line for x in NEEDED.get(label, ("",))):
            continue
        line = re.sub(pattern, lambda m, label=label, group=group: swap(m, label, group, 0.0), line)
    return re.sub(TOKEN, lambda m: swap(m, "highentropy", 0, threshold), line), n


def masked(lines: DataFrame, threshold: float = 4.0) -> DataFrame:
    """The lines with secrets replaced by placeholders, and the number of replacements.

    Patterns are applied in order, then tokens of 20 characters or more whose entropy reaches ``threshold``. Digests
    stay. Only what a pattern matches is replaced: an equal text elsewhere in the line is judged by itself.
    """

    @F.pandas_udf("line string, n int")
    def replaced(suspects: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else _mask(x, threshold) for x in suspects], columns=["line", "n"]).astype({"n": "Int32"})

    # only lines that some pattern matches leave the JVM; as nondeterministic the function is not run once more for a filter on its result
    def may_hold(label: str, pattern: str) -> Column:
        looked_up = [F.col("line").contains(x) for x in NEEDED.get(label, ())]
        return (reduce(lambda a, b: a | b, looked_up) & F.col("line").rlike(pattern)) if looked_up else F.col("line").rlike(pattern)

    # the tokens of 20 characters come first: they take in what the pattern without a look-up matches
    suspect = reduce(lambda c, s: c | may_hold(s[0], s[1]), [s for s in SECRETS if s[0] in NEEDED], F.col("line").rlike(TOKEN))
    out = lines.withColumn("m", replaced.asNondeterministic()(F.when(suspect, F.col("line"))))
    return out.withColumn("masked", F.coalesce("m.line", "line")).withColumn("n_masked", F.coalesce("m.n", F.lit(0))).drop("m")


def sanitised(texts: DataFrame, mode: str = "redact", suffixes: tuple[str, ...] = (".env", ".pem", ".key")) -> DataFrame:
    """Texts (path, text; one row a path) as they may leave: path, text, n_masked, blocked.

    off: unchanged. Else files of a sensitive suffix are withheld, and lines are masked; block: a text with any secret is withheld.
    """
    if mode not in ("off", "redact", "block"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "off":
        return texts.select("path", "text", F.lit(0).cast("long").alias("n_masked"), F.lit(False).alias("blocked"))
    withheld = F.lit(False)
    for suffix in suffixes:
        withheld = withheld | F.lower("path").endswith(suffix)
    shut = F.lit(mode == "block")
    notice = F.concat(F.lit("[QUARANTINED — '"), "path", F.lit("' is a sensitive data file; contents withheld. A 'hardcoded secret/data file' finding is recorded locally.]"))
    out = texts.filter(withheld).select("path", notice.alias("text"), F.lit(0).cast("long").alias("n_masked"), shut.alias("blocked"))
    parts = F.split(F.coalesce("text", F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", -1)
    lines = masked(texts.filter(~withheld).select("path", F.posexplode(parts).alias("line_no", "line")))
    whole = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "masked"))).alias("l"), F.sum("n_masked").cast("long").alias("n_masked"))
    each = F.col("l.masked")
    # what follows the last line break is no line if it is empty
    each = F.when(F.element_at(each, -1) == "", F.slice(each, 1, F.size(each) - 1)).otherwise(each)
    stop = shut & (F.col("n_masked") > 0)
    blocked = F.concat(F.lit("[BLOCKED — content in '"), "path", F.lit("' tripped "), F.col("n_masked").cast("string"), F.lit(" sensitive-data detector(s); not transmitted.]"))
    return out.unionByName(whole.select("path", F.when(stop, blocked).otherwise(F.array_join(each, "\n")).alias("text"), "n_masked", stop.alias("blocked")))
