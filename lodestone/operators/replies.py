"""Structured content out of free-text replies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.replies import id_of  # noqa: F401 (part of this module's interface)
from lodestone.functions.scoring import confidence_of, lookup, severity_of
from lodestone.functions.text import as_col, hedged, squeezed
from lodestone.operators import detect, symbols
from lodestone.sources import files

# Failure classes in order, with what tells each: any of the alternatives, all words of one.
FAILURES = {
    "rate limited": [["throttl"], ["toomanyrequests"]],
    "access denied": [["accessdenied"], ["not authorized"], ["forbidden"]],
    "model not found": [["resource", "notfound"]],
    "parameter rejected": [["unsupported"], ["temperature"]],
    "invalid request": [["validationexception"], ["invalid"]],
    "timed out": [["timeout"], ["timed out"]],
    "unparseable reply": [["parse"]],
    "gateway auth rejected": [["unauthorized"], ["401"]],
    "network failure": [["connection"], ["urlerror"], ["dns"]],
}
# The same for why a judge gave no verdict, after the stop reasons that tell by themselves.
STOPS = {"retries_exhausted": "transport retries exhausted", "max_turns": "turn budget exhausted"}
JUDGE_FAILURES = {
    "rate limited": [["throttl"], ["toomanyrequests"], ["rate"]],
    "timed out": [["timeout"], ["timed out"]],
    "access denied": [["accessdenied"], ["unauthor"], ["forbidden"]],
    "request rejected by the model": [["validation"]],
}


def _first_class(text: Column, classes: dict[str, list[list[str]]], other: str) -> Column:
    out = F.lit(other)
    for kind, alternatives in reversed(classes.items()):
        hits = [reduce(lambda a, b: a & b, [text.contains(w) for w in words]) for words in alternatives]
        out = F.when(reduce(lambda a, b: a | b, hits), kind).otherwise(out)
    return out


def failure_kind(error: str | Column) -> Column:
    return _first_class(F.lower(F.coalesce(as_col(error), F.lit(""))), FAILURES, "other")


def judge_reason(stop_reason: str | Column, error: str | Column) -> Column:
    """Why a judge gave no verdict, in a few fixed words that hold nothing of the message."""
    told = _first_class(F.lower(F.coalesce(as_col(error), F.lit(""))), JUDGE_FAILURES, "model call failed")
    return lookup(as_col(stop_reason), STOPS, told)


def last_block(text: str, tag: str) -> Column:
    """Content of the last ``<tag>...</tag>`` of a text; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1))


def last_block_of_conversation(turns: DataFrame, tag: str) -> DataFrame:
    """(conv_id, turn, block): the block of the latest assistant turn that has one."""
    found = turns.filter("role = 'assistant'").withColumn("block", last_block("text", tag)).filter("block is not null")
    return found.groupBy("conv_id").agg(F.max(F.struct("turn", "block")).alias("x")).select("conv_id", "x.turn", "x.block")


def _containers(text: str) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of every JSON object or list within a text. Brackets in strings of a value don't count."""
    read = json.JSONDecoder().raw_decode
    for found in re.finditer(r"[\[{]", text):
        try:
            value, end = read(text, found.start())
        except (ValueError, RecursionError):
            continue
        yield found.start(), end, value


def _rank(value: object) -> int:
    """Lists of objects before objects and lists of lists before other containers."""
    each = value if isinstance(value, list) else []
    if each and all(isinstance(x, dict) for x in each):
        return 3
    return 2 if isinstance(value, dict) and value or each and all(isinstance(x, list) for x in each) else 1


def _value(text: str, most: int) -> object | None:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        last = sorted(_containers(text), key=lambda x: -x[1])[:most]
        return max(last, key=lambda x: (_rank(x[2]), x[0]))[2] if last else None


def json_of(text: str | None, most: int = 12) -> str | None:
    """The JSON value of a reply: of its fenced blocks from the last on, else of the whole text.

    A body that is JSON as a whole counts as such. Else, of the ``most`` last containers in it, the one of the best rank,
    and of equal ones the last to begin.
    """
    if not text:
        return None
    parts = text.split("```")
    fenced = [p.removeprefix("json") for p in parts[1:-1:2]][::-1]
    for body in [*fenced, text]:
        value = _value(body.strip(), most)
        if value is not None:
            return json.dumps(value, ensure_ascii=False)
    return None


#: Texts that can hold JSON: others never reach Python.
MAY_HOLD_JSON = r"""[\[{]|^\s*(?:["\d-]|true\s*$|false\s*$|NaN|Infinity)|```"""


def with_json(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``json``, the value of each reply as text, null without one. Scanning for it has no built-in form."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(json_of)

    return replies.withColumn("json", scan(F.when(F.col(text).rlike(MAY_HOLD_JSON), F.col(text))))


ENVELOPES = ["findings", "vulnerabilities", "vulns", "issues", "results", "items", "data"]
FINDING_KEYS = ["cited_snippet", "title", "description", "line_start", "severity"]


def unwrapped(text: str | None) -> dict:
    """The objects of a reply's JSON as texts, and shape_ok: could all of it be read?"""
    try:
        parsed = json.loads(text or "")
    except ValueError:
        return {"listed": [], "shape_ok": False}
    listed, ok = [], True
    if isinstance(parsed, list):
        listed = parsed[0] if len(parsed) == 1 and isinstance(parsed[0], list) else parsed
    elif isinstance(parsed, dict) and any(k in parsed for k in FINDING_KEYS):
        listed = [parsed]
    elif isinstance(parsed, dict):
        named = [parsed[k] for k in ENVELOPES if isinstance(parsed.get(k), list)]
        lists = [v for v in parsed.values() if isinstance(v, list)]
        listed = named[0] if named else lists[0] if len(lists) == 1 else []
        ok = bool(named) or len(lists) == 1 or not parsed
    else:
        ok = False
    return {"listed": [json.dumps(x, ensure_ascii=False) for x in listed if isinstance(x, dict)], "shape_ok": ok and all(isinstance(x, dict) for x in listed)}


def items(replies: DataFrame, schema: str) -> DataFrame:
    """One row for each object of a list, an envelope object, or a bare finding; adds pos, item and shape_ok.

    A reply without any keeps one row with null pos and item. shape_ok is false where some of a reply could not be read.
    """

    @F.pandas_udf("listed array<string>, shape_ok boolean")
    def unwrap(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unwrapped(t) for t in texts], columns=["listed", "shape_ok"])

    out = replies.withColumn("unwrapped", unwrap("json"))
    return out.select(*replies.columns, F.col("unwrapped.shape_ok").alias("shape_ok"), F.posexplode_outer("unwrapped.listed").alias("pos", "item")).withColumn("item", F.from_json("item", schema))


def located(claims: DataFrame, lines: DataFrame, slack: int = 2, span: int = 128) -> DataFrame:
    """Where a cited snippet really stands near its claimed range (claim_id, path, lo, hi, snippet): adds found_at, found_to.

    White space counts as one blank. The lines looked at are the range, as many as the snippet has, and ``slack`` more on
    both sides. found_at is the first line from which the snippet's number of lines holds it; if only all lines looked
    at together do, the claimed range stays. Null: not found, empty, or too generic. Lines are listed by spans of a file, so that
    every line and every snippet travels once; only a claim that reaches over the end of a span gathers its lines. Ranges
    that may be wider than a span are first cut to the file, however far a reply says they go.
    """
    body = detect.stripped("snippet")
    height = F.when(F.contains("snippet", F.lit("\n")), F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1).otherwise(1)
    told = F.struct(squeezed("snippet").alias("want"), height.alias("height"))
    a, b = F.least("lo", "hi").cast("long"), F.greatest("lo", "hi").cast("long")
    newlines = F.length("snippet") - F.length(F.replace(F.col("snippet"), F.lit("\n")))
    c = claims.select("claim_id", "path", a.alias("a"), b.alias("b"), "snippet", (F.greatest(b, a + newlines) - a > span).alias("wide"))
    last = lines.groupBy("path").agg(F.max("line_no").cast("long").alias("last"))
    c = c.filter("not wide").withColumn("last", F.lit(None).cast("long")).unionByName(c.filter("wide").join(last, "path"))
    # a generated row keeps what follows from working out the snippet's form again
    c = c.select("claim_id", "path", "a", "b", "last", F.explode(F.array(told)).alias("told")).select("claim_id", "path", "a", "b", "last", "told.*")
    c = c.filter((F.col("want") != "") & ~generic(F.col("want"))).withColumn("top", F.greatest(F.lit(1), F.col("a") - slack))
    c = c.withColumn("end", F.least(F.greatest("b", F.col("a") + F.col("height") - 1) + slack, "last")).filter(F.col("top") <= F.col("end")).drop("last")
    c = c.withColumn("several", F.floor(F.col("top") / span) < F.floor(F.col("end") / span)).withColumn("span_", F.explode(F.sequence(F.floor(F.col("top") / span), F.floor(F.col("end") / span))))
    # lines are squeezed one by one, once: joined by blanks they are their text squeezed, as a line end is white space too
    listed = lines.select("path", F.floor(F.col("line_no") / span).alias("span_"), F.struct("line_no", squeezed("line").alias("flat")).alias("x"))
    listed = listed.groupBy("path", "span_").agg(F.array_sort(F.collect_list("x")).alias("listed_"))
    # a line that holds a snippet of one line settles it; a word can stand nowhere else, other snippets may run over line ends: those look at all lines
    lone = F.col("height") == 1
    gathers = ~lone | F.contains("want", F.lit(" "))

    def holds(part: Column) -> Column:
        return F.contains(F.array_join(F.filter(part["flat"], lambda x: x != ""), " "), F.col("want"))

    starts = F.filter(F.sequence(F.lit(1), F.size("near")), lambda i: holds(F.slice("near", i, F.col("height"))))
    first = F.get("near", F.get(starts, F.lit(0)) - 1)["line_no"].cast("long")
    together = F.when(F.size("near") > 0, F.when(holds(F.col("near")), F.struct(F.when(~lone, first).alias("first"))))
    alone = F.when(lone, F.get(F.filter("near", lambda x: F.contains(x["flat"], F.col("want"))), F.lit(0))["line_no"].cast("long"))
    met = c.join(listed, ["path", "span_"]).withColumn("near", F.filter("listed_", lambda x: x["line_no"].between(F.col("top"), F.col("end")))).drop("listed_").withColumn("alone", alone)
    found = F.when(F.col("alone").isNotNull(), F.struct(F.col("alone").alias("first"))).when(~F.col("several") & gathers, together)
    kept = F.when(F.col("several") & gathers, F.struct("span_", "near"))
    # a name of its own: within functions of lists Spark would take a new column's name for the new one
    met = met.select("claim_id", "a", "b", "height", F.when(F.col("several") & gathers, F.col("want")).alias("sought"), "alone", found.alias("found"), kept.alias("kept"))
    met = met.groupBy("claim_id").agg(*[F.first(x).alias(x) for x in ("a", "b", "height")], F.first("sought").alias("want"), F.min("alone").alias("alone"), F.first("found", True).alias("found"), F.array_sort(F.collect_list("kept")).alias("kept"))
    met = met.withColumn("near", F.flatten(F.col("kept")["near"])).drop("kept")
    found = F.when(F.col("alone").isNotNull(), F.struct(F.col("alone").alias("first"))).otherwise(F.coalesce("found", together))
    at = met.select("claim_id", "a", "b", "height", F.explode(F.array(found)).alias("found")).filter("found is not null")
    at = at.select("claim_id", F.coalesce("found.first", "a").cast("int").alias("found_at"), F.coalesce(F.col("found.first") + F.col("height") - 1, "b").cast("int").alias("found_to"))
    return claims.join(at, "claim_id", "left")


def too_generic(snippet: str) -> Column:
    """A lone short word: an identifier, or letters and digits only."""
    return generic(squeezed(snippet))


def generic(flat: Column) -> Column:
    """The same of a text whose white space is squeezed."""
    return (F.length(flat) < 12) & flat.rlike(r"^(?:[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*|[\p{L}\p{N}]+)$")


def default_category(attack_class: str) -> Column:
    """The category of a finding that names none: its cell's class, unless that is open-ended."""
    given = F.coalesce(F.col(attack_class), F.lit(""))
    return F.when(given.isin("", "all") | given.contains(","), "novel/other").otherwise(given)


#: The fields that are read of a finding in a reply.
ITEM = "struct<file string, line_start string, line_end string, cited_snippet string, title string, description string, severity string, confidence string, category string, cwe string, remediation string>"


def cited_findings(items: DataFrame, lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings out of reply items (reply_id, pos, default_file, attack_class, item as ITEM) that prove their citation.

    The file's path is made canonical (else the default file's). A snippet is required and must stand near the
    claimed lines; the range becomes the lines where it does, and only then the enclosing symbol is looked up.
    """
    given = F.coalesce(F.nullif("item.file", F.lit("")), "default_file")
    f = items.filter("item is not null").select("reply_id", "pos", "attack_class", "default_file", given.alias("given"), "item")
    f = f.withColumn("path", F.coalesce(F.nullif(files.canonical_path("given"), F.lit("")), "default_file"))
    lo = F.coalesce(F.col("item.line_start").try_cast("int"), F.lit(0))
    f = f.withColumn("lo", lo).withColumn("hi", F.coalesce(F.col("item.line_end").try_cast("int"), "lo")).withColumn("snippet", F.coalesce("item.cited_snippet", F.lit(""))).withColumn("claim_id", F.struct("reply_id", "pos"))
    f = located(f, lines).filter("found_at is not null").withColumn("line_no", F.col("found_at"))
    f = symbols.enclosing(f, ranges)
    description = F.coalesce("item.description", F.lit(""))
    return f.select(
        "reply_id",
        "pos",
        F.col("path").alias("file_rel"),
        F.col("found_at").alias("line_start"),
        F.col("found_to").alias("line_end"),
        F.coalesce(F.nullif("item.category", F.lit("")), default_category("attack_class")).alias("category"),
        F.coalesce("item.title", F.lit("")).alias("title"),
        description.alias("description"),
        severity_of("item.severity").alias("severity"),
        confidence_of("item.confidence").alias("confidence"),
        F.col("item.cwe").alias("cwe"),
        hedged(description).alias("hedged"),
        F.col("snippet").alias("cited_snippet"),
        F.coalesce("symbol", F.lit("")).alias("symbol"),
        F.col("item.remediation").alias("remediation"),
    )


RESPONSE = """struct<choices array<struct<message struct<content string, tool_calls array<struct<function struct<name string, arguments string>>>>, finish_reason string>>,
usage struct<prompt_tokens bigint, completion_tokens bigint, prompt_tokens_details struct<cached_tokens bigint>>>"""


def normalised(responses: DataFrame, column: str = "json") -> DataFrame:
    """Text, tool names, stop reason and disjoint token counts of chat-completion responses."""
    r = responses.withColumn("r", F.from_json(column, RESPONSE))
    choice = F.get("r.choices", F.lit(0))
    cached = F.coalesce("r.usage.prompt_tokens_details.cached_tokens", F.lit(0))
    tools = F.coalesce(F.transform(choice["message"]["tool_calls"], lambda t: t["function"]["name"]), F.array().cast("array<string>"))
    reason = choice["finish_reason"]
    stop = F.when(reason == "length", "max_tokens").when(F.size(tools) > 0, "tool_use").otherwise("end_turn")
    fresh = F.greatest(F.lit(0), F.coalesce("r.usage.prompt_tokens", F.lit(0)) - cached)
    return r.withColumn("reply", F.coalesce(choice["message"]["content"], F.lit(""))).withColumn("tools", tools).withColumn("stop_reason", stop).withColumn("input_tokens", fresh).withColumn("cache_read_tokens", cached).withColumn("output_tokens", F.coalesce("r.usage.completion_tokens", F.lit(0))).drop("r")


CONVERSE = """struct<output struct<message struct<content array<struct<text string, toolUse struct<name string>>>>>, stopReason string,
usage struct<inputTokens bigint, outputTokens bigint, cacheReadInputTokens bigint, cacheWriteInputTokens bigint>>"""


def normalised_converse(responses: DataFrame, column: str = "json") -> DataFrame:
    """The same of responses whose content is a list of blocks: texts joined by lines, tools in order, tokens as they are counted there."""
    r = responses.withColumn("r", F.from_json(column, CONVERSE))
    blocks = F.coalesce("r.output.message.content", F.array())
    texts = F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"])
    tools = F.transform(F.filter(blocks, lambda b: b["text"].isNull() & b["toolUse"].isNotNull()), lambda b: F.coalesce(b["toolUse"]["name"], F.lit("")))
    counts = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadInputTokens", "cache_write_tokens": "cacheWriteInputTokens"}
    out = r.withColumn("reply", F.array_join(texts, "\n")).withColumn("tools", tools).withColumn("stop_reason", F.col("r.stopReason"))
    return out.withColumns({n: F.coalesce(f"r.usage.{c}", F.lit(0)) for n, c in counts.items()}).drop("r")


def action_of(text: str | None) -> dict | None:
    """First ``ACTION: name({...})`` of a reply: its tool, arguments and whether they were a whole JSON object."""
    found = re.search(r"ACTION:\s*([A-Za-z_]\w*)\s*\(\s*", text or "")
    if not found:
        return None
    try:
        args, _ = json.JSONDecoder().raw_decode(text, found.end())
    except ValueError:
        args = None
    ok = isinstance(args, dict)
    return {"tool": found[1], "args": json.dumps(args if ok else {}), "parse_ok": ok}


def with_actions(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``action`` (tool, args as JSON, parse_ok), null without one."""

    @F.pandas_udf("tool string, args string, parse_ok boolean")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([action_of(t) or {"tool": None, "args": None, "parse_ok": None} for t in texts], columns=["tool", "args", "parse_ok"])

    # only texts with the mark reach Python
    out = replies.withColumn("action", scan(F.when(F.col(text).contains("ACTION:"), F.col(text))))
    return out.withColumn("action", F.when(F.col("action.tool").isNotNull(), F.col("action")))
