"""Registered queries of the audit engine, and the SQL each of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.operators import chunks, costs, detect, endpoints, findings, gate, graph, ledger, replies, symbols
from lodestone.plans.fixtures import ALL_CLASSES, EXPRESSIONS, PRICES, derived, sql_of
from lodestone.plans.lineage import kept, sound_unions
from lodestone.sources import documents, files, reports, sinks
from lodestone.streaming import spend

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parts of SQL text that several queries share.
LINES = "l as (select path, generate_subscripts(a, 1) as line_no, unnest(a) as line from (select path, string_split(case when ends_with(text, chr(10)) then text[:-2] else text end, chr(10)) as a from ({files}) where text <> ''))".replace("{files}", sql_of("files"))
N_LINES = "n as (select path, case when text = '' then 0 else len(string_split(case when ends_with(text, chr(10)) then text[:-2] else text end, chr(10))) end as n_lines from ({files}))".replace("{files}", sql_of("files"))
CODE = f"code as ({sql_of('code')})"
FOUND = f"f as ({sql_of('findings')})"
CALLS = f"calls as ({sql_of('calls')})"
TOKEN_OF = "case when symbol <> '' then 'sym:' || symbol else 'blk:' || cast(cast(floor(line_start / 25) as bigint) as varchar) end"
PRINT = f"sha256(file_rel || '|' || category || '|' || cwe || '|' || {TOKEN_OF})[1:16]"
PLACE = f"sha256(file_rel || '|' || category || '|' || {TOKEN_OF})[1:16]"
PRICED = (
    CALLS + ", prices(model_id, pi, po, pr, pw) as (values " + ", ".join(str(p) for p in PRICES) + "),"
    " c as (select calls.*, coalesce(input_tokens / 1e6 * pi, 0) + coalesce(output_tokens / 1e6 * po, 0) + coalesce(cache_read_tokens / 1e6 * case when pr > 0 then pr else pi end, 0)"
    " + coalesce(cache_write_tokens / 1e6 * case when pw > 0 then pw else pi end, 0) as cost from calls left join prices using (model_id))"
)


def document_files(spark, sf_dir):
    return derived(spark, sf_dir, "files")


def document_lines(spark, sf_dir):
    return files.lines(document_files(spark, sf_dir))


def calls_of(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "model_id string, p_input double, p_output double, p_cache_read double, p_cache_write double")
    return costs.priced(derived(spark, sf_dir, "calls"), prices)


def code_symbols(spark, sf_dir):
    """Lines, sizes and symbols of the code. Numbering the lines is the most work, so they are numbered once and kept."""
    code = kept(derived(spark, sf_dir, "code"))
    files = kept(symbols.outline(code))
    sizes = files.select("path", "n_lines")
    defs = files.select("path", F.explode("defs").alias("d")).select("path", "d.name", "d.start_line")
    return code, sizes, symbols.ranges(defs, sizes)


# ------------------------------------------------------------------ sources and predicates


@query(f"""
with x as (select doc_id, path, lower(regexp_extract(path, '[^/]*$')) as name from ({sql_of("named_files")})),
y as (select *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) as ext from x)
select doc_id, path,
 case when name = '.env' then 'dotenv' when name = 'docker-compose.yml' then 'compose' when starts_with(name, 'dockerfile') then 'dockerfile' when ext = '.py' then 'python' when ext = '.ts' then 'typescript' when ext = '.yml' then 'yaml' when ext = '.tf' then 'terraform' else 'unknown' end as language,
 case when name = '.env' then 'config' when name = 'docker-compose.yml' or starts_with(name, 'dockerfile') or ext = '.tf' then 'iac' when ext = '.yml' then 'config' else 'code' end as category from y""")
def s2_classified(spark, sf_dir):
    return files.classified(derived(spark, sf_dir, "named_files"))


@query(f"with {N_LINES} select n.path, n_lines, sha256(text) as sha256, cast(strlen(text) as bigint) as size from n join ({sql_of('files')}) f on f.path = n.path")
def s3_line_counts(spark, sf_dir):
    f = files.with_line_counts(document_files(spark, sf_dir))
    return f.select("path", "n_lines", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query(r"select page_id, regexp_replace(regexp_replace(url_decode(regexp_replace('file:' || regexp_extract(url, '://(.*)$', 1), '^file:(//[^/]*)?', '')), '\\', '/', 'g'), '^(\./|/)+', '') as file_rel from pages")
def s10_report_uris(spark, sf_dir):
    rest = F.regexp_extract("url", "://(.*)$", 1)
    p = given(spark, sf_dir, "pages").withColumn("uri", F.concat(F.lit("file:"), rest))
    return p.select("page_id", reports.sarif_uri("uri").alias("file_rel"))


@query(f"select path, 1.0::double + case when regexp_matches(lower(path), '{'|'.join(detect.PATH_HINTS)}') then 0.5 else 0 end + case when regexp_matches(text, '{detect.RISKY_CONTENT}') then 1.0 else 0 end::double as weight from ({sql_of('files')})")
def p1_priority_weight(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", detect.priority_weight("path", "text").cast("double").alias("weight"))


def _rule_sql() -> str:
    each = [f"select path, line_no, '{i}' as rule_id, '{c}' as cwe, '{s}' as severity, trim(line)[1:200] as snippet from code where regexp_matches(line, '{p.replace(chr(39), chr(39) * 2).split('(?![')[0]}')" for i, c, s, p in detect.RULES]
    return f"with {CODE} " + " union all ".join(each)


@query(_rule_sql())
def p3_rule_hits(spark, sf_dir):
    return detect.rule_hits(derived(spark, sf_dir, "code"))


def _surface_sql() -> str:
    each = []
    for kind, labels in detect.SURFACE.items():
        case = " ".join(f"when regexp_matches(line, '{p}') then '{label}'" for label, p in labels)
        each.append(f"select path, line_no, '{kind}' as kind, case {case} end as label from code")
    return f"with {CODE} select * from (" + " union all ".join(each) + ") where label is not null"


@query(_surface_sql())
def p5_surface_hits(spark, sf_dir):
    return detect.surface_hits(derived(spark, sf_dir, "code"))


@query(f"select distinct path from ({_surface_sql()}) where kind in ('source', 'sink')")
def p6_trust_boundaries(spark, sf_dir):
    return detect.trust_boundary_files(p5_surface_hits(spark, sf_dir))


@query(f"with {CODE}, h as (select path, line_no, 0 as pattern_index, trim(line)[1:160] as snippet, row_number() over (partition by path order by line_no) as nth from code where regexp_matches(line, 'ignore\\s+(?:all\\s+)?(?:previous|prior|above)\\s+instructions')) select path, line_no, pattern_index, snippet from h where nth <= 20")
def p7_injection_hits(spark, sf_dir):
    return detect.injection_hits(derived(spark, sf_dir, "code"))


@query("select doc_id, regexp_matches(lower(text), '" + "|".join(text.HEDGES) + "') as hedged from documents")
def p8_hedged(spark, sf_dir):
    return given(spark, sf_dir, "documents").select("doc_id", text.hedged("text").alias("hedged"))


@query(f"with {LINES} select path, line_no, trim(line)[1:80] as snippet from l where regexp_matches(line, 'token\\s*=') order by path, line_no limit 50")
def p12_search(spark, sf_dir):
    return document_lines(spark, sf_dir).filter(F.col("line").rlike(r"token\s*=")).orderBy("path", "line_no").limit(50).select("path", "line_no", F.substring(detect.stripped("line"), 1, 80).alias("snippet"))


@query(r"""
with t as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9/+=_\-]{20,}')) as token from documents),
c as (select token, count(*) as n, len(token) as size from (select token, unnest(string_split(token, '')) as ch from t) group by token, ch)
select token, round(-sum(n / size * log2(n / size)), 6) + 0.0 as entropy, len(token) in (32, 40, 56, 64, 96, 128) and regexp_matches(token, '^[0-9A-Fa-f]+$') as digest from c group by token""")
def f1_token_entropy(spark, sf_dir):
    t = given(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(detect.TOKEN), F.lit(0))).alias("token")).distinct()
    return t.select("token", F.round(text.entropy("token"), 6).alias("entropy"), text.is_digest("token").alias("digest"))


@query(rf"""
with {CODE}, v as (select *, case when line like '%password%' then regexp_extract(line, '"(.*)"', 1) when line like '%mail%' then regexp_extract(line, '"(.*)"', 1) else '' end as value from code),
p as (select *, case when value = '' then '' else '<' || case when line like '%password%' then 'PASSWORD_ASSIGN' else 'EMAIL' end || '_' || sha256(value)[1:6] || '>' end as base from v)
select path, line_no, case when value = '' then line else replace(line, value, rpad(base, cast(greatest(len(base), len(value)) as int), '*')) end as masked, cast(value <> '' as int) as n_masked from p""")
def f3_masked_lines(spark, sf_dir):
    return detect.masked(derived(spark, sf_dir, "code")).select("path", "line_no", "masked", "n_masked")


@query("select doc_id, case when s = '' then 'finding' else s end as slug from (select doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] as s from documents)")
def f39_slugs(spark, sf_dir):
    return given(spark, sf_dir, "documents").select("doc_id", text.slug("text", F.lit("")).alias("slug"))


# ------------------------------------------------------------------------ chunks and cells

CHUNKS = f"{N_LINES}, w as (select path, n_lines, unnest(range(0, case when n_lines <= 40 then 1 else cast(ceil((n_lines - 40) / 32.0) as int) + 1 end)) as w from n where n_lines > 0), ch as (select path, w as chunk_index, cast(w * 32 + 1 as int) as start_line, cast(least(n_lines, w * 32 + 40) as int) as end_line from w)"


@query(f"with {CHUNKS} select path, cast(chunk_index as int) as chunk_index, start_line, end_line from ch")
def f8_fixed_chunks(spark, sf_dir):
    return chunks.fixed_chunks(files.with_line_counts(document_files(spark, sf_dir)), 40, 8)


@query(f"with {CHUNKS}, x as (select n.path, coalesce(chunk_index, 0) as chunk_index from n left join ch on ch.path = n.path) select attack_class, count(*) as n_cells, count(distinct path) as n_files from x, (select unnest({ALL_CLASSES}) as attack_class) group by attack_class")
def j1_cells(spark, sf_dir):
    f = files.with_line_counts(document_files(spark, sf_dir))
    return chunks.cells(chunks.fixed_chunks(f, 40, 8), f, ALL_CLASSES).groupBy("attack_class").agg(F.count("*").alias("n_cells"), F.countDistinct("path").alias("n_files"))


@query(f"with {CHUNKS}, k as (select sum(greatest(1, c)) * {len(ALL_CLASSES)} as k from (select n.path, count(ch.path) as c from n left join ch on ch.path = n.path group by n.path)), y as (select cast(k as bigint) as n_cells, cast(k + floor(k * 0.1 * 2) as bigint) as calls from k) select n_cells, calls, calls * 6000 as tokens, round(calls * 6000 * 0.85 / 1e6 * 3.0 + calls * 6000 * 0.15 / 1e6 * 15.0, 2) as cost, round(n_cells * 8.0 / 8 / 60, 1) as minutes from y")
def a18_dry_run_projection(spark, sf_dir):
    f = files.with_line_counts(document_files(spark, sf_dir))
    n = chunks.cells(chunks.fixed_chunks(f, 40, 8), f, ALL_CLASSES).agg(F.count("*").alias("n_cells"))
    return costs.projection(n, 3.0, 15.0)


# ------------------------------------------------------------------------ symbols and graph

SYMBOLS = rf"""{CODE}, sizes as (select path, max(line_no) as n_lines from code group by path),
d as (select path, regexp_extract(line, '^\s*def\s+([A-Za-z_]\w*)\s*\(', 1) as name, line_no as start_line from code where regexp_matches(line, '^\s*def\s+([A-Za-z_]\w*)\s*\(')),
s as (select d.path, name, start_line, cast(greatest(start_line, coalesce(lead(start_line) over (partition by d.path order by start_line, name) - 1, n_lines)) as int) as end_line from d join sizes on sizes.path = d.path)"""
BODY_TOKENS = r"t as (select distinct path, line_no, unnest(regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*')) as name from code)"


@query(f"with {SYMBOLS} select * from s")
def f11_w1_symbols(spark, sf_dir):
    return code_symbols(spark, sf_dir)[2]


@query(f"""with {SYMBOLS}, p as (select distinct path, line_no from code where line like '%request%'),
j as (select p.path, p.line_no, s.name, case when p.line_no between start_line and end_line then 0 else 1 end as k, case when p.line_no between start_line and end_line then end_line - start_line else start_line - p.line_no end as g, start_line
 from p join s on s.path = p.path and (p.line_no between start_line and end_line or start_line - p.line_no between 1 and 3)),
r as (select *, row_number() over (partition by path, line_no order by k, g, start_line, name) as nth from j)
select p.path, p.line_no, r.name as symbol from p left join r on r.path = p.path and r.line_no = p.line_no and nth = 1""")
def j5_enclosing_symbols(spark, sf_dir):
    code, _, ranges = code_symbols(spark, sf_dir)
    return symbols.enclosing(code.filter("line like '%request%'").select("path", "line_no"), ranges)


@query(f"with {SYMBOLS}, {BODY_TOKENS} select distinct t.path, t.name from t where name in (select name from s)")
def j10_file_references(spark, sf_dir):
    code, _, ranges = code_symbols(spark, sf_dir)
    return symbols.file_references(code, ranges).select("path", "name")


@query(f"with {SYMBOLS}, {BODY_TOKENS} select distinct t.name as callee, s.name as caller from t join s on s.path = t.path and t.line_no between s.start_line and s.end_line where t.name in (select name from s) and t.name <> s.name")
def j11_call_edges(spark, sf_dir):
    code, _, ranges = code_symbols(spark, sf_dir)
    return symbols.call_edges(code, ranges)


@query(f"""with {SYMBOLS}, r as (select s.path, start_line as a, end_line as b, n_lines from s join sizes on sizes.path = s.path),
c as (select *, greatest(1, coalesce(max(b + 1) over (partition by path order by a, b rows between unbounded preceding and 1 preceding), 1)) as cur from r),
k as (select * from c where b >= cur),
seg as (select path, greatest(a, cur) as lo, b as hi from k union all select path, cur, a - 1 from k where a > cur
 union all select sizes.path, coalesce(max(b), 0) + 1, sizes.n_lines from sizes left join k on k.path = sizes.path group by sizes.path, sizes.n_lines having coalesce(max(b), 0) < sizes.n_lines),
w as (select path, lo, hi, unnest(range(0, case when hi - lo + 1 <= 12 then 1 else cast(ceil((hi - lo + 1 - 12) / 9.0) as int) + 1 end)) as w from seg)
select path, cast(row_number() over (partition by path order by lo + w * 9, least(hi, lo + w * 9 + 11)) - 1 as int) as chunk_index, cast(lo + w * 9 as int) as start_line, cast(least(hi, lo + w * 9 + 11) as int) as end_line from w""")
def f9_w2_symbol_chunks(spark, sf_dir):
    _, sizes, ranges = code_symbols(spark, sf_dir)
    return chunks.symbol_chunks(sizes, ranges, 12, 3)


@query(f"""with recursive e as (select distinct callee, caller from ({sql_of("edges")}) where callee <> caller), r(name, d) as (select * from (values ('n1', 0), ('n2', 0)) union select e.callee, d + 1 from e join r on e.caller = r.name where d < 25),
names as (select callee as name from e union select caller from e)
select name, case when name in (select name from r) then 'reachable' when name not in (select callee from e) then 'unreachable' else 'unclear' end as verdict from names""")
def g4_reachability(spark, sf_dir):
    edges = derived(spark, sf_dir, "edges").filter("callee <> caller")
    names = kept(edges.select(F.explode(F.array("callee", "caller")).alias("name")).distinct())
    return graph.verdicts(names, edges, names.filter("name in ('n1', 'n2')"))


@query(f"""with recursive e as (select distinct callee, caller from ({sql_of("edges")}) where callee <> caller), narrow as (select * from e where callee in (select callee from e group by callee having count(*) <= 200)),
held as (select distinct callee as name from e where cast(callee[2:] as bigint) % 50 = 0),
d(name, depth) as (select name, 0 from held union select n.callee, depth + 1 from narrow n join d on n.caller = d.name where depth < 16), m as (select name, min(depth) as depth from d group by name),
nx as (select n.callee as name, min(n.caller) as via from narrow n join m a on a.name = n.callee join m b on b.name = n.caller and b.depth = a.depth - 1 group by n.callee),
walk(name, place) as (select name, name from m union all select walk.name, nx.via from walk join nx on nx.name = walk.place)
select w.name, '/' || w.place as route, m.depth from walk w join held h on h.name = w.place join m on m.name = w.name where w.name in (select callee from e)""")
def g6_nearest_routes(spark, sf_dir):
    """Routes at the names whose number 50 divides."""
    edges = derived(spark, sf_dir, "edges").filter("callee <> caller").distinct()
    names = edges.select(F.col("callee").alias("name")).distinct()
    routes = names.filter("cast(substring(name, 2) as bigint) % 50 = 0").withColumn("route", F.concat(F.lit("/"), "name"))
    return graph.nearest_routes(names, edges, routes)


# --------------------------------------------------------------------------------- findings


TIES = ", ".join(findings.TIES)


def _merge_sql(key: str) -> str:
    return f"""with {FOUND}, k as (select *, {key} as key, {PRINT} as print, row(ord, {TIES}) as place, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end as r from f),
b as (select *, coalesce(r > max(r) over (partition by key order by ord, {TIES} rows between unbounded preceding and 1 preceding), true) as raises from k)
select key, min(ord) as ord, arg_min(file_rel, place) as file_rel, arg_min(line_start, place) as line_start, arg_min(category, place) as category, cast(sum(votes) as int) as votes, arg_min(severity, (-r, place)) as severity,
coalesce(arg_max(title, place) filter (where raises and title <> ''), '') as title, max(confidence) as confidence, case when bool_or(reachable = 'reachable') then 'reachable' else arg_min(reachable, place) end as reachable,
coalesce(arg_min(cited_snippet, place) filter (where cited_snippet <> ''), '') as cited_snippet, coalesce(arg_min(cwe, place) filter (where cwe <> ''), '') as cwe, coalesce(arg_min(symbol, place) filter (where symbol <> ''), '') as symbol, string_agg('e' || ord, ',' order by ord) as evidence,
list_sort(list_filter(list_distinct(list(print)), lambda x: x <> arg_min_print)) as superseded from (select *, first_value(print) over (partition by key order by ord, {TIES}) as arg_min_print from b) group by key, arg_min_print"""


MERGED = ["key", "ord", "file_rel", "line_start", "category", "votes", "severity", "title", "confidence", "reachable", "cited_snippet", "cwe", "symbol", "superseded"]


def _findings(spark, sf_dir):
    return derived(spark, sf_dir, "findings").withColumn("evidence", F.array(F.concat(F.lit("e"), F.col("ord").cast("string"))))


@query(_merge_sql(PRINT))
def a2_merge_by_fingerprint(spark, sf_dir):
    return findings.merge_findings(_findings(spark, sf_dir)).select(*MERGED, F.array_join("evidence", ",").alias("evidence"))


@query(_merge_sql(PLACE))
def a3_merge_by_location(spark, sf_dir):
    return findings.merge_by_location(_findings(spark, sf_dir)).select(*MERGED, F.array_join("evidence", ",").alias("evidence"))


@query("""with v as (select doc_id as id, (doc_id % 10) / 10.0 as prior, case when x = 0 then quality = 1 when x = 1 then toxic = 0 else doc_id % 3 = 0 end as yes, x <> 2 or doc_id % 4 <> 0 as voted, case when x = doc_id % 3 then 'reachable' when x = 1 then 'unclear' else 'unreachable' end as reach from labels, (select unnest([0, 1, 2]) as x)),
t as (select id, cast(max(prior) as double) as p, count(*) filter (where voted and yes) as c, count(*) filter (where voted and not yes) as r, count(*) filter (where voted) as n from v group by id),
m as (select id, reach, row_number() over (partition by id order by count(*) desc, reach) as nth from v where voted group by id, reach)
select t.id, case when c >= 2 then 'confirmed' when r >= 2 then 'false_positive' else 'new' end as status, round(case when c >= 2 then greatest(p, least(1.0, 0.5 + 0.15 * c)) when r >= 2 then greatest(0, p - 0.4) when n < 2 then p else greatest(0.1, least(p, 0.2 + 0.1 * c)) end, 4) as confidence, c as votes, m.reach as reachable from t join m on m.id = t.id and nth = 1""")
def a5_a6_judge_quorum(spark, sf_dir):
    v = given(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("x"))
    yes = F.when(F.col("x") == 0, F.col("quality") == 1).when(F.col("x") == 1, F.col("toxic") == 0).otherwise(F.col("doc_id") % 3 == 0)
    reach = F.when(F.col("x") == F.col("doc_id") % 3, "reachable").when(F.col("x") == 1, "unclear").otherwise("unreachable")
    v = v.select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 10) / 10.0).alias("prior"), F.when(yes, "confirmed").otherwise("rejected").alias("verdict"), reach.alias("reachable"), ((F.col("x") != 2) | (F.col("doc_id") % 4 != 0)).alias("voted"))
    return findings.judged(v, 2, 3).withColumn("confidence", F.round("confidence", 4))


@query(f"""with {FOUND}, m(category, c, o) as (values {", ".join(str((k, *v)) for k, v in scoring.CATEGORIES.items())}),
x as (select f.*, case when cwe = '' then m.c else cwe end as cwe2, m.o, case severity when 'critical' then 0.95 when 'high' then 0.75 when 'medium' then 0.5 when 'low' then 0.15 when 'informational' then 0.1 else 0.05 end * case reachable when 'reachable' then 1.0 when 'unclear' then 0.7 else 0.4 end as s from f join m on m.category = f.category)
select ord, cwe2 as cwe, o as owasp, case when reachable = 'unreachable' or severity = 'informational' then 'informational' when s >= 0.85 then 'critical' when s >= 0.65 then 'high' when s >= 0.4 then 'medium' when s >= 0.05 then 'low' else 'informational' end as severity,
round(greatest(0, least(1, confidence - case when hedged then 0.2 else 0 end)), 4) as confidence from x""")
def f17_f19_enriched(spark, sf_dir):
    e = findings.enriched(derived(spark, sf_dir, "findings"))
    return e.select("ord", "cwe", "owasp", "severity", F.round("confidence", 4).alias("confidence"))


@query(f"with {FOUND} select ord, source = 'llm' and case severity when 'informational' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 2 end < 2 as skip from f")
def p10_severity_gate(spark, sf_dir):
    return gate.skip_validation(derived(spark, sf_dir, "findings"), "medium").select("ord", "skip")


GATES = f"""{FOUND}, g as (select ord, severity, status, {PRINT} as fingerprint from f),
quiet as (select fingerprint from (select fingerprint, ord, row_number() over (partition by fingerprint order by ord desc) as nth from g where ord % 11 = 0) where nth = 1 and (ord % 2 = 0 or ord > 20000000000000)),
known as (select distinct fingerprint from g where ord % 7 = 0),
z as (select ord, case when status = 'false_positive' then 'dropped' when case severity when 'medium' then 2 when 'high' then 3 when 'critical' then 4 when 'low' then 1 else 0 end < 2 then case when severity = 'informational' and fingerprint not in (select fingerprint from quiet) then 'informational' else 'dropped' end
 when fingerprint in (select fingerprint from quiet) then 'suppressed' when fingerprint in (select fingerprint from known) then 'baselined' else 'reportable' end as gate from g)"""


@query(f"with {GATES} select * from z")
def j7_j8_gated(spark, sf_dir):
    f = derived(spark, sf_dir, "findings").withColumn("fingerprint", scoring.fingerprint())
    quiet = f.filter("ord % 11 = 0").select("fingerprint", "ord", F.when(F.col("ord") % 2 != 0, F.col("ord").cast("double")).alias("expires"))
    return gate.gated(f, f.filter("ord % 7 = 0"), quiet, 2e13).select("ord", "gate")


@query(f"with {FOUND}, o as (select distinct {PRINT} as fingerprint from f where ord % 7 = 0), n as (select distinct {PRINT} as fingerprint from f where ord % 5 = 0) select coalesce(o.fingerprint, n.fingerprint) as fingerprint, o.fingerprint is null as added from o full join n on n.fingerprint = o.fingerprint")
def u1_baseline_union(spark, sf_dir):
    f = derived(spark, sf_dir, "findings").withColumn("fingerprint", scoring.fingerprint())
    return gate.merged_baseline(f.filter("ord % 7 = 0"), f.filter("ord % 5 = 0"))


@query(f"with {FOUND} select severity, count(*) as n, count(*) filter (where reachable = 'reachable') as reachable from f group by severity")
def a10_severity_counts(spark, sf_dir):
    return sinks.severity_counts(derived(spark, sf_dir, "findings"))


RULE_OF = "'LODE-' || case when cwe <> '' then replace(cwe, 'CWE-', 'CWE') else replace(upper(category), '/', '_') end"
RULE_JSON = """'{"id":"' || rule_id || '","name":"' || category || '","shortDescription":{"text":"' || case when title = '' then category else title end || '"},"properties":{"cwe":"' || cwe || '","owasp":""}}'"""
RESULT_JSON = """'{"ruleId":"' || rule_id || '","level":"' || case when severity in ('critical', 'high') then 'error' when severity in ('low', 'informational') then 'note' else 'warning' end || '","message":{"text":"' || (title || ': ' || description)[1:2000]
 || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file_rel || '"},"region":{"startLine":' || greatest(1, line_start) || ',"endLine":' || greatest(1, line_end) || '}}}],"properties":{"severity":"' || severity || '","confidence":' || round(confidence, 2)
 || ',"votes":' || votes || ',"reachable":"' || reachable || '","hedged":' || hedged || ',"source":"' || source || '","status":"' || status || '"}}'"""
IN_ORDER = f"row_number() over (order by file_rel, line_start, line_end, category, {PRINT}, ord, {TIES}) - 1"


@query(f"with {FOUND}, r as (select *, {RULE_OF} as rule_id from f), a as (select unnest(arg_min(r, ord)) from r group by rule_id) select rule_id, ord as place, {RULE_JSON} as json from a")
def a17_sarif_rules(spark, sf_dir):
    return documents.sarif_rules(derived(spark, sf_dir, "findings"), by="ord")


@query(f"with {FOUND}, r as (select *, {RULE_OF} as rule_id from f) select ord, rule_id, {RESULT_JSON} as json from r")
def k2_sarif_results(spark, sf_dir):
    return documents.sarif_results(derived(spark, sf_dir, "findings"), keep=("ord",))


@query(f"""with {FOUND}, r as (select *, {RULE_OF} as rule_id, {IN_ORDER} as place from f), a as (select unnest(arg_min(r, place)) from r group by rule_id)
select 0 as section, 0 as place, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"lodestone","rules":[' as text
union all select 1, place, case when place > 0 then ',' else '' end || {RULE_JSON} from a
union all select 2, 0, ']}}}},"results":[' union all select 3, place, case when place > 0 then ',' else '' end || {RESULT_JSON} from r union all select 4, 0, ']}}]}}'""")
def k2_sarif_document(spark, sf_dir):
    return documents.report_sarif(derived(spark, sf_dir, "findings"))


def _object_sql() -> str:
    """A finding as the report's JSON object, fields by name."""
    numbers, flags = {"line_start", "line_end", "votes"}, {"hedged"}
    names = sorted({*EXPRESSIONS["findings"][1], "fingerprint", "id"} - {"ord"})
    return "'{" + ",".join(f'"{n}":' + (f"' || {n} || '" if n in numbers | flags | {"confidence"} else f"\"' || {n} || '\"") for n in names) + "}'"


def _json_sql() -> str:
    def tier(section: int, name: str, gate: str) -> list[str]:
        rows = f"select *, fingerprint[1:8] as h, 'F-' || fingerprint[1:8] as id, {IN_ORDER} as place from g where gate = '{gate}'"
        return [
            f"select {section}, 0, ',\"{name}_count\":' || count(*) from g where gate = '{gate}'",
            f"select {section + 1}, 0, ',\"{'findings' if name == 'finding' else name}\":['",
            f"select {section + 2}, place, case when place > 0 then ',' else '' end || {_object_sql()} from ({rows})",
        ]

    head = '{"tool": "lodestone", "config_hash": "c0", "coverage_pct": 0.75, "coverage_complete": false, "suppressed_count": 0, "baselined_count": 0'
    parts = [f"select 0 as section, 0 as place, '{head}' as text", *tier(1, "finding", "reportable"), "select 4, 0, ']'", *tier(5, "informational", "informational"), "select 8, 0, ']}'"]
    return f"with {GATES.replace('with ', '', 1) if GATES.startswith('with ') else GATES}, g2 as (select f.*, gate, {PRINT} as fingerprint from f join z on z.ord = f.ord) " + " union all ".join(parts).replace("from g where", "from g2 where")


@query(_json_sql())
def k1_report_json(spark, sf_dir):
    """The tiers of j7, each in the canonical order."""
    f = derived(spark, sf_dir, "findings")
    told = kept(f.join(j7_j8_gated(spark, sf_dir).filter("gate in ('reportable', 'informational')"), "ord"))
    return documents.report_json(*[told.filter(F.col("gate") == g).drop("gate") for g in ("reportable", "informational")], {"config_hash": "c0"}, 0.75)


MD_FINDING = f"""'### `F-' || {PRINT}[1:8] || '` — [' || upper(severity) || '] ' || case when title = '' then category else title end || chr(10) || '- **Location:** `' || file_rel || ':' || line_start || '-' || line_end || '`' || chr(10)
 || '- **Category:** ' || category || '  |  **CWE:** ' || case when cwe = '' then 'n/a' else cwe end || '  |  **OWASP:** n/a' || chr(10) || '- **Confidence:** ' || printf('%.2f', confidence) || '  |  **Votes:** ' || votes || '  |  **Reachable:** ' || reachable || '  |  **Source:** ' || source || chr(10)
 || chr(10) || description || chr(10) || case when cited_snippet = '' then '' else chr(10) || '```' || chr(10) || cited_snippet || chr(10) || '```' || chr(10) end || case when remediation = '' then '' else chr(10) || '**Remediation:** ' || remediation || chr(10) end"""


@query(f"""with {FOUND}, m as (select *, row_number() over (partition by reachable = 'unreachable' order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'informational' then 4 else 9 end, file_rel, line_start, category, {PRINT}, ord, {TIES}) - 1 as place from f)
select 0 as section, 0 as place, '# Vulnerability Scan Report' || chr(10) || chr(10) || 'Coverage complete (100%).' || chr(10) || chr(10) || '## Reachable findings' || chr(10) as text
union all select 1, place, {MD_FINDING} from m where reachable <> 'unreachable'
union all select distinct 3, 0, chr(10) || '---' || chr(10) || chr(10) || '## Informational — not externally reachable' || chr(10) || chr(10) || '_No path from an external entry point leads here: code hygiene, in no count and no gate._' || chr(10) from m where reachable = 'unreachable'
union all select 4, place, {MD_FINDING} from m where reachable = 'unreachable'""")
def k3_markdown(spark, sf_dir):
    return documents.report_markdown(derived(spark, sf_dir, "findings"), 1.0)


@query(f"""with {FOUND} select 0 as section, 0 as place, '# Executive Summary' || chr(10) || chr(10) || '⚠ COVERAGE INCOMPLETE (87.5%): some cells did not reach the thoroughness bar.' || chr(10) || chr(10) || '- **Total reportable findings:** ' || count(*) || ' (' || count(*) filter (where severity <> 'informational') || ' exploitable + ' || count(*) filter (where severity = 'informational') || ' informational)' || chr(10)
 || '- Critical: ' || count(*) filter (where severity = 'critical') || ' | High: ' || count(*) filter (where severity = 'high') || ' | Medium: ' || count(*) filter (where severity = 'medium') || ' | Low: ' || count(*) filter (where severity = 'low') || ' | Informational: ' || count(*) filter (where severity = 'informational') || chr(10)
 || '- **Reachable (attacker-exposed):** ' || count(*) filter (where reachable = 'reachable') || chr(10) || '- Suppressed: 3 | In baseline (not new): 4' || chr(10) || chr(10) || 'Findings are judgments of models, checked by citation, review and reachability; no code was run.' as text from f""")
def k3_executive_summary(spark, sf_dir):
    return documents.executive_summary(derived(spark, sf_dir, "findings"), 0.875, 3, 4)


# ----------------------------------------------------------------------------------- ledger


@query("with o as (select doc_id, sha256(text) as s from documents where doc_id % 7 <> 0), n as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as s from documents where doc_id % 3 <> 0) select cast(coalesce(n.doc_id, o.doc_id) as varchar) as path, coalesce(n.s, o.s) as sha256, case when o.s is null then 'added' when n.s is null then 'missing' when o.s = n.s then 'same' else 'changed' end as change from o full join n on n.doc_id = o.doc_id")
def u7_changed_files(spark, sf_dir):
    d = given(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    new = d.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    return ledger.changed_files(d.filter("doc_id % 7 <> 0").select("path", sha.alias("sha256")), new.select("path", sha.alias("sha256")))


READS = "r as (select l_orderkey % 300 as file_id, cast(floor(l_extendedprice) as int) % 500 as start_line, cast(floor(l_extendedprice) as int) % 500 + l_linenumber - 2 as end_line from lineitem), fn as (select o_orderkey % 300 as file_id, 'f' || o_orderkey as name, cast(o_custkey % 500 as int) as start_line, cast(o_custkey % 500 + 6 as int) as end_line from orders)"


@query(f"with {READS} select fn.*, exists (select 1 from r where r.file_id = fn.file_id and r.end_line >= r.start_line and r.start_line <= fn.end_line and r.end_line >= fn.start_line) as visited from fn")
def j4_visited_functions(spark, sf_dir):
    price = F.floor("l_extendedprice").cast("int") % 500
    reads = given(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("file_id"), price.alias("start_line"), (price + F.col("l_linenumber") - 2).alias("end_line"))
    fn = given(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("file_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_custkey") % 500).cast("int").alias("start_line"), (F.col("o_custkey") % 500 + 6).cast("int").alias("end_line"))
    return ledger.visited(fn, reads)


CELLS = "c as (select o_orderkey as id, 'src/m' || cast(o_custkey % 50 as string) || '.py' as path, case o_orderkey % 5 when 0 then 'PENDING' when 1 then 'IN_PROGRESS' when 2 then 'ANALYZED' when 3 then 'SHALLOW' else 'FAILED' end as state, cast(floor(o_totalprice) as int) % 10 / 10.0 as thoroughness, 1.0 + o_custkey % 3 as weight, cast(o_custkey as double) as lease_expires, cast(o_orderkey % 4 as int) as attempts from orders)"


def ledger_cells(spark, sf_dir):
    orders = given(spark, sf_dir, "orders")
    c = spark.sql(CELLS[6:-1].replace("from orders", "from {orders}"), orders=orders)
    return c.withColumn("thoroughness", F.col("thoroughness").cast("double")).withColumn("weight", F.col("weight").cast("double"))


@query(f"with {CELLS} select id, path, 'IN_PROGRESS' as state, cast(thoroughness as double) as thoroughness, cast(weight as double) as weight, 1100.0::double as lease_expires, attempts + 1 as attempts from c where (state in ('PENDING', 'SHALLOW', 'FAILED') or state = 'IN_PROGRESS' and lease_expires < 500) and attempts < 3 order by weight desc, attempts, id limit 100")
def o2_claimed_cells(spark, sf_dir):
    return ledger.claimed(ledger_cells(spark, sf_dir), 100, 500.0).select("id", "path", "state", "thoroughness", "weight", "lease_expires", "attempts")


@query(f"with {CELLS} select count(*) as n_cells, count(*) filter (where state = 'ANALYZED') as analyzed, count(*) filter (where state = 'ANALYZED' and thoroughness < 0.7) as thin, count(*) filter (where state = 'ANALYZED') / count(*) as ratio from c")
def a7_a8_coverage(spark, sf_dir):
    return ledger.coverage(ledger_cells(spark, sf_dir), 0.7)


@query(f"with {CELLS}, p as (select distinct 'src/m' || cast(s_suppkey % 9 as varchar) as prefix from supplier) select id, cast(weight + 0.5 * (select count(*) from p where starts_with(path, prefix)) as double) as weight from c")
def j9_boosted_weights(spark, sf_dir):
    prefixes = given(spark, sf_dir, "supplier").select(F.concat(F.lit("src/m"), (F.col("s_suppkey") % 9).cast("string")).alias("prefix")).distinct()
    return ledger.boosted(ledger_cells(spark, sf_dir), prefixes, 0.5).select("id", "weight")


# ------------------------------------------------------------------------------------ costs


@query(f"with {PRICED} select model_id, role, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_read_tokens) as bigint) as cache_read_tokens, cast(sum(cache_write_tokens) as bigint) as cache_write_tokens, round(sum(cost), 4) as cost from c group by grouping sets ((model_id), (role), ())")
def a11_a12_cost_totals(spark, sf_dir):
    return costs.totals(calls_of(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query(f"with {PRICED} select id, round(sum(cost) over (order by ts, id rows unbounded preceding), 8) as so_far from c")
def w3_running_cost(spark, sf_dir):
    return costs.running(calls_of(spark, sf_dir)).select("id", F.round("so_far", 8).alias("so_far"))


@query(f"with {PRICED}, r as (select ts, id, sum(cost) over (order by ts, id rows unbounded preceding) as so_far from c) select id from r where so_far >= 20 order by ts, id limit 1")
def w3_first_over_ceiling(spark, sf_dir):
    return costs.first_over(costs.running(calls_of(spark, sf_dir)), 20.0).select("id")


@query(f"with {PRICED} select count(*) filter (where cost > 0 and abs(reported - cost) > greatest(0.01, 0.25 * cost)) as mismatches, count(*) as calls from c")
def a13_cost_mismatches(spark, sf_dir):
    return costs.mismatches(calls_of(spark, sf_dir))


@query(f"with {PRICED} select id, model_id, count(*) over w as step, cast(sum(input_tokens) over w as bigint) as input_tokens, cast(sum(output_tokens) over w as bigint) as output_tokens, round(sum(cost) over w, 8) as cost from c window w as (partition by model_id order by ts, id rows unbounded preceding)")
def w4_cumulative_by_model(spark, sf_dir):
    return costs.cumulative_by(calls_of(spark, sf_dir), "model_id").withColumn("cost", F.round("cost", 8))


@query("select date_trunc('hour', ts) as start, event_type, round(sum(value), 4) as value, count(*) as n from events group by all")
def t2_spend_by_window(spark, sf_dir):
    return spend.spend_by_window(given(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("with e as (select *, coalesce(ts - lag(ts) over w > interval 600 second, true) as fresh from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(fresh::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e) select user_id, min(ts) as opened, max(ts) + interval 600 second as expires, count(*) as renewals from s group by user_id, k")
def t1_leases(spark, sf_dir):
    return spend.open_leases(given(spark, sf_dir, "events"))


# ---------------------------------------------------------------------------------- replies


@query("select event_id, case event_id % 6 when 0 then least(1.0, case when value > 100 then 1.0 when value > 10 then value / 100 when value > 1 then 1.0 else greatest(0.0, value) end) when 1 then 0.8 when 2 then greatest(0.0, least(1.0, value / 100)) when 3 then 0.5 when 4 then 0.15 else 0.5 end as confidence, case event_id % 6 when 0 then 'high' when 1 then 'informational' when 2 then 'critical' else 'medium' end as severity from events")
def f21_f22_coerced(spark, sf_dir):
    e = given(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 6)
    raw = F.when(F.col("k") == 0, F.col("value").cast("string")).when(F.col("k") == 1, " HIGH").when(F.col("k") == 2, F.concat(F.col("value").cast("string"), F.lit("%"))).when(F.col("k") == 3, "true").when(F.col("k") == 4, "very low")
    sev = F.when(F.col("k") == 0, "Severe").when(F.col("k") == 1, "info").when(F.col("k") == 2, "crit ").when(F.col("k") == 3, "moderate").when(F.col("k") == 4, "?")
    return findings.coerced(e.withColumn("raw_confidence", raw).withColumn("raw_severity", sev)).select("event_id", "confidence", "severity")


@query("select conv_id, turn, block from (select conv_id, turn, 'a' || turn || text as block, row_number() over (partition by conv_id order by turn desc) as nth from conversations where role = 'assistant' and turn % 3 <> 0) where nth = 1")
def f25_last_blocks(spark, sf_dir):
    tagged = F.concat(F.lit("<out>x</out> so <out>a"), F.col("turn").cast("string"), "text", F.lit("</out> end"))
    c = given(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 0, tagged).otherwise(F.col("text")))
    return replies.last_block_of_conversation(c, "out")


@query("select event_id, case when event_id % 2 = 0 then '[' || props || ']' else props end as json from events")
def f26_last_json(spark, sf_dir):
    e = given(spark, sf_dir, "events").select("event_id", "props")
    even = F.concat(F.lit("first {\"draft\": 1}\n```json\n["), "props", F.lit("]\n```\nas in [1]"))
    return replies.with_json(e.withColumn("text", F.when(F.col("event_id") % 2 == 0, even).otherwise(F.concat(F.lit("see [1] or "), "props", F.lit(" thus"))))).select("event_id", "json")


@query("select event_id, case event_type when 'click' then 'rate limited' when 'error' then 'timed out' when 'purchase' then 'access denied' when 'view' then 'network failure' else 'other' end as kind from events")
def p17_failure_kinds(spark, sf_dir):
    message = F.when(F.col("event_type") == "click", "ThrottlingException").when(F.col("event_type") == "error", "Read timed out").when(F.col("event_type") == "purchase", "AccessDeniedException: x").when(F.col("event_type") == "view", "Connection refused").otherwise("odd")
    return given(spark, sf_dir, "events").select("event_id", replies.failure_kind(message).alias("kind"))


FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""with {LINES}, q as (select *, lead(line) over (partition by path order by line_no) as below from l),
c as (select path, line_no, case when line_no % 2 = 0 and below is not null then line || chr(10) || below else line end as snippet from q),
d as (select path, line_no, {FLAT.format("snippet")} as want, len(body) - len(replace(body, chr(10), '')) + 1 as height from (select *, regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') as body from c)),
e as (select *, greatest(1, line_no - 1) as top, greatest(line_no + 1, line_no + height) + 2 as last from d where want <> '' and not (length(want) < 12 and regexp_matches(want, '^([\\pL_][\\pL\\p{{Mn}}\\p{{Mc}}\\p{{Nd}}\\p{{Pc}}]*|[\\pL\\pN]+)$'))),
s as (select e.path, e.line_no, e.height, want, x.line_no as first, x.line || case when height = 2 and x.line_no < last then coalesce(chr(10) || below, '') else '' end as part from e join q x on x.path = e.path and x.line_no between top and last),
f as (select path, line_no, height, min(first) as first from s where contains({FLAT.format("part")}, want) group by all)
select q.path || ':' || q.line_no as claim_id, cast(first as int) as found_at, cast(first + height - 1 as int) as found_to from q left join f on f.path = q.path and f.line_no = q.line_no""")
def f7_located_snippets(spark, sf_dir):
    """Every line, and every second one with the next, cited one line too far down."""
    l = document_lines(spark, sf_dir)
    own = document_files(spark, sf_dir).select("path", text.lines_of("text").alias("own"))
    pairs = F.arrays_zip(F.col("own").alias("line"), F.slice("own", F.lit(2), F.size("own")).alias("below"))
    c = own.select("path", F.posexplode(pairs).alias("pos", "x")).select("path", (F.col("pos") + 1).alias("line_no"), "x.line", "x.below")
    snippet = F.when(F.col("line_no") % 2 == 0, F.concat_ws("\n", "line", "below")).otherwise(F.col("line"))
    cited = (F.col("line_no") + 1).cast("int")
    claims = c.select(F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("claim_id"), "path", cited.alias("lo"), cited.alias("hi"), snippet.alias("snippet"))
    return replies.located(claims, l).select("claim_id", "found_at", "found_to")


# ------------------------------------------------------------- handlers, actions and updates


@query(f"""with {SYMBOLS}, h as (select s.path, s.name, s.start_line, code.line_no, regexp_extract(line, '"([^"]+)"', 1) as route from s join code on code.path = s.path and code.line_no between start_line - 4 and start_line + 1 where line like '@app.route%')
select path, name, start_line, 'POST' as method, arg_min(route, line_no) as route from h group by path, name, start_line""")
def f13_routes(spark, sf_dir):
    code, _, ranges = code_symbols(spark, sf_dir)
    return endpoints.routes(ranges, code)


@query(f"with {SYMBOLS} select distinct s.path, s.name, s.start_line, 'id' as param, 'query' as location from s join code on code.path = s.path and code.line_no between start_line and end_line where line like '%request.args.get%'")
def f14_parameters(spark, sf_dir):
    code, _, ranges = code_symbols(spark, sf_dir)
    return endpoints.parameters(ranges, code)


@query("select conv_id, turn, role as tool, '{\"turn\": ' || turn || '}' as args, true as parse_ok from conversations where turn % 2 = 0")
def f27_actions(spark, sf_dir):
    action = F.concat(F.lit("so "), "text", F.lit("\nACTION: "), "role", F.lit("( {\"turn\": "), F.col("turn").cast("string"), F.lit("}) ACTION: other({})"))
    c = given(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, action).alias("text"))
    return replies.with_actions(c).filter("action is not null").select("conv_id", "turn", "action.*")


@query("select event_id, event_type as reply, case when event_id % 3 = 0 then 'max_tokens' when event_id % 2 = 0 then 'tool_use' else 'end_turn' end as stop_reason, greatest(0, user_id * 3 - event_id % 100) as input_tokens, event_id % 100 as cache_read_tokens, event_id % 7 as output_tokens from events")
def f29_normalised_responses(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    tool = F.when(F.col("event_id") % 2 == 0, ',"tool_calls":[{"function":{"name":"read","arguments":"{}"}}]').otherwise("")
    reason = F.when(F.col("event_id") % 3 == 0, "length").otherwise("stop")
    body = F.format_string('{"choices":[{"message":{"content":"%s"%s},"finish_reason":"%s"}],"usage":{"prompt_tokens":%d,"completion_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d}}}', "event_type", tool, reason, F.col("user_id") * 3, F.col("event_id") % 7, F.col("event_id") % 100)
    return replies.normalised(e.select("event_id", body.alias("json"))).select("event_id", "reply", "stop_reason", "input_tokens", "cache_read_tokens", "output_tokens")


@query("select count(*) filter (where event_type <> 'view') as failed, (select case event_type when 'click' then 'rate limited' when 'error' then 'timed out' else 'other' end as kind from events where event_type <> 'view' group by kind order by count(*) desc, kind desc limit 1) as kind, false as systemic from events")
def a15_systemic_failure(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "rate limited").when(F.col("event_type") == "error", "timed out").otherwise("other")
    return costs.systemic_failure(e.select(F.when(F.col("event_type") == "view", "ANALYZED").otherwise("FAILED").alias("state"), kind.alias("kind")), 8)


@query(f"with {CHUNKS}, o as (select path, chunk_index, attack_class, case when chunk_index % 2 = 0 then 'ANALYZED' else 'SHALLOW' end as state from ch, (select unnest({ALL_CLASSES}) as attack_class) where path like '%.en'), p as (select path, chunk_index, attack_class from ch, (select unnest({ALL_CLASSES}) as attack_class)) select p.path, p.chunk_index, p.attack_class, case when o.state = 'ANALYZED' then 'ANALYZED' else 'PENDING' end as state, case when o.state = 'ANALYZED' then 0.8 else 0.0 end::double as thoroughness from p left join o using (path, chunk_index, attack_class)")
def u5_reseeded_cells(spark, sf_dir):
    f = kept(files.with_line_counts(document_files(spark, sf_dir)).select("path", "n_lines"))
    ch = chunks.fixed_chunks(f, 40, 8)
    some = f.join(ch.select("path").distinct(), "path", "left_semi")
    old = chunks.cells(ch.filter("path like '%.en'"), some.filter("path like '%.en'"), ALL_CLASSES).withColumn("state", F.when(F.col("chunk_index") % 2 == 0, "ANALYZED").otherwise("SHALLOW")).withColumn("thoroughness", F.lit(0.8))
    planned = chunks.cells(ch, some, ALL_CLASSES).drop("start_line", "end_line")
    return ledger.reseeded(old, planned, True).select("path", "chunk_index", "attack_class", "state", "thoroughness")


@query(f"with {FOUND}, g as (select {PRINT} as dedup_key, status, confidence, ord from f), n as (select dedup_key, arg_min(status, ord) as status, arg_min(confidence, ord) as base_confidence from g where ord % 3 <> 0 group by dedup_key), o as (select dedup_key, case when min(ord) % 4 = 0 then 'accepted_risk' else 'new' end as status, max(confidence) as base_confidence from g where ord % 2 = 0 group by dedup_key) select coalesce(o.dedup_key, n.dedup_key) as dedup_key, case when o.status = 'accepted_risk' then o.status else coalesce(n.status, o.status) end as status, coalesce(n.base_confidence, o.base_confidence) as base_confidence from o full join n on n.dedup_key = o.dedup_key")
def u8_upserted_findings(spark, sf_dir):
    g = derived(spark, sf_dir, "findings").withColumn("dedup_key", scoring.fingerprint())
    new = g.filter("ord % 3 <> 0").groupBy("dedup_key").agg(F.min_by("status", "ord").alias("status"), F.min_by("confidence", "ord").alias("base_confidence"))
    old = g.filter("ord % 2 = 0").groupBy("dedup_key").agg(F.when(F.min("ord") % 4 == 0, "accepted_risk").otherwise("new").alias("status"), F.max("confidence").alias("base_confidence"))
    return ledger.upserted_findings(old, new)


# --------------------------------- queries without SQL: held against small fixtures by the tests


@query(f"with m as ({ORACLES['f3_masked_lines']}), t as (select path, list(masked order by line_no) as l, cast(sum(n_masked) as bigint) as n_masked from m group by path) select path, array_to_string(case when l[-1] = '' then l[:-2] else l end, chr(10)) as text, n_masked, false as blocked from t")
def f4_sanitised_files(spark, sf_dir):
    lines = derived(spark, sf_dir, "code").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return detect.sanitised(lines.select("path", F.array_join("l.line", "\n").alias("text")), "redact")


@query()
def f28_items(spark, sf_dir):
    e = given(spark, sf_dir, "events").withColumn("json", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{\"vulns\": ["), "props", F.lit("]}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[["), "props", F.lit("]]"))).otherwise("7"))
    return replies.items(e.select("event_id", "json"), "struct<title string>").select("event_id", "pos", "item", "shape_ok")


@query(f"""with recursive e as (select distinct callee, caller from ({sql_of("edges")}) where callee <> caller),
r(name, d) as (select distinct caller, 0 from e where caller in ('n1', 'n2') union select e.callee, d + 1 from e join r on e.caller = r.name where d < 25),
x as (select ord, reachable, case when symbol = '' then null else 'n' || ord % 700 end as name from ({sql_of("findings")})),
v as (select *, case when name is null or not exists (select 1 from r) then 'unclear' when name in (select name from r) then 'reachable' when name not in (select callee from e) then 'unreachable' else 'unclear' end as verdict from x)
select ord, case when verdict = 'unclear' then reachable else verdict end as reachable, name, verdict = 'unreachable' as demoted, case when verdict = 'unreachable' then 'reachability: no caller path to an external entry point (deterministic call-graph walk) — demoted to informational, not sent to judges.' end as note from v""")
def g5_gated_findings(spark, sf_dir):
    edges = derived(spark, sf_dir, "edges").filter("callee <> caller").distinct()
    f = derived(spark, sf_dir, "findings").select("ord", "reachable", F.expr("case when symbol = '' then null else 'n' || ord % 700 end").alias("name"))
    return graph.gated(f, edges, edges.select(F.col("caller").alias("name")).filter("name in ('n1', 'n2')"))


@query(f"""with {SYMBOLS}, again as (select distinct path from s where start_line % 5 = 0)
select path, name, start_line, end_line, start_line % 2 = 0 and start_line % 3 <> 0 as visited from s where path in (select path from again) or start_line % 3 <> 0""")
def u6_replaced_functions(spark, sf_dir):
    _, _, ranges = code_symbols(spark, sf_dir)
    new = ranges.select("path", "name", "start_line", "end_line")
    old = new.filter("start_line % 3 <> 0").withColumn("visited", F.col("start_line") % 2 == 0)
    return ledger.replaced_functions(old, new.filter("start_line % 5 = 0").select("path"), new, True)
