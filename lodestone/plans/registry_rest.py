"""Registered queries of the audit engine for what was held by unit tests alone: outcomes, pruning, look-ups, orders, exits, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import chunks, costs, detect, gate, ledger, replies, runs
from lodestone.plans.fixtures import derived
from lodestone.plans.registry import CELLS, FOUND, GATES, IN_ORDER, ORACLES, PRINT, RULE_OF, TIES, code_symbols, given, j7_j8_gated, ledger_cells, query
from lodestone.sources import documents, reports

REPLIES = {
    "event_id": "event_id", "error": "case when event_id % 7 = 0 then 'boom' end", "parsed": "event_id % 5 <> 0", "shape_ok": "event_id % 11 <> 0", "truncated": "event_id % 13 = 0",
    "calls": "user_id % 6", "errors": "event_id % 3", "n_findings": "case when event_id % 4 = 0 then 1 else 0 end", "attempts": "event_id % 4", "prior": "event_id % 10 / 10.0",
}


@query(f"""with r as (select {", ".join(f"{e} as {n}" for n, e in REPLIES.items())} from events), s as (select *, greatest(0, calls - errors) as ok from r),
x as (select *, least(1.0, case when ok >= 1 then 0.4 else 0 end + case when ok >= 3 then 0.2 else 0 end + case when n_findings > 0 or ok >= 2 then 0.4 else 0 end) as score from s),
t as (select *, case when error is not null then 0 when not parsed then 0.3 when not shape_ok or truncated then least(score, 0.5) else score end as t from x)
select event_id, cast(round(t, 4) as double) as thoroughness, case when error is not null then 'FAILED' when parsed and shape_ok and not truncated and t >= 0.7 or n_findings > 0 or t > 0 and attempts >= 2 and t <= prior then 'ANALYZED' else 'SHALLOW' end as state from t""")
def f42_outcomes(spark, sf_dir):
    """Every event as a reply: its thoroughness and the state of its cell (F23, F42, W7)."""
    r = given(spark, sf_dir, "events").selectExpr(*(f"{e} as {n}" for n, e in REPLIES.items())).withColumn("prior", F.col("prior").cast("double"))
    return ledger.outcome(r, 0.7, 2).select("event_id", F.round("thoroughness", 4).alias("thoroughness"), "state")


@query(f"with {CELLS}, k as (select distinct path, cast(path[6:-4] as int) as m from c), g as (select sum((m % 5 = 0)::int) as gone, count(*) as n from k) select 5 as share, id from c where (select gone * 2 > n from g) or cast(path[6:-4] as int) % 5 <> 0 union all select 1, id from c")
def j12_pruned_cells(spark, sf_dir):
    """Cells of a fifth of the paths go; where all paths but a few would, none does."""
    c = ledger_cells(spark, sf_dir)
    m = F.regexp_extract("path", r"m(\d+)", 1).cast("int")
    some, few = c.filter(m % 5 != 0), c.filter(m == 1)
    return ledger.pruned(c, some).select(F.lit(5).alias("share"), "id").unionByName(ledger.pruned(c, few).select(F.lit(1).alias("share"), "id"))


@query(f"""with {FOUND}, p as (select ord as id, {PRINT} as print from f), w as (select distinct cast(id as varchar) as asked from p where id % 97 = 0 union select distinct print from p where id % 83 = 0 union select distinct 'F-' || print[1:8] from p where id % 89 = 0 union select distinct print[1:8] || 'zz' from p where id % 79 = 0 union select distinct print[1:7] from p where id % 73 = 0),
h as (select asked, 1 as way, id from w join p on asked = cast(id as varchar) union all select asked, 2, id from w join p on asked = print union all select asked, 3, id from w join p on regexp_replace(asked, '^F-', '')[1:8] = print[1:8] where length(regexp_replace(asked, '^F-', '')[1:8]) = 8),
b as (select asked, way, count(distinct id) as n, min(id) as id from h group by asked, way), x as (select *, row_number() over (partition by asked order by way) as nth from b)
select w.asked, case when n is null then 'none' when n > 1 then 'ambiguous' else 'found' end as status, case when n = 1 then id end as id from w left join x on x.asked = w.asked and nth = 1""")
def j13_resolved(spark, sf_dir):
    """Findings asked for by row, whole fingerprint or prefix; some too short, some with something behind the prefix."""
    f = derived(spark, sf_dir, "findings").select(F.col("ord").alias("id"), scoring.fingerprint().alias("fingerprint"))
    short = F.substring("fingerprint", 1, 8)
    asked = [(97, F.col("id").cast("string")), (83, F.col("fingerprint")), (89, F.concat(F.lit("F-"), short)), (79, F.concat(short, F.lit("zz"))), (73, F.substring("fingerprint", 1, 7))]
    each = F.array(*[F.when(F.col("id") % n == 0, c) for n, c in asked])
    wanted = f.filter(" or ".join(f"id % {n} = 0" for n, _ in asked)).select(F.explode(each).alias("asked")).filter("asked is not null")
    return gate.resolved(f, wanted.distinct())


@query(f"with {FOUND} select ord, {IN_ORDER} as place from f")
def o4_canonical_places(spark, sf_dir):
    return documents.ordered(derived(spark, sf_dir, "findings")).select("ord", "place")


@query(f"with {FOUND} select ord, row_number() over (order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'informational' then 4 else 9 end, file_rel, line_start, category, {PRINT}, ord, {TIES}) - 1 as place from f")
def o5_report_places(spark, sf_dir):
    return documents.ordered(derived(spark, sf_dir, "findings"), urgent_first=True).select("ord", "place")


@query(f"with {GATES}, {CELLS}, n as (select count(*) filter (where gate = 'reportable') as n from z), l as (select count(*) filter (where state <> 'ANALYZED') as l from c) select 'all' as run, case when n > 0 then 1 when l > 0 then 2 else 0 end as code from n, l union all select 'clean', case when l > 0 then 2 else 0 end from l union all select 'limited', 0 union all select 'done', 0")
def k10_exit_codes(spark, sf_dir):
    """Ends of a run: as it is, without reportable findings, the same with a limit, and with all cells analyzed."""
    gates, cells = j7_j8_gated(spark, sf_dir), ledger_cells(spark, sf_dir)
    clean = gates.filter("gate <> 'reportable'")
    runs = {"all": (gates, cells, False), "clean": (clean, cells, False), "limited": (clean, cells, True), "done": (clean, cells.filter("state = 'ANALYZED'"), False)}
    out = None
    for name, (g, c, limited) in runs.items():
        part = gate.exit_code(g, c, limited).select(F.lit(name).alias("run"), "code")
        out = part if out is None else out.unionByName(part)
    return out


ROLES = {"role": "case s_suppkey % 4 when 0 then 'hunt' when 1 then 'j1' when 2 then 'j2' else 'other' end", "p_input": "case when s_suppkey % 5 = 0 then 0 else s_acctbal end", "p_output": "case when s_suppkey % 5 = 0 then 0 else s_acctbal * 3 end", "billing": "case when s_suppkey % 7 = 0 then 'free' else 'metered' end"}


@query(f"""with r as (select {", ".join(f"{e} as {n}" for n, e in ROLES.items())} from supplier), w as (select *, case role when 'hunt' then 1.0 when 'j1' then 0.1 when 'j2' then 0.1 else 0 end as w, billing = 'free' as free, p_input <= 0 and p_output <= 0 as un from r)
select round(sum(w * case when free then 0 when un then 15.0 else p_input end)::double / sum(w)::double, 4) as p_input, round(sum(w * case when free then 0 when un then 15.0 else p_output end)::double / sum(w)::double, 4) as p_output from w where w > 0""")
def a19_blended_price(spark, sf_dir):
    """Suppliers as roles with prices, some free or unpriced."""
    roles = given(spark, sf_dir, "supplier").selectExpr(*(f"{e} as {n}" for n, e in ROLES.items()))
    roles = roles.withColumns({c: F.col(c).cast("double") for c in ("p_input", "p_output")})
    return costs.blended_price(roles, ["j1", "j2"]).select(*(F.round(c, 4).alias(c) for c in ("p_input", "p_output")))


@query(f"with {FOUND} select {PRINT} as dedup_key, min(ord) as id, arg_min(title, ord) as title from f group by dedup_key")
def a20_first_rows(spark, sf_dir):
    f = derived(spark, sf_dir, "findings").select(scoring.fingerprint().alias("dedup_key"), F.col("ord").alias("id"), "title")
    return ledger.first_rows(f)


@query("with p as (select n_nationkey as pass_no, case when n_nationkey >= 5 then 1.0 else 0.5 end as coverage, (n_nationkey % 4 = 0 and n_nationkey < 20)::int as confirmed from nation), i as (select *, sum(confirmed) over (order by pass_no rows unbounded preceding) as island from p), r as (select *, sum(1 - confirmed) over (partition by island order by pass_no rows unbounded preceding) as run from i) select min(pass_no) as stop_at from r where coverage >= 1 and run >= 3")
def w6_convergence(spark, sf_dir):
    p = given(spark, sf_dir, "nation").selectExpr("n_nationkey as pass_no", "case when n_nationkey >= 5 then 1.0d else 0.5d end as coverage", "cast(n_nationkey % 4 = 0 and n_nationkey < 20 as int) as confirmed")
    return ledger.convergence(p, 3)


EXPIRES = "case c_custkey % 4 when 0 then cast(c_custkey * 1000 as {}) when 1 then '2025-0' || cast(c_custkey % 9 + 1 as {}) || '-11' when 2 then 'soon' end"


@query(f"""with s as (select c_custkey as ord, 'fp' || c_custkey % 50 as fingerprint, {EXPIRES.format("varchar", "varchar")} as expires from customer where c_custkey % 10 <> 0)
select ord, fingerprint, coalesce(try_cast(expires as double), epoch(try_strptime(expires, '%Y-%m-%d'))) as expires from s""")
def s12_suppression_entries(spark, sf_dir):
    """Customers as suppressions: epochs, days, words and nulls as their end; a tenth has no fingerprint."""
    c = given(spark, sf_dir, "customer").selectExpr("c_custkey as ord", "case when c_custkey % 10 <> 0 then 'fp' || cast(c_custkey % 50 as string) end as fingerprint", f"{EXPIRES.format('string', 'string')} as expires")
    return reports.suppression_entries(c)


@query(f"with {FOUND}, r as (select *, {RULE_OF} as rule_id from f), k as (select rule_id, arg_min(cwe, ord) as cwe from r group by rule_id) select file_rel, greatest(1, line_start) as line_start, greatest(1, line_end) as line_end, k.cwe, case when severity in ('critical', 'high') then 'high' when severity in ('low', 'informational') then 'low' else 'medium' end as severity, (title || ': ' || description)[1:120] as title, count(*) as n from r join k using (rule_id) group by all")
def s9_round_trip(spark, sf_dir):
    """SARIF results, each with its rule as a document of its own, read back as seeds."""
    f = derived(spark, sf_dir, "findings")
    rules = documents.sarif_rules(f, by="ord").select("rule_id", F.col("json").alias("rule"))
    # a report has a rule for each CWE or category, so few: dealt by rule, the results would land in as few tasks
    both = documents.sarif_results(f).join(F.broadcast(rules), "rule_id")
    doc = F.concat(F.lit('{"runs":[{"tool":{"driver":{"rules":['), "rule", F.lit(']}},"results":['), "json", F.lit("]}]}"))
    return reports.seeds(both.select(doc.alias("json"))).groupBy("file_rel", "line_start", "line_end", "cwe", "severity", "title").agg(F.count("*").alias("n"))


@query("select user_id as finding_id, arg_max(event_type, row(ts, event_id)) as human_result from events group by user_id")
def u11_latest_verdicts(spark, sf_dir):
    e = given(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("human_result"))
    return ledger.latest_verdicts(e)


@query("select model_id, first_role, role from (select 'm' || p_partkey % 97 as model_id, 'r' || p_partkey as role, first_value('r' || p_partkey) over w as first_role, row_number() over w as nth from part window w as (partition by p_partkey % 97 order by p_partkey)) where nth > 1")
def f44_shared_judges(spark, sf_dir):
    """Parts as judges that share 97 models."""
    return costs.shared_judges(given(spark, sf_dir, "part").selectExpr("p_partkey as ord", "'r' || cast(p_partkey as string) as role", "'m' || cast(p_partkey % 97 as string) as model_id"))


STORED = {"id": "o_orderkey", "dedup_key": "'k' || cast(o_orderkey % 700 as {0})", "file_id": "case when o_orderkey % 3 <> 0 then o_custkey end", "confidence": "case when o_orderkey % 4 = 0 then null else 0.25 end", "votes": "case when o_orderkey % 5 = 0 then null else 0 end"}


@query(f"""with s as (select {", ".join(f"{e.format('varchar')} as {n}" for n, e in STORED.items())} from orders), fs as (select c_custkey as id, 'src/c' || c_custkey || '.py' as path from customer where c_custkey % 2 = 0)
select s.id, dedup_key, coalesce(path, '') as file_rel, coalesce(confidence, 0.5)::double as confidence, coalesce(votes, 1) as votes from s left join fs on fs.id = s.file_id where dedup_key not in (select 'k' || p_partkey from part where p_partkey % 3 = 0)""")
def s14_j6_reloaded(spark, sf_dir):
    """Orders as stored findings; keys that are present already stay away, only nulls get defaults."""
    stored = given(spark, sf_dir, "orders").selectExpr(*(f"{e.format('string')} as {n}" for n, e in STORED.items())).withColumn("confidence", F.col("confidence").cast("double"))
    files = given(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey as id", "'src/c' || cast(c_custkey as string) || '.py' as path")
    present = given(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("'k' || cast(p_partkey as string) as dedup_key")
    return ledger.reloaded(stored, files, present).select("id", "dedup_key", "file_rel", "confidence", "votes")


# ------------------------------------------------------------------ words, hints, fallbacks

SAID = {0: "Blocker", 1: " major ", 2: "MINOR", 3: "crit", 4: "info", 5: "odd", 6: "", 7: "High"}
SAID_SQL = "case event_id % 9 " + " ".join(f"when {k} then '{v}'" for k, v in SAID.items()) + " end"


@query("select event_id, case event_id % 9 when 0 then 'critical' when 1 then 'high' when 2 then 'low' when 3 then 'critical' when 4 then 'informational' when 7 then 'high' else 'medium' end as severity from events")
def f22_rule_severities(spark, sf_dir):
    return given(spark, sf_dir, "events").withColumn("said", F.expr(SAID_SQL)).select("event_id", scoring.rule_severity_of("said").alias("severity"))


ERRORS = "case event_id % 8 when 0 then 'ThrottlingException: slow' when 1 then 'Read timed out' when 2 then 'AccessDenied by x' when 3 then 'ValidationException' when 4 then 'HTTP rate 7' when 5 then 'boom' when 6 then '' end"


@query("select event_id, case when event_id % 5 = 0 then 'transport retries exhausted' when event_id % 7 = 0 then 'turn budget exhausted' else case event_id % 8 when 0 then 'rate limited' when 1 then 'timed out' when 2 then 'access denied' when 3 then 'request rejected by the model' when 4 then 'rate limited' else 'model call failed' end end as reason from events")
def p17_judge_reasons(spark, sf_dir):
    stop = "case when event_id % 5 = 0 then 'retries_exhausted' when event_id % 7 = 0 then 'max_turns' when event_id % 3 = 0 then 'end_turn' end"
    e = given(spark, sf_dir, "events").selectExpr("event_id", f"{stop} as stop", f"{ERRORS} as error")
    return e.select("event_id", replies.judge_reason("stop", "error").alias("reason"))


@query("select user_id as cell, event_id as attempt_id, nth as attempt, t as thoroughness, t > 0 and nth >= 3 and t <= coalesce(before, 0) as plateau from (select *, lag(t) over (partition by user_id order by nth) as before from (select user_id, event_id, cast(row_number() over (partition by user_id order by event_id) as int) as nth, event_id * 7 % 11 / 10.0::double as t from events))")
def w7_plateaus(spark, sf_dir):
    """Every user's events as attempts at one cell."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = given(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_id").alias("attempt_id"), nth.alias("attempt"), (F.col("event_id") * 7 % 11 / 10.0).alias("thoroughness"))
    return ledger.plateaus(e, 3)


@query(f"with h as ({ORACLES['p5_surface_hits']}), n as (select *, row_number() over (partition by kind order by path, line_no, label) as nth from h where kind in ('source', 'sink')) select kind, path, line_no, '  ' || label || ' ' || path || ':' || line_no as hint from n where nth <= case kind when 'sink' then 30 else 25 end")
def o6_hints(spark, sf_dir):
    """What a prompt shows of the surface: 30 sinks, 25 sources."""
    hits = detect.surface_hits(derived(spark, sf_dir, "code"))
    parts = [runs.hints(hits, kind, most).withColumn("kind", F.lit(kind)) for kind, most in (("sink", 30), ("source", 25))]
    return parts[0].unionByName(parts[1]).select("kind", "path", "line_no", "hint")


@query(f"with ch as ({ORACLES['f9_w2_symbol_chunks']}), s as (select path, max(end_line) as n_lines from ch group by path), c as (select path, unnest([0, 1, 2, 90]) as chunk_index from s) select c.path, c.chunk_index, case when c.chunk_index = 1 then 3 else coalesce(ch.start_line, 1) end as start_line, case when c.chunk_index = 1 then 5 else coalesce(ch.end_line, greatest(1, n_lines)) end as end_line from c join s using (path) left join ch on ch.path = c.path and ch.chunk_index = c.chunk_index")
def j16_derived_ranges(spark, sf_dir):
    """Cells of which only the second has its lines stored: the others' are found anew by symbols, and past these it is the file."""
    _, sizes, ranges = code_symbols(spark, sf_dir)
    cells = sizes.select("path", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 90)])).alias("chunk_index"))
    stored = sizes.select("path", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).selectExpr("path", "chunk_index", "if(chunk_index = 1, 3, null) as start_line", "if(chunk_index = 1, 5, null) as end_line")
    return runs.cell_ranges(cells, stored, sizes, chunks.symbol_chunks(sizes, ranges, 12, 3)).select("path", "chunk_index", "start_line", "end_line")


@query("select event_id, case when event_id % 3 = 0 then '' else event_type || chr(10) || 'v' || user_id end as reply, case when event_id % 2 = 0 then 'read,' else '' end as tools, case when event_id % 4 <> 0 then 'stop_' || event_id % 4 end as stop_reason, user_id as input_tokens, event_id % 7 as output_tokens, case when event_id % 2 = 0 then event_id % 100 else 0 end as cache_read_tokens, 0 as cache_write_tokens from events")
def f29_converse_responses(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    n = F.col("event_id")
    text = F.when(n % 3 == 0, "").otherwise(F.format_string('{"text":"%s"},{"text":"v%d"},', "event_type", "user_id"))
    tools = F.when(n % 2 == 0, '{"toolUse":{"toolUseId":"t","name":"read","input":{"a":1}}},{"toolUse":{"input":{}}},').otherwise("")
    stop = F.when(n % 4 != 0, F.format_string('"stopReason":"stop_%d",', n % 4)).otherwise("")
    cache = F.when(n % 2 == 0, F.format_string(',"cacheReadInputTokens":%d', n % 100)).otherwise("")
    body = F.concat(F.lit('{"output":{"message":{"content":['), text, tools, F.lit('{"image":{}}]}},'), stop, F.format_string('"usage":{"inputTokens":%d,"outputTokens":%d', "user_id", n % 7), cache, F.lit("}}"))
    out = replies.normalised_converse(e.select("event_id", body.alias("json")))
    return out.select("event_id", "reply", F.array_join("tools", ",").alias("tools"), "stop_reason", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
