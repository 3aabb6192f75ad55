"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann_search, chat_format, jaccard_join, language_id, lexical_search, pair_alignment, piece_codec, quality, source_mixing, substring_dedup, topk_search, toxicity, url_filter
from lodestone.llm.shared import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(table(spark, sf_dir, "documents"), PIECES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"), entropy=0.98, max_epochs=1.5)
    return mixed.select("doc_id", "source", "n_tokens", "weight_ppb", "copies", "block")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return predicted.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.perspectives(table(spark, sf_dir, "conversations")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_alignment.align(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", "toxic_lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_piece_codec": op2_piece_codec,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_chat_format": op6_chat_format,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ann_search": op9_ann_search,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_pair_alignment": op11_pair_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}

OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' ')) as ks from w where len(ws) >= 20),
p as (select doc_id, unnest(ks) as k, generate_subscripts(ks, 1) as i from l),
r as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from p),
c as (select distinct doc_id, i + t.o as j from r, unnest(range(0, 20)) as t(o) where n > 1),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
k as (select words.doc_id, word, words.j, c.j is not null as gone from words left join c on c.doc_id = words.doc_id and c.j = words.j),
s as (select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by j) filter (where not gone), '') as kept from k group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join s on s.doc_id = w.doc_id
"""

OP10 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from w union select reach.a, links.b from reach join links on links.a = reach.b)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.b) as component_id
from w left join n on n.doc_id = w.doc_id join reach on reach.a = w.doc_id group by w.doc_id
"""

OP1 = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id
),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify rank <= 5
"""

OP5 = r"""
with r(verdict, rule, host, path) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
u as (select row_number() over () as n, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
h as (select n, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by n)
select page_id, host, path, h.rule, coalesce(h.verdict, 'allow') as verdict from p left join h on h.n = p.n
"""

OP6 = r"""
with t as (select row_number() over () as n, conv_id, turn, coalesce(nullif(role, ''), 'unknown') as speaker, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
s as (
  select t.n, t.conv_id, p.perspective, t.turn, t.speaker, t.text, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
  from t join people p on t.conv_id is not distinct from p.conv_id
),
r as (select *, case when role = 'user' then speaker end as name, '<|im_start|>' || role || coalesce(' name=' || case when role = 'user' then speaker end, '') || chr(10) as head from s),
x as (select *, head || text || '<|im_end|>' || chr(10) as rendered from r),
o as (select *, cast(coalesce(sum(length(rendered)) over (partition by conv_id, perspective order by turn nulls first, speaker, text, n rows between unbounded preceding and 1 preceding), 0) as bigint) as char_start from x)
select conv_id, perspective, turn, role, name, sha256(rendered) as rendered_sha256, char_start,
  case when role = 'assistant' then char_start + length(head) end as mask_start, case when role = 'assistant' then char_start + length(rendered) - 1 end as mask_end
from o
"""

OP3 = r"""
with recursive d as (select doc_id, source, text, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as n_tokens, md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as h, coalesce('=' || source, 'null') as src from documents),
digits as (select greatest(1, cast(ceil(ln(greatest(1, count(*) / 512.0)) / ln(16)) as integer)) as k from d),
s as (select src, sum(n_tokens) as tokens, sum(n_tokens) / cast(sum(sum(n_tokens)) over () as double) as p from d group by src),
m as (select list(p order by tokens, src) as ps, count(*) as n from s),
low(i, lo, hi) as (
  select 0, cast(0 as double), cast(1 as double) union all
  select i + 1, case when bad then mid else lo end, case when bad then hi else mid end from (
    select i, lo, hi, (lo + hi) / 2 as mid, list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) / list_min(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) > 1.5 as bad from low, m where i < 40)
),
high(i, lo, hi) as (
  select 0, cast(0 as double), cast(1 as double) union all
  select i + 1, case when good then mid else lo end, case when good then hi else mid end from (
    select i, lo, hi, mid, ln(z) - mid * list_sum(list_transform(ps, lambda p: pow(p, mid) * ln(p))) / z >= 0.98 * ln(n) as good
    from (select i, lo, hi, (lo + hi) / 2 as mid, ps, n, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) as z from high, m where i < 40))
),
a as (select greatest((select hi from low where i = 40), (select lo from high where i = 40)) as alpha),
w as (select src, tokens, cast(round(pow(p, alpha) / sum(pow(p, alpha)) over () * 1000000000) as bigint) as weight_ppb from s, a),
g as (select *, greatest(tokens, cast(floor(weight_ppb * max(cast(tokens as double) / weight_ppb) over ()) as bigint)) as budget from w),
c as (select d.*, weight_ppb, cast(budget // tokens as bigint) as whole, budget - budget // tokens * tokens as rest, sum(n_tokens) over (partition by d.src order by h, doc_id, n_tokens, text rows unbounded preceding) as upto from d join g on g.src = d.src)
select doc_id, source, cast(n_tokens as bigint) as n_tokens, weight_ppb, cast(whole + case when upto <= rest then 1 else 0 end as integer) as copies, substr(h, 1, k) as block from c, digits
"""

OP12 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
t as (select r, doc_id, cast(len(ws) as bigint) as n, unnest(ws) as w from d),
f as (select r, doc_id, n, w, count(*) as tf from t group by all),
c as (select cast(count(*) as bigint) as docs, cast(sum(len(ws)) as bigint) as terms from d where len(ws) > 0),
wt as (select w, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from f, c group by w, docs),
i as (select i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as w from (select *, row_number() over () as i from benchmark)),
s as (select i, item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score from i join f using (w) join wt using (w), c group by all)
select item_id, cast(row_number() over (partition by i order by score desc, doc_id, r) as integer) as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""

ORACLES: dict[str, str] = {"op1_topk_search": OP1, "op3_source_mixing": OP3, "op5_url_filter": OP5, "op6_chat_format": OP6, "op8_substring_dedup": OP8, "op10_jaccard_join": OP10, "op12_lexical_search": OP12}
