"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, mixing, neardup, packing, pii, quality, resample, rollup, secrets, shards, tokenfiles, toolcalls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(_table(spark, sf_dir, "conversations"))
    linked = toolcalls.link(calls, results, toolcalls.TURN_SCHEMAS)
    return linked.select("call_id", F.array_join("parents", ",").alias("parents"), "tool", "n_calls", "n_results", "status", "chain", "depth", "position", "errors", F.md5("record").alias("record_md5"))


def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {"byte-50k": public_tokenizers.path("byte_bpe_50k.json"), "word-49k": public_tokenizers.path("word_bpe_49k.json")}
    return rollup.document_ledger(_table(spark, sf_dir, "documents"), versions).totals()


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_slim(_table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def text_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, row = neardup.with_rows(_table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return neardup.near_duplicates(docs, row).select("doc_id", "n_shingles", "component_id", "kept")


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_mixing_weights": mixing_weights,
        "op2_tool_calls": tool_calls,
        "op3_token_rollup": token_rollup,
        "op4_jump_shards": jump_shards,
        "op5_vector_neardup": vector_neardup,
        "op6_harmonic_packing": harmonic_packing,
        "op7_quality_rules": quality_rules,
        "op8_secret_scan": secret_scan,
        "op9_token_files": token_files,
        "op10_text_neardup": text_neardup,
        "op11_importance_resampling": importance_resampling,
        "op12_personal_data": personal_data,
        "op13_token_alignment": token_alignment,
    }


WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1 = rf"""
with d as (
  select doc_id, source, {WORDS_SQL}::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, sum(source_size) over () * 1.5::double as budget from s),
r as (select *,
    coalesce(sum(2 * source_size) over (order by source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by source_size / weight, source rows between current row and unbounded following) as free
  from w),
l as (select min((budget - capped)::double / free) as level, min_by(budget - capped, rk) as rest, min_by(free, rk) as free from (
    select *, row_number() over (order by source_size / weight, source) as rk from r) where (budget - capped) * weight / free <= 2 * source_size),
t as (select w.source, w.source_size, case when l.rest * w.weight / l.free > 2 * w.source_size then 2.0 * w.source_size else l.rest * w.weight / l.free end::double as target from w, l),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t),
c as (select d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size as rest,
    sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
    sum(size) over (partition by d.source, h) as tied
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (passes + case when upto < rest or (upto - tied < rest and 2 * (rest - (upto - tied)) >= tied) then 1 else 0 end))::bigint as taken
from c
"""

OP2 = r"""
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
calls as (
  select 'call-' || conv_id || '-' || turn as call_id,
    list_filter([case when turn >= 1 then 'call-' || conv_id || '-' || (turn - case when turn >= 2 then 2 else 1 end) end, case when turn % 4 = 0 and turn >= 4 then 'call-' || conv_id || '-' || (turn - 4) end], lambda p: p is not null) as parents,
    case when role = 'system' then 'system' when turn >= 2 then 'follow' else 'open' end as tool, turn, text,
    case when text = '' then 'nothing' when ends_with(text, '?') then 'question' else 'statement' end as kind
  from t where role in ('user', 'system')),
ranked as (select *, count(*) over (partition by call_id) as n_calls, row_number() over (partition by call_id order by tool, text) as rn from calls),
one as (select * from ranked where rn = 1),
answers as (select 'call-' || conv_id || '-' || (turn - 1) as call_id, count(*) as n_results, min(text) as result from t where role = 'assistant' group by 1),
edges as (select distinct c.call_id, p.parent from (select call_id, unnest(parents) as parent from one) p join one c using (call_id) where p.parent in (select call_id from one)),
deep as (
  select call_id, 0::bigint as depth from one where call_id not in (select call_id from edges)
  union
  select e.call_id, d.depth + 1 from edges e join deep d on e.parent = d.call_id),
depths as (select call_id, max(depth) as depth from deep group by call_id),
ways as (select call_id as a, parent as b from edges union all select parent, call_id from edges),
reach(node, seen) as (select call_id, call_id from one union select r.node, b.b from reach r join ways b on r.seen = b.a),
chains as (select node as call_id, min(seen) as chain from reach group by node),
placed as (select call_id, chain, depth, row_number() over (partition by chain order by depth nulls last, call_id) - 1 as position from one join chains using (call_id) left join depths using (call_id))
select coalesce(o.call_id, a.call_id) as call_id, array_to_string(parents, ',') as parents, tool, coalesce(n_calls, 0)::bigint as n_calls, coalesce(n_results, 0)::bigint as n_results,
  case when o.call_id is null then 'orphan' when a.call_id is null then 'unanswered' else 'linked' end as status, chain, depth, position::bigint as position,
  case when o.call_id is null then null when tool = 'system' then '$: unknown tool'
    else array_to_string(list_filter([case when kind = 'nothing' then '$.kind: enum' end, case when length(text) < 1 then '$.text: minLength' when length(text) > 400 then '$.text: maxLength' end, case when turn > 5 and tool = 'follow' then '$.turn: maximum' end], lambda x: x is not null), '; ') end as errors,
  case when o.call_id is not null then md5('{"arguments":{"kind":"' || kind || '","text":' || to_json(text) || case when turn >= 2 then ',"turn":' || turn else '' end
    || '},"id":"' || o.call_id || '","name":"' || tool || '","result":' || coalesce(to_json(result)::varchar, 'null') || '}') end as record_md5
from one o left join placed p on o.call_id = p.call_id full join answers a on o.call_id = a.call_id
"""

OP5 = r"""
with recursive g as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (
  select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
r(node, seen) as (select vec_id, vec_id from g union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as component_id from r group by node),
n as (select a, count(*) as n_links from e group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join c on c.node = vec_id
"""

OP7 = r"""
with t as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (select r, unnest(range(1, len(w) - 6)) as i, w from t where len(w) >= 8),
k as (select r, i, count(*) over (partition by r, array_to_string(w[i:i+7], ' ')) as n from win),
cover as (select r, count(distinct i + o) as n_repeat_words from k, (select unnest(range(0, 8)) as o) where n > 1 group by r),
m as (
  select t.r, doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from t left join cover on t.r = cover.r),
f as (select *, n_words < 20 as f1, 100 * n_repeat_words > 30 * n_words as f2, 10 * n_symbols > n_words as f3, 4 * n_dup_lines > n_words as f4,
    word_chars < 2 * n_words or word_chars > 15 * n_words as f5 from m),
h as (select source, count(*)::double as n, [sum(f1::int), sum(f2::int), sum(f3::int), sum(f4::int), sum(f5::int)]::double[] as x from f where source is not null group by source),
s as (select rule, sum(n) as n, count(*) as k, sum(n * n) as n2, sum(x[rule]) as x, sum(x[rule] * x[rule] / n) as sq from h, (select unnest(range(1, 6)) as rule) group by rule),
p as (select rule, (x + 0.5) / (n + 1.0) as mean, n - n2 / n as scale, greatest(0, sq - x * x / n) as between_, k from s),
q as (select rule, mean, case when scale > 0 then (between_ - (k - 1) * mean * (1 - mean)) / scale else 0 end as excess from p),
a as (select rule, mean, case when excess > 0 then least(1e6, greatest(1.0, mean * (1 - mean) / excess - 1.0)) else 1e6 end as strength from q),
v as (select source from h, a group by source having max((x[rule] + mean * strength) / (n + strength)) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed, v.source is not null as host_failed, not (f1 or f2) and v.source is null as kept
from f left join v on f.source = v.source
"""

OP10 = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as sh from t)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n x on i.a = x.doc_id join n y on i.b = y.doc_id where 100 * common >= 75 * (x.n + y.n - common)),
r(node, seen) as (select doc_id, doc_id from n union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as component_id from r group by node)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, t.doc_id) as component_id, coalesce(component_id, t.doc_id) = t.doc_id as kept
from t left join n on n.doc_id = t.doc_id left join c on c.node = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing_weights": OP1, "op2_tool_calls": OP2, "op5_vector_neardup": OP5, "op7_quality_rules": OP7, "op10_text_neardup": OP10}
