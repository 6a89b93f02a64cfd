"""Registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import fingerprint, jaccard, language, licenses, mixing, packing, pages, quality, records, repair, repeats, toxicity, trie
from kinspark.llm.digests import ordered_digest
from kinspark.llm.text import held_out
from kinspark.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=2)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = jaccard.jaccard_groups(table(spark, sf_dir, "documents")).members
    return members.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    index = records.write_records(table(spark, sf_dir, "documents"), path, end_id=1)
    return records.read_records(spark, path, index)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"), keep=["url"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("host")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damage(conversations))
    lines = found.turns.select("conv", "pos", F.concat_ws(":", "role", "text").alias("line"))
    hashes = ordered_digest(lines, ["conv"], ["pos"], "line", "repaired_sha256", "\n")
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    joined = ids.join(found.report, "conv", "left").join(hashes, "conv", "left")
    numbers = (F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_toxicity, op2_fingerprints, op3_packing, op4_ngram_jaccard_join, op5_language_id, op6_mixing,
        op7_token_records, op8_html_extraction, op9_quality_rules, op10_license_scan, op11_conversation_repair,
        op12_substring_dedup, op13_prefix_trie, pipeline,
    ]
    return {f.__name__: f for f in own}


_WORD_SETS = r"""
with recursive words as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as materialized (
  select distinct doc_id, s from (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end as ss from words), unnest(ss) as u(s)),
sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
links as materialized (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
    join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  group by 1, 2, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach as (
  select doc_id as id, doc_id as r from documents
  union select reach.id, links.b from reach join links on links.a = reach.r)
"""

OP4_SQL = (
    _WORD_SETS
    + """
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id from documents d
left join sizes using (doc_id) join (select id as doc_id, min(r) as component_id from reach group by 1) c using (doc_id)
"""
)

OP6_SQL = f"""
with recursive sizes as (select source, sum(length(coalesce(text, '')))::bigint as mass from documents group by 1),
weights as (select *, case when mass > 0 then pow(mass, {mixing.TEMPERATURE}) else 0 end as w from sizes),
rates as (select source, case when mass = 0 then 1.0 else w * (sum(mass) over ())::double / ((sum(w) over ()) * mass) end as rate from weights),
cdf(source, rate, k, p, c) as (
  select source, rate, 0, exp(-rate), exp(-rate) from rates
  union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < ceil(rate + 12 * sqrt(rate) + 20)),
tables as (select source, list(c) as cs from cdf group by 1),
drawn as (
  select d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u, cs
  from documents d join tables t on t.source is not distinct from d.source),
copies as (
  select doc_id, text, lang, source, n_chars, unnest(range(1, 1 + len(list_filter(cs, lambda c: c <= u)))) as copy_number from drawn)
select doc_id, text, lang, source, n_chars, copy_number::int as copy_number,
  ('0x' || substr(md5('17/order:' || coalesce(doc_id::varchar, 'null') || ':' || copy_number), 1, 15))::bigint as mix_order
from copies
"""

_MEASURES_SQL = r"""
with texts as materialized (
  select doc_id, source, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
lined as (
  select *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from texts),
windows as materialized (
  select doc_id, k, array_to_string(w[k:k + 4], chr(10)) as s from texts, unnest(range(1, greatest(1, len(w) - 3))) as u(k)),
again as (select doc_id, k from (select *, count(*) over (partition by doc_id, s) as c from windows) where c > 1),
repeats as (select doc_id, count(distinct k + j) as n from again, unnest(range(0, 5)) as u(j) group by 1),
measured as (
  select doc_id, source, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
    coalesce(n, 0) as n_repeat_words from lined left join repeats using (doc_id)),
failures as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
     word_chars < 3 * n_words or word_chars > 15 * n_words] as fails from measured),
by_rule as (
  select lower(source) as host, r, count(*) as n, sum(fails[r]::int) as f from failures, range(1, 6) as u(r) group by 1, 2),
priors as (select r, sum(f) / sum(n) as m, var_pop(f / n) as v from by_rule group by 1),
strengths as (select r, m, least(greatest(case when v > 0 then m * (1 - m) / v - 1 else 1000 end, 1), 1000) as s from priors),
verdicts as (select host, bool_and((f + m * s) / (n + s) <= 0.5) as ok from by_rule join strengths using (r) group by 1)
"""

OP9_SQL = (
    _MEASURES_SQL
    + """
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and coalesce(ok, true) as kept
from failures left join verdicts on verdicts.host is not distinct from lower(failures.source)
"""
)


# The checksum of zlib over the characters (ASCII) of ``{}``: a table of 256 remainders, then a fold.
_CRC_TABLE = """crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, list_transform(range(8), lambda i: i::bigint)),
    lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_of)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, crc_of[1 + xor(c, b) % 256])), 4294967295)"""

# Every row becomes the list of arcs into each of four states (nothing, after s, u, a): inserts, then one
# edit of the row. A fold over the rows keeps the least (cost, letters, lines) of each state.
OP11_SQL = f"""
with {_CRC_TABLE},
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_CRC.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as roll from conversations, crc_table),
damaged as (
  select conv_id, turn, case when roll = 4 then 'user' else role end as role,
    case roll when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from keyed, unnest(range(0, case roll when 0 then 0 when 3 then 2 else 1 end)) as u(copy)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq from damaged),
seen as (
  select *, row_number() over (partition by conv_id, role, text order by seq) > 1 as again, role[1] as initial,
    lag(role[1]) over (partition by conv_id order by seq) as before, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) as tail from placed),
faults as (
  select *, case when tail = '' then 'blank' when again then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
    before is not null and (before || initial) not in ('su', 'ua', 'au') as illegal from seen),
hops(q, n, cost, letters, lines) as (
  values (1, 1, 0, '', []::varchar[]), (1, 3, 3, 'I', ['user:']), (1, 4, 6, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 3, 'I', ['user:']), (2, 4, 6, 'II', ['user:', 'assistant:']),
    (3, 3, 0, '', []), (3, 4, 3, 'I', ['assistant:']), (3, 3, 6, 'II', ['assistant:', 'user:']),
    (4, 4, 0, '', []), (4, 3, 3, 'I', ['user:']), (4, 4, 6, 'II', ['user:', 'assistant:'])),
edits as (
  select conv_id, seq, q, n, 'D' as letter, 4 as cost, []::varchar[] as line from faults, (select distinct n as q, n from hops)
  union all select conv_id, seq, q, n, 'K', case fault when 'truncated' then 3 else 0 end, [role || ':' || text]
    from faults, (values (1, 's', 2), (1, 'u', 3), (2, 'u', 3), (3, 'a', 4), (4, 'u', 3)) as t(q, i, n) where initial = i and fault not in ('blank', 'duplicate')
  union all select conv_id, seq, q, n, 'R', 3 + case fault when 'truncated' then 3 else 0 end, [case n when 3 then 'user:' else 'assistant:' end || text]
    from faults, (values (1, 3), (2, 3), (3, 4), (4, 3)) as t(q, n) where fault not in ('blank', 'duplicate')),
arcs as (
  select conv_id, seq, e.n, list({{'q': h.q::int, 'cost': (h.cost + e.cost)::bigint, 'letters': h.letters || letter, 'lines': h.lines || line}}) as into_
  from edits e join hops h on h.n = e.q group by 1, 2, 3),
grid as (
  select g.conv_id, g.seq, list(coalesce(into_, []) order by g.n) as into_ from (select conv_id, seq, unnest([1, 2, 3, 4]) as n from faults) g
  left join arcs a on a.conv_id is not distinct from g.conv_id and a.seq = g.seq and a.n = g.n group by 1, 2),
folded as (
  select conv_id, list_reduce(
    list_prepend({{'a': []::struct(q int, cost bigint, letters varchar, lines varchar[])[][], 'v': [
        {{'cost': 0::bigint, 'letters': '', 'lines': []::varchar[]}}, {{'cost': 1000000000::bigint, 'letters': '', 'lines': []::varchar[]}},
        {{'cost': 1000000000::bigint, 'letters': '', 'lines': []::varchar[]}}, {{'cost': 1000000000::bigint, 'letters': '', 'lines': []::varchar[]}}]}},
      list({{'a': into_, 'v': []::struct(cost bigint, letters varchar, lines varchar[])[]}} order by seq)),
    lambda s, r: {{'a': r.a, 'v': list_transform(r.a, lambda arcs: list_sort(list_prepend({{'cost': 1000000000::bigint, 'letters': '', 'lines': []::varchar[]}},
      list_transform(arcs, lambda x: {{'cost': s.v[x.q].cost + x.cost, 'letters': s.v[x.q].letters || x.letters, 'lines': s.v[x.q].lines || x.lines}})))[1])}}).v as v
  from grid group by 1),
best as (
  select conv_id, list_sort([v[1], {{'cost': v[2].cost + 6, 'letters': v[2].letters || 'II', 'lines': v[2].lines || ['user:', 'assistant:']}},
    {{'cost': v[3].cost + 3, 'letters': v[3].letters || 'I', 'lines': v[3].lines || ['assistant:']}}, v[4]])[1] as b from folded),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal
  from faults group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(b.cost, 0) as cost, coalesce(b.letters, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id
"""

OP12_SQL = r"""
with texts as materialized (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
windows as materialized (select doc_id, k, array_to_string(w[k:k + 12], ' ') as s from texts, unnest(range(1, len(w) - 11)) as u(k)),
firsts as materialized (select s, min(doc_id) as first from windows group by 1),
gone as (
  select doc_id, list(distinct k + j) as ks from windows join firsts using (s), unnest(range(0, 13)) as u(j) where first < doc_id group by 1),
kept as (
  select t.doc_id, w, coalesce(len(ks), 0) as n, list_filter(w, lambda x, i: not list_contains(coalesce(ks, []), i)) as rest from texts t left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, n::bigint as n_removed, sha256(array_to_string(rest, ' ')) as kept_sha256 from kept
"""

OP13_SQL = f"""
with {_CRC_TABLE},
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as seq,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list({{'role': role, 'text': text}} order by seq) as ts from turns group by 1),
heads as (select conv_id, ts, {_CRC.format("conv_id::varchar")} % {trie.HEADS} as h from own, crc_table),
rebuilt as materialized (
  select x.conv_id, coalesce(b.ts, [])[:x.h] || x.ts[x.h + 1:] as ts from heads x left join own b on b.conv_id = x.conv_id - x.conv_id % {trie.FAMILY}),
steps as materialized (select conv_id, d, ts[:d] as prefix, len(ts) as n from rebuilt, unnest(range(0, len(ts) + 1)) as u(d)),
nodes as materialized (
  select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id) as ends
  from steps group by 1, 2),
children as (select prefix[:d - 1] as prefix, count(*) as n_children from nodes where d > 0 group by 1),
below as (select distinct x.prefix, y.prefix as under, y.d from steps x join steps y on x.conv_id = y.conv_id and y.d >= x.d),
sums as (
  select b.prefix, count(*) filter (c.n_children is null) as n_leaves,
    sum(case when b.d > 0 then (n.n_convs - 1) * length(b.under[b.d].text) else 0 end) as saved_tokens
  from below b join nodes n on n.prefix = b.under left join children c on c.prefix = b.under group by 1)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children, s.n_leaves,
  s.saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n left join nodes p on n.d > 0 and p.prefix = n.prefix[:n.d - 1] left join children c on c.prefix = n.prefix join sums s on s.prefix = n.prefix
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": OP4_SQL, "op6_mixing": OP6_SQL, "op9_quality_rules": OP9_SQL, "op11_conversation_repair": OP11_SQL,
        "op12_substring_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL,
    }
