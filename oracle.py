"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

CUTOFF = 0.75
TEXT_CUTOFF = 0.3
DIM = 64


def _one_line(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\s*\n\s*', '', 'g'), '^\s+|\s+$', '', 'g')"


def _fnv(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"list_reduce(list_concat([2166136261::BIGINT], {codes}), lambda a, x: (xor(a, x) * 16777619) & 4294967295)"


def _distance(a: str, b: str) -> str:
    return f"round(list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[]), 6) + 0.0"


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}::DOUBLE[], lambda x: x * x)))"


def _squared_l2(a: str, b: str) -> str:
    parts = f"list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"
    return f"round(list_sum({parts}), 6) + 0.0"


def _characters(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} as (select {key} as id, unnest(string_split({text}, '')) as c,
        generate_subscripts(string_split({text}, ''), 1) as p from {source})"""


def _kmers(name: str, chars: str, k: int) -> str:
    letters = " || ".join("c" if i == 0 else f"lead(c, {i}) over w" for i in range(k))
    return f"""{name} as (select distinct id, kmer from (select id, {letters} as kmer from {chars}
        window w as (partition by id order by p)) where kmer is not null)"""


def _spaced_seeds(name: str, chars: str, shape) -> str:
    """Letters at the marked places of every pattern, wherever it fits."""
    parts = []
    for number, (offsets, pattern) in enumerate(zip(shape.offsets(), shape.patterns)):
        letters = " || ".join("c" if k == 0 else f"lead(c, {k}) over w" for k in offsets.tolist())
        parts.append(f"""select id, p, {number} as pattern, {letters} as seed, lead(c, {len(pattern) - 1}) over w as last
            from {chars} window w as (partition by id order by p)""")
    return f"{name} as (select id, p, pattern, seed from ({' union all '.join(parts)}) where last is not null)"


def _classes(text: str, shape) -> str:
    table = shape.folded()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return f"translate({text}, '{letters}', '{''.join(chr(table[ord(x)]) for x in letters)}')"


def _spaced_pairs() -> str:
    from kinspark.plans.views import TEXT_SHAPE as shape

    return f"""with {QUERY_TEXTS}, {SEQUENCES},
        {_characters("qchars", "qtexts", "query_idx", _classes("sequence", shape))}, {_characters("tchars", "seqs", "centroid_idx", _classes("sequence", shape))},
        {_spaced_seeds("qseeds", "qchars", shape)}, {_spaced_seeds("tseeds", "tchars", shape)},
        seed_hits as (select distinct t.id as target_idx, q.id as query_idx, t.p - q.p as diagonal, t.p as p from tseeds t join qseeds q using (pattern, seed)),
        met as (select *, count(*) over (partition by target_idx, query_idx, diagonal order by p range between {shape.reach} preceding and {shape.apart} preceding) as n from seed_hits)
        select target_idx, query_idx, count(distinct diagonal) as diagonals from met where n > 0 group by all"""


def _embedding(name: str, chars: str) -> str:
    """Values of the hashed 3-mer embedding, in single precision, zeros left out."""
    return f"""{name}_sums as (
      select id, h % {DIM} as dim, sum(1 - 2 * ((h // {DIM}) % 2)) as v from (
        select id, (unicode(c)::BIGINT * 1000003 + unicode(lead(c) over w)::BIGINT * 10007
                    + unicode(lead(c, 2) over w)::BIGINT * 101) % 2147483647 as h
        from {chars} window w as (partition by id order by p)) where h is not null group by all),
    {name} as (select s.id, s.dim, (s.v / n.n)::FLOAT::DOUBLE as v from {name}_sums s
      join (select id, sqrt(sum(v * v)) as n from {name}_sums group by id) n using (id) where s.v <> 0)"""


# Common tables -------------------------------------------------------------------------

CORPUS = "corpus as (select vec_id as centroid_idx, embedding from embeddings)"

QUERY = """query as (select label::BIGINT as query_idx, 'label_' || label as query_name, list(v::FLOAT order by p) as embedding
    from (select label, p, avg(v) as v from (select label, unnest(embedding)::DOUBLE as v, generate_subscripts(embedding, 1) as p
          from embeddings) group by label, p) group by label)"""

HITS = f"""{CORPUS}, {QUERY}, hits as (select * from (select c.centroid_idx, q.query_idx,
    {_distance("c.embedding", "q.embedding")} as distance from corpus c, query q) where distance < {CUTOFF})"""

SEQUENCES = f"""seqs as (select doc_id as centroid_idx, 'DOC' || doc_id || '_' || source || '_1 ' || lang as name,
    {_one_line("text")} as sequence from documents)"""

NAMED = f"""{HITS}, {SEQUENCES}, named as (select q.query_name, s.name as centroid_name, s.sequence, h.distance
    from hits h join seqs s using (centroid_idx) join query q using (query_idx))"""

MEMBERSHIP = """membership as (select 'C' || min(doc_id) over (partition by text) || '_7_1' as centroid_id,
    'M' || doc_id as member_id, doc_id from documents)"""

MEMBERS = f"""{MEMBERSHIP}, members as (select m.centroid_id, m.member_id,
    m.centroid_id || '_' || m.member_id || ' # ' || d.n_chars || ' # 1 # 1' as member_header,
    {_one_line("d.text")} as sequence, d.doc_id, d.n_chars from membership m join documents d using (doc_id))"""

QUERY_TEXTS = f"qtexts as (select item_id as query_idx, 'Q' || item_id as query_name, {_one_line('text')} as sequence from benchmark)"

SEEDS = f"""{SEQUENCES}, {QUERY_TEXTS}, {_characters("tchars", "seqs", "centroid_idx", "sequence")},
    {_characters("qchars", "qtexts", "query_idx", "sequence")}, {_kmers("tkmers", "tchars", 12)}, {_kmers("qkmers", "qchars", 12)},
    seeds as (select t.id as target_idx, q.id as query_idx, count(*) as shared from tkmers t join qkmers q using (kmer) group by all)"""

ALIGNMENTS = f"""{SEEDS}, alignments as (select 'M' || d.doc_id || '#' || d.n_chars || '#1#1' as target, 'Q' || s.query_idx as query,
    1.0::DOUBLE as identity, s.shared::INTEGER as alignment_length, 0::INTEGER as nb_mismatches, 0::INTEGER as nb_gap_openings, 1::INTEGER as target_start,
    s.shared::INTEGER as target_end, 1::INTEGER as query_start, s.shared::INTEGER as query_end, round(1.0 / s.shared, 6) as evalue, s.shared::DOUBLE as bitscore
    from seeds s join documents d on d.doc_id = s.target_idx)"""

TOP = f"""{ALIGNMENTS}, top as (select * from alignments
    qualify row_number() over (partition by target order by evalue, bitscore desc, query) = 1)"""

PROTEINS = """proteins as (select distinct member_id || '#' || n_chars || '#1#1' as protein_header, sequence, member_header from members)"""

MATCHED = f"""{MEMBERS}, {PROTEINS}, {ALIGNMENTS},
    matched as (select protein_header, sequence from proteins where protein_header in (select target from alignments))"""

PAIRS = f"""{QUERY}, pairs as (select e.vec_id, e.label::BIGINT as query_idx, e.embedding, q.embedding as q
    from embeddings e join query q on q.query_idx = e.label)"""

NEAREST = f"""{CORPUS}, {QUERY}, ranked as (select query_idx, shard, centroid_idx, distance,
    row_number() over (partition by query_idx, shard order by distance, centroid_idx) as rank from (
      select q.query_idx, c.centroid_idx // 100 as shard, c.centroid_idx, {_distance("c.embedding", "q.embedding")} as distance
      from corpus c, query q))"""

MODEL_TEXTS = f"{SEQUENCES}, mtexts as (select centroid_idx, name, '<+>' || rtrim(sequence, '*') as t from seqs)"

EMBEDDED = f"{MODEL_TEXTS}, {_characters('mchars', 'mtexts', 'centroid_idx', 't')}, {_embedding('emb', 'mchars')}"


def _text_hits(reps: str) -> str:
    """Threshold join of embedded texts: ``reps`` has ``centroid_idx, name, sequence``."""
    return f"""{QUERY_TEXTS}, rtexts as (select centroid_idx, '<+>' || rtrim(sequence, '*') as t from {reps}),
    ptexts as (select query_idx, '<+>' || rtrim(sequence, '*') as t from qtexts),
    {_characters("rchars", "rtexts", "centroid_idx", "t")}, {_characters("pchars", "ptexts", "query_idx", "t")},
    {_embedding("remb", "rchars")}, {_embedding("pemb", "pchars")},
    rnorm as (select id, sqrt(sum(v * v)) as n from remb group by id), pnorm as (select id, sqrt(sum(v * v)) as n from pemb group by id),
    products as (select r.id as centroid_idx, p.id as query_idx, sum(r.v * p.v) as s from remb r join pemb p using (dim) group by all),
    thits as (select * from (select x.centroid_idx, x.query_idx, round(1 - x.s / (a.n * b.n), 6) + 0.0 as distance
      from products x join rnorm a on a.id = x.centroid_idx join pnorm b on b.id = x.query_idx) where distance < {TEXT_CUTOFF})"""


SEARCH = f"""with reps as (select min(doc_id) as centroid_idx, text from documents group by text),
    rseqs as (select r.centroid_idx, 'C' || r.centroid_idx || '_7_1 ' || d.lang as name, {_one_line("d.text")} as sequence
      from reps r join documents d on d.doc_id = r.centroid_idx), {_text_hits("rseqs")}
    select q.query_name, s.name as centroid_name, s.sequence, h.distance
    from thits h join rseqs s using (centroid_idx) join qtexts q using (query_idx)"""

def _deep_search() -> str:
    hits = SEARCH[: SEARCH.rindex("select q.query_name")]
    return f"""{hits}, {MEMBERS} select distinct member_header, sequence from members
        where centroid_id in (select 'C' || centroid_idx || '_7_1' from thits)"""


def _self_alignment() -> str:
    from kinspark.operators.align import blosum62

    own = ", ".join(f"('{a}', {s})" for (a, b), s in blosum62().items() if a == b)
    return f"""with {QUERY_TEXTS}, {_characters("cs", "qtexts", "query_idx", "sequence")}, own(c, s) as (values {own}),
        scored as (select id, count(*)::INTEGER as n, sum(coalesce(own.s, 5)) as s from cs left join own using (c) group by id),
        space as (select sum(n) as m from scored)
        select query_name as target, query_name as query, 1.0::DOUBLE as identity, n as alignment_length, 0::INTEGER as nb_mismatches,
        0::INTEGER as nb_gap_openings, 1::INTEGER as target_start, n as target_end, 1::INTEGER as query_start, n as query_end,
        round((0.267 * s - ln(0.041)) / ln(2), 6) as bitscore, round(ln(0.041 * n * m) - 0.267 * s, 4) as log_evalue
        from scored join qtexts on id = query_idx, space"""


# Half precision has 10 bits behind the point; below 2 ** -14 its steps are 2 ** -24.
HALVES = """with v as (select vec_id as centroid_idx, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
    s as (select *, case when x = 0 then 1 else 2.0 ** (greatest(floor(log2(abs(x))), -14) - 10) end as step from v)
    select centroid_idx, dim::INTEGER as dim, round_even(x / step, 0) * step as value from s"""

EMBED_ROWS = f"with {EMBEDDED} select id as centroid_idx, {DIM}::INTEGER as dims, dim, round(v, 6) as value from emb"


def _prefix_members() -> str:
    return f"""with {MEMBERS}, placed as (select string_split(centroid_id, '_')[1] as centroid_id, member_header from members),
            ids as (select distinct centroid_id as lookup_id from placed),
            a as (select *, {_fnv("centroid_id")} % 4 as dir from placed), b as (select *, {_fnv("lookup_id")} % 4 as dir from ids)
            select b.lookup_id, a.centroid_id, a.member_header from a join b on a.dir = b.dir and starts_with(a.member_header, b.lookup_id)"""


def sql_by_query() -> dict[str, str]:
    sequences = f"with {SEQUENCES} select name, sequence from seqs where sequence <> ''"
    named = f"with {NAMED} select query_name, centroid_name, sequence, distance from named"
    hits = f"with {HITS} select centroid_idx, query_idx, distance from hits"
    top = f"with {TOP} select target, query, round(evalue, 6) as evalue, bitscore from top"
    return {
        "s01_fasta_scan": sequences,
        "s02_compressed_fasta_scan": sequences,
        "s02_zstd_frames_scan": sequences,
        "s04_half_vectors_scan": HALVES,
        "s03_fasta_glob_scan": sequences,
        "s05_membership_scan": f"with {MEMBERSHIP} select centroid_id, member_id from membership",
        "s06_hits_scan": named,
        "s07_alignment_scan": f"with {ALIGNMENTS} select * from alignments",
        "s08_query_embeddings_scan": f"with {QUERY} select query_idx, 'query_' || query_idx as query_name, 1.0::DOUBLE as norm from query",
        "k01_diversified_hits": f"""with {NAMED} select query_name || chr(9) || centroid_name || chr(9) || sequence as line, distance, null::VARCHAR as header from named
            union all select '#query_name' || chr(9) || 'result_name' || chr(9) || 'result_sequences', null, 'cosine_distance'""",
        "k02_hit_fasta": f"with {NAMED} select centroid_name || '#' || query_name as name, sequence from named where sequence <> ''",
        "k03_unique_centroid_fasta": f"""with {NAMED} select distinct centroid_name as name, sequence from named where sequence <> ''""",
        "k04_member_fasta": f"""with {MEMBERS} select member_id || '#' || n_chars || '#1#1#' || centroid_id as name, sequence from members
            where sequence <> ''""",
        "k05_matched_fasta": f"with {MATCHED} select protein_header as name, sequence from matched where sequence <> ''",
        "k06_alignment_table": f"""with {ALIGNMENTS} select concat_ws(chr(9), target, query, '1.0', alignment_length, 0, 0, 1, target_end, 1, query_end) as line, evalue, bitscore,
            null::VARCHAR as header from alignments union all
            select concat_ws(chr(9), '#target', 'query', 'identity', 'alignment_length', 'nb_mismatches', 'nb_gap_openings', 'target_start', 'target_end',
              'query_start', 'query_end'), null, null, 'evalue' || chr(9) || 'bitscore'""",
        "k07_top_hit_table": f"with {TOP} select * from top",
        "k08_sharded_corpus": f"""select 'M' || doc_id as protein_id, 'M' || doc_id || ' # ' || n_chars || ' # 1 # 1' as header,
            {_one_line("text")} as sequence, true as placed from documents""",
        "k09_embedding_store": f"""select vec_id as centroid_idx, vec_id // 100 as chunk, round({_norm("embedding")}, 6) as norm from embeddings""",
        "k10_member_store": f"""with {MEMBERS}, hashed as (select *, {_fnv("centroid_id")} as h from members)
            select centroid_id, member_header, sequence, h % 64 as dir, (h // 64) % 1000 as grp from hashed""",
        "k11_query_embedding_store": f"with {QUERY} select query_idx, query_name, round({_norm('embedding')}, 6) as norm from query",
        "p01_distance_cutoff": f"""with {PAIRS} select * from (select vec_id, query_idx, {_distance("embedding", "q")} as distance from pairs)
            where distance < {CUTOFF}""",
        "p02_validation_report": """select case when s = '' then 'empty_sequence' else 'nucleotide_sequence' end as violation,
            count(*) as n_records from (select unnest(string_split(text, ' ')) as s from documents)
            where s = '' or regexp_full_match(s, '[ACGTNacgtn]+') group by 1""",
        "p03_drop_comments": """select doc_id, count(*) as n_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
            where trim(line) <> '' and line not like '#%' group by doc_id""",
        "p04_record_id": f"with {SEQUENCES} select centroid_idx, string_split(name, ' ')[1] as record_id from seqs",
        "p05_truncate_header": """select 'M' || doc_id || ' # ' || n_chars || ' # 1 # 1 # tail' as name,
            'M' || doc_id || ' # ' || n_chars || ' # 1 # 1' as header from documents""",
        "p06_member_header": f"""with {MEMBERS} select member_header, centroid_id as accession, member_id || '#' || n_chars || '#1#1' as member
            from members union all select centroid_id || ' ' || substring(member_header, length(centroid_id) + 2), centroid_id,
            member_id || '#' || n_chars || '#1#1' from members""",
        "p07_composite_header": f"with {SEQUENCES} select centroid_idx, name || '#query' as header from seqs",
        "p08_model_text": f"with {SEQUENCES} select centroid_idx, '<+>' || rtrim(sequence || '**', '*') as model_text from seqs",
        "p09_strip_marker": f"with {SEQUENCES} select centroid_idx, name from seqs",
        "p10_normalise": f"""with v as (select vec_id, unnest(embedding)::DOUBLE * 3 as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
            n as (select vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) + 1e-10 as n from v group by vec_id)
            select vec_id as centroid_idx, dim, round(x / n, 6) + 0.0 as value from v join n using (vec_id)""",
        "p11_unit_norm": f"""select bool_and(abs({_norm("embedding")} - 1) <= 0.00101) as all_unit,
            count(*) filter (abs(2 * {_norm("embedding")} - 1) > 0.00101) as n_not_unit from embeddings""",
        "p12_cosine_distance": f"with {PAIRS} select vec_id, query_idx, {_distance('embedding', 'q')} as distance from pairs",
        "p13_squared_l2": f"with {PAIRS} select vec_id, query_idx, {_squared_l2('embedding', 'q')} as squared_l2 from pairs",
        "p14_metric_conversion": f"""with {PAIRS} select vec_id, round(2 * list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) + 0.0 as squared_l2,
            true as agrees from pairs""",
        "p15_half_precision": "select vec_id as centroid_idx, true as within_half_precision from embeddings",
        "p15_half_precision_values": HALVES,
        "j01_similarity_scattered": hits,
        "j02_approximate_quality": f"with {HITS} select 0::BIGINT as n_wrong, true as enough, count(*) as n_exact from hits",
        "a08_shard_totals": "select count(*) as n_rows, 0::BIGINT as n_outside from documents",
        "m02_reduction_invariants": """select 'n_assigned' as stage, count(*) as n_rows from benchmark
            union all select unnest(['n_repeated', 'n_strangers', 'n_not_own']), 0""",
        "m03_alignment_violations": "select unnest(['spans', 'columns', 'gaps', 'evalue', 'existence']) as kind, 0::BIGINT as n_wrong",
        "f02_top_hits_checked": "select 0::BIGINT as n_wrong, true as any",
        "m03_self_alignment": _self_alignment(),
        "f03_deep_search": _deep_search(),
        "p16_fnv1a32": f"with {MEMBERSHIP} select centroid_id, member_id, {_fnv('centroid_id')} as hash from membership",
        "p17_bucket_coordinates": f"""with {MEMBERSHIP}, h as (select centroid_id, member_id, {_fnv("centroid_id")} as h from membership)
            select centroid_id, member_id, h % 10000 as dir, (h // 10000) % 1000 as grp from h""",
        "p18_id_shard": "select 'M' || doc_id as member_id, true as together from documents",
        "p19_range_shard": """select vec_id as centroid_idx, vec_id // 100 as shard, vec_id % 100 as local_idx, vec_id as again from embeddings""",
        "p20_fallback_query_name": f"""with {QUERY_TEXTS} select query_idx,
            case when length(sequence) > 200 then query_name else 'query_' || query_idx end as query_name from qtexts""",
        "p21_remove_whitespace": r"select doc_id, regexp_replace(text, '\s+', '', 'g') as packed from documents",
        "p22_marker_flag": """select flag, count(*) as n_records from (select contains(html, '>') as flag from pages
            union all select contains(text, '>') from documents) group by flag""",
        "j01_similarity_join": hits,
        "j02_stored_cells": hits,
        "j01_similarity_cells": f"""select * from (select c.vec_id as centroid_idx, q.vec_id as query_idx,
            {_distance("c.embedding", "q.embedding")} as distance, {_squared_l2("c.embedding", "q.embedding")} as squared_l2
            from embeddings c, embeddings q) where distance < {CUTOFF}""",
        "j03_attach_sequences": f"""with {HITS}, {SEQUENCES} select h.centroid_idx, h.query_idx, h.distance, s.name as centroid_name, s.sequence
            from hits h join seqs s using (centroid_idx)""",
        "j03_stored_sequences": f"""with {HITS}, {SEQUENCES} select h.centroid_idx, h.query_idx, h.distance, s.name as centroid_name, s.sequence
            from hits h join seqs s using (centroid_idx)""",
        "j04_attach_query_names": f"""with {HITS} select h.centroid_idx, h.query_idx, h.distance, q.query_name
            from hits h join query q using (query_idx)""",
        "j05_filter_aligned": f"""with {NAMED}, {SEEDS.replace(SEQUENCES + ", ", "")}
            select n.query_name, n.centroid_name, n.sequence, n.distance from named n where string_split(n.centroid_name, ' ')[1] in
            (select string_split(s.name, ' ')[1] from seqs s join seeds x on x.target_idx = s.centroid_idx)""",
        "j06_expand_members": f"with {MEMBERS} select centroid_id, member_header, sequence from members",
        "j07_expand_members_prefix": _prefix_members(),
        "j07_prefix_merge": _prefix_members(),
        "j08_matched_proteins": f"with {MATCHED} select protein_header, sequence from matched",
        "j09_build_members": f"with {MEMBERS} select centroid_id, member_id, member_header, sequence from members",
        "j10_kmer_candidates": f"with {SEEDS} select target_idx, query_idx, shared from seeds where shared >= 5",
        "j10_spaced_candidates": _spaced_pairs(),
        "j10_spaced_groups": _spaced_pairs(),
        "j11_self_candidates": f"""with {QUERY_TEXTS}, {_characters("qchars", "qtexts", "query_idx", "sequence")}, {_kmers("k", "qchars", 6)}
            select a.id as a_idx, b.id as b_idx, count(*) as shared from k a join k b on a.kmer = b.kmer and a.id < b.id
            group by all having count(*) >= 10""",
        "a01_matches_per_shard": f"""with {HITS} select centroid_idx // 100 as shard, count(distinct centroid_idx) as n_matches from hits group by 1""",
        "a02_stage_counts": f"""with {NAMED} select 'queries' as stage, count(*) as n_rows from query union all
            select 'hits', count(*) from hits union all select 'named_hits', count(*) from named""",
        "a03_distinct_members": f"with {MEMBERS} select distinct member_header, sequence from members",
        "a04_distinct_centroid_sequences": f"with {NAMED} select distinct centroid_name, sequence from named",
        "a05_distinct_centroids": f"""with {NAMED}, {SEEDS.replace(SEQUENCES + ", ", "")}
            select distinct string_split(n.centroid_name, ' ')[1] as centroid_id from named n where string_split(n.centroid_name, ' ')[1] in
            (select string_split(s.name, ' ')[1] from seqs s join seeds x on x.target_idx = s.centroid_idx)
            union all select distinct centroid_idx::VARCHAR from hits""",
        "a06_search_coverage": f"""with {NEAREST} select query_idx, shard, max(distance) as max_distance, count(*) as n_returned,
            count(*) >= 4 and max(distance) < {CUTOFF} as saturated from ranked where rank <= 4 group by query_idx, shard""",
        "a07_hits_by_centroid": f"""with {HITS} select centroid_idx,
            string_agg(query_idx || ':' || round(distance * 1e6)::BIGINT, ',' order by query_idx) as matches from hits group by 1""",
        "a09_store_size": "select count(*) as n_vectors, ceil(count(*) / 100.0)::BIGINT as n_shards from embeddings",
        "w01_top_hit_per_target": top,
        "w02_nearest_per_shard": f"with {NEAREST} select query_idx, shard, centroid_idx, distance, rank from ranked where rank <= 5",
        "w02_nearest_bounded": f"with {NEAREST} select query_idx, shard, centroid_idx, distance, rank from ranked where rank <= 5",
        "j01_similarity_index": hits,
        "w03_deepening_report": f"""with {HITS}, n as (select query_idx, centroid_idx // 100 as shard, count(*) as n_hits from hits group by all),
            r as (select *, case when n_hits < 2 then 1 when n_hits < 4 then 2 else 3 end as rounds from n)
            select query_idx, shard, n_hits, rounds, (2 ** rounds)::BIGINT as k, n_hits < 8 as complete from r""",
        "o01_sort_hits": hits + " order by centroid_idx, query_idx",
        "o02_sort_named_hits": named + " order by query_name, distance, centroid_name",
        "o03_sort_by_centroid": named + " order by centroid_name, sequence, query_name",
        "u01_union_hits": f"""with {HITS}, {SEQUENCES}, {_text_hits("seqs")} select centroid_idx, query_idx, distance from hits
            union all select centroid_idx, query_idx, distance from thits""",
        "u02_id_sets": """select doc_id, doc_id in (select doc_id from labels) as labelled from documents""",
        "u03_job_split": sequences,
        "m01_embed": EMBED_ROWS,
        "f01_build_index": EMBED_ROWS,
        "f02_search": SEARCH,
        "f02_search_reduced": "select unnest(['extra', 'missing', 'none']) as kind, 0::BIGINT as n_wrong",
        "f04_resume_build": EMBED_ROWS,
        "f05_reuse_query_embeddings": SEARCH,
        "f08_build_member_store": f"with {MEMBERS} select centroid_id, member_id, member_header, sequence from members",
        "t01_incremental_embedding": f"""with {EMBEDDED} select m.name, {DIM}::INTEGER as dims, e.dim, round(e.v, 6) as value from emb e
            join mtexts m on m.centroid_idx = e.id""",
    }
