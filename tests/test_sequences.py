import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from kinspark.operators import align, cluster, hits, kmers, lanes, members, seeds
from kinspark.operators.skew import restrict, salted_join
from kinspark.sources import stores, tables

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def best_score(a, b, s):
    """Plain dynamic program over all cells."""
    low = -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(e[i - 1][j] - s.gap_extend, h[i - 1][j] - s.gap_open)
            f[i][j] = max(f[i][j - 1] - s.gap_extend, h[i][j - 1] - s.gap_open)
            pair = int(s.row(ord(a[i - 1]), align.code_points(b[j - 1]))[0])
            h[i][j] = max(0, h[i - 1][j - 1] + pair, e[i][j], f[i][j])
            top = max(top, h[i][j])
    return top


def mutated(rng, text, changes, letters):
    out = list(text)
    for _ in range(changes):
        p = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.4 or p == len(out):
            out.insert(p, rng.choice(letters))
        elif kind < 0.7:
            out.pop(p)
        else:
            out[p] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("scoring", [align.Scoring(), align.Scoring(match=2, mismatch=-1, gap_open=2, matrix={})])
def test_alignment_is_optimal_and_its_columns_add_up(scoring):
    rng = random.Random(7)
    for _ in range(80):
        letters = rng.choice(["ACDE", LETTERS])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        b = mutated(rng, a, rng.randint(0, 6), letters)
        found = align.local_alignment(a, b, scoring)
        assert (found[0] if found else 0) == best_score(a, b, scoring)
        if found:
            score, a0, a1, b0, b1, length, matches, mismatches, gaps = found
            gap_columns = length - matches - mismatches
            assert (a1 - a0 + 1) + (b1 - b0 + 1) == 2 * (matches + mismatches) + gap_columns
            assert gaps <= gap_columns and 1 <= a0 <= a1 <= len(a) and 1 <= b0 <= b1 <= len(b)


def test_protein_scores():
    m = align.blosum62()
    assert len(m) == 400 and all(m[a, b] == m[b, a] for a, b in m)
    s = align.Scoring()
    assert s.row(ord("W"), align.code_points("WFCx")).tolist() == [11, 1, -2, -4]
    assert s.bits(100) == pytest.approx((0.267 * 100 - math.log(0.041)) / math.log(2))
    for limit in (1e-3, 10.0):
        least = s.least_score(limit, 300, 5000)
        assert s.evalue(least, 300, 5000) <= limit < s.evalue(least - 1, 300, 5000)


def test_alignment_cases():
    s = align.Scoring(mismatch=-3, gap_open=11, matrix={})
    text = "MKVLLAWQNDEGHIKRST"
    assert align.local_alignment(text, text, s) == (5 * 18, 1, 18, 1, 18, 18, 18, 0, 0)
    changed = text[:8] + "C" + text[9:]
    assert align.local_alignment(text, changed, s)[6:] == (17, 1, 0)
    gapped = text[:9] + text[10:]
    assert align.local_alignment(text, gapped, s)[5:] == (18, 17, 0, 1)
    assert align.local_alignment("AAAA", "WWWW", s) is None
    assert align.local_alignment("", "A", s) is None
    rng = random.Random(1)
    long = "".join(rng.choice(LETTERS) for _ in range(20_000))
    assert align.local_alignment(long, long[7000:7300], s)[:5] == (1500, 7001, 7300, 1, 300)


def test_scoring_matrix_text():
    s = align.Scoring.from_matrix_text("# c\n  A  C\nA 4 -2\nC -2 9\n")
    assert s.row(ord("A"), align.code_points("ACW")).tolist() == [4, -2, -4]


def sequences(spark, key, texts):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, sequence string")


def shared_by_brute_force(targets, queries, k, m):
    cut = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    counts = ((t, q, len(cut(a) & cut(b))) for t, a in enumerate(targets) for q, b in enumerate(queries))
    return sorted(c for c in counts if c[2] >= m)


@pytest.mark.parametrize("limit", [kmers.MAX_INDEX_BYTES, 0])
@pytest.mark.parametrize("m", [1, 3])
def test_kmer_candidates(spark, limit, m):
    rng = random.Random(3)
    # Two letters make every k-mer common; the empty and the short text have none.
    targets = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 30))) for _ in range(30)] + ["", "a", "çé日本語ab" * 3]
    queries = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(5)] + ["", "日本語abçé", "zzzzzzzz"]
    got = kmers.kmer_candidates(sequences(spark, "target_idx", targets), sequences(spark, "query_idx", queries), 4, m, limit)
    assert rows(got) == shared_by_brute_force(targets, queries, 4, m)


def test_self_candidates(spark):
    texts = ["abcdefgh", "xxabcdef", "abcdefgh", "zzzzzz"]
    got = kmers.self_candidates(sequences(spark, "query_idx", texts), 4, 2)
    want = [(a, b, n) for a, b, n in shared_by_brute_force(texts, texts, 4, 2) if a < b]
    assert rows(got) == want


def test_align_repeats_results_for_copies(spark):
    rng = random.Random(5)
    base = "".join(rng.choice(LETTERS) for _ in range(120))
    other = "".join(rng.choice(LETTERS) for _ in range(120))
    targets = [("t1", base), ("t2", mutated(rng, base, 6, LETTERS)), ("t3", base), ("far", other), ("t1", base)]
    queries = [("q", base), ("w", "W" * 40)]
    got = align.align(
        spark.createDataFrame(targets, ["target", "sequence"]), spark.createDataFrame(queries, ["query", "sequence"]), k=4, min_shared=3
    )
    found = align.best_first(got).collect()
    assert got.columns == list(tables.ALIGNMENT_COLUMNS)
    assert sorted(r.target for r in found) == ["t1", "t1", "t2", "t3"] and {r.query for r in found} == {"q"}
    first = found[0]
    assert first.target == "t1" and first.identity == 1.0 and first.nb_gap_openings == 0 and first.target_end == 120
    s = align.Scoring()
    own = sum(s.matrix[x, x] for x in base)
    assert first.evalue == pytest.approx(s.evalue(own, 120, 160)) and first.bitscore == pytest.approx(s.bits(own), abs=1e-6)
    ids = align.aligned_centroids(
        spark.createDataFrame([("c1_7_1 text", base), ("c2_7_1 text", other)], ["centroid_name", "sequence"]),
        spark.createDataFrame(queries, ["query", "sequence"]),
    )
    assert rows(ids) == [("c1_7_1",)]


def test_queries_of_one_name_stay_apart(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choice(LETTERS) for _ in range(90)) for _ in range(2))
    targets = spark.createDataFrame([("ta", a), ("tb", b), ("none", None)], "target string, sequence string")
    queries = spark.createDataFrame([("q", a), ("q", b), ("empty", None)], "query string, sequence string")
    found = align.align(targets, queries, k=4, min_shared=3).select("target", "query", "identity").collect()
    assert sorted(map(tuple, found)) == [("ta", "q", 1.0), ("tb", "q", 1.0)]
    named = targets.withColumnRenamed("target", "centroid_name")
    assert rows(align.aligned_centroids(named, queries, k=4, min_shared=3)) == [("ta",), ("tb",)]


@pytest.mark.parametrize("block", [cluster.NODES_PER_BLOCK, 2, 1])
def test_reduce_redundancy(spark, block):
    rng = random.Random(11)
    a = "".join(rng.choice(LETTERS) for _ in range(200))
    change = lambda s, at: s[:at] + ("W" if s[at] != "W" else "C") + s[at + 1 :]
    b, c = a, None
    for at in range(0, 200, 11):  # 19 changes: a and b are just linked
        b = change(b, at)
    c = b
    for at in range(5, 200, 11):  # b and c are linked, a and c are not
        c = change(c, at)
    other = "".join(rng.choice(LETTERS) for _ in range(90))
    table = [(0, a + "MK"), (1, b + "M"), (2, c), (3, other), (4, other), (5, a + "MK"), (6, other)]
    df = spark.createDataFrame(table, "query_idx long, sequence string")
    reps, assignment = cluster.reduce_redundancy(df, k=4, min_shared=2, block=block)
    # The chain a - b - c: a represents b, and c, only linked to b, stands for itself.
    assert sorted(r.query_idx for r in reps.collect()) == [0, 2, 3]
    assert rows(assignment) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 0), (6, 3)]


def greedy_reps(table, s):
    """Sequential greedy clustering, all pairs aligned."""
    owner, reps = {}, []
    for key, text in sorted(table, key=lambda r: (-len(r[1]), r[0])):
        for rep_key, rep in reps:
            found = align.local_alignment(text, rep, s)
            if found and round(found[6] / found[5], 6) >= 0.9 and (found[2] - found[1] + 1) / len(text) >= 0.8:
                owner[key] = rep_key
                break
        else:
            reps.append((key, text))
            owner[key] = key
    return sorted(owner.items())


@pytest.mark.parametrize("block", [cluster.NODES_PER_BLOCK, 7])
def test_reduce_redundancy_equals_sequential_greedy(spark, block):
    rng = random.Random(13)
    table = []
    for _ in range(4):
        base = "".join(rng.choice(LETTERS) for _ in range(80))
        table += [mutated(rng, base, rng.randint(0, 9), LETTERS) for _ in range(7)]
    table = list(enumerate(table))
    df = spark.createDataFrame(table, "query_idx long, sequence string")
    _, assignment = cluster.reduce_redundancy(df, k=3, min_shared=1, block=block)
    assert rows(assignment) == greedy_reps(table, align.Scoring())


def test_filter_aligned_keeps_hits_by_id_without_description(spark):
    named = spark.createDataFrame(
        [("q", "c1_7_1 some text", "MK", 0.1), ("q", "c2_7_1 some text", "ML", 0.1)], list(tables.HIT_COLUMNS)
    )
    ids = spark.createDataFrame([("c1_7_1",), ("1_7_1",)], ["centroid_id"])
    assert [r.centroid_name for r in hits.filter_aligned(named, ids).collect()] == ["c1_7_1 some text"]


def test_members_exact_and_prefix(spark):
    from kinspark.functions.hashing import bucket_dir

    store = [("X_7_1", "X_7_1_M1 # 1", "MK"), ("X_7_10", "X_7_10_M2 # 1", "ML")] + [
        (f"X_7_1{i}", f"X_7_1{i}_M", "MM") for i in range(20)
    ]
    df = spark.createDataFrame(store, ["centroid_id", "member_header", "sequence"])
    ids = spark.createDataFrame([("X_7_1",), ("absent",), ("X_7_1",)], ["centroid_id"])
    assert rows(members.expand_members(ids, df)) == [store[0]]
    placed = {r.centroid_id: r.dir for r in df.select("centroid_id", bucket_dir("centroid_id", 3).alias("dir")).collect()}
    want = sorted(h for c, h, _ in store if placed[c] == placed["X_7_1"])
    got = members.expand_members(ids, df, "prefix", dirs=3, groups=1)
    assert sorted(r.member_header for r in got.collect()) == want and 1 < len(want) < len(store)
    assert {r.lookup_id for r in got.collect()} == {"X_7_1"}


@pytest.mark.parametrize("limit", [members.MAX_ID_BYTES, 0])
def test_prefixes_by_brute_force(spark, limit):
    """Ids that begin other ids, a crowded bucket, repeated rows, nulls, and columns beyond those known."""
    from kinspark.functions.hashing import bucket_dir, bucket_group

    rng = random.Random(limit)
    store = [(c, f"{c}{rng.choice(['', '_', 'b'])}{rng.randint(0, 3)} # 1", "MK", k) for k, c in enumerate(rng.choice(["a", "ab", "aba", "é", "éa", "b", "hot"]) for _ in range(300))]
    store += [("a", None, "MK", 1), ("hot", "hot_1", None, 2), ("hot", "hot_1", None, 2)]
    df = spark.createDataFrame(store, "centroid_id string, member_header string, sequence string, extra int")
    ids = spark.createDataFrame([("a",), ("ab",), ("",), ("é",), ("hot",), ("ho",), (None,), ("a",)], ["centroid_id"])
    known = {r[0] for r in ids.collect() if r[0] is not None} | {s[0] for s in store}
    spots = spark.createDataFrame([(x,) for x in known], ["i"]).select("i", bucket_dir("i", 2).alias("d"), bucket_group("i", 2, 2).alias("g")).collect()
    at = {r["i"]: (r["d"], r["g"]) for r in spots}
    want = [(i, *s) for i in ("a", "ab", "", "é", "hot", "ho") for s in store if s[1] is not None and at[i] == at[s[0]] and s[1].startswith(i)]
    got = members.expand_members(ids, df, "prefix", dirs=2, groups=2, limit=limit)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and want
    assert members.expand_members(ids.limit(0), df, "prefix", limit=limit).isEmpty()
    assert members.expand_members(ids, df.limit(0), "prefix", limit=limit).isEmpty()


def test_expand_reads_only_the_folders_it_needs(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", f"c{i}_m", "MK") for i in range(40)], ["centroid_id", "member_header", "sequence"])
    path = str(tmp_path / "store")
    stores.write_member_store(df, path, buckets=8)
    found = members.expand_members(spark.createDataFrame([("c7",)], ["centroid_id"]), stores.read_member_store(spark, path), store_dirs=8)
    plan = plan_of(found)
    assert "Exchange hashpartitioning" not in plan and "dir" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.member_header for r in found.collect()] == ["c7_m"]


def test_same_protein_under_two_representatives_stays_twice(spark):
    expanded = spark.createDataFrame([("c1_m", "MK"), ("c2_m", "MK"), ("c1_m", "MK")], ["member_header", "sequence"])
    assert rows(members.distinct_members(expanded)) == [("c1_m", "MK"), ("c2_m", "MK")]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_matched_proteins_by_header_or_first_token(spark, limit):
    proteins = spark.createDataFrame([("a b", "1"), ("c d", "2"), ("e", "3"), ("f g", "4")], ["protein_header", "sequence"])
    alignments = spark.createDataFrame([(">a",), ("c d",), ("c",), ("e",), ("g",)], ["target"])
    assert rows(members.matched_proteins(proteins, alignments, limit)) == [("a b", "1"), ("c d", "2"), ("e", "3")]


def test_top_hit(spark):
    make = lambda t, q, e, b: (t, q, 1.0, 1, 0, 0, 1, 1, 1, 1, e, b)
    df = spark.createDataFrame([make("t", "b", 1e-5, 9.0), make("t", "a", 1e-5, 9.0), make("t", "c", 1e-5, 10.0), make("u", "z", 1e-9, 1.0)], tables.ALIGNMENT_SCHEMA)
    top = hits.top_hit_per_target(df)
    assert rows(top.select("target", "query")) == [("t", "c"), ("u", "z")]
    assert "WindowGroupLimit" in plan_of(top)


def test_joins_have_no_cartesian_product(spark, sf_dir):
    from kinspark.plans import views

    for df in (views.membership(spark, sf_dir), views.members(spark, sf_dir), views.representatives(spark, sf_dir)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucketed_expansion_needs_no_exchange(spark):
    df = spark.createDataFrame([(f"c{i % 9}", f"m{i}") for i in range(90)], ["centroid_id", "member_header"])
    stores.save_bucketed(df, "bucket_members", "centroid_id", 4)
    stores.save_bucketed(df.select("centroid_id").distinct().where("centroid_id < 'c5'"), "bucket_ids", "centroid_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = members.expand_bucketed_members(spark.table("bucket_ids"), spark.table("bucket_members"))
        assert "Exchange" not in plan_of(found) and found.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucket_members")
        spark.sql("drop table bucket_ids")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    many = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50), ("none", 51)], ["k", "v"])
    one = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("spare", "z")], ["k", "w"])
    want = rows(many.join(one, "k", how).na.fill(""))
    assert rows(salted_join(many, one, "k", how, salts=4).na.fill("")) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(salted_join(many, one, "k", how, salts=4).na.fill("")) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_restrict_both_ways(spark):
    big = spark.createDataFrame([(i % 10, i) for i in range(100)], ["k", "v"])
    ids = spark.createDataFrame([(3,), (3,), (11,)], ["k"])
    small, large = restrict(big, ids, "k"), restrict(big, ids, "k", limit=0)
    assert rows(small) == rows(large) == [(3, i) for i in range(3, 100, 10)]
    assert "Exchange hashpartitioning" not in plan_of(small)


# --- inexact seeds and lanes ---------------------------------------------------------------------

AMINO = align.AMINO_ACIDS


def relatives(rng, text, rate, indel=0.01):
    """A copy with likely substitutions at ``rate`` and a few insertions and deletions."""
    matrix, out = align.blosum62(), []
    for c in text:
        if rng.random() < indel:
            continue
        likely = [(x, 2.0 ** (matrix[c, x] / 2)) for x in AMINO if x != c]
        out.append(rng.choices([x for x, _ in likely], [w for _, w in likely])[0] if rng.random() < rate else c)
        if rng.random() < indel:
            out.append(rng.choice(AMINO))
    return "".join(out)


def pairs_by_brute_force(targets, queries, shape):
    fold = shape.folded()
    cut = lambda s: "".join(chr(fold[ord(c)]) if ord(c) < 128 else c for c in s)
    found = {}
    for t, a in enumerate(map(cut, targets)):
        for q, b in enumerate(map(cut, queries)):
            hits = set()
            for pattern in shape.patterns:
                places = [k for k, x in enumerate(pattern) if x == "1"]
                for i in range(len(a) - len(pattern) + 1):
                    for j in range(len(b) - len(pattern) + 1):
                        if all(a[i + k] == b[j + k] for k in places):
                            hits.add((i - j, i))
            good = {d for d, i in hits if any(d == e and shape.apart <= i - h <= shape.reach for e, h in hits)}
            if good:
                found[t, q] = len(good)
    return sorted((*k, n) for k, n in found.items())


@pytest.mark.parametrize("limit,hits_at_once", [(1 << 26, 1 << 21), (2000, 50)])
def test_spaced_candidates_by_brute_force(spark, monkeypatch, limit, hits_at_once):
    monkeypatch.setattr(seeds, "MAX_HITS", hits_at_once)
    monkeypatch.setattr(seeds, "PIECE", 60)
    rng = random.Random(hits_at_once)
    shape = seeds.SeedShape(patterns=("111", "1011"), apart=4, reach=12)
    targets = ["".join(rng.choice("ACDEé") for _ in range(rng.randint(0, 60))) for _ in range(25)] + ["", "a" * 40, "LIVM" * 6, "cccc"]
    queries = ["".join(rng.choice("ACDEé") for _ in range(25)) for _ in range(8)] + ["A" * 30, "VVVVVVVVVV", "", "x"]
    got = seeds.spaced_candidates(sequences(spark, "target_idx", targets), sequences(spark, "query_idx", queries), shape, limit)
    assert rows(got) == pairs_by_brute_force(targets, queries, shape)
    kept = seeds.spaced_candidates(sequences(spark, "target_idx", targets), sequences(spark, "query_idx", queries), shape, limit, keep_sequence=True)
    assert all(r["sequence"] == targets[r["target_idx"]] for r in kept.collect())
    assert seeds.spaced_candidates(sequences(spark, "target_idx", targets), sequences(spark, "query_idx", []), shape).count() == 0


def test_inexact_seeds_find_distant_relatives(spark):
    """Against all pairs aligned: exact 6-mers miss most, inexact seeds hardly any."""
    rng = random.Random(11)
    base = ["".join(rng.choice(AMINO) for _ in range(rng.randint(120, 260))) for _ in range(40)]
    targets = [relatives(rng, b, 0.6) for b in base]
    scoring, space = align.Scoring(), sum(map(len, base))
    all_pairs = [(t, q) for t in range(40) for q in range(40)]
    scores = align.local_alignments([(targets[t], base[q]) for t, q in all_pairs], scoring, [1] * len(all_pairs), True)
    true = {p for p, s in zip(all_pairs, scores) if s and scoring.evalue(s[0], len(targets[p[0]]), space) <= align.MAX_EVALUE}
    exact = {(t, q) for t, q in all_pairs if len(kmers.kmer_set(targets[t], 6) & kmers.kmer_set(base[q], 6)) >= 2}
    assert len(true) >= 38 and len(exact & true) < 0.5 * len(true)
    t, q = sequences(spark, "target", targets), sequences(spark, "query", base)
    found = {(r["target_idx"], r["query_idx"]) for r in seeds.spaced_candidates(t.withColumnRenamed("target", "target_idx"), q.withColumnRenamed("query", "query_idx")).collect()}
    assert len(found & true) >= 0.9 * len(true)
    assert len(found) < 0.25 * len(all_pairs)
    aligned = align.align(t.selectExpr("string(target) as target", "sequence"), q.selectExpr("string(query) as query", "sequence"), shape=seeds.SeedShape())
    assert {(int(r["target"]), int(r["query"])) for r in aligned.collect()} == found & true


@pytest.mark.parametrize("tile", [lanes.LEAST_TILE, 8])
@pytest.mark.parametrize("scoring", [align.Scoring(), align.Scoring(match=3, mismatch=-2, gap_open=4, gap_extend=2, matrix={})])
def test_lanes_find_the_first_best_cell(monkeypatch, tile, scoring):
    monkeypatch.setattr(lanes, "LEAST_TILE", tile)
    monkeypatch.setattr(lanes, "LANE_CELLS", 400)
    rng = random.Random(tile)
    pairs = [("", "A"), ("AAAA", "WWWW"), ("é" * 30, "é" * 50)]
    for _ in range(60):
        letters = rng.choice(["AB", "ARND", AMINO + "xyz"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(1, n))) for n in (30, 80))
        pairs.append((a, b[:20] + a[len(a) // 4 :] + b[20:]))

    def cells(a, b):
        go, ge = scoring.gap_open, scoring.gap_extend
        rows_, columns = (a, b) if len(a) <= len(b) else (b, a)
        h = [[0] * (len(columns) + 1) for _ in range(len(rows_) + 1)]
        e, f = ([[-go] * (len(columns) + 1) for _ in range(len(rows_) + 1)] for _ in range(2))
        best = (0, 0, 0)
        for i in range(1, len(rows_) + 1):
            scores = scoring.row(ord(rows_[i - 1]), align.code_points(columns)).tolist()
            for j in range(1, len(columns) + 1):
                e[i][j] = max(e[i - 1][j] - ge, h[i - 1][j] - go)
                f[i][j] = max(f[i][j - 1] - ge, h[i][j - 1] - go)
                h[i][j] = max(0, h[i - 1][j - 1] + scores[j - 1], e[i][j], f[i][j])
                if h[i][j] > best[0]:
                    best = (h[i][j], i, j)
        return best

    for (a, b), got in zip(pairs, align.local_alignments(pairs, scoring, [1] * len(pairs))):
        score, i, j = cells(a, b)
        if not score:
            assert got is None
        else:
            ends = (got[2], got[4]) if len(a) <= len(b) else (got[4], got[2])
            assert (got[0], *ends) == (score, i, j)


def test_a_mismatch_must_cost_something():
    with pytest.raises(ValueError):
        align.local_alignment("AB", "BA", align.Scoring(mismatch=0))


def test_tasks_of_the_alignment_grow_with_the_pairs(spark):
    pairs = spark.createDataFrame([(1, "MKVLAW", 1, "MKVLAW")], "target_idx long, sequence string, query_idx long, query_sequence string")
    few, many = (align.align_pairs(pairs, 6, align.Scoring(), None, n_pairs=n) for n in (1, 20 * align.PAIRS_PER_TASK))
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 20
    assert [tuple(r) for r in many.collect()] == [tuple(r) for r in few.collect()] != []
