"""Structure repair and the prefix trie against brute force; tree contraction on paths, stars and forests."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from kinspark.llm import contraction, repair, trie
from kinspark.llm.digests import ordered_digest

duckdb = pytest.importorskip("duckdb")
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- repair -------------------------------------------------------------------------------------


def next_state(q):
    return "a" if q == "u" else "u"


def cheapest(rows):
    """Least (cost, letters, lines) by dynamic programming over whole strings."""
    best = {"": (0, "", ())}

    def insert():
        for _ in range(4):
            for q, (c, a, o) in list(best.items()):
                n = next_state(q)
                one = (c + 3, a + "I", (*o, {"u": "user:", "a": "assistant:"}[n]))
                best[n] = min(best.get(n, one), one)

    for role, text, fault in rows:
        insert()
        new = {}
        for q, (c, a, o) in best.items():
            more = 3 if fault == "truncated" else 0
            choices = [(q, (c + 4, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                n, i = next_state(q), role[:1]
                choices.append((n, (c + 3 + more, a + "R", (*o, {"u": "user:", "a": "assistant:"}[n] + text))))
                if i == n or (i == "s" and q == ""):
                    choices.append((i, (c + more, a + "K", (*o, f"{role}:{text}"))))
            for to, one in choices:
                new[to] = min(new.get(to, one), one)
        best = new
    insert()
    return min(best[q] for q in ("", "a") if q in best)


def repaired(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        c, key, r, x = " " if c is None else str(c), " " if t is None else str(t), " " if r is None else r, " " if x is None else x
        own = convs[c]
        roll = zlib.crc32(f"{c}:{key}".encode()) % 20
        x = "" if roll == 1 else re.sub("[.!?]", "", x) if roll == 2 else x
        own += [] if roll == 0 else [(t is not None, t or 0, "user" if roll == 4 else r, x)] * (2 if roll == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort()
        turns = {t for there, t, _, _ in own if there}
        faults, seen = [], set()
        for _, _, r, x in own:
            tail = x.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append((r, x, "blank" if not tail else "duplicate" if (r, x) in seen else "truncated" if tail not in ".!?" else ""))
            seen.add((r, x))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit, lines = cheapest(faults)
        counts = (sum(f[2] == n for f in faults) for n in ("blank", "duplicate", "truncated"))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out)


def found_repairs(df, **how):
    found = repair.repair(repair.damage(df), **how)
    lines = found.turns.select("conv", "pos", F.concat_ws(":", "role", "text").alias("line"))
    joined = found.report.join(ordered_digest(lines, ["conv"], ["pos"], "line", "h", "\n"), "conv", "left").collect()
    by = {r["conv"]: r for r in joined}
    every = {" " if r[0] is None else str(r[0]) for r in df.select("conv_id").collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return sorted((c, *(by[c][n] for n in names), by[c]["audit"], by[c]["h"] or EMPTY) if c in by else (c, *(0,) * 6, "", EMPTY) for c in every)


@pytest.mark.parametrize("block_rows", [repair.BLOCK_ROWS, 3, 1])
def test_repairs_by_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    roles, texts = ["user", "assistant", "system", "", "x", None, "user", "assistant"], ["a", "b.", "c!", None, " ", "d? ", "e", "f."]
    rows = [(rng.choice([1, 2, 3, None, *range(10, 40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    assert found_repairs(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows) == repaired(rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t % 50}{rng.choice(['.', '', '!'])}") for t in range(700)]
    rows += [(t, k, "user", "hello.") for t in range(100, 800) for k in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_repairs(df, block_rows=64) == found_repairs(df) == repaired(rows)


def test_edits_rebuild_the_turns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.repair(repair.damage(df))
    turns = defaultdict(list)
    for r in found.turns.orderBy("conv", "pos").collect():
        turns[r["conv"]].append(r["role"][:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t)) for t in turns.values())
    audits = {r["conv"]: r["audit"] for r in found.report.collect()}
    letters = defaultdict(str)
    for r in found.edits.orderBy("conv", "pos").collect():
        letters[r["conv"]] += r["edit"]
    assert {c: a for c, a in audits.items() if a} == letters


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_substring_dedup", "op13_prefix_trie"])
def test_new_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    place = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[k] for k in place]) for r in result.fetchall())


# --- trie ---------------------------------------------------------------------------------------


def nodes(rows, family, heads):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(own)] for c, own in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        built = convs.get(c - c % family, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
    rest = lambda n: (min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n])
    return sorted((min(members[n]), len(n), *rest(n), sha(",".join(map(str, sorted(ends[n]))))) for n in members)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40), *range(100, 140), 305]), rng.choice([None, *range(6)]), rng.choice(["u", None, ""]), rng.choice(["é", "b", None, "cc"])) for _ in range(400)]
    rows += [(c, t, "u", "same") for c in range(500, 560) for t in range(12)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 10 * seed, 6)
    assert sorted(tuple(r) for r in got.collect()) == nodes(rows, 10 * seed, 6)


def test_totals_of_paths_stars_and_forests(spark):
    rng = random.Random(3)
    parents = {("p", k): ("p", k - 1) if k else None for k in range(60)}
    parents |= {("s", k): ("s", 0) if k else None for k in range(50)}
    parents |= {("t", k): ("t", rng.randrange(max(0, k - 3), k)) if k else None for k in range(60)}
    name = lambda n: None if n is None else f"{n[0]}{n[1]}"
    values = {n: rng.randrange(10) for n in parents}
    rows = [(name(n), name(p), values[n]) for n, p in parents.items()] + [("lone", "nowhere", None)]
    totals = defaultdict(int, {"lone": 0})
    for n in parents:
        at = n
        while at is not None:
            totals[name(at)] += values[n]
            at = parents[at]
    got = contraction.subtree_totals(spark.createDataFrame(rows, "id string, parent string, v int"), ["v"])
    assert {r["id"]: r["v"] for r in got.collect()} == totals
    assert contraction.subtree_totals(spark.createDataFrame([], "id long, parent long, v int"), ["v"]).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    wide = SCHEMA + ", conv string, seq int, pos int, depth int, id long, parent long, block int"
    empty = spark.createDataFrame([], wide)
    assert trie.prefix_trie(empty).count() == 0
    found = repair.repair(repair.damage(empty))
    assert found.report.count() == found.turns.count() == 0
    rows = [(1, 0, "user", "a.", "x", 1, 1, 1, 1, 1, 1), (1, 1, "assistant", "b" * 200_000 + ".", "x", 1, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, wide)
    assert sorted(tuple(r) for r in trie.prefix_trie(df).collect()) == nodes([r[:4] for r in rows], trie.FAMILY, trie.HEADS)
    assert found_repairs(df) == repaired([r[:4] for r in rows])
    cut = repair.repair(df).report.collect()
    assert [(r["cost"], r["audit"]) for r in cut] == [(0, "KK")]
