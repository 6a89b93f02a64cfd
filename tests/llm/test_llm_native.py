"""Fingerprints, mixing, quality rules, license scans, page text and the Jaccard join against brute force."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter, defaultdict
from re import _parser as sre

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from kinspark.llm import components, fingerprint, jaccard, licenses, mixing, pages, quality

duckdb = pytest.importorskip("duckdb")
SPACE = "[\x20\x09-\x0d]+"


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", plan)


@pytest.mark.parametrize("name", ["op2_fingerprints", "op6_mixing", "op9_quality_rules", "op10_license_scan"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    assert not python_nodes(registry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op6_mixing", "op9_quality_rules"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    place = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[k] for k in place]) for r in result.fetchall())


# --- fingerprints -------------------------------------------------------------------------------


def leaves(text):
    return [x for s in re.split("(?<=\n\n)", text) for p in re.split("(?<=\n)", s) for x in re.split("(?<=[.!?;] )", p)]


def test_fingerprints_by_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    for size in (7, 4000):
        monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", size)
        bounds, _, _ = fingerprint.range_bounds(docs, "doc_id", size)
        assert (len(bounds) > 20) == (size == 7)
        found = {r["_key"]: r["next"]["text"] for r in fingerprint.with_next(docs, rows_per_range=size).withColumnRenamed("doc_id", "_key").collect()}
        assert found == {k: rows[(n + 1) % len(rows)][1] for n, (k, _) in enumerate(rows)}
    result = {r["doc_id"]: r for r in fingerprint.compare_with_edit(docs).collect()}
    for n, (k, text) in enumerate(rows):
        after, r = rows[(n + 1) % len(rows)][1], result[k]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = set(leaves(text)), set(leaves(other))
            assert value == pytest.approx(len(a & b) / len(a | b))
    assert len({r["fingerprint"] for r in result.values()}) == len({t for _, t in rows})


def test_differing_nodes_locate_an_edit(spark):
    df = spark.createDataFrame([("One. Two.\nThree.\n\nFour.\nFive.", "One. Two.\nThree.\n\nFour.\nSix.")], "a string, b string")
    df = df.select(fingerprint.tree(F.col("a")).alias("a"), fingerprint.tree(F.col("b")).alias("b"))
    r = df.select(*(F.size(fingerprint.differing(F.col("a"), F.col("b"), level)).alias(level) for level in ("sections", "paragraphs"))).first()
    assert tuple(r) == (1, 1)


# --- mixing -------------------------------------------------------------------------------------


def test_poisson_counts(spark):
    table = spark.createDataFrame([(0.0,), (0.3,), (2.5,), (40.0,)], "rate double").withColumn("t", mixing.poisson_table(F.col("rate")))
    for r in table.collect():
        want, p = [], math.exp(-r["rate"])
        for k in range(len(r["t"])):
            want.append((want[-1] if want else 0) + p)
            p = p * r["rate"] / (k + 1)
        assert r["t"] == pytest.approx(want) and r["t"][-1] == pytest.approx(1)


def test_shares_reach_their_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("some text").alias("text"))
    counts = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert counts["a"] + counts["b"] == pytest.approx(6000, rel=0.05) and counts["a"] / counts["b"] == pytest.approx(3, rel=0.08)
    # Named weights may ask for any rate: one document of 2,001 times 9 characters for nearly all of the mix.
    rare = mixing.mix(docs.where("source = 'b' and doc_id < 3000 or doc_id = 3"), {"a": 1000, "b": 1}).where("source = 'a'").count()
    assert rare == pytest.approx(2001 * 1000 / 1001, abs=5 * 2001**0.5)


def test_null_keys_are_spread_over_tasks(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sizes = [r["n"] for r in mixing.mix(docs, partitions=8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_a_tiny_source_is_repeated_at_any_rate(spark):
    # One character against a source of 1.5 billion: a mean of 566 copies, of 30 documents of which all but one are empty.
    tiny = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("tiny").alias("source"), F.when(F.col("id") == 0, "x").otherwise("").alias("text"))
    large = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("large").alias("source"), F.expr("repeat('y', 5000000)").alias("text"))
    mass = 300 * 5_000_000
    rate = (mass + 1) / (mass**0.7 + 1)
    found = {r["source"]: r for r in mixing.source_rates(tiny.union(large)).collect()}
    assert found["tiny"]["_rate"] == pytest.approx(rate) and rate > mixing.MAX_RATE and found["tiny"]["_draws"] == 2 and found["large"]["_draws"] == 1
    mixed = mixing.mix(tiny.union(large)).where("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_number").alias("last")).collect()
    copies = [r["n"] for r in mixed]
    assert len(copies) == 30 and all(r["n"] == r["last"] for r in mixed)
    assert sum(copies) / 30 == pytest.approx(rate, abs=5 * (rate / 30) ** 0.5)
    variance = sum((n - rate) ** 2 for n in copies) / 30
    assert 0.3 * rate < variance < 3 * rate


# --- quality ------------------------------------------------------------------------------------


def brute_measures(text):
    w = [x for x in re.split(SPACE, text) if x]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count, seen, again = Counter(windows), set(), 0
    covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), again, len(covered)


def test_measures_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "#", "ab&", "\n", "\n", "\t ", "é", "\xa0", "\x85"]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "h") for k, t in rows], "doc_id long, text string, source string")
    found = quality.judge(docs).collect()
    want = dict(rows)
    for r in found:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_measures(want[r["doc_id"]])


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = "some clean words that never repeat in this short little text here now", "x ###### y $$$$$$ z ****** a %%%%%% b c d e f g h"
    rows = [(k, good, "https://www.good.org/a") for k in range(40)] + [(100 + k, bad, "bad.org") for k in range(40)]
    rows += [(200, good, "bad.org"), (300, bad, "tiny.org"), (301, good, "tiny.org")]
    rows += [(1000 + 10 * h + k, good, f"h{h}.org") for h in range(20) for k in range(5)]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[0]["host"] == "good.org" and found[0]["kept"] and not found[200]["kept"] and not found[200]["base_failed"]
    assert found[301]["kept"]  # two documents are not enough to condemn a host


# --- licenses -----------------------------------------------------------------------------------


def labels_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_license_labels(spark):
    assert len(licenses.rules()) > 300
    cases = {
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "under the GNU Lesser General Public License version 2.1 or later": "gpl,lgpl-2.1",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
        "nothing of the kind, mit ohne license": "",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    }
    found = labels_of(spark, list(cases))
    assert [r["labels"] for r in found] == list(cases.values())
    assert all((r["score"] > 0) == bool(r["labels"]) for r in found)


def test_license_places_by_brute_force(spark):
    rng = random.Random(4)
    words = ["MIT", "license", "Apache", "general", "public", "license", "mit", "x", "é", "copyright", "gnu"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for text, r in zip(texts, labels_of(spark, texts)):
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        places = [(k, name) for phrase, name in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_contained_spans_are_suppressed():
    names = [r["label"] for r in licenses.rules()]
    assert names.index("apache-2.0") < len(names)  # identifiers come first
    assert licenses.rules()[0]["confidence"] == 1.0


def spelled(parts, longest):
    """A text that a pattern matches: without its options and by the first alternatives, or with them and by the last."""
    out = ""
    for op, value in parts:
        if op is sre.LITERAL:
            out += chr(value)
        elif op is sre.IN:
            kind, own = value[0]
            out += chr(own[0]) if kind is sre.RANGE else chr(own)
        elif op is sre.ANY:
            out += "x"
        elif op is sre.BRANCH:
            out += spelled(value[1][-1 if longest else 0], longest)
        elif op is sre.SUBPATTERN:
            out += spelled(value[-1], longest)
        else:
            assert op is sre.MAX_REPEAT, op
            low, high, own = value
            out += spelled(own, longest) * (min(high, 3) if longest else low)
    return out


def test_every_license_rule_fires_on_its_own_text(spark):
    rules = licenses.rules()
    whole = [re.compile(r["pattern"]) for r in rules]
    plain = [r["pattern"].removeprefix("(?<= )(?:").removesuffix(")(?= )") for r in rules]
    texts = [" ".join(spelled(sre.parse(p), longest).split()) for p in plain for longest in (False, True)]
    for k, (text, r) in enumerate(zip(texts, labels_of(spark, texts))):
        norm = f" {text} "
        assert whole[k // 2].search(norm) and rules[k // 2]["keyword"] in norm, text
        spans = sorted((m.start(), -m.end(), own["rank"]) for own, p in zip(rules, whole) for m in p.finditer(norm))
        want, end = {name for phrase, name in licenses.BASE.items() if f" {phrase} " in norm}, -1
        for start, neg, rank in spans:
            if -neg > end:
                want.add(rules[rank]["label"])
                end = -neg
        assert r["labels"] == ",".join(sorted(want)), text


# --- pages --------------------------------------------------------------------------------------

PAGE = """<html><body><header><a href="/">Site name</a></header><nav><ul><li><a>Menu</a></ul></nav>
<div id="cookieNotice">We use cookies on this site, and you agree to them.</div>
<div class="post"><h1>Title &amp; more</h1><p>First  long paragraph, with <a href="x">a link</a> and quite\nsome words in it to be text.</p>
<p>Short.</p><form>Your mail <input></form><div class="ad-slot">Buy this product now</div>
<p>Second long paragraph, which also has quite some words in it &#233; so that it counts as text.</p></div>
<aside>Other stories that are related to this one</aside><script>if (a < b) "</p>";</script>
<section class="comments"><p>A reader wrote a long comment here that looks just like text, and goes on and on.</p></section>
<footer>Imprint and all rights reserved</footer></body></html>"""


def test_page_text():
    assert pages.main_lines(PAGE) == [
        "Title & more",
        "First long paragraph, with a link and quite some words in it to be text.",
        "Short.",
        "Second long paragraph, which also has quite some words in it é so that it counts as text.",
    ]


def test_page_names_that_only_describe_the_page():
    body = "<p>Some paragraph of text that is long enough to be read as text by anyone.</p>"
    assert len(pages.main_lines(f'<body><div class="layout has-sidebar no-comments">{body}</div></body>')) == 1
    assert len(pages.main_lines(f'<article class="post comments-open">{body}</article><article class="comment">{body}{body}</article>')) == 1
    assert pages.main_lines(f'<div class="comments">{body}</div><div class="ad">{body}</div>') == []
    assert len(pages.main_lines(f'<div class="menu-page"><article>{body}</article></div>')) == 1
    nested = f'<article>{body}<article class="comment">{body}</article><div class="reply">{body}</div></article>'
    assert len(pages.main_lines(nested)) == 1


def test_a_dropped_paragraph_ends_at_the_next_block():
    text = "Some paragraph of text that is long enough to be read as text by anyone."
    for ad in ('<p class="ad">Buy this now', '<p class="ad">Buy <span class="ad">this now', '<p class="ad">Buy <button>this</button> now'):
        assert pages.main_lines(f"<div>{ad}<p>{text}<p>{text}<div>{text}</div></div>") == [text] * 3


def test_link_lists_within_an_article_are_kept():
    text = "Some paragraph of text that is long enough to be read as text by anyone."
    links = "".join(f'<li><a href="{k}">Source {k}</a></li>' for k in range(5))
    assert pages.main_lines(f"<article><p>{text}</p><ul>{links}</ul><p>{text}</p></article>") == [text, *(f"Source {k}" for k in range(5)), text]


def test_regions_keep_all_of_the_text():
    text = " ".join(["word"] * 40)
    many = lambda n: "".join(f"<p>{text} {k}</p>" for k in range(n))
    count = lambda html: len(pages.main_lines(html))
    # An article in two parts; a teaser within a main text; sections; a table between paragraphs; one block in another.
    assert count(f"<body><article>{many(3)}</article><article>{many(2)}</article></body>") == 5
    assert count(f'<main>{many(8)}<article class="card"><p>teaser text</p></article></main>') == 9
    assert count(f"<body><section>{many(6)}</section><section>{many(2)}</section></body>") == 8
    cells = "".join(f"<tr><td>a{k}</td><td>b{k}</td></tr>" for k in range(4))
    assert count(f"<body><div>{many(3)}<table>{cells}</table>{many(3)}</div></body>") == 14
    assert count("<body>" + "".join(f"<div>{text} {k}" for k in range(1000))) == 1000
    # Words that name a subject within an article.
    for name in ('class="social-science"', 'id="related-work"', 'class="legal"', 'class="notice-of-motion"'):
        assert count(f"<article>{many(3)}<div {name}><p>{text}</p></div></article>") == 4
        assert count(f"<article>{many(3)}<p {name}>{text}</p></article>") == 4
    for name in ("social-share", "related-posts", "ad-slot-2", "commentList", "cookie_notice"):
        assert count(f'<article>{many(3)}<div class="{name}"><p>{text}</p></div></article>') == 3


def test_ratios_choose_the_lines_of_pages_without_marks(monkeypatch):
    """Menus and imprints without any name: short lines and links around the text."""
    rng, made = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    for _ in range(60):
        text = [" ".join(word() for _ in range(rng.randint(25, 90))) for _ in range(rng.randint(4, 12))]
        short = lambda n: "".join(f"<div><b><i>{word()}</i></b></div>" for _ in range(n))
        made.append((f"<body><div>{short(rng.randint(15, 30))}</div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div>{short(rng.randint(15, 30))}</div></body>", text))
    assert all(pages.main_lines(h) == text for h, text in made)
    monkeypatch.setattr(pages, "smoothed_ratios", lambda lengths, tags: np.ones(len(lengths)))
    assert sum(pages.main_lines(h) != text for h, text in made) > 50


def test_ratios_and_clusters_by_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 60)
        lengths, tags = [rng.choice([2, 9, 60, 400]) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)]
        got = pages.smoothed_ratios(np.array(lengths, float), np.array(tags, float))
        for i in range(n):
            near = [(math.exp(-((i - j) ** 2) / (2 * pages.SIGMA**2)), lengths[j] / max(tags[j], 1)) for j in range(n) if abs(i - j) <= 3]
            assert got[i] == pytest.approx(sum(w * r for w, r in near) / sum(w for w, _ in near))
        content, linked = [rng.random() < 0.4 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        content[rng.randrange(n)] = True
        runs, at = [], 0
        while at < n:
            end = at
            while end < n and content[end]:
                end += 1
            if end > at:
                runs.append((at, end))
            at = max(end, at + 1)
        size = lambda r: sum(lengths[r[0] : r[1]])
        main = max(range(len(runs)), key=lambda k: (size(runs[k]), -k))
        want = [runs[main]]

        def near_gap(a, b):
            gap = sum(lengths[a:b])
            link = sum(x for x, k in zip(lengths[a:b], linked[a:b]) if k)
            return (b - a <= pages.GAP_LINES or gap <= pages.GAP_SHARE * sum(map(size, want))) and not (link > 0.5 * gap and b - a > 2)

        for k in range(main - 1, -1, -1):
            if not near_gap(runs[k][1], want[0][0]):
                break
            want.insert(0, runs[k])
        for k in range(main + 1, len(runs)):
            if not near_gap(want[-1][1], runs[k][0]):
                break
            want.append(runs[k])
        assert pages.text_clusters(np.array(content), np.array(lengths, float), np.array(linked)) == want


def test_deep_pages_take_time_and_memory_by_their_length():
    started = time.perf_counter()
    assert len(pages.main_lines("<div>x y " * 50_000)) == 50_000
    assert pages.main_lines("<div>" * 50_000 + "</span></p>" * 1000 + "x") == ["x"]
    assert time.perf_counter() - started < 20


def test_articles_of_the_given_pages(spark, sf_dir):
    import html

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in rows:
        article = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert pages.main_lines(r["html"]) == [x for x in lines if x]
        # The same without the marks.
        assert pages.main_lines(r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) == [x for x in lines if x]


# --- Jaccard join -------------------------------------------------------------------------------


def brute_groups(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.add((a, b))
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(len(s), top(k)) for k, s in enumerate(sets)], links, sets


def crowd(seed):
    """Chains of edits, exact copies, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.2:
                base = base[: rng.randint(1, len(base))] + [word()]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 9))]) for _ in range(25)]
    texts += ["A b c", "a B c", "a b", "", None, "  "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block,bands", [(1, 2048, 4), (2, 4, 4), (3, 3, 0)])
def test_groups_by_brute_force(spark, monkeypatch, seed, block, bands):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    if not bands:  # without the first step the exact join alone finds the same
        monkeypatch.setattr(jaccard, "verified", lambda p, d, t, whole=jaccard.verified, n=[]: whole(p if n.append(1) or len(n) > 1 else p.limit(0), d, t))
    texts = crowd(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = jaccard.jaccard_groups(docs).members.collect()
    want, _, _ = brute_groups(texts)
    assert [(r["n_shingles"], r["component"]) for r in sorted(members, key=lambda r: r["id"])] == want


def test_all_links_between_different_sets(spark):
    texts = crowd(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = jaccard.jaccard_groups(docs, all_links=True)
    class_of = {r["id"]: r["representative"] for r in groups.members.collect()}
    _, links, sets = brute_groups(texts)
    want = {tuple(sorted((class_of[a], class_of[b]))) for a, b in links if sets[a] != sets[b]}
    found = {(r["a"], r["b"]): (r["overlap"], r["union_size"]) for r in groups.links.collect()}
    assert set(found) == want
    assert all(v == (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for (a, b), v in found.items())


def test_suffix_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(2))
        assert jaccard.suffix_distance(a, b) <= len(np.setxor1d(a, b))


def test_stars_need_no_round(spark, monkeypatch):
    rounds, stars = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda edges, large: rounds.append(large) or stars(edges, large))
    find = lambda edges: sorted(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert find([(1, 2), (3, 1), (1, 2), (7, 8), (4, 4)]) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert not rounds
    assert find([(1, 2), (2, 3), (9, 8), (9, 7)]) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]
    assert rounds


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    neighbours = defaultdict(set)
    for a, b in edges:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    want = {}
    for start in sorted(neighbours):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += neighbours[x]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(want) and {r["id"]: r["component"] for r in found} == want


def test_no_upward_imports():
    top = os.path.dirname(os.path.abspath(registry.__file__))
    for folder, _, files in os.walk(os.path.join(top, "kinspark")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "kinspark.llm" not in open(os.path.join(folder, f)).read()
