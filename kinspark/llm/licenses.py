"""License detection by ordered signature rules over normalised words."""

from __future__ import annotations

import json
from collections import Counter
from functools import cache
from re import _parser as patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import bind

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Shorter words occur in other words too often to be looked for alone.
LEAST_GATE = 5

_V = "(?: (?:v|ver|version)?)?"  # between a name and its version
_NC = "(?: non ?commercial| nc)"
_ND = "(?: no ?derivatives| no ?derivs?| nd)"
_SA = "(?: share ?alike| sa)"

# Label, and how the license is named in words (lower case, single
# spaces; versions such as 2.0 read "2 0"). Order is priority: earlier rules win.
NAMES = [
    ("apache-2.0", f"apache(?: software)? license{_V}(?: )?2(?: 0)?"),
    ("apache-2.0", "apache(?: license)? 2(?: 0)?"),
    ("apache-1.1", f"apache(?: software)? license{_V}(?: )?1 1"),
    ("apache-1.0", f"apache(?: software)? license{_V}(?: )?1 0"),
    ("agpl-3.0", f"(?:gnu )?affero general public license{_V} ?3(?: 0)?"),
    ("agpl-1.0", f"affero general public license{_V} ?1(?: 0)?"),
    ("agpl-3.0", "(?:gnu )?agpl ?v?3(?: 0)?"),
    ("lgpl-3.0", f"(?:gnu )?lesser general public license{_V} ?3(?: 0)?"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public license{_V} ?2 1"),
    ("lgpl-2.0", f"(?:gnu )?library general public license{_V} ?2(?: 0)?"),
    ("lgpl-3.0", "(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "(?:gnu )?lgpl ?v?2 1"),
    ("gpl-3.0", f"(?:gnu )?general public license{_V} ?3(?: 0)?"),
    ("gpl-2.0", f"(?:gnu )?general public license{_V} ?2(?: 0)?"),
    ("gpl-1.0", f"(?:gnu )?general public license{_V} ?1(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?gpl ?v?3(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "general public license as published by the free software foundation either version 2"),
    ("gfdl-1.3", f"(?:gnu )?free documentation license{_V} ?1 3"),
    ("gfdl-1.2", f"(?:gnu )?free documentation license{_V} ?1 2"),
    ("gfdl-1.1", f"(?:gnu )?free documentation license{_V} ?1 1"),
    ("bsd-2-clause-freebsd", "freebsd license"),
    ("bsd-4-clause", "(?:4|four) clause bsd(?: license)?"),
    ("bsd-4-clause", "original bsd license"),
    ("bsd-3-clause", "(?:3|three) clause bsd(?: license)?"),
    ("bsd-3-clause", "(?:new|modified|revised) bsd license"),
    ("bsd-2-clause", "(?:2|two) clause bsd(?: license)?"),
    ("bsd-2-clause", "simplified bsd license"),
    ("bsd-1-clause", "(?:1|one) clause bsd(?: license)?"),
    ("0bsd", "(?:zero|0) clause bsd(?: license)?"),
    ("mit-0", "mit no attribution(?: license)?"),
    ("mit", "(?:the )?mit licen[cs]e"),
    ("mit", "expat license"),
    ("mit", "licensed under (?:the )?(?:terms of the )?mit"),
    ("x11", "x11 license"),
    ("isc", "isc license"),
    ("mpl-2.0", f"mozilla public license{_V} ?2(?: 0)?"),
    ("mpl-1.1", f"mozilla public license{_V} ?1 1"),
    ("mpl-1.0", f"mozilla public license{_V} ?1 0"),
    ("mpl-2.0", "mpl ?v?2(?: 0)?"),
    ("epl-2.0", f"eclipse public license{_V} ?2(?: 0)?"),
    ("epl-1.0", f"eclipse public license{_V} ?1(?: 0)?"),
    ("edl-1.0", "eclipse distribution license(?: v? ?1 0)?"),
    ("cddl-1.1", f"common development and distribution license{_V} ?1 1"),
    ("cddl-1.0", f"common development and distribution license{_V} ?1 0"),
    ("cpl-1.0", f"common public license{_V} ?1 0"),
    ("ipl-1.0", "ibm public license"),
    ("cpal-1.0", "common public attribution license(?: version)?(?: 1 0)?"),
    ("eupl-1.2", f"european union public licen[cs]e{_V} ?1 2"),
    ("eupl-1.1", f"european union public licen[cs]e{_V} ?1 1"),
    ("eupl-1.0", f"european union public licen[cs]e{_V} ?1 0"),
    ("artistic-2.0", f"artistic license{_V} ?2(?: 0)?"),
    ("artistic-1.0", f"artistic license{_V} ?1(?: 0)?"),
    ("bsl-1.0", f"boost software license(?:{_V} ?1 0)?"),
    ("busl-1.1", f"business source license(?:{_V} ?1 1)?"),
    ("sspl-1.0", f"server side public license(?:{_V} ?1)?"),
    ("elastic-2.0", f"elastic license{_V} ?2(?: 0)?"),
    ("elastic-1.0", f"elastic license{_V} ?1(?: 0)?"),
    ("commons-clause", "commons clause(?: license)?(?: condition)?"),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business-1.0.0", "polyform small business license(?: 1 0 0)?"),
    ("polyform-shield-1.0.0", "polyform shield license(?: 1 0 0)?"),
    ("ecl-2.0", f"educational community license(?:{_V} ?2 0)?"),
    ("afl-3.0", f"academic free license(?:{_V} ?3 0)?"),
    ("osl-3.0", f"open software license(?:{_V} ?3 0)?"),
    ("rpl-1.5", "reciprocal public license(?: 1 5)?"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("mulanpsl-2.0", f"mulan permissive software license{_V} ?2"),
    ("mulanpsl-1.0", f"mulan permissive software license{_V} ?1"),
    ("upl-1.0", "universal permissive license(?: v? ?1 0)?"),
    ("unlicense", "(?:the )?unlicense"),
    ("wtfpl", "do what the f[a-z]* you want to public license"),
    ("wtfpl", "wtfpl"),
    ("zlib", "zlib(?: libpng)? license"),
    ("libpng", "(?:png reference library|libpng) license"),
    ("ijg", "independent jpeg group(?: s)? license"),
    ("openssl", "openssl license"),
    ("ssleay", "(?:original )?ssleay license"),
    ("curl", "curl license"),
    ("psf-2.0", f"python software foundation license(?:{_V} ?2)?"),
    ("python-2.0", "python license(?: 2 0)?"),
    ("php-3.01", f"php license(?:{_V} ?3 01)?"),
    ("php-3.0", f"php license{_V} ?3 0"),
    ("ruby", "ruby license"),
    ("tcl", "tcl tk license"),
    ("vim", "vim license"),
    ("postgresql", "postgresql licen[cs]e"),
    ("sleepycat", "sleepycat license"),
    ("ncsa", "(?:university of illinois )?ncsa open source license"),
    ("w3c", "w3c software (?:notice and )?(?:document )?license"),
    ("unicode-3.0", "unicode license(?: v? ?3)?"),
    ("icu", "icu license"),
    ("ofl-1.1", f"(?:sil )?open font license(?:{_V} ?1 1)?"),
    ("ofl-1.0", f"(?:sil )?open font license{_V} ?1 0"),
    ("lppl-1.3c", "latex project public license(?: v(?:ersion)? ?1 3c)?"),
    ("qpl-1.0", "q public license(?: version)?(?: 1 0)?"),
    ("npl-1.1", "netscape public license(?: version)?(?: 1 1)?"),
    ("spl-1.0", "sun public license(?: version)?(?: 1 0)?"),
    ("apsl-2.0", "apple public source license(?: version)?(?: 2 0)?"),
    ("nasa-1.3", "nasa open source agreement(?: version)?(?: 1 3)?"),
    ("cecill-2.1", "cecill(?: free software license agreement)?(?: v(?:ersion)? ?2 1)"),
    ("cecill-b", "cecill b"),
    ("cecill-c", "cecill c"),
    ("odbl-1.0", "open (?:data commons open )?database license(?: v? ?1 0)?"),
    ("odc-by-1.0", "open data commons attribution license(?: v? ?1 0)?"),
    ("pddl-1.0", "public domain dedication and license(?: v? ?1 0)?"),
    ("cdla-permissive-2.0", "community data license agreement permissive(?: version)? 2 0"),
    ("cdla-permissive-1.0", "community data license agreement permissive(?: version)? 1 0"),
    ("cdla-sharing-1.0", "community data license agreement sharing(?: version)? 1 0"),
    ("ogl-uk-3.0", f"open government licen[cs]e{_V} ?3 0"),
    ("ogl-uk-2.0", f"open government licen[cs]e{_V} ?2 0"),
    ("etalab-2.0", "licence ouverte(?: v(?:ersion)?)? ?2 0"),
    ("dl-de-by-2.0", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("cern-ohl-s-2.0", "cern open hardware licen[cs]e(?: version)? 2 strongly reciprocal"),
    ("cern-ohl-w-2.0", "cern open hardware licen[cs]e(?: version)? 2 weakly reciprocal"),
    ("cern-ohl-p-2.0", "cern open hardware licen[cs]e(?: version)? 2 permissive"),
    ("openrail-m", "(?:creativeml |bigscience )?(?:open rail|openrail) ?m(?: license)?"),
    ("llama-community", "llama(?: 2| 3(?: 1| 2| 3)?)? community license(?: agreement)?"),
    ("gemma", "gemma terms of use"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons (?:zero|cc0)(?: license)?(?: v? ?1 0)?"),
    ("cc-pdm-1.0", "creative commons public domain mark(?: 1 0)?"),
    ("public-domain", "(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("public-domain", "(?:is|are) in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "end user license agreement"),
]

_CC = {
    "by-nc-nd": (_NC, _ND), "by-nc-sa": (_NC, _SA), "by-nd": (_ND,), "by-sa": (_SA,), "by-nc": (_NC,), "by": (),
}
_CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")

# Sentences of the license texts themselves.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "www apache org licenses license 2 0"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("ncsa", "developed by .{1,80} university of illinois"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "without the (?:express )?(?:prior )?written permission of"),
]

CONFIDENCE = {"identifier": 1.0, "text": 0.95, "address": 0.95, "versioned": 0.9, "name": 0.8}


def literals(pattern: str) -> list[str]:
    """What every match of a pattern holds, with the space before and after it: runs of characters outside options, repeats and alternatives."""
    runs = [" "]
    for op, value in patterns.parse(pattern):
        if op is patterns.LITERAL:
            runs[-1] += chr(value)
        else:
            runs.append("")
    runs[-1] += " "
    return [x for x in runs if x.strip()] or [" "]


@cache
def gate() -> tuple[str, ...]:
    """Strings of which a text that any rule matches holds one: the word (or string) that most rules need first, until all rules have one."""
    needs = []
    for rule in rules():
        runs = literals(rule["pattern"].removeprefix("(?<= )(?:").removesuffix(")(?= )"))
        words = {w for x in runs for w in x.split() if len(w) >= LEAST_GATE}
        needs.append(words | {rule["keyword"]})
    chosen = []
    while needs:
        counts = Counter(x for own in needs for x in own)
        best = max(counts, key=lambda x: (counts[x], len(x), x))
        chosen.append(best)
        needs = [own for own in needs if best not in own]
    return tuple(x for x in chosen if not any(y in x for y in chosen if y != x))


def rules() -> list[dict]:
    """All signatures by descending priority: identifiers, license texts, addresses, versioned names, plain names."""
    out: list[tuple[str, str, str]] = []
    labels = list(dict.fromkeys(label for label, _ in NAMES if label not in ("proprietary", "public-domain")))
    labels += [f"cc-{kind}-{v}" for kind in _CC for v in _CC_VERSIONS]
    for label in labels:
        words = label.replace("-", " ").replace(".", " ")
        out.append(("identifier", label, f"spdx license identifier {words}(?: only| or later)?"))
    out += [("text", label, pattern) for label, pattern in TEXTS]
    for label in labels:
        words = label.replace("-", " ").replace(".", " ")
        if label.startswith("cc-by"):
            kind, version = label[3:].rsplit("-", 1)
            out.append(("address", label, f"creativecommons org licenses {kind.replace('-', ' ')} {version.replace('.', ' ')}"))
        else:
            out.append(("address", label, f"opensource org licenses? {words}"))
    for kind, parts in _CC.items():
        for v in _CC_VERSIONS:
            version = v.replace(".", " ")
            tail = "".join(parts)
            out.append(("versioned", f"cc-{kind}-{v}", f"cc by{tail} {version}"))
            out.append(("versioned", f"cc-{kind}-{v}", f"creative commons attribution{tail}(?: international| unported| generic)?(?: license)? {version}"))
        out.append(("name", f"cc-{kind}", f"cc by{''.join(parts)}"))
        out.append(("name", f"cc-{kind}", f"creative commons attribution{''.join(parts)}(?: license)?"))
    out += [("versioned" if any(c.isdigit() for c in label) else "name", label, pattern) for label, pattern in NAMES]
    return [
        {"rank": k, "label": label, "keyword": max(literals(pattern), key=len), "pattern": f"(?<= )(?:{pattern})(?= )", "confidence": CONFIDENCE[kind]}
        for k, (kind, label, pattern) in enumerate(out)
    ]


_RULE = "array<struct<rank:int,label:string,keyword:string,pattern:string,confidence:double>>"
_BASE_PATTERN = "(?<= )(?:" + "|".join(BASE) + ")(?= )"


def normal(text: Column) -> Column:
    """Lower-case words with one space before, between and after; one space if there is no word."""
    words = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), NOT_WORD, " "))
    return bind(words, lambda w: F.when(w == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(norm: Column, rule: Column) -> Column:
    """Character spans of one rule's matches: what lies between matches tells where they begin."""

    def placed(found: Column, gaps: Column) -> Column:
        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,neg:int,rank:int>>").alias("s"))

        def step(acc: Column, p: Column) -> Column:
            a = acc["at"] + p["g"]
            b = a + p["m"]
            return F.struct(b.alias("at"), F.concat(acc["s"], F.array(F.struct(a.alias("a"), (-b).alias("neg"), rule["rank"].alias("rank")))).alias("s"))

        return F.aggregate(pairs, start, step, lambda acc: acc["s"])

    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    return bind(found, lambda m: bind(F.split(norm, rule["pattern"], -1), lambda g: placed(m, g)))


def detect(norm: Column) -> Column:
    """``labels`` and ``score`` of normalised words, by all rules whose keyword occurs.

    A span within another (or equal to one of an earlier rule) is suppressed; spans that only
    overlap both count. Spans are sorted by start, then longest, then rule, so one pass with the
    farthest end so far finds those contained in another.
    """
    table = F.from_json(F.lit(json.dumps(rules())), _RULE)
    fired = F.filter(table, lambda r: F.contains(norm, r["keyword"]))

    def resolved(own: Column) -> Column:
        spans = F.sort_array(F.flatten(F.transform(own, lambda r: _spans(norm, r))))
        start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("ranks"))

        def step(acc: Column, s: Column) -> Column:
            new = -s["neg"] > acc["end"]
            ranks = F.when(new, F.array_union(acc["ranks"], F.array(s["rank"]))).otherwise(acc["ranks"])
            return F.struct(F.greatest(acc["end"], -s["neg"]).alias("end"), ranks.alias("ranks"))

        ranks = F.aggregate(spans, start, step, lambda acc: acc["ranks"])
        kept = bind(ranks, lambda k: F.filter(own, lambda r: F.array_contains(k, r["rank"])))
        return bind(kept, lambda k: F.struct(F.transform(k, lambda r: r["label"]).alias("labels"), F.coalesce(F.array_max(F.transform(k, lambda r: r["confidence"])), F.lit(0.0)).alias("score")))

    return bind(fired, resolved)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License places and labels of every whole text.

    Returns the key, ``n_words``, ``n_base`` (places of the base phrases), ``first_word`` and
    ``last_word`` (the smallest and largest word at which one starts), ``base_labels``,
    ``labels`` (those and the rules') and ``score`` (the confidence of the surest detection).
    Null texts count as empty and have no labels; equal texts have equal results; an empty
    table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(key), normal(F.col(text)).alias("_norm"))
    n = F.col("_norm")
    n_words = F.when(n == " ", 0).otherwise(_spaces(n) - 1).cast("long")
    maybe = F.lit(False)
    for own in gate():
        maybe = maybe | F.contains(n, F.lit(own))

    def base(found: Column) -> Column:
        def places(gaps: Column) -> Column:
            last = F.element_at(found, -1)
            return F.struct(
                F.size(found).cast("long").alias("n"),
                (_spaces(F.get(gaps, F.lit(0))) - 1).cast("long").alias("first"),
                (n_words - (_spaces(F.element_at(gaps, -1)) - 1) - (_spaces(last) + 1)).cast("long").alias("last"),
                F.array_distinct(F.transform(found, lambda f: F.create_map(*[F.lit(x) for item in BASE.items() for x in item])[f])).alias("labels"),
            )

        some = bind(F.split(n, _BASE_PATTERN, -1), places)
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
        return F.when(F.size(found) > 0, some).otherwise(none)

    nothing = F.array().cast("array<string>")
    found = F.when(F.contains(n, F.lit(" license ")), F.regexp_extract_all(n, F.lit(_BASE_PATTERN), F.lit(0))).otherwise(nothing)
    ruled = F.when(maybe, detect(n)).otherwise(F.struct(nothing.alias("labels"), F.lit(0.0).alias("score")))
    rows = rows.select(key, n_words.alias("n_words"), bind(found, base).alias("_b"), ruled.alias("_r"))
    join = lambda a: F.concat_ws(",", F.sort_array(F.array_distinct(a)))
    score = F.greatest(F.col("_r.score"), F.when(F.col("_b.n") > 0, CONFIDENCE["name"]).otherwise(0.0))
    return rows.select(
        key, "n_words", F.col("_b.n").alias("n_base"), F.col("_b.first").alias("first_word"), F.col("_b.last").alias("last_word"),
        join(F.col("_b.labels")).alias("base_labels"), join(F.concat("_b.labels", "_r.labels")).alias("labels"), score.alias("score"),
    )
