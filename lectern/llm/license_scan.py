"""License detection by ordered signature rules.

A text is lower-cased (A-Z), cut into words and rewritten as " w1  w2  w3 ". A family's names, its versions and a
few ways of quoting a license give several hundred regular expressions; SPDX ids, one-word abbreviations and sentences
of the grant texts have rules of their own. Labels name the family, not the version. A text that holds none of the keywords
is done after one pass; otherwise a signature runs only if the text holds its own keyword. Detections are word
intervals; one that lies inside another of the same or a higher priority is suppressed (same interval: higher
priority, then lower rule number, wins).

Base phrases are counted at every place where their words stand consecutively and always keep their label.

Defined cases: null and empty texts have no words, empty labels and score 0; every place of a repeated phrase
counts; repeated rows are scanned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and the words between.
ANY_BREAK, ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every phrase and rule holds one of these, or "cc" and "by" as neighbouring words.
STEMS = (
    "license", "licence", "gpl", "mpl", "cddl", "eupl", "wtfpl", "cc0", "bsd", "domain", "reserved", "commons", "gfdl", "odbl", "pddl", "sspl", "busl",
    "apache", "permission", "distribut", "released under", "endorse", "mentioning",
)

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label, keyword that gates the family, name as a regular expression over words, versions.
FAMILIES = (
    ("gpl", "general", "gnu general public license", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "lesser", "gnu lesser general public license", ("2 1", "3")),
    ("lgpl", "library", "gnu library general public license", ("2",)),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public license", ("1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("gfdl", "documentation", "gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)? license", ("1 0", "1 1", "2 0")),
    ("mit", "mit", "(?:the )?mit license", ()),
    ("mit", "expat", "expat license", ()),
    ("mit", "x11", "x11 license", ()),
    ("isc", "isc", "isc license", ()),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd)(?: license)?", ()),
    ("bsd-2-clause", "freebsd", "freebsd(?: license)?", ()),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)(?: license)?", ()),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|original bsd)(?: license)?", ()),
    ("bsd", "bsd", "bsd license", ()),
    ("0bsd", "0bsd", "0bsd", ()),
    ("mpl", "mozilla", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public license", ("1 0", "2 0")),
    ("edl", "eclipse", "eclipse distribution license", ("1 0",)),
    ("cpl", "common", "common public license", ("0 5", "1 0")),
    ("cddl", "distribution", "common development and distribution license", ("1 0", "1 1")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic license", ("1 0", "2 0")),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("zlib", "zlib", "zlib(?: libpng)? license", ()),
    ("libpng", "libpng", "libpng license", ("2",)),
    ("boost", "boost", "boost software license", ("1 0",)),
    ("bsl", "business", "business source license", ("1 0", "1 1")),
    ("sspl", "server", "server side public license", ("1",)),
    ("elastic", "elastic", "elastic license", ("2 0",)),
    ("ofl", "font", "(?:sil )?open font license", ("1 0", "1 1")),
    ("python", "python", "(?:python software foundation|python) license", ("2", "2 0")),
    ("php", "php", "php license", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby license", ()),
    ("openssl", "openssl", "openssl license", ()),
    ("postgresql", "postgresql", "postgresql license", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?license", ()),
    ("afl", "academic", "academic free license", ("1 1", "2 0", "3 0")),
    ("osl", "open", "open software license", ("1 0", "2 0", "3 0")),
    ("ms-pl", "microsoft", "microsoft public license", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal license", ()),
    ("upl", "universal", "universal permissive license", ("1 0",)),
    ("odbl", "database", "open (?:data )?database license", ("1 0",)),
    ("pddl", "domain", "public domain dedication and license", ("1 0",)),
    ("public-domain", "domain", "(?:in|into|to) the public domain", ()),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", ("3 0", "4 0")),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike", ("3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ("3 0", "4 0")),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s", ("3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ("3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution", ("3 0", "4 0")),
    ("all-rights-reserved", "reserved", "all rights reserved", ()),
)

#: How a name may stand in a text; %s is the name with or without a version. A longer setting has a higher priority.
SETTINGS = (
    (3, r"(?:is |are )?licen[cs]ed under (?:the )?(?:terms of the )?%s"),
    (3, r"released under (?:the )?(?:terms of the )?%s"),
    (3, r"distributed under (?:the )?(?:terms of the )?%s"),
    (3, r"spdx license identifier %s"),
    (1, r"%s"),
)
WEIGHT = {1: 0.6, 2: 0.8, 3: 0.9}

#: label, keyword, id in words. Most mean something else when they stand alone, so they count in a setting or after the SPDX tag.
IDS = (
    ("mit", "mit", "mit(?: 0)?"),
    ("isc", "isc", "isc"),
    ("mit", "x11", "x11"),
    ("apache", "apache", "apache(?: software)?(?: (?:version )?(?:1 0|1 1|2 0|2))?"),
    ("bsd", "bsd", "bsd"),
    ("gpl", "gpl", "gpl (?:1|2|3)(?: 0)?(?: or later| only)?"),
    ("lgpl", "lgpl", "lgpl (?:2 0|2 1|2|3 0|3)(?: or later| only)?"),
    ("agpl", "agpl", "agpl (?:1|3)(?: 0)?(?: or later| only)?"),
    ("gfdl", "gfdl", "gfdl 1 [123](?: invariants| no invariants)?(?: or later| only)?"),
    ("epl", "epl", "epl (?:1|2)(?: 0)?"),
    ("cpl", "cpl", "cpl 1 0"),
    ("artistic", "artistic", "artistic (?:1 0|2 0)"),
    ("zlib", "zlib", "zlib"),
    ("libpng", "libpng", "libpng(?: 2 0)?"),
    ("boost", "bsl", "bsl 1 0"),
    ("bsl", "busl", "busl 1 1"),
    ("sspl", "sspl", "sspl 1 0"),
    ("elastic", "elastic", "elastic 2 0"),
    ("ofl", "ofl", "ofl 1 [01]"),
    ("python", "psf", "psf 2 0"),
    ("python", "python", "python 2 0"),
    ("php", "php", "php 3 (?:0|01)"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "ncsa"),
    ("afl", "afl", "afl (?:1 1|1 2|2 0|2 1|3 0)"),
    ("osl", "osl", "osl (?:1 0|1 1|2 0|2 1|3 0)"),
    ("ms-pl", "ms", "ms pl"),
    ("ms-rl", "ms", "ms rl"),
    ("upl", "upl", "upl 1 0"),
    ("odbl", "odbl", "odbl 1 0"),
    ("pddl", "pddl", "pddl 1 0"),
)
BSD_IDS = tuple((f"bsd-{n}-clause", "spdx", f"bsd {n} clause") for n in (2, 3, 4))
#: Operands of an SPDX expression: the later ones hold the earlier ones, so their priority is lower.
OPERAND = "[a-z0-9]+(?: [0-9]+| clause| only| or later| by| nc| nd| sa| pl| rl| invariants| no invariants| with [a-z0-9]+ exception(?: [0-9]+)*)*"
SPDX = tuple((3 - k, "spdx license identifier " + f"{OPERAND} (?:or|and) " * k + "%s") for k in range(3))
#: label, one word that is a license and its version.
ABBREVIATIONS = tuple(
    [(x, f"{x}{v}{n}", f"{x}{v}{n}(?: [01])?" + plus) for x, ns in (("gpl", "123"), ("lgpl", "23"), ("agpl", "13")) for n in ns for v in ("v", "") for plus in ("(?: or later| only)?",)]
) + (
    ("mpl", "mplv1", "mplv1(?: [01])?"), ("mpl", "mplv2", "mplv2(?: 0)?"), ("mpl", "mpl2", "mpl2(?: 0)?"), ("apache", "apache2", "apache2(?: 0)?"), ("apache", "apachev2", "apachev2(?: 0)?"),
    ("apache", "apache", "apache (?:version |v )?2 0"), ("gfdl", "gfdl", "gfdl"), ("odbl", "odbl", "odbl"), ("pddl", "pddl", "pddl"), ("sspl", "sspl", "sspl"), ("sspl", "ssplv1", "ssplv1"), ("bsl", "busl", "busl 1 1"),
)
#: label, keyword, priority and a sentence that only this license's text has; the first also opens texts that a longer sentence settles.
GRANTS = (
    ("mit", "hereby", 1, "permission is hereby granted free of charge"),
    ("mit", "hereby", 3, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("ncsa", "hereby", 3, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("boost", "hereby", 3, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "hereby", 3, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", 3, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("postgresql", "hereby", 3, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", 3, "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd-2-clause", "materials", 3, "and or other materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "endorse", 3, "nor the names of (?:its|other|the) (?:contributors|authors) may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 3, "all advertising materials mentioning features or use of this software must display"),
    ("zlib", "anyone", 3, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", "unencumbered", 3, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 3, "do what the fuck you want to public license"),
)


def spaced(pattern: str) -> str:
    """A pattern over single-spaced words as one over " w1  w2 "."""
    return " " + re.sub(" +", "  ", pattern.replace(" ?", "(?: )?")) + " "


def signatures() -> list[tuple[int, str, str, int, str]]:
    """(number, keyword, label, priority, pattern) of every rule: each family in each setting, without and with a version,
    then ids in settings and SPDX expressions, abbreviations and grant texts."""
    rules = []
    for label, keyword, name, versions in FAMILIES:
        name = re.sub(r"\blicense\b", "licen[cs]e", name)
        forms = [(0, name)]
        if versions:
            known = "|".join(sorted(versions, key=len, reverse=True))
            forms.append((1, rf"{name} (?:version |v )?(?:{known})(?: or later| only)?"))
        for priority, setting in SETTINGS:
            for more, form in forms:
                rules.append((len(rules), keyword, label, priority + (more if priority == 1 else 0), spaced(setting % f"(?:{form})")))
    named = [(label, "spdx", rf"(?:{name})" + (rf"(?: (?:{'|'.join(sorted(versions, key=len, reverse=True))})(?: 0)?)?(?: or later| only)?" if versions else "")) for label, _, name, versions in FAMILIES if re.fullmatch(r"[a-z0-9 ]+", name) and "license" not in name.split()]
    more = [(keyword, label, priority, setting % f"(?:{form})") for label, keyword, form in IDS for priority, setting in SETTINGS if priority == 3 and "spdx" not in setting]
    more += [("spdx", label, priority, setting % f"(?:{form})") for label, _, form in IDS + tuple(named) + BSD_IDS for priority, setting in SPDX]
    more += [(keyword, label, priority, setting % f"(?:{form})") for label, keyword, form in ABBREVIATIONS for priority, setting in ((3, SETTINGS[0][1]), (2, "%s"))]
    more += [(keyword, label, priority, sentence) for label, keyword, priority, sentence in GRANTS]
    return rules + [(len(rules) + i, keyword, label, priority, spaced(form)) for i, (keyword, label, priority, form) in enumerate(more)]


def _words(spaced_text: Column) -> Column:
    """Words in a piece of " w1  w2 ", whose words each hold two spaces."""
    return F.floor((F.length(spaced_text) - F.length(F.translate(spaced_text, " ", ""))) / 2)


def _places(text: Column, pattern: Column) -> Column:
    """Word intervals (start, end) of the matches of a pattern that begins and ends at word borders."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    spans = F.zip_with(gaps, hits, lambda g, h: F.struct(_words(g).cast("long").alias("g"), F.coalesce(_words(h), F.lit(0)).cast("long").alias("h")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        more = F.when(x["h"] > 0, F.array(F.struct(s.alias("s"), (s + x["h"]).alias("e")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
        return F.struct((s + x["h"]).alias("at"), F.concat(a["found"], more).alias("found"))

    return F.aggregate(spans, start, step, lambda a: a["found"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, word and base counts, first and last place, base and all labels, score, kept detections of every text."""
    flat = F.trim(F.regexp_replace(F.translate(F.col("body"), UPPER, LOWER), WORD_BREAK, " "))
    rules = signatures()
    by_keyword: dict[str, list] = {}
    for n, keyword, label, p, pattern in rules:
        by_keyword.setdefault(keyword, []).append({"n": n, "label": label, "p": p, "r": pattern})
    # One constant, each keyword once: a text is searched for every keyword, not for every rule.
    grouped = F.from_json(F.lit(json.dumps([{"k": f" {k} ", "rules": v} for k, v in by_keyword.items()])), "array<struct<k:string,rules:array<struct<n:int,label:string,p:int,r:string>>>>")
    low = F.col("low")
    stem = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in STEMS])
    may = stem | (F.contains(low, F.lit("cc")) & low.rlike("cc" + WORD_BREAK + "by"))
    gated = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).withColumn("low", F.lower("body"))
    staged = gated.select(
        "doc_id", F.size(F.regexp_extract_all("body", F.lit(ANY_WORD), F.lit(0))).cast("long").alias("n_words"),
        F.when(may, F.concat(F.lit(" "), F.replace(flat, F.lit(" "), F.lit("  ")), F.lit(" "))).alias("wide"),
    )
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def base_places(phrase: str) -> Column:
        pattern = F.lit(" " + phrase.replace(" ", "  ") + " ")
        return F.when(F.contains(F.col("wide"), pattern), _places(F.col("wide"), pattern)).otherwise(none)

    bases = F.array(*[F.struct(F.lit(label).alias("label"), base_places(phrase).alias("at")) for phrase, label in BASE])
    wanted = F.flatten(F.transform(F.filter(grouped, lambda g: F.contains(F.col("wide"), g["k"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(wanted, lambda r: F.transform(_places(F.col("wide"), r["r"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-r["p"]).alias("p"), r["n"].alias("n"), r["label"].alias("label")))))
    detected = staged.withColumn("base", F.when(F.col("wide").isNotNull(), bases)).withColumn("found", F.when(F.col("wide").isNotNull(), F.sort_array(found)))

    # A container of an interval comes before it in order of (start, -end, -priority, number): a sweep that keeps the
    # furthest end seen at each priority decides suppression.
    levels = sorted(WEIGHT)
    begin = F.struct(*[F.lit(-1).cast("long").alias(f"end{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("top"))

    def sweep(a: Column, d: Column) -> Column:
        end, pri = -d["e"], -d["p"]
        reach = F.greatest(*[F.when(pri <= p, a[f"end{p}"]).otherwise(F.lit(-1).cast("long")) for p in levels])
        kept = reach < end
        return F.struct(
            *[F.when(pri == p, F.greatest(a[f"end{p}"], end)).otherwise(a[f"end{p}"]).alias(f"end{p}") for p in levels],
            F.when(kept, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            (a["n"] + kept.cast("long")).alias("n"),
            F.when(kept, F.greatest(a["top"], pri)).otherwise(a["top"]).alias("top"),
        )

    swept = detected.withColumn("kept", F.aggregate("found", begin, sweep))
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["at"], lambda x: x["s"])))
    own = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    empty = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base_labels, labels = F.coalesce(own, empty), F.coalesce(F.col("kept.labels"), empty)
    weight = F.element_at(F.create_map(*[F.lit(x) for p, w in WEIGHT.items() for x in (p, w)]), F.col("kept.top"))
    return swept.select(
        "doc_id", "n_words",
        F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, labels)).alias("labels"),
        F.when(F.col("kept.top") > 0, weight).when(F.size(base_labels) > 0, F.lit(WEIGHT[1])).otherwise(F.lit(0.0)).alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
