"""License scan with ordered signature rules, all in DataFrame functions (no Python on the executors).

A text is lower-cased (A-Z only) and cut into words; rules are regular
expressions over the words joined by single spaces, so punctuation and line
breaks never matter. Most texts end at a keyword prefilter of plain substring
searches. For the others each rule whose own keyword occurs is matched; its
places are intervals of characters. Overlaps are resolved in one ordered pass:
an interval is suppressed if another one of the same or a higher priority
contains it (of equal intervals the earlier rule stays). The base phrases are
reported apart and are never suppressed.

Score: the greatest weight of a kept rule; without one 0.6 if a base phrase stands in the
text, else 0.

Null text is empty: no words, no labels, score 0. Rows are judged one by one, so
repeated rows and null ids give repeated results; nothing is shuffled. An empty table
gives an empty result; columns besides doc_id and text are ignored. Very long texts are
taken whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the lower-cased text, and of the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every place counts, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A text without any of these (in lower case) has no detection.
GATES = ("licen", "gpl", "gnu", "cc", "spdx", "copyright", "copyleft", "domain", "reserved", "permission", "redistribut", "merchantability", "creative", "contributors", "proprietary", "unencumbered", "plainly", "lgpl", "eupl", "cecill", "gfdl", "openrail", "sil ofl", "perl", "want", "attribution", "advertising", "bsd", "mpl", "cddl", "wtfpl", "mulan")

#: License names as words: label, keyword, pattern. {v} stands for an optional "version" or "v".
NAMES = [
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[sc]e {v}3(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[sc]e {v}2(?: 0)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public licen[sc]e {v}1(?: 0)?"),
    ("gpl", "gnu", r"gnu general public licen[sc]e"),
    ("gpl-3.0", "gpl", r"gpl {v}3(?: 0)?"),
    ("gpl-2.0", "gpl", r"gpl {v}2(?: 0)?"),
    ("gpl-1.0", "gpl", r"gpl {v}1(?: 0)?"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e {v}3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e {v}2 1"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e(?: {v}2(?: 0)?)?"),
    ("lgpl", "lgpl", r"lgpl"),
    ("lgpl-3.0", "lgplv3", r"lgplv3"),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: {v}3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?: {v}3(?: 0)?)?"),
    ("agpl-3.0", "agplv3", r"agplv3"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[sc]e {v}1 3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", "gfdl", r"gfdl"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e {v}2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e {v}1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e {v}1 0"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("mit", "mit", r"mit licen[sc]e"),
    ("mit-x11", "x11", r"x11 licen[sc]e"),
    ("mit-0", "mit", r"mit no attribution"),
    ("expat", "expat", r"expat licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?)"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?)"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?)"),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd zero clause)"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e"),
    ("bsd", "berkeley", r"berkeley software distribution licen[sc]e"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e {v}2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e {v}1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e {v}1 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl-2.0", "mpl", r"mpl {v}2(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e {v}2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e {v}1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: {v}1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: {v}1 0)?"),
    ("cddl-1.0", "common", r"common development and distribution licen[sc]e(?: {v}1 0)?"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: {v}1 0)?"),
    ("cpal-1.0", "common", r"common public attribution licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: {v}1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "public", r"do what the f\w* you want to public licen[sc]e"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e {v}2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e {v}1(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("python-2.0", "python", r"python (?:software foundation )?licen[sc]e(?: {v}2(?: 0)?)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: {v}3 01)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("perl", "perl", r"same terms as perl itself"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[sc]e(?: {v}1 1)?"),
    ("ofl-1.1", "ofl", r"sil ofl(?: {v}1 1)?"),
    ("osl-3.0", "open", r"open software licen[sc]e(?: {v}3(?: 0)?)?"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: {v}3(?: 0)?)?"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?: {v}2(?: 0)?)?"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: {v}1 2)?"),
    ("eupl-1.2", "eupl", r"eupl(?: {v}1 2)?"),
    ("cecill-2.1", "cecill", r"cecill(?: licen[sc]e)?(?: {v}2 1)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("apsl-2.0", "apple", r"apple public source licen[sc]e(?: {v}2(?: 0)?)?"),
    ("sunpublic", "sun", r"sun public licen[sc]e"),
    ("ibm-pl", "ibm", r"ibm public licen[sc]e"),
    ("lucent", "lucent", r"lucent public licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("qpl-1.0", "q", r"q public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("sspl-1.0", "side", r"server side public licen[sc]e"),
    ("bsl-1.1", "business", r"business source licen[sc]e(?: {v}1 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: {v}2(?: 0)?)?"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e"),
    ("x11", "x", r"x consortium licen[sc]e"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?: {v}2 1)?"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e"),
    ("blueoak-1.0", "blue", r"blue oak model licen[sc]e"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e)"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database licen[sc]e"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: {v}1 0)?"),
    ("cc0-1.0", "zero", r"(?:creative commons|cc) zero"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?"),
    ("llama", "llama", r"llama \d* ?community licen[sc]e"),
    *((f"cc-{k}-{v.replace(' ', '.')}", f"cc {k.replace('-', ' ')} {v}", rf"cc {k.replace('-', ' ')} {v}") for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")),
    *((f"cc-{k}", f"cc {k.replace('-', ' ')}", rf"cc {k.replace('-', ' ')}") for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative|ativ)(?:e|es|s)?(?: works)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?derivatives?"),
    ("cc", "creative", r"creative commons(?: licen[sc]e)?"),
]
#: Ways a text names its license; {n} is the name.
NOTICE = r"(?:licen[sc]ed|relicen[sc]ed|dual licen[sc]ed|released|distributed|available|provided|published|covered|governed|redistribute it and or modify it|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}"
#: Passages and remarks: label, keyword, pattern, priority, weight.
PASSAGES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, 1.0),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 2, 0.8),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 0.95),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse", 3, 0.95),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 3, 0.95),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 3, 0.95),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 3, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 3, 0.95),
    ("gpl-3.0", "version", r"as published by the free software foundation either version 3 of the licen[sc]e", 3, 1.0),
    ("gpl-2.0", "version", r"as published by the free software foundation either version 2 of the licen[sc]e", 3, 1.0),
    ("gpl", "gnu", r"gnu org licenses", 1, 0.6),
    ("gpl-3.0-only", "gpl", r"gpl 3 0 only", 3, 1.0),
    ("gpl-3.0-or-later", "gpl", r"gpl 3 0 or later", 3, 1.0),
    ("gpl-2.0-only", "gpl", r"gpl 2 0 only", 3, 1.0),
    ("gpl-2.0-or-later", "gpl", r"gpl 2 0 or later", 3, 1.0),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public licen[sc]e v 2 0", 3, 1.0),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3, 1.0),
    ("public-domain", "domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", 2, 0.8),
    ("public-domain", "domain", r"(?:is|are) in the public domain", 1, 0.6),
    ("wtfpl", "just", r"you just do what the f\w* you want to", 3, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 3, 1.0),
    ("bsl-1.0", "boost", r"www boost org license 1 0", 3, 1.0),
    ("ofl-1.1", "reserved", r"reserved font name", 2, 0.8),
    ("cc", "creativecommons", r"creativecommons org licenses", 2, 0.8),
    *((f"cc-{k}", "creativecommons", rf"creativecommons org licenses {k.replace('-', ' ')}", 3, 0.95) for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero", 3, 0.95),
    ("proprietary", "reserved", r"all rights reserved", 0, 0.3),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 1, 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0, 0.3),
    ("copyleft", "copyleft", r"copyleft", 0, 0.3),
    ("license-file", "licen", r"see (?:the )?(?:accompanying )?licen[sc]e (?:file|txt|md)", 0, 0.3),
    ("other", "licen", r"(?:licen[sc]ed|released|distributed) under (?:the )?(?:\S+ ){1,4}licen[sc]e", 0, 0.4),
]


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """All rules in order: label, two keywords that a text must hold, pattern over words, priority, weight."""
    made = []
    for label, key, name in NAMES:
        name = name.replace("{v}", "(?:version |v |ver )?")
        versioned = any(c.isdigit() for c in label)
        made.append((label, key, "identifier", rf"(?:spdx )?licen[sc]e identifier {name}", 3, 1.0))
        made.append((label, key, "under", NOTICE.replace("{n}", f"(?:{name})"), 3, 0.95))
        made.append((label, key, key, name, 2 if versioned else 1, 0.8 if versioned else 0.6))
    made += [(label, key, key, pattern, priority, weight) for label, key, pattern, priority, weight in PASSAGES]
    return made


def _rules() -> Column:
    """The rules as one constant array of structs (parsed from one literal: quicker to plan than hundreds)."""
    rows = [{"label": label, "key": f" {key}", "key2": f" {key2}", "pattern": f" (?:{pattern})(?= )", "priority": priority, "weight": weight, "nth": nth} for nth, (label, key, key2, pattern, priority, weight) in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,key:string,key2:string,pattern:string,priority:int,weight:double,nth:int>>")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower("raw")
    gate = F.lit(False)
    for word in GATES:
        if word == "cc":
            gate = gate | (low.contains("cc") & low.rlike(rf"cc{GAP}(?:by|zero)|cc0"))
        elif word == "mpl":
            gate = gate | (low.contains("mpl") & low.rlike(rf"mpl{GAP}(?:v|2)"))
        else:
            gate = gate | low.contains(word)
    norm = F.when(gate, F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate("raw", UPPER, LOWER), GAP, " ")), F.lit(" ")))
    out = docs.select(F.col("doc_id"), text.alias("raw")).withColumn("norm", norm)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        spaced = f" {phrase} "
        count = F.regexp_count("norm", F.lit(rf"(?<= ){phrase}(?= )")).cast("long")
        at, back = F.instr("norm", spaced), F.instr(F.reverse("norm"), spaced[::-1])
        counts.append(F.coalesce(count, F.lit(0)))
        firsts.append(F.when(at > 0, _spaces(F.substring("norm", F.lit(1), at)) - 1))
        lasts.append(F.when(back > 0, _spaces(F.substring("norm", F.lit(1), F.length("norm") - back - len(spaced) + 2)) - 1))
        labels.append(F.when(at > 0, F.lit(label)))
    n_base = counts[0] + counts[1] + counts[2] + counts[3]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(F.col("norm"), r["pattern"], F.lit(0))
        between = F.split(F.col("norm"), r["pattern"], -1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e")))).alias("spans"))
        spans = F.aggregate(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len"))), zero, step)["spans"]
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-r["priority"]).alias("p"), r["nth"].alias("nth"), r["label"].alias("label"), r["weight"].alias("weight")))

    hits = F.flatten(F.transform(F.filter(_rules(), lambda r: F.contains(F.col("norm"), r["key"]) & F.contains(F.col("norm"), r["key2"])), places))
    # In the order start, longest, priority, rule, an interval is contained in an earlier one exactly if that one's end is as far;
    # `far` is the farthest end so far for each priority and all above it.
    zero = F.struct(F.array(*[F.lit(-1)] * 4).alias("far"), F.array().cast("array<struct<label:string,weight:double>>").alias("kept"))

    def keep(acc: Column, x: Column) -> Column:
        own = F.element_at(acc["far"], (1 - x["p"]).cast("int"))
        far = F.transform(acc["far"], lambda v, i: F.when(i <= -x["p"], F.greatest(v, -x["e"])).otherwise(v))
        one = F.array(F.struct(x["label"].alias("label"), x["weight"].alias("weight")))
        return F.struct(F.when(own >= -x["e"], acc["far"]).otherwise(far).alias("far"), F.when(own >= -x["e"], acc["kept"]).otherwise(F.array_union(acc["kept"], one)).alias("kept"))

    kept = F.when(F.col("norm").isNotNull(), F.aggregate(F.array_sort(hits), zero, keep)["kept"])
    out = out.select(
        "doc_id", F.regexp_count("raw", F.lit(ANY_WORD)).cast("long").alias("n_words"), n_base.alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), kept.alias("kept"))
    own = F.coalesce(F.transform("kept", lambda x: x["label"]), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: x["weight"])), F.when(F.col("n_base") > 0, F.lit(0.6)), F.lit(0.0)).alias("score"))

