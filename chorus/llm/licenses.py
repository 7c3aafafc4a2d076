"""Licence scan by ordered signature rules (DataFrame functions only).

Texts become lower-case words with single spaces.  A rule is a regular expression over that form with a
label, a priority, keywords and a score.  Every match of a rule holds one of its keyword phrases at the
beginning of a word ("wtfplv2"); one pass with one pattern finds a row's keywords, and only rules of present
keywords run.  Matches are word intervals; one that lies inside an interval of the same or better priority is
suppressed, so "mit license" inside "licensed under the mit license" counts once.  Rules are the signatures of
the licences' own texts and notices, and families of names in several wordings, some hundreds in all.

One narrow scan finds the matches (lengths only, no text leaves it); intervals, suppression and labels
work on the few rows with matches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import stage

#: The phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence families, hand-written: label, keyword phrases of which every match has one, name as a pattern over words, SPDX words.
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "agpl"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "lgpl"),
    ("lgpl", "gnu library", "gnu library general public licen[sc]e", "lgpl"),
    ("gpl", "gnu general public", "gnu general public licen[sc]e", "gpl"),
    ("gfdl", "gnu free documentation", "gnu free documentation licen[sc]e", "gfdl"),
    ("apache", "apache", "apache (?:software )?licen[sc]e", "apache"),
    ("mit", "mit licen", "mit licen[sc]e", "mit"),
    ("mit", "x11", "(?:mit )?x11 licen[sc]e", "x11"),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-2-clause", "bsd,freebsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e", "bsd"),
    ("0bsd", "bsd,0bsd", "(?:zero clause bsd|0bsd)(?: licen[sc]e)?", "0bsd"),
    ("mpl", "mozilla public", "mozilla public licen[sc]e", "mpl"),
    ("epl", "eclipse public", "eclipse public licen[sc]e", "epl"),
    ("edl", "eclipse distribution", "eclipse distribution licen[sc]e", "edl"),
    ("cddl", "common development", "common development and distribution licen[sc]e", "cddl"),
    ("cpl", "common public", "common public licen[sc]e", "cpl"),
    ("eupl", "european union public", "european union public licen[sc]e", "eupl"),
    ("isc", "isc licen", "isc licen[sc]e", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("boost", "boost software", "boost software licen[sc]e", "bsl"),
    ("artistic", "artistic licen", "artistic licen[sc]e", "artistic"),
    ("python", "python software", "python software foundation licen[sc]e", "psf"),
    ("php", "php licen", "php licen[sc]e", "php"),
    ("ruby", "ruby licen", "ruby licen[sc]e", "ruby"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[sc]e", "w3c"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "open font licen", "(?:sil )?open font licen[sc]e", "ofl"),
    ("odbl", "database licen", "open (?:data commons )?(?:open )?database licen[sc]e", "odbl"),
    ("odc-by", "odc by", "odc by", "odc by"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("upl", "universal permissive", "universal permissive licen[sc]e", "upl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("vim", "vim licen", "vim licen[sc]e", "vim"),
    ("cc0", "cc0", "cc0", "cc0"),
    ("cc0", "creative commons", "creative commons (?:cc0|zero)", "cc0"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike", "cc by nc sa"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by", "creative commons", "creative commons attribution", "cc by"),
    ("cc-by", "cc by", "cc by", "cc by"),
    ("cc-by-sa", "cc by", "cc by sa", "cc by sa"),
    ("cc-by-nc", "cc by", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by", "cc by nd", "cc by nd"),
    ("public-domain", "public domain", "(?:released into|dedicated to|in) the public domain", "public domain"),
    ("proprietary", "all rights reserved", "all rights reserved", "proprietary"),
]
#: Wordings around a family's name: pattern, priority (1 is best), score.
_VERSION = "(?:,? ?(?:version|v|ver) ?\\d+(?: \\d+)*| \\d+(?: \\d+)*)"
WORDINGS = [
    ("spdx license identifier {spdx}(?: \\d+)*(?: only| or later)?", 1, 1.0),
    ("(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}" + _VERSION, 1, 1.0),
    ("(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 2, 0.95),
    ("(?:under|see|subject to|covered by|governed by|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 3, 0.85),
    ("{name}" + _VERSION + "(?: or (?:any )?later(?: version)?| only)?", 3, 0.9),
    ("{name}", 4, 0.7),
]
#: Signatures of the licences' own texts and notices, hand-written: label, pattern over words.  Priority 1.
SIGNATURES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "except as contained in this notice the names? of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software"),
    ("isc", "the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is"),
    ("bsd-3-clause", "nor the names of (?:its|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache", "subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "the gnu general public licen[sc]e is a free copyleft licen[sc]e"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e"),
    ("agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "if a copy of the mpl was not distributed with this file"),
    ("mpl", "the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("cpl", "the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", "licensed under the eupl"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "this licen[sc]e establishes the terms under which a given free software package may be copied"),
    ("python", "psf is making python available to licensee on an as is basis"),
    ("python", "this licen[sc]e agreement is between the python software foundation"),
    ("php", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty"),
    ("ofl", "this licen[sc]e is copied below and is also available with a faq at"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ms-pl", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("upl", "the above copyright notice and either this complete permission notice or at a minimum a reference to the upl"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution \\d+ \\d+ (?:international|unported)"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike \\d+ \\d+ (?:international|unported)"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution no ?derivatives \\d+ \\d+ (?:international|unported)"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial \\d+ \\d+ (?:international|unported)"),
    ("cc-by-sa", "if you alter transform or build upon this work you may distribute the resulting work only under the same"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents licen[sc]e"),
    ("odc-by", "made available under the open data commons attribution licen[sc]e"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("afl", "licensed under the academic free licen[sc]e"),
    ("osl", "licensed under the open software licen[sc]e"),
    ("mulan", "you can use this software according to the terms and conditions of the mulan psl"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the licen[sc]e does not grant to you the right to sell the software"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
]
_LEVELS = sorted({w[1] for w in WORDINGS})


def rules() -> list[tuple[str, tuple[str, ...], int, float, str, bool]]:
    """(label, keywords, priority, score, pattern, is a contract phrase), best priority first.

    A signature's keyword is its literal beginning, five words at most.
    """
    out = [(label, (words,), 4, 0.7, f" {words}(?= )", True) for words, label in BASE.items()]
    for label, text in SIGNATURES:
        literal = re.match(r"[a-z0-9 ]+(?!\?)", text)[0]  # a character before ? may be absent
        out.append((label, (" ".join(literal.split()[:5]),), 1, 1.0, f" {text}(?= )", False))
    for label, keyword, name, spdx in FAMILIES:
        for text, priority, score in WORDINGS:
            if "{spdx}" in text:
                keywords, pattern = ("spdx",), text.format(spdx=spdx)
            else:
                keywords, pattern = tuple(keyword.split(",")), text.replace("{name}", name)
            out.append((label, keywords, priority, score, f" {pattern}(?= )", False))
    return sorted(out, key=lambda r: r[2])


def gate(keywords: set[str]) -> str:
    """One pattern that captures, at every word, the longest keyword the text goes on with."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted(keywords, key=lambda k: (-len(k), k)):
        by_letter.setdefault(k[0], []).append(k[1:])
    return " (?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + "))"


def normal(text):
    """' word word ... ': A-Z lower-cased, every run of other ASCII one space, padded; ' ' if no word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(F.translate(flat, upper, lower)), F.lit(" "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_detections, score, spans.

    ``spans`` lists the kept detections (start word, end word, label).  Null and empty texts have no words
    and no labels (empty strings, score 0); repeated rows and null ids get a row each; no rows, no rows.
    """
    table = rules()
    keywords = {k for r in table for k in r[1]}
    longer = {k: [x for x in sorted(keywords) if x.startswith(k)] for k in keywords}  # the gate captures the longest one
    lits = F.array(*[F.struct(F.lit(i).alias("rule"), F.array(*[F.lit(x) for k in r[1] for x in longer[k]]).alias("keywords"),
                              F.lit(r[4]).alias("pattern")) for i, r in enumerate(table)])
    rows = docs.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col).cast("string")).alias("norm"))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    present = F.array_distinct(F.regexp_extract_all("norm", F.lit(gate(keywords)), F.lit(1)))
    found = F.transform(
        F.filter(lits, lambda r: F.arrays_overlap(F.col("present"), r["keywords"]) & F.rlike(F.col("norm"), r["pattern"])),
        lambda r: F.struct(r["rule"].alias("rule"),
                           F.transform(F.regexp_extract_all("norm", r["pattern"], F.lit(0)), spaces).alias("words"),
                           F.transform(F.split("norm", r["pattern"]), spaces).alias("gaps")))
    none = F.array().cast("array<struct<rule:int,words:array<int>,gaps:array<int>>>")
    rows = rows.withColumn("present", present)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.when(F.col("norm") == "  ", 0).otherwise(spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
                       F.when(F.size("present") > 0, found).otherwise(none).alias("hits"))
    rows = stage(rows, "licences")
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select(
        "row", "h.rule", F.posexplode(F.arrays_zip(F.expr("h.words").alias("words"), F.expr("slice(h.gaps, 1, size(h.words))").alias("gaps")))
        .alias("k", "x")).select("row", "rule", "k", "x.words", F.col("x.gaps").alias("gap"))
    upto = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("words")).over(upto))
    hits = hits.withColumn("start", F.col("end") - F.col("words"))
    info = F.array(*[F.struct(F.lit(r[0]).alias("label"), F.lit(r[2]).alias("priority"), F.lit(r[3]).alias("score"),
                              F.lit(r[5]).alias("base")) for r in table])
    hits = hits.withColumn("i", F.element_at(info, F.col("rule") + 1)).select("row", "rule", "start", "end", "i.*")
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", F.desc("base"), "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in _LEVELS:
        furthest = F.max(F.when(F.col("priority") <= level, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") == level) & F.coalesce(furthest >= F.col("end"), F.lit(False)))
    hits = hits.withColumn("kept", ~inside)
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = hits.groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), labels(F.col("base")).alias("base_labels"),
        labels(F.col("base") | F.col("kept")).alias("labels"), F.count_if("kept").alias("n_detections"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct(F.col("start"), F.col("end"), F.col("label"))))).alias("spans"))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "spans")
