"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Everything is DataFrame functions. Few texts pass the first gate; only those are split into words and
brought to a plain form (lower-case words joined by single spaces) that the rules are written for.
"""

from __future__ import annotations

import json
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Words after lower-casing A-Z; in raw text, capitals count too.
WORD_LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count: label -> words. They have the highest priority and are never suppressed.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
BASE_PRIORITY = 4

#: Words that begin so; every rule contains one of these, and a text without any is not looked at further.
ANCHORS = (
    "licen", "spdx", "released under", "distributed under", "available under", "covered by", "permission", "redistribution",
    "public domain", "publicdomain", "rights reserved", "creative commons", "creativecommons", "warrant", "copyleft", "opensource org",
    "copyright", "misrepresented", "unauthorized copying", "confidential", "retain this notice", "advertising materials", "endorse",
    "free software", "altered source", "machine executable",
)

#: Named licenses: label, what words must begin with (whole words end with a space), pattern of the name in plain form.
NAMES = (
    ("mit", "mit ", "mit"),
    ("mit-0", "mit ", "mit (no attribution|0)"),
    ("apache-1.1", "apache", "apache( software)?( license)?( version)? 1 1"),
    ("apache-2.0", "apache", "apache( software)?( license)?( version)? v?2( 0)?"),
    ("apache", "apache", "apache( software)?"),
    ("gpl-2.0", "gpl", "(gnu )?gpl ?v?( version)? ?2( 0)?( only| or later)?"),
    ("gpl-3.0", "gpl", "(gnu )?gpl ?v?( version)? ?3( 0)?( only| or later)?"),
    ("gpl", "gpl", "(gnu )?gpl"),
    ("gpl-2.0", "general public", "(gnu )?general public license( gpl)?( as published by the free software foundation)?( either)?( version)? v?2( 0)?"),
    ("gpl-3.0", "general public", "(gnu )?general public license( gpl)?( as published by the free software foundation)?( either)?( version)? v?3( 0)?"),
    ("lgpl-2.1", "lgpl", "(gnu )?lgpl ?v?( version)? ?2 1( only| or later)?"),
    ("lgpl-3.0", "lgpl", "(gnu )?lgpl ?v?( version)? ?3( 0)?( only| or later)?"),
    ("lgpl", "lgpl", "(gnu )?lgpl"),
    ("lgpl", "lesser general", "(gnu )?lesser general public"),
    ("lgpl", "library general", "(gnu )?library general public"),
    ("agpl-3.0", "agpl", "(gnu )?agpl ?v?( version)? ?3( 0)?( only| or later)?"),
    ("agpl", "agpl", "(gnu )?agpl"),
    ("agpl", "affero", "(gnu )?affero general public"),
    ("gfdl", "free documentation", "(gnu )?free documentation"),
    ("bsd-2-clause", "bsd", "bsd 2 clause( simplified)?"),
    ("bsd-2-clause", "bsd", "(2 clause|simplified|freebsd) bsd"),
    ("bsd-3-clause", "bsd", "bsd 3 clause( new| revised)?"),
    ("bsd-3-clause", "bsd", "(3 clause|new|revised|modified) bsd"),
    ("bsd-4-clause", "bsd", "(bsd 4 clause|(4 clause|original|old) bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("bsd", "bsd", "bsd( style)?"),
    ("isc", "isc ", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public license( mpl)?( version)? v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license( mpl)?( version)? v?2( 0)?"),
    ("mpl-2.0", "mpl", "mpl ?v?( version)? ?2( 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public license( epl)?( version)? v?1( 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license( epl)?( version)? v?2( 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl( version)?( 1 [01])?"),
    ("cddl", "common development", "common development and distribution"),
    ("cpl", "common public", "common public"),
    ("eupl", "european union", "european union public"),
    ("eupl", "eupl", "eupl( version)?( 1 [0-2])?"),
    ("artistic-2.0", "artistic", "artistic license( version)? 2( 0)?"),
    ("artistic", "artistic", "(perl )?artistic"),
    ("zlib", "zlib", "zlib( libpng)?"),
    ("bsl-1.0", "boost", "boost software( license)?( version)?( 1 0)?"),
    ("bsl-1.0", "bsl", "bsl 1 0"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"),
    ("psf", "python", "python( software foundation)?( psf)?"),
    ("php", "php", "php( version)?( 3 01)?"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)?"),
    ("ofl-1.1", "open font", "(sil )?open font( license)?( version)?( 1 1)?"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal"),
    ("osl-3.0", "open software", "open software( license)?( version)?( 3 0)?"),
    ("afl-3.0", "academic free", "academic free( license)?( version)?( 3 0)?"),
    ("ecl-2.0", "educational community", "educational community( license)?( version)?( 2 0)?"),
    ("odbl", "open database", "(odc )?open database"),
    ("sspl", "server side public", "server side public"),
    ("busl", "business source", "business source"),
    ("elastic", "elastic", "elastic( license)?( version)?( 2 0)?"),
    ("cc0", "cc0", "cc0( 1 0)?( universal)?"),
)

#: How a name is put: rule name, anchor that must occur, pattern, priority, weight.
FORMS = (
    ("spdx", "spdx", "spdx license identifier {}", 3, 1.0),
    ("licensed", "licen", "(dual )?licensed under( the)?( terms of)?( the)? {}", 3, 0.95),
    ("released", "released under", "released under( the)?( terms of)?( the)? {}( license)?", 2, 0.9),
    ("distributed", "distributed under", "distributed under( the)?( terms of)?( the)? {}( license)?", 2, 0.9),
    ("available", "available under", "(made )?available under( the)?( terms of)?( the)? {}( license)?", 2, 0.85),
    ("covered", "covered by", "covered by( the)? {}( license)?", 2, 0.85),
    ("named", "licen", "(the )?{} licen[sc]e( agreement)?", 1, 0.8),
    ("field", "licen", "licen[sc]e (is )?(the )?{}", 1, 0.7),
)

#: Sentences of the licenses themselves and other notices: label, keyword, anchor, pattern, priority, weight.
SENTENCES = (
    ("mit", "free of charge", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("isc", "with or without fee", "permission", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("bsd", "source and binary forms", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("bsd-3-clause", "neither the name", "endorse", "neither the name of .{1,80}? nor the names of (its|the) contributors may be used to endorse", 3, 1.0),
    ("unlicense", "unencumbered", "public domain", "this is free and unencumbered software released into the public domain", 3, 1.0),
    ("public-domain", "dedicated", "public domain", "dedicated to the public domain", 2, 0.8),
    ("public-domain", "placed", "public domain", "placed (in|into) the public domain", 2, 0.8),
    ("gpl", "verbatim copies", "licen", "everyone is permitted to copy and distribute verbatim copies of this license document", 3, 1.0),
    ("gpl", "redistribute it", "free software", "this program is free software you can redistribute it and or modify it", 3, 0.95),
    ("zlib", "plainly marked", "altered source", "altered source versions must be plainly marked as such", 3, 0.95),
    ("bsl-1.0", "source language processor", "machine executable", "machine executable object code generated by a source language processor", 3, 0.95),
    ("apache-2.0", "compliance with the license", "licen", "you may not use this file except in compliance with the license", 3, 0.95),
    ("wtfpl", "what the fuck you want", "licen", "do what the fuck you want to public license", 3, 1.0),
    ("cc0", "commons", "creative commons", "creative commons (cc0|zero)( 1 0)?( universal)?", 3, 0.95),
    ("cc-by-nc-nd", "commons", "creative commons", "creative commons attribution non ?commercial no ?deriv(ative)?s", 3, 0.95),
    ("cc-by-nc-sa", "commons", "creative commons", "creative commons attribution non ?commercial share ?alike", 3, 0.95),
    ("cc-by-nc", "commons", "creative commons", "creative commons attribution non ?commercial", 3, 0.95),
    ("cc-by-nd", "commons", "creative commons", "creative commons attribution no ?deriv(ative)?s", 3, 0.95),
    ("cc-by-sa", "commons", "creative commons", "creative commons attribution share ?alike", 3, 0.95),
    ("cc-by", "commons", "creative commons", "creative commons attribution", 3, 0.95),
    ("proprietary", "proprietary", "licen", "proprietary (and confidential )?licen[sc]e", 2, 0.7),
    ("mit", "merchantability", "warrant", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 3, 0.95),
    ("mit", "opensource org", "opensource org", "opensource org licenses mit( license)?( php)?", 3, 0.95),
    ("bsd-2-clause", "opensource org", "opensource org", "opensource org licenses bsd 2 clause", 3, 0.95),
    ("bsd-3-clause", "opensource org", "opensource org", "opensource org licenses bsd 3 clause", 3, 0.95),
    ("bsd", "source code must retain", "copyright", "redistributions of source code must retain the above copyright notice", 3, 0.95),
    ("bsd", "in binary form must", "copyright", "redistributions in binary form must reproduce the above copyright notice", 3, 0.95),
    ("bsd", "copyright holders and contributors", "copyright", "this software is provided by the copyright holders and contributors as is", 3, 0.95),
    ("bsd-4-clause", "mentioning features", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 3, 1.0),
    ("apache-2.0", "as is basis", "warrant", "on an as is basis without warranties or conditions of any kind either express or implied", 3, 0.95),
    ("apache-2.0", "apache org", "licen", "apache org licenses license 2 0", 3, 1.0),
    ("gpl", "received a copy", "licen", "you should have received a copy of the gnu general public license along with this program", 3, 1.0),
    ("lgpl", "received a copy", "licen", "you should have received a copy of the gnu lesser general public license", 3, 1.0),
    ("agpl", "received a copy", "licen", "you should have received a copy of the gnu affero general public license", 3, 1.0),
    ("gpl", "gnu org", "licen", "gnu org licenses (old licenses )?gpl( [23] 0)?", 3, 0.95),
    ("lgpl", "gnu org", "licen", "gnu org licenses (old licenses )?lgpl( [23] [01])?", 3, 0.95),
    ("agpl", "gnu org", "licen", "gnu org licenses agpl( 3 0)?", 3, 0.95),
    ("mpl-2.0", "mozilla public", "licen", "this source code form is subject to the terms of the mozilla public license v 2 0", 3, 1.0),
    ("mpl-1.1", "mozilla public", "licen", "the contents of this file are subject to the mozilla public license version 1 1", 3, 1.0),
    ("epl", "accompanying materials", "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license", 3, 1.0),
    ("ofl-1.1", "font software", "licen", "this font software is licensed under the sil open font license version 1 1", 3, 1.0),
    ("zlib", "the origin of this", "misrepresented", "the origin of this software must not be misrepresented", 3, 1.0),
    ("zlib", "held liable", "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 3, 1.0),
    ("bsl-1.0", "this entire statement", "copyright", "the copyright notices in the software and this entire statement including the above license grant", 3, 1.0),
    ("beerware", "whatever you want", "retain this notice", "as long as you retain this notice you can do whatever you want with this stuff", 3, 1.0),
    ("cc0", "publicdomain zero", "creativecommons", "creativecommons org publicdomain zero 1 0", 3, 1.0),
    ("cc0", "neighboring rights", "copyright", "waived all copyright and related or neighboring rights", 3, 0.95),
    ("cc-by", "licenses by", "creativecommons", "creativecommons org licenses by [1-4] [05]", 3, 1.0),
    ("cc-by-sa", "licenses by", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", 3, 1.0),
    ("cc-by-nc", "licenses by", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", 3, 1.0),
    ("cc-by-nd", "licenses by", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", 3, 1.0),
    ("cc-by-nc-sa", "licenses by", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", 3, 1.0),
    ("cc-by-nc-nd", "licenses by", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", 3, 1.0),
    ("proprietary", "via any medium", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 3, 0.95),
    ("proprietary", "confidential and proprietary", "confidential", "this software is the confidential and proprietary information of", 3, 0.95),
    ("all-rights-reserved", "rights reserved", "rights reserved", "all rights reserved", 1, 0.6),
)


def rules() -> list[dict]:
    """All signature rules in order: base phrases, names in each form, sentences."""
    made = [
        {"rule": f"base:{label}", "label": label, "keyword": words, "anchor": "licen", "pattern": words, "priority": BASE_PRIORITY, "weight": 0.9}
        for label, words in BASE.items()
    ]
    for label, keyword, name in NAMES:
        for form, anchor, pattern, priority, weight in FORMS:
            made.append({"rule": f"{form}:{label}", "label": label, "keyword": keyword, "anchor": anchor, "pattern": pattern.format(f"({name})"), "priority": priority, "weight": weight})
    for label, keyword, anchor, pattern, priority, weight in SENTENCES:
        made.append({"rule": f"text:{label}", "label": label, "keyword": keyword, "anchor": anchor, "pattern": pattern, "priority": priority, "weight": weight})
    for rule in made:
        rule["pattern"] = f"(?<![^ ]){rule['pattern']}(?![^ ])"
    return made


RULE = "rule string, label string, keyword string, anchor string, pattern string, priority int, weight double"
SPAN = "start:bigint, end:bigint, label:string, rule:string, priority:int, weight:double"
NO_SPANS = f"array<struct<{SPAN}>>"


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words_in(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _found(plain: Column, rule: Column) -> Column:
    """All places of a rule, in words, by marking them in the text and counting spaces between the marks."""
    marked = F.regexp_replace(plain, rule["pattern"], F.lit("\u0001$0\u0002"))

    def step(seen, piece):
        cut = F.instr(piece, "\u0002")
        inside = F.when(cut > 0, F.substring(piece, F.lit(1), cut)).otherwise("")
        span = F.struct(
            seen["at"].alias("start"), (seen["at"] + _words_in(inside) + 1).alias("end"), rule["label"].alias("label"),
            rule["rule"].alias("rule"), rule["priority"].alias("priority"), rule["weight"].alias("weight"),
        )
        spans = F.when(cut > 0, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"])
        return F.struct((seen["at"] + _words_in(piece)).alias("at"), spans.cast(NO_SPANS).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(NO_SPANS).alias("spans"))
    return F.aggregate(F.split(marked, "\u0001"), start, step)["spans"]


def _resolved(spans: Column) -> Column:
    """Drops a place that lies in another of the same or a higher priority.

    Sorted by start, then longest and highest first, whatever contains a place comes before it, so one
    pass with the furthest end per priority decides.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["priority"]).alias("c"), s["rule"].alias("d"), s.alias("s"))))
    levels = range(1, BASE_PRIORITY + 1)

    def step(seen, entry):
        s = entry["s"]
        reach = F.lit(None).cast("bigint")
        for level in levels:
            reach = F.when(s["priority"] == level, seen[f"m{level}"]).otherwise(reach)
        stays = s["end"] > reach
        furthest = [
            F.when(s["priority"] >= level, F.greatest(seen[f"m{level}"], s["end"])).otherwise(seen[f"m{level}"]).alias(f"m{level}")
            for level in levels
        ]
        kept = F.when(stays, F.concat(seen["kept"], F.array(s))).otherwise(seen["kept"])
        return F.struct(*furthest, kept.cast(NO_SPANS).alias("kept"))

    start = F.struct(*(F.lit(0).cast("bigint").alias(f"m{level}") for level in levels), F.array().cast(NO_SPANS).alias("kept"))
    return F.aggregate(ordered, start, step)["kept"]


def scan_licenses(docs: DataFrame, text_column: str = "text", signatures: list[dict] | None = None) -> DataFrame:
    """``row`` (the input's columns), ``n_words``, ``base_spans``, ``spans``, ``labels`` and ``score`` of each whole text.

    Spans have start and end (exclusive) in words, label, rule, priority and weight. Base phrases are
    found at all their places and never suppressed. Labels are distinct and sorted; the score is the
    largest weight among the spans, 0 without any. A null text counts as empty: no words, no spans.
    White space, punctuation and line breaks between words don't matter. Rows are independent of each other,
    so nothing is shuffled.
    """
    signatures = rules() if signatures is None else signatures
    columns = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    given = docs.select(columns, text_or_empty(text_column).alias("text")).withColumn("low", F.lower("text"))
    gate = F.lit(False)
    for anchor in ANCHORS:  # words of an anchor may stand on two lines, so each is looked for by itself
        gate = gate | reduce(Column.__and__, [F.contains("low", F.lit(word)) for word in anchor.split(" ")])
    gated = given.select("row", F.regexp_count("text", F.lit(WORD_RAW)).cast("bigint").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    plain = gated.select("row", "n_words", F.array_join(F.array_remove(F.split(lower, GAP_LOWER), ""), " ").alias("plain"))
    keywords = _constant(sorted({r["keyword"] for r in signatures}), "array<string>")
    anchors = _constant(list(ANCHORS), "array<string>")
    padded = plain.withColumn("padded", F.concat(F.lit(" "), "plain", F.lit(" ")))
    present = lambda words: F.filter(words, lambda w: F.contains(F.col("padded"), F.concat(F.lit(" "), w)))
    seen = padded.select("*", present(keywords).alias("keywords"), present(anchors).alias("anchors"))
    chosen = F.filter(
        _constant(signatures, f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>"),
        lambda r: F.array_contains(F.col("keywords"), r["keyword"]) & F.array_contains(F.col("anchors"), r["anchor"]),
    )
    # both lists are used twice so that the optimizer keeps them as columns of the row, outside the lambda
    chosen = F.when((F.size("keywords") > 0) & (F.size("anchors") > 0), chosen)
    spans = F.flatten(F.transform(chosen, lambda r: _found(F.col("plain"), r)))
    found = seen.select("row", "n_words", F.coalesce(spans, F.array().cast(NO_SPANS)).alias("all"))
    base = F.filter("all", lambda s: s["priority"] == BASE_PRIORITY)
    resolved = found.select("row", "n_words", base.alias("base_spans"), F.when(F.size("all") > 0, _resolved(F.col("all"))).otherwise(F.col("all")).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"])))
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["weight"])), F.lit(0.0))
    return resolved.select("*", labels.alias("labels"), score.alias("score"))
