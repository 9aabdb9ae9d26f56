"""License scan: ordered signature rules behind a keyword prefilter, with priority and containment settling overlaps."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.common import stage
from netspark.llm.spans import matches

# Phrases that are always looked for, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Priority of a rule: a lower tier wins over what it contains.
NAMED, TITLE, CLAUSE, HINT = 1, 2, 3, 4
SCORES = {NAMED: 1.0, TITLE: 0.8, CLAUSE: 0.6, HINT: 0.3}

#: What ends the name in the endorsement clause, however long the name is; the second part keeps the search linear.
NEITHER = "nor the names of its contributors may be used to endorse |neither the name of "

# Rules are written over lower-case words with one space between, so "CC BY-NC 4.0" reads "cc by nc 4 0".
# Every match of a rule holds its keyword as a word; spellings without a common word are rules of their own.
# (label, keyword, pattern, versions, tier): {v} takes each version's words; without versions the pattern stands alone.
FAMILIES = [
    ("gpl-{}", "general", r"(?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? v(?:ersion )?{v}", ["1", "2", "3"], NAMED),
    ("gpl-{}-or-later", "general", r"(?:gnu )?general public license(?: gpl)? v(?:ersion )?{v} or (?:at your option )?(?:any )?later(?: version)?", ["1", "2", "3"], NAMED),
    ("lgpl-{}", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)? v(?:ersion )?{v}", ["2", "2 1", "3"], NAMED),
    ("lgpl-{}", "library", r"(?:gnu )?library general public license(?: lgpl)? v(?:ersion )?{v}", ["2"], NAMED),
    ("agpl-{}", "affero", r"(?:gnu )?affero general public license(?: agpl)? v(?:ersion )?{v}", ["1", "3"], NAMED),
    ("gfdl-{}", "documentation", r"(?:gnu )?free documentation license v(?:ersion )?{v}", ["1 1", "1 2", "1 3"], NAMED),
    ("gpl-{}", "gpl", r"(?:gnu )?gpl v?(?:ersion )?{v}(?: 0)?(?: only)?", ["1", "2", "3"], NAMED),
    ("gpl-{}-or-later", "gpl", r"(?:gnu )?gpl v?{v}(?: 0)? or later", ["1", "2", "3"], NAMED),
    ("lgpl-{}", "lgpl", r"(?:gnu )?lgpl v?{v}(?: only)?", ["2", "2 0", "2 1", "3", "3 0"], NAMED),
    ("lgpl-{}-or-later", "lgpl", r"(?:gnu )?lgpl v?{v} or later", ["2", "2 0", "2 1", "3", "3 0"], NAMED),
    ("agpl-{}", "agpl", r"(?:gnu )?agpl v?{v}(?: only)?", ["1 0", "3", "3 0"], NAMED),
    ("agpl-{}-or-later", "agpl", r"(?:gnu )?agpl v?{v} or later", ["1 0", "3", "3 0"], NAMED),
    ("gfdl-{}", "gfdl", r"gfdl {v}(?: only| or later)?", ["1 1", "1 2", "1 3"], NAMED),
    ("apache-{}", "apache", r"apache(?: software)? licen[sc]e(?: v(?:ersion)?)? ?{v}", ["1 0", "1 1", "2 0"], NAMED),
    ("apache-{}", "apache", r"apache {v}", ["1 0", "1 1", "2 0"], NAMED),
    ("mpl-{}", "mozilla", r"mozilla public licen[sc]e(?: mpl)?(?: v(?:ersion)?)? ?{v}", ["1 0", "1 1", "2 0"], NAMED),
    ("mpl-{}", "mpl", r"mpl v?{v}", ["1 0", "1 1", "2 0"], NAMED),
    ("epl-{}", "eclipse", r"eclipse public licen[sc]e(?: epl)?(?: v(?:ersion)?)? ?{v}", ["1 0", "2 0"], NAMED),
    ("epl-{}", "epl", r"epl v?{v}", ["1 0", "2 0"], NAMED),
    ("eupl-{}", "european", r"european union public licen[sc]e(?: eupl)?(?: v(?:ersion)?)? ?{v}", ["1 0", "1 1", "1 2"], NAMED),
    ("eupl-{}", "eupl", r"eupl v?{v}", ["1 0", "1 1", "1 2"], NAMED),
    ("cddl-{}", "cddl", r"cddl v?{v}", ["1 0", "1 1"], NAMED),
    ("cddl-{}", "distribution", r"common development and distribution licen[sc]e(?: cddl)?(?: v(?:ersion)?)? ?{v}", ["1 0", "1 1"], NAMED),
    ("osl-{}", "open", r"open software licen[sc]e(?: v(?:ersion)?)? ?{v}", ["1 0", "1 1", "2 0", "2 1", "3 0"], NAMED),
    ("afl-{}", "academic", r"academic free licen[sc]e(?: v(?:ersion)?)? ?{v}", ["1 1", "1 2", "2 0", "2 1", "3 0"], NAMED),
    ("artistic-{}", "artistic", r"artistic licen[sc]e(?: v(?:ersion)?)? ?{v}", ["1 0", "2 0"], NAMED),
    ("bsl-{}", "boost", r"boost software licen[sc]e(?: v(?:ersion)?)? ?{v}", ["1 0"], NAMED),
    ("bsd-{}-clause", "bsd", r"(?:{v} clause bsd|bsd {v} clause)(?: licen[sc]e)?", ["0", "1", "2", "3", "4"], NAMED),
    ("bsd-2-clause", "bsd", r"simplified bsd(?: licen[sc]e)?", [], NAMED),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[sc]e)?", [], NAMED),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", [], NAMED),
    ("bsd-4-clause", "bsd", r"original bsd(?: licen[sc]e)?", [], NAMED),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", [], NAMED),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", [], NAMED),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: version 1 0)?", [], NAMED),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e(?: version 1 0)?", [], NAMED),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[sc]e", [], NAMED),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[sc]e", [], NAMED),
    ("pddl-1.0", "domain", r"public domain dedication and licen[sc]e", [], NAMED),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[sc]e(?: (?:ofl )?v(?:ersion )?1 1)?", [], NAMED),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", [], NAMED),
    ("cc0-1.0", "commons", r"creative commons zero(?: v?1 0)?(?: universal)?", [], NAMED),
    ("mit", "mit", r"(?:the )?mit licen[sc]e", [], NAMED),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", [], NAMED),
    ("isc", "isc", r"(?:the )?isc licen[sc]e", [], NAMED),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", [], NAMED),
    ("unlicense", "unlicense", r"the unlicense", [], NAMED),
    ("wtfpl", "want", r"do what the f\w+ you want to public licen[sc]e", [], NAMED),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?", [], NAMED),
    ("ruby", "ruby", r"ruby licen[sc]e", [], NAMED),
    ("php-3.01", "php", r"php licen[sc]e(?: v(?:ersion )?3 0?1)?", [], NAMED),
    ("openssl", "openssl", r"openssl licen[sc]e", [], NAMED),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", [], NAMED),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", [], NAMED),
    ("beerware", "beer", r"the beer ware licen[sc]e", [], NAMED),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", [], TITLE),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", [], TITLE),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", [], TITLE),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", [], TITLE),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", [], TITLE),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", [], TITLE),
    ("epl", "eclipse", r"eclipse public licen[sc]e", [], TITLE),
    ("eupl", "european", r"european union public licen[sc]e", [], TITLE),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", [], TITLE),
    ("artistic", "artistic", r"artistic licen[sc]e", [], TITLE),
    ("cc", "commons", r"creative commons licen[sc]e", [], TITLE),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", [], TITLE),
    ("public-domain", "domain", r"(?:is|are) in the public domain", [], TITLE),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[sc]e|software)", [], TITLE),
    ("proprietary", "permission", r"may not be (?:copied|reproduced|redistributed) without (?:prior |written |express )*permission", [], TITLE),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", [], CLAUSE),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", [], CLAUSE),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", [], CLAUSE),
    ("bsd-3-clause", "endorse", rf"neither the name of(?: (?!{NEITHER})[^ ]++)++ nor the names of its contributors may be used to endorse", [], CLAUSE),
    ("zlib", "origin", r"the origin of this software must not be misrepresented", [], CLAUSE),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", [], CLAUSE),
    ("gpl", "software", r"this program is free software you can redistribute it and or modify it", [], CLAUSE),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", [], CLAUSE),
    ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public licen[sc]e", [], CLAUSE),
    ("warranty", "warranty", r"without warranty of any kind", [], CLAUSE),
    ("reserved", "rights", r"(?:all|some|no) rights reserved", [], HINT),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", [], HINT),
    ("licensed", "licensed", r"(?:is )?licensed under", [], HINT),
    ("licensed", "released", r"released under", [], HINT),
    ("licensed", "license", r"see (?:the )?license(?: file)?", [], HINT),
    ("licensed", "licence", r"see (?:the )?licence(?: file)?", [], HINT),
    ("licensed", "spdx", r"spdx license identifier", [], HINT),
]
CC_PARTS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}


def signatures() -> list[tuple]:
    """All rules in order: (rule, label, keyword, regex, tier)."""
    out = []
    for label, keyword, pattern, versions, tier in FAMILIES:
        for v in versions or [""]:
            out.append((label.format(v.replace(" ", ".")), keyword, pattern.replace("{v}", v), tier))
    for parts in CC_PARTS:
        name, long = "cc-" + parts.replace(" ", "-"), " ".join(CC_LONG[p] for p in parts.split())
        for v in CC_VERSIONS:
            out.append((f"{name}-{v.replace(' ', '.')}", "cc", f"cc {parts} {v}", NAMED))
            out.append((f"{name}-{v.replace(' ', '.')}", "commons", f"creative commons {long}(?: licen[sc]e)? {v}", NAMED))
        out.append((name, "cc", f"cc {parts}", TITLE))
        out.append((name, "commons", f"creative commons {long}", TITLE))
    return [(i, label, keyword, f"(?<= )(?:{pattern})(?= )", tier) for i, (label, keyword, pattern, tier) in enumerate(out)]


def normal(text: Column) -> Column:
    """Lower-case words with one space around each: " cc by 4 0 "; a text without words is one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def word_places(words: Column, pattern: Column) -> Column:
    """Matches in a normal text by words: array of (start, end).

    The words before a place are the spaces before it less one; a match is
    behind a space and holds one word more than spaces.
    """
    return F.transform(matches(words, pattern), lambda m: F.struct(
        (spaces(F.substring(words, F.lit(1), m["start"].cast("int"))) - 1).alias("start"),
        (spaces(F.substring(words, F.lit(1), m["end"].cast("int")))).alias("end")))


def base_places(words: Column) -> Column:
    """Places of the base phrases: array of (start, label)."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def places(phrase, label):
        at = F.transform(word_places(words, F.lit(f"(?<= ){phrase}(?= )")), lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))
        return F.when(words.contains(f" {phrase} "), at).otherwise(none)

    return F.concat(*[places(*b) for b in BASE])


def detections(words: Column) -> Column:
    """Every match of every rule whose keyword is in the text: array of (start, end, tier, rule, label)."""
    rules = signatures()
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(f" {key} ").alias("keyword"), F.lit(regex).alias("regex"), F.lit(tier).alias("tier"))
                      for i, label, key, regex, tier in rules])
    gate = "|".join(sorted({re.escape(r[2]) for r in rules}))
    some = F.filter(table, lambda r: words.contains(r["keyword"]))
    hits = F.flatten(F.transform(some, lambda r: F.transform(word_places(words, r["regex"]), lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), r["tier"].alias("tier"), r["rule"].alias("rule"), r["label"].alias("label")))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,tier:int,rule:int,label:string>>")
    return F.when(words.rlike(f" (?:{gate}) "), hits).otherwise(none)


def settle(found: DataFrame, key: list[str]) -> DataFrame:
    """Drop each detection that lies inside another of the same or a higher priority.

    In order of start, longer first, whatever contains a detection stands
    before it, so a running largest end per tier decides: no pairs are met.
    """
    before = Window.partitionBy(*key).orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = None
    for tier in SCORES:
        so_far = F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(before)
        reach = F.when(F.col("tier") == tier, so_far) if reach is None else reach.when(F.col("tier") == tier, so_far)
    return found.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, detections) of docs (doc_id, text).

    `texts`: doc_id, text_hash, n_words, base (start, label) per row of docs.
    `detections`: doc_id, text_hash, start, end, tier, rule, label, in words, after overlaps are settled.
    Null and empty texts have no words and no places; equal rows have equal
    detections; null ids are ids; other columns are not read; an empty table
    gives empty tables.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normal(F.col("text")).alias("_words"))
    read = stage(words.select("doc_id", "text_hash", (spaces(F.col("_words")) - 1).alias("n_words"), base_places(F.col("_words")).alias("base"),
                              detections(F.col("_words")).alias("found")), "licenses")
    rows = read.select("doc_id", "text_hash", F.explode("found").alias("d")).select("doc_id", "text_hash", "d.*")
    return read.drop("found"), settle(rows, ["doc_id", "text_hash"])


def label_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base, found_labels, score (of its best detection; 0 without one)."""
    texts, found = scan(docs)
    points = F.lit(0.0)
    for tier, score in SCORES.items():
        points = F.when(F.col("tier") == tier, score).otherwise(points)
    per = found.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found_labels"), F.max(points).alias("score"))
    per = per.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = texts.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "n_words", "base", F.coalesce("found_labels", F.array().cast("array<string>")).alias("found_labels"),
                      F.coalesce("score", F.when(F.size("base") > 0, SCORES[HINT]).otherwise(0.0)).alias("score"))
