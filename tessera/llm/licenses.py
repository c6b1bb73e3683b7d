"""License scan by ordered signature rules, in built-in expressions only.

A text is reduced to its words, one blank before, between and after them, so a rule is a regular expression over words and
a place is a word number.  A rule's regular expression runs only if a word of the text begins with the rule's keyword and the
text holds what the pattern always spells out; both are taken from the rules, so no match is lost.  What the rules find
are intervals of words.  They are resolved in one pass by place: an interval inside a kept one is
suppressed, equal intervals go to the rule that comes first, and of two that overlap in part the one whose rule comes
first stays.  Base phrases are found beside that and are never suppressed.

Defined results: null and empty texts have no words and no labels, score 0; repeated rows each get their own row; input
columns whose names clash with results are replaced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.llm.common import text_of

#: What parts words once A-Z are lower-cased: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str  # over words parted by one blank
    weight: float


# label | keyword | full name in words | short id in words.  Names are regular expressions over words; every match of a name has a
# word that begins with its keyword.
NAMES = """
agpl-3 | affero | (gnu )?affero general public licen[cs]e( version)? v?3( 0)? | agpl ?v? ?3( 0)?( only| or later)?
agpl-1 | affero | affero general public licen[cs]e( version)? v?1( 0)? | agpl ?v? ?1( 0)?( only| or later)?
agpl | affero | (gnu )?affero general public licen[cs]e | agpl
lgpl-3 | lesser | (gnu )?lesser general public licen[cs]e( version)? v?3( 0)? | lgpl ?v? ?3( 0)?( only| or later)?
lgpl-2.1 | lesser | (gnu )?lesser general public licen[cs]e( version)? v?2 1 | lgpl ?v? ?2 1( only| or later)?
lgpl-2 | library | (gnu )?library general public licen[cs]e( version)? v?2( 0)? | lgpl ?v? ?2( 0)?( only| or later)?
lgpl | lesser | (gnu )?lesser general public licen[cs]e | lgpl
gfdl-1.3 | documentation | (gnu )?free documentation licen[cs]e( version)? v?1 3 | gfdl ?v? ?1 3( only| or later)?
gfdl-1.2 | documentation | (gnu )?free documentation licen[cs]e( version)? v?1 2 | gfdl ?v? ?1 2( only| or later)?
gfdl | documentation | (gnu )?free documentation licen[cs]e | gfdl
gpl-3 | general | (gnu )?general public licen[cs]e( version)? v?3( 0)? | gpl ?v? ?3( 0)?( only| or later)?
gpl-2 | general | (gnu )?general public licen[cs]e( version)? v?2( 0)? | gpl ?v? ?2( 0)?( only| or later)?
gpl-1 | general | (gnu )?general public licen[cs]e( version)? v?1( 0)? | gpl ?v? ?1( 0)?( only| or later)?
gpl | general | (gnu )?general public licen[cs]e | gpl
cc-by-nc-nd | attribution | (creative commons )?attribution non ?commercial no ?deriv(ative)?s | cc by nc nd( [1-4] [05])?
cc-by-nc-sa | attribution | (creative commons )?attribution non ?commercial share ?alike | cc by nc sa( [1-4] [05])?
cc-by-nc-4 | attribution | (creative commons )?attribution non ?commercial 4 0( international)? | cc by nc 4 0
cc-by-nc | attribution | (creative commons )?attribution non ?commercial | cc by nc( [1-3] [05])?
cc-by-nd | attribution | (creative commons )?attribution no ?deriv(ative)?s | cc by nd( [1-4] [05])?
cc-by-sa-4 | attribution | (creative commons )?attribution share ?alike 4 0( international)? | cc by sa 4 0
cc-by-sa-3 | attribution | (creative commons )?attribution share ?alike 3 0( unported)? | cc by sa 3 0
cc-by-sa | attribution | (creative commons )?attribution share ?alike | cc by sa( [12] [05])?
cc-by-4 | attribution | (creative commons )?attribution 4 0( international)? | cc by 4 0
cc-by-3 | attribution | (creative commons )?attribution 3 0( unported)? | cc by 3 0
cc-by | commons | creative commons attribution | cc by( [12] [05])?
cc0 | universal | (creative commons )?(zero|cc0)( v?1 0)? universal | cc0( 1 0)?
apache-2 | apache | apache( software)? licen[cs]e( version)? v?2( 0)? | apache 2 0
apache-1.1 | apache | apache( software)? licen[cs]e( version)? v?1 1 | apache 1 1
apache-1 | apache | apache( software)? licen[cs]e( version)? v?1 0 | apache 1 0
apache | apache | apache( software)? licen[cs]e | apache licen[cs]ed
bsd-4-clause | bsd | (original|four clause|4 clause) bsd licen[cs]e | bsd 4 clause( uc)?
bsd-3-clause | bsd | (new|modified|revised|three clause|3 clause) bsd licen[cs]e | bsd 3 clause( clear| lbnl)?
bsd-2-clause | bsd | (simplified|freebsd|two clause|2 clause) bsd licen[cs]e | bsd 2 clause( patent| views)?
bsd-0 | bsd | (zero clause|0 clause) bsd licen[cs]e | 0bsd
bsd | bsd | bsd( style)? licen[cs]e | bsd licen[cs]ed
mit-0 | mit | mit no attribution( licen[cs]e)? | mit 0
x11 | x11 | x11 licen[cs]e | x11
mit | expat | expat licen[cs]e | expat
mit | mit | mit licen[cs]e | mit
mpl-2 | mozilla | mozilla public licen[cs]e( version)? v?2( 0)? | mpl ?v? ?2 0
mpl-1.1 | mozilla | mozilla public licen[cs]e( version)? v?1 1 | mpl ?v? ?1 1
mpl | mozilla | mozilla public licen[cs]e | mpl
epl-2 | eclipse | eclipse public licen[cs]e( version)? v?2( 0)? | epl ?v? ?2 0
epl-1 | eclipse | eclipse public licen[cs]e( version)? v?1( 0)? | epl ?v? ?1 0
edl-1 | eclipse | eclipse distribution licen[cs]e( version)? v?1( 0)? | edl ?v? ?1 0
cddl-1.1 | distribution | common development and distribution licen[cs]e( version)? v?1 1 | cddl ?v? ?1 1
cddl-1 | distribution | common development and distribution licen[cs]e( version)? v?1( 0)? | cddl ?v? ?1 0
cpl-1 | common | common public licen[cs]e( version)? v?1( 0)? | cpl ?v? ?1 0
eupl-1.2 | european | european union public licen[cs]e( version)? v?1 2 | eupl ?v? ?1 2
eupl | european | european union public licen[cs]e | eupl( 1 [01])?
isc | licen | (isc|internet systems consortium) licen[cs]e | isc
zlib | zlib | zlib( libpng)? licen[cs]e | zlib( libpng)?
boost-1 | boost | boost software licen[cs]e( version)? v?1( 0)? | bsl 1 0
unlicense | unlicense | unlicense( licen[cs]e)? | unlicense
wtfpl | fuck | do what the fuck you want to public licen[cs]e | wtfpl
artistic-2 | artistic | artistic licen[cs]e( version)? v?2( 0)? | artistic 2 0
artistic-1 | artistic | artistic licen[cs]e( version)? v?1( 0)? | artistic 1 0( perl)?
python-2 | python | python( software foundation)? licen[cs]e( version| v)?( 2)?( 0)? | psf 2 0
php-3 | php | php licen[cs]e( version)? v?3( 0[01])? | php 3 0[01]?
ruby | ruby | ruby licen[cs]e | ruby
openssl | openssl | openssl licen[cs]e | openssl
postgresql | postgresql | postgresql licen[cs]e | postgresql
ofl-1.1 | open | sil open font licen[cs]e( version| v)?( 1 [01])? | ofl( 1 [01])?
odbl-1 | open | open (data commons open )?database licen[cs]e( v?1 0)? | odbl( 1 0)?
odc-by-1 | open | open data commons attribution licen[cs]e( v?1 0)? | odc by( 1 0)?
pddl-1 | public | public domain dedication and licen[cs]e( v?1 0)? | pddl( 1 0)?
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
afl-3 | academic | academic free licen[cs]e( version)? v?3( 0)? | afl ?v? ?3 0
osl-3 | open | open software licen[cs]e( version)? v?3( 0)? | osl ?v? ?3 0
ncsa | illinois | (university of )?illinois( ncsa)? open source licen[cs]e | ncsa
sspl-1 | server | server side public licen[cs]e( version| v)?( 1)? | sspl( v)?( 1 0)?
busl-1.1 | business | business source licen[cs]e( version| v)?( 1 1)? | busl( 1 1)?
elastic-2 | elastic | elastic licen[cs]e( version| v)?( 2)?( 0)? | elastic 2 0
rail-m | responsible | responsible ai licen[cs]e | openrail( ?m)?
llama-2 | llama | llama 2 community licen[cs]e( agreement)? | llama 2
llama-3 | llama | (meta )?llama 3( [123])? community licen[cs]e( agreement)? | llama 3( [123])?
"""

GRANT = (r"((is|are) )?(licen[cs]ed|released|distributed|published|available|provided|made available) under( the)?( terms of)?"
         r"( the)?( conditions of)?( the)? %s( licen[cs]e)?")

#: Forms in the order of their priority: pattern around {name} or {id}, weight.
FORMS = (
    (GRANT % "{name}", 1.0),
    (GRANT % "{id}", 1.0),
    (r"spdx licen[cs]e identifier {id}", 1.0),
    (r"(the )?{name}", 0.8),
    (r"licen[cs]ed? (under )?(is |as |the |of )*{id}", 0.6),
)

#: Notices that name no license: label, keyword, pattern, weight.
NOTICES = (
    ("proprietary", "rights", r"all rights reserved", 0.5),
    ("proprietary", "confidential", r"(proprietary and confidential|confidential and proprietary)", 0.6),
    ("proprietary", "prohibited", r"unauthori[sz]ed (copying|use|distribution)( or [a-z]+)* of this [a-z]+( [a-z]+)* is (strictly )?prohibited", 0.6),
    ("public-domain", "domain", r"(dedicated to|released into|placed in|in) the public domain", 0.7),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 0.9),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("copyright", "copyright", r"copyright( c)? (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?", 0.3),
)


def signature_rules() -> list[Rule]:
    """Rules in the order of their priority: by form, within a form the names as listed (special ones before general
    ones), then the notices.  A rule around a name has the name's keyword, one around an id the id's first letters."""
    rules = []
    for form, weight in FORMS:
        for line in NAMES.strip().splitlines():
            label, own, rest = (x.strip() for x in line.split("|", 2))
            name, _, short = (x.strip() for x in rest.rpartition(" | "))
            keyword = own if "{name}" in form else re.match("[a-z0-9]+", short)[0]
            rules.append(Rule(label, keyword, form.replace("{name}", f"({name})").replace("{id}", f"({short})"), weight))
    return rules + [Rule(*n) for n in NOTICES]


RULES = signature_rules()

_INTERVALS = "array<struct<start:bigint,stop:bigint,rule:int,label:string,weight:double>>"


def word_string(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, a blank before and after each; one blank if there are none."""
    inner = F.regexp_replace(text, SEPARATORS, " ")
    one = F.concat(F.lit(" "), F.trim(inner), F.lit(" "))
    return F.when(F.trim(inner) == "", F.lit(" ")).otherwise(one)


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _regex(pattern: str) -> str:
    return f"(?i) (?:{pattern})(?= )"


def _found(words: Column, regex: Column) -> Column:
    """Places of ``regex`` as structs (start, stop) of word numbers, in order.

    The text between two matches ends before the match's leading blank, and a match stops before its trailing blank, so
    the blanks passed so far number the words.
    """
    gaps, hits = F.split(words, regex, -1), F.regexp_extract_all(words, regex, F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))
    return F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start,
        lambda acc, x: let(
            acc["at"] + _blanks(x["gap"]),
            lambda at: F.when(x["hit"].isNull(), F.struct(at.alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                (at + _blanks(x["hit"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(at.alias("start"), (at + _blanks(x["hit"])).alias("stop")))).alias("out")))),
        lambda acc: acc["out"])


def spelled_out(pattern: str) -> list[str]:
    """Strings in every match of a rule's pattern between blanks: what stands outside classes, options and alternatives.  The longest three."""
    p = re.sub(r"\[[^\]]*\][?*+]?", "\0", f" {pattern} ")
    p = re.sub(r"[^()\0]\?", "\0", p)
    while "(" in p:
        p = re.sub(r"\(([^()]*)\)([?*]?)", lambda m: "\0" if m[2] or "|" in m[1] else m[1], p)
    return sorted((x for x in p.split("\0") if len(x.strip()) > 2), key=len, reverse=True)[:3]


def _table(rules) -> Column:
    """The rules as one constant array, by keyword."""
    by: dict[str, list] = {}
    for n, r in enumerate(rules):
        by.setdefault(" " + r.keyword, []).append(
            {"rule": n, "label": r.label, "spelled": spelled_out(r.pattern), "regex": _regex(r.pattern), "weight": r.weight})
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": rows} for k, rows in by.items()])),
                       "array<struct<keyword:string,rules:array<struct<rule:int,label:string,spelled:array<string>,regex:string,weight:double>>>>")


def detections(words: Column, rules=None) -> Column:
    """All intervals of all rules whose keyword and spelled-out strings the text holds, unresolved."""
    table = _table(RULES if rules is None else rules)
    return let(F.lower(words), lambda low: F.flatten(F.transform(
        F.filter(F.flatten(F.transform(F.filter(table, lambda g: F.contains(low, g["keyword"])), lambda g: g["rules"])),
                 lambda r: F.forall(r["spelled"], lambda x: F.contains(low, x))),
        lambda r: F.transform(_found(low, r["regex"]), lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight"))))))


def resolve(found: Column) -> Column:
    """Priority and containment: the interval of the first rule is kept, or the longest that contains it, what overlaps it goes, and so
    on with those left; so only kept intervals suppress others.

    An interval takes the place in line of the first rule among those it contains and stands before them.  Stretches of the text whose
    intervals don't touch are resolved each on its own."""
    ordered = F.transform(F.sort_array(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), (-x["stop"]).alias("back"), x["rule"].alias("rule"), x["label"].alias("label"), x["weight"].alias("weight")))),
        lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["rule"].alias("rule"), x["label"].alias("label"), x["weight"].alias("weight")))
    none = F.array().cast(_INTERVALS)
    begun = F.struct(F.lit(-1).cast("bigint").alias("stop"), F.array().cast(f"array<{_INTERVALS}>").alias("done"), none.alias("open"))

    def sweep(acc, x):
        apart = x["start"] >= acc["stop"]
        return F.struct(
            F.greatest(acc["stop"], x["stop"]).alias("stop"),
            F.when(apart, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(apart, F.array(x)).otherwise(F.concat(acc["open"], F.array(x))).alias("open"))

    def settle(stretch):
        line = F.sort_array(F.transform(stretch, lambda x: F.struct(
            F.array_min(F.transform(F.filter(stretch, lambda y: (y["start"] >= x["start"]) & (y["stop"] <= x["stop"])), lambda y: y["rule"])).alias("place"),
            (x["start"] - x["stop"]).alias("shortness"), x["start"].alias("start"), x["rule"].alias("rule"), x.alias("own"))))
        kept = F.aggregate(F.transform(line, lambda x: x["own"]), none, lambda kept, x: F.when(
            F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"])), kept).otherwise(F.concat(kept, F.array(x))))
        return F.when(F.size(stretch) < 2, stretch).otherwise(F.sort_array(kept))

    stretches = F.aggregate(ordered, begun, sweep, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.when(F.size(found) == 0, none).otherwise(F.flatten(F.transform(stretches, settle)))


def scan(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and the kept ``detections``."""
    places = "array<struct<start:bigint,label:string>>"

    def places_of(label):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label"))

    def base_of(w, phrase, label):
        held = F.transform(_found(w, F.lit(_regex(phrase))), places_of(label))
        return F.when(F.contains(F.lower(w), F.lit(f" {phrase} ")), held.cast(places)).otherwise(F.array().cast(places))

    def digest(w):
        base = F.flatten(F.array(*[base_of(w, *b) for b in BASE]))
        return F.struct(base.alias("base"), resolve(detections(w, rules)).alias("found"))

    out = df.withColumn("__llm_words", word_string(text_of(text)))
    out = out.withColumn("__llm_hits", let(F.col("__llm_words"), digest))
    base, found = F.col("__llm_hits.base"), F.col("__llm_hits.found")
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda x: x["label"]), F.transform(found, lambda x: x["label"]))))
    return out.withColumns({
        "n_words": F.greatest(_blanks(F.col("__llm_words")) - 1, F.lit(0).cast("bigint")),
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda x: x["start"])),
        "last_word": F.array_max(F.transform(base, lambda x: x["start"])),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ","),
        "labels": F.array_join(labels, ","),
        "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["weight"])), F.lit(0.0))),
        "detections": found,
    }).drop("__llm_words", "__llm_hits")
