"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its words (A-Z in lower case, everything else that is ASCII and neither letter nor digit parts words), set
apart by single spaces, and every rule is a regular expression over that. Rules come from two hand-written tables, licenses by
name (``FAMILIES``) in the forms in which a license is referred to (``FORMS``), and sentences of license texts (``NOTICES``), in
that order of priority. They are gated twice: a text that contains none of a few triggers is never normalised, and a rule
runs only over texts that contain its keyword.

Detections are intervals of words. One that lies within another whose priority isn't lower is suppressed (of equal intervals
the one of higher priority stays, then the earlier rule), so 'GNU Lesser General Public License' isn't reported as
'General Public License' too. Phrases (``PHRASES``) are told at every place whatever else is found there.

A text is scanned by one task, as in any scan; what the scan gives are numbers of words between and in matches. Places and
suppression are running sums and maxima over the detections of a text in order, linear in their number.

Defined cases: a null text is empty; an empty text has no words, labels or places and score 0; null and repeated ids are
rows of their own; an empty table gives an empty table; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, materialize

#: What parts words, in texts of any case.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = PARTS.replace("[", "[^", 1)
#: Phrases that are always told, with their labels: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
PHRASE_SCORE = 0.9


def _v(name: str, version: str, later: str = "") -> tuple[str, str]:
    """A name with a version, as it is said with or without the word license ('GPLv3') and only with it ('Apache License, Version 2.0')."""
    number = f"(?: (?:v|ver|version))? ?v?{version}(?: 0)?{later}"
    return f"{name}(?: public)?(?: licen[cs]e)?{number}", f"{name}(?: public)?(?: licen[cs]e{number}|{number} licen[cs]e)"


def _said(name: str | tuple[str, str]) -> tuple[str, str]:
    """The two ways of a name that has no version."""
    return name if isinstance(name, tuple) else (name, name if "licen" in name else name + "(?: public)? licen[cs]e")


_L = " licen[cs]e"
_GPL, _LGPL, _AGPL, _FDL = "(?:gnu )?(?:gpl|general public)", "(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public))", "(?:gnu )?(?:agpl|affero (?:gpl|general public))", "(?:gnu )?(?:gfdl|fdl|free documentation)"
_LATER = "(?: (?:only|or (?:at your option )?(?:any )?later(?: version)?))?"
_CC = "(?:creative commons|cc)(?: licen[cs]e)?"
_BY, _NC, _ND, _SA = "(?: by| attribution)", "(?: nc| non ?commercial)", "(?: nd| no ?deriv(?:ative)?s?(?: works)?)", "(?: sa| share ?alike)"
_CCV = "(?: licen[cs]e)?(?: v| version)?(?: [1-4] [05])?(?: (?:international|unported|generic))?"
#: label: (keywords of which every match contains one, name). Names whose words also mean other things carry the word license.
FAMILIES = {
    "mit": (" mit ", "mit(?: x11| expat)?"),
    "mit-0": (" mit ", "mit (?:0|zero|no attribution)"),
    "x11": (" x11 ", "x11" + _L),
    "expat": (" expat ", "expat" + _L),
    "apache-1.1": ("apache", _v("apache(?: software)?", "1 1")),
    "apache-1": ("apache", _v("apache(?: software)?", "1")),
    "apache-2": ("apache|asl", _v("(?:apache(?: software)?|asl)", "2")),
    "apache": ("apache", "apache(?: software)?" + _L),
    "gpl-1": ("gpl|general public", _v(_GPL, "1", _LATER)),
    "gpl-2": ("gpl|general public", _v(_GPL, "2", _LATER)),
    "gpl-3": ("gpl|general public", _v(_GPL, "3", _LATER)),
    "gpl": ("gpl|general public", "(?:gnu gpl|gpl|(?:gnu )?general public licen[cs]e)"),
    "lgpl-2": ("lgpl|lesser|library", _v(_LGPL, "2", _LATER)),
    "lgpl-2.1": ("lgpl|lesser|library", _v(_LGPL, "2 1", _LATER)),
    "lgpl-3": ("lgpl|lesser|library", _v(_LGPL, "3", _LATER)),
    "lgpl": ("lgpl|lesser|library", "(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public licen[cs]e))"),
    "agpl-3": ("agpl|affero", _v(_AGPL, "3", _LATER)),
    "agpl": ("agpl|affero", "(?:gnu )?(?:agpl|affero (?:gpl|general public licen[cs]e))"),
    "gfdl-1.2": ("fdl|free documentation", _v(_FDL, "1 2", _LATER)),
    "gfdl-1.3": ("fdl|free documentation", _v(_FDL, "1 3", _LATER)),
    "gfdl": ("fdl|free documentation", "(?:gfdl|(?:gnu )?free documentation licen[cs]e)"),
    "bsd-2": ("bsd", "(?:(?:simplified|free)bsd|(?:simplified|free) bsd|bsd 2(?: clause)?|2 clause bsd|two clause bsd)"),
    "bsd-3": ("bsd", "(?:(?:new|modified|revised) bsd|bsd 3(?: clause)?|3 clause bsd|three clause bsd)"),
    "bsd-4": ("bsd", "(?:(?:original|old) bsd|bsd 4(?: clause)?|4 clause bsd|four clause bsd)"),
    "0bsd": ("bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "bsd": ("bsd", "bsd(?: style| type)?"),
    "isc": (" isc ", "isc" + _L),
    "zlib": ("zlib", "zlib(?: libpng)?" + _L),
    "libpng": ("libpng", "libpng" + _L),
    "curl": ("curl", "curl" + _L),
    "boost-1": ("boost", "boost software licen[cs]e(?: version)?(?: 1(?: 0)?)?"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?" + _L),
    "unlicense": ("unlicen", "unlicen[cs]e"),
    "wtfpl": ("wtfpl", "(?:do what the f[a-z]* you want to public licen[cs]e|wtfpl)"),
    "beerware": ("beer", "beer ?ware" + _L),
    "mpl-1.1": ("mpl|mozilla", _v("(?:mozilla|mpl)", "1 1")),
    "mpl-2": ("mpl|mozilla", _v("(?:mozilla|mpl)", "2")),
    "mpl": ("mozilla", "mozilla public" + _L),
    "epl-1": ("epl|eclipse", _v("(?:eclipse|epl)", "1")),
    "epl-2": ("epl|eclipse", _v("(?:eclipse|epl)", "2")),
    "epl": ("eclipse", "eclipse public" + _L),
    "cddl-1.1": ("cddl|common development", _v("(?:cddl|common development and distribution)", "1 1")),
    "cddl-1": ("cddl|common development", _v("(?:cddl|common development and distribution)", "1")),
    "cddl": ("common development", "common development and distribution" + _L),
    "cpl-1": ("common public", _v("common public", "1")),
    "ipl-1": ("ibm public", _v("ibm public", "1")),
    "artistic-1": ("artistic", _v("artistic", "1")),
    "artistic-2": ("artistic", _v("artistic", "2")),
    "artistic": ("artistic", "(?:perl )?artistic" + _L),
    "python": ("python|psf", "(?:python(?: software foundation)?|psf) licen[cs]e(?: (?:agreement|version 2))?"),
    "php-3": (" php ", _v("php", "3(?: 01)?")),
    "ruby": ("ruby", "ruby" + _L),
    "postgresql": ("postgresql", "postgresql" + _L),
    "openssl": ("openssl", "openssl" + _L),
    "ofl-1.1": ("ofl|open font", "(?:(?:sil )?open font licen[cs]e|ofl)(?: v| version)? ?(?:1 1)"),
    "ofl": ("open font", "(?:sil )?open font" + _L),
    "eupl-1.1": ("eupl|european union", _v("(?:eupl|european union)", "1 1")),
    "eupl-1.2": ("eupl|european union", _v("(?:eupl|european union)", "1 2")),
    "cecill": ("cecill", "cecill(?: [bc])?(?: licen[cs]e)?(?: 2(?: [01])?)?"),
    "ms-pl": ("microsoft public|ms pl", "(?:microsoft public licen[cs]e|ms pl)"),
    "ms-rl": ("microsoft reciprocal|ms rl", "(?:microsoft reciprocal licen[cs]e|ms rl)"),
    "osl-3": ("osl|open software", _v("(?:osl|open software)", "3")),
    "afl-3": ("afl|academic free", _v("(?:afl|academic free)", "3")),
    "apsl-2": ("apsl|apple public", _v("(?:apsl|apple public source)", "2")),
    "qpl": ("qpl|q public", "(?:q public licen[cs]e|qpl)"),
    "sleepycat": ("sleepycat", "sleepycat" + _L),
    "zpl": ("zope", _v("zope", "2(?: [01])?")),
    "w3c": (" w3c ", "w3c(?: software(?: notice)?(?: and)?)?(?: document)?" + _L),
    "vim": (" vim ", "vim" + _L),
    "unicode": ("unicode", "unicode(?: data files and software)?(?: terms of use)?" + _L),
    "upl-1": ("universal permissive", "universal permissive licen[cs]e(?: v| version)?(?: 1(?: 0)?)?"),
    "json": (" json ", "json" + _L),
    "sspl-1": ("sspl|server side", "(?:server side public licen[cs]e|sspl)(?: v| version)?(?: v?1)?"),
    "busl-1.1": ("busl|business source", "(?:business source licen[cs]e|busl)(?: v| version)?(?: 1 1)?"),
    "elastic-2": ("elastic", "elastic licen[cs]e(?: v| version)?(?: v?2(?: 0)?)?"),
    "odbl": ("odbl|open data", "(?:open (?:data commons open )?database licen[cs]e|odbl)(?: v?1(?: 0)?)?"),
    "odc-by": ("odc|open data", "(?:open data commons attribution licen[cs]e|odc by)(?: v?1(?: 0)?)?"),
    "pddl": ("pddl|public domain", "(?:public domain dedication and licen[cs]e|pddl)"),
    "cc0": ("cc0|cc zero|creative commons", "(?:cc0|creative commons (?:zero|0)|cc zero)" + _CCV),
    "cc-by": ("creative commons| cc ", _CC + _BY + _CCV),
    "cc-by-sa": ("creative commons| cc ", _CC + _BY + _SA + _CCV),
    "cc-by-nd": ("creative commons| cc ", _CC + _BY + _ND + _CCV),
    "cc-by-nc": ("creative commons| cc ", _CC + _BY + _NC + _CCV),
    "cc-by-nc-sa": ("creative commons| cc ", _CC + _BY + _NC + _SA + _CCV),
    "cc-by-nc-nd": ("creative commons| cc ", _CC + _BY + _NC + _ND + _CCV),
}
_UNDER = "(?: to you| for use)?(?: only)? under(?: the)?(?: terms(?: and conditions)? of)?(?: an?| the| either the)?"
#: form: (priority, score, pattern around a name said loosely or with the word license).
FORMS = {
    "identifier": (6, 1.0, "spdx licen[cs]e identifiers? {loose}"),
    "grant": (5, 0.95, "(?:dual |multi )?licen[cs]ed" + _UNDER + " {loose}(?: public)?(?: licen[cs]e)?"),
    "release": (5, 0.95, "(?:re)?(?:released|distributed|distributable|available|published|provided|covered|shared|offered|contributed)" + _UNDER + " {strict}"),
    "terms": (4, 0.9, "(?:subject to|governed by|in accordance with|pursuant to|under)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {strict}"),
    "field": (4, 0.9, "licen[cs]es?(?: type| name| expression| is)? {loose}"),
    "lizenz": (4, 0.9, "(?:unter (?:der|einer) {loose}(?: public)? (?:lizenz|licen[cs]e)|lizenz {loose})"),
    "licence": (4, 0.9, "(?:sous (?:la )?licence {loose}|bajo (?:la |una )?licencia {loose})"),
    "title": (2, 0.7, "{strict}"),
}
#: Names that are told without the word license about them.
BARE = ("gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "agpl-3", "gfdl-1.2", "gfdl-1.3", "cc0", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "wtfpl", "unlicense")
#: (label, keyword, sentence of a license text or address); priority 7, as such a text says more than a name.
NOTICES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-1", "hereby granted", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", "(?:www )?apache org licenses(?: license)? 2 0(?: txt| html)?"),
    ("gpl", "redistribute it", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "redistribute it", "redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("gpl-3", "redistribute it", "redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("lgpl", "redistribute it", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "redistribute it", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)? version 2 1"),
    ("lgpl-3", "redistribute it", "redistribute it and or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("agpl-3", "redistribute it", "redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla org mpl", "(?:www )?mozilla org mpl 2 0"),
    ("epl-2", "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2"),
    ("epl-1", "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?1"),
    ("cddl-1", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", "you just do what the f[a-z]* you want to"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("cc0", "public domain", "(?:dedicated|placed) (?:[^ ]+ ){0,6}public domain worldwide"),
    ("public-domain", "public domain", "(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("json", "for good", "the software shall be used for good not evil"),
    ("commons-clause", "commons clause", "commons clause licen[cs]e condition"),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("gpl-2", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org licenses", "gnu org licenses gpl 3 0"),
    ("lgpl-3", "gnu org licenses", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "gnu org licenses", "gnu org licenses agpl 3 0"),
    ("mit", "opensource org", "opensource org licenses? mit"),
    ("bsd-3", "opensource org", "opensource org licenses? bsd 3 clause"),
    ("bsd-2", "opensource org", "opensource org licenses? bsd 2 clause"),
    ("isc", "opensource org", "opensource org licenses? isc"),
]
#: What a text must contain, in any case, for a rule to match; several words stand together.
TRIGGERS = ("licen", "lizenz", "gpl", "gfdl", "wtfpl", "cc0", "redistribut", "hereby granted", "creative commons", "creativecommons", "cc by", "cc zero", "public domain", "fdl", "general public", "free documentation", "copyright notice", "advertising materials", "origin of this software", "used for good", "buy me a beer", "do what the", "gnu lesser", "gnu library", "affero", "derived from this software", "mozilla org", "gnu org", "opensource org")


def rules() -> list[dict]:
    """All rules in order: id, label, priority, score, keyword, regex (over the words), least first."""
    found = [(label, 7, 1.0, word, text) for label, word, text in NOTICES]
    for priority, score, around in FORMS.values():
        for label, (word, name) in FAMILIES.items():
            loose, strict = _said(name)
            found.append((label, priority, score, word, around.replace("{loose}", f"(?:{loose})").replace("{strict}", f"(?:{strict})")))
    found += [(label, 1, 0.6, FAMILIES[label][0], _said(FAMILIES[label][1])[0]) for label in BARE]
    return [dict(id=i, label=label, priority=p, score=s, keyword=w, regex=f"(?<= )(?:{r})(?= )") for i, (label, p, s, w, r) in enumerate(found)]


def _phrase_rules(phrases: Mapping[str, str], first: int) -> list[dict]:
    """A phrase matches by its first word with the others ahead, so that places that overlap are found too."""
    out = []
    for i, (phrase, label) in enumerate(phrases.items()):
        head, *rest = map(re.escape, phrase.split())
        out.append(dict(id=first + i, label=label, priority=0, score=PHRASE_SCORE, keyword=phrase, regex=f"(?<= ){head}(?={''.join(' ' + w for w in rest)} )"))
    return out


def _contains(text: Column, lower: Column, words: str) -> Column:
    """Whether a text contains the words next to each other; a cheap look for each goes first."""
    each = words.split()
    seen = F.contains(lower, F.lit(each[0]))
    for w in each[1:]:
        seen &= F.contains(lower, F.lit(w))
    return seen if len(each) == 1 else seen & F.regexp_like(text, F.lit("(?i)" + (PARTS + "++").join(map(re.escape, each))))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _hits(found: list[dict]) -> Column:
    """array<struct<rule, gaps, sizes>> of the rules that match the column words: words before and between the matches, words of each match."""
    by_key: dict[str, list[dict]] = {}
    for r in found:
        by_key.setdefault(r["keyword"], []).append({"id": r["id"], "regex": r["regex"]})
    kind = "array<struct<keywords array<string>, rules array<struct<id int, regex string>>>>"
    table = F.from_json(F.lit(json.dumps([{"keywords": k.split("|"), "rules": v} for k, v in by_key.items()])), kind)
    gated = F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(F.col("words"), k)))
    parted = F.transform(F.flatten(F.transform(gated, lambda g: g["rules"])), lambda r: F.struct(r["id"].alias("id"), r["regex"].alias("regex"), F.split(F.col("words"), r["regex"], -1).alias("gaps")))
    told = lambda r: F.struct(
        r["id"].alias("rule"), F.transform(F.slice(r["gaps"], 1, F.size(r["gaps"]) - 1), _spaces).alias("gaps"), F.transform(F.regexp_extract_all(F.col("words"), r["regex"], F.lit(0)), _spaces).alias("sizes")
    )
    return F.transform(F.filter(parted, lambda r: F.size(r["gaps"]) > 1), told)


def detections(scanned: DataFrame, found: list[dict]) -> DataFrame:
    """A row per detection of the written scan: tag, rule, label, priority, score, start, end (in words, exclusive)."""
    spark = scanned.sparkSession
    kind = "array<struct<id int, label string, priority int, score double, words int>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{k: v for k, v in r.items() if k not in ("keyword", "regex")} for r in found])), kind)).alias("r"))
    table = table.select(F.col("r.id").alias("rule"), "r.label", "r.priority", "r.score", "r.words")  # a few hundred rows
    each = scanned.select("tag", F.explode("hits").alias("h")).repartition("tag")  # both windows below keep a text's detections where this puts them
    each = each.select("tag", "h.rule", F.posexplode(F.arrays_zip(F.col("h.gaps").alias("gap"), F.col("h.sizes").alias("size"))).alias("k", "m"))
    before = Window.partitionBy("tag", "rule").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    each = each.select("tag", "rule", (end - F.col("m.size") - 1).alias("start"), end.alias("last")).join(F.broadcast(table), "rule")
    return each.withColumn("end", F.when(F.col("words").isNotNull(), F.col("start") + F.col("words")).otherwise(F.col("last"))).drop("last", "words")


def unsuppressed(found: DataFrame, levels: list[int]) -> DataFrame:
    """Detections without those that lie within another of no lower priority; a phrase (priority 0) is always kept."""
    order = Window.partitionBy("tag").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order)) for p in levels])
    return found.withColumn("reach", reach).filter((F.col("priority") == 0) | F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """A row per input row: doc_id, n_words, n_base, first_word, last_word (of the phrases' places), base_labels, labels, score."""
    own = rules()
    found = own + [r | {"words": len(p.split())} for r, p in zip(_phrase_rules(phrases, len(own)), phrases, strict=True)]
    text = F.col("text")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.select("doc_id", "text", F.lower(text).alias("lower"))
    seen = F.lit(False)
    for words in dict.fromkeys([*TRIGGERS, *phrases]):
        seen |= _contains(text, F.col("lower"), words)
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, upper, lower), PARTS + "++", " "), F.lit(" "))
    slim = slim.select("doc_id", F.regexp_count(text, F.lit(WORD + "++")).cast("long").alias("n_words"), F.when(seen, F.regexp_replace(plain, "^  | {2,}+", " ")).alias("words"))
    step = Scratch(docs.sparkSession)
    slim = step.write(slim.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "n_words", F.when(F.col("words").isNotNull(), _hits(found)).alias("hits")), "scanned")
    at = F.when(F.col("priority") == 0, F.col("start"))
    hit = slim.filter(F.size("hits") > 0).select("tag", "doc_id", "n_words", "hits")
    told = unsuppressed(detections(hit, found), sorted({r["priority"] for r in own})).groupBy("tag").agg(
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("priority") == 0, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("score").alias("score"),
    )
    columns = lambda df: df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )
    with_hits = columns(hit.drop("hits").join(told, "tag"))
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("long")
    rest = columns(slim.filter("hits is null or size(hits) = 0").select("*", F.lit(0).cast("long").alias("n_base"), null.alias("first_word"), null.alias("last_word"), none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score")))
    out = materialize(with_hits.unionByName(rest), "licenses")
    step.clear()
    return out
