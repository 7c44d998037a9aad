"""Licence detections by ordered signature rules.

A rule is a regular expression over the lower-cased text (A-Z only), with a literal keyword that gates it, a
priority (1 binds most) and a label. The rules come from a table of licences and the forms in which each can be
named: an SPDX tag, "licensed under", its name, its address, and so on. Of overlapping detections, one is
suppressed if another contains its interval and has a higher priority, or the same and is longer (or equal and
an earlier rule). A document's labels are those of the detections left and of the base phrases in it, which
are consecutive words and never suppressed. Its score is 1 minus the product of the doubts of its detections'
forms.

Everything is DataFrame expressions: rules run only over texts that hold a keyword of any rule, each only where
its own keyword stands, and detections are resolved in one pass over their sorted starts. Null and empty texts
have no words and no labels (empty text); repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, words of the name as a regular expression, keyword of the name (several: each alternative holds one), host of the text.
LICENSES = [
    ("0bsd", r"(?:zero[- ]clause bsd|0bsd|bsd zero[- ]clause)", "bsd", "opensource.org/licenses/0bsd"),
    ("afl-3.0", r"academic free licen[cs]e", "academic free", "opensource.org/licenses/afl"),
    ("agpl-3.0", r"(?:gnu )?affero general public licen[cs]e", "affero", "gnu.org/licenses/agpl"),
    ("apache-1.1", r"apache software licen[cs]e(?:,? version)? 1\.1", "apache", "apache.org/licenses/license-1.1"),
    ("apache-2.0", r"apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", "apache", "apache.org/licenses/license-2.0"),
    ("apsl-2.0", r"apple public source licen[cs]e", "apple public", "opensource.apple.com/license/apsl"),
    ("artistic-2.0", r"artistic licen[cs]e", "artistic", "perlfoundation.org/artistic"),
    ("bsd-2-clause", r"(?:bsd 2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:bsd 3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:bsd 4[- ]clause|4[- ]clause bsd|original bsd)(?: licen[cs]e)?", "bsd", "directory.fsf.org/wiki/license:bsd-4clause"),
    ("bsl-1.0", r"boost software licen[cs]e", "boost", "boost.org/license_1_0"),
    ("busl-1.1", r"business source licen[cs]e", "business source", "mariadb.com/bsl11"),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?", ("cc0", "creative commons zero"), "creativecommons.org/publicdomain/zero"),
    ("cc-by-4.0", r"(?:cc[- ]by|creative commons attribution) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by/4.0"),
    ("cc-by-3.0", r"(?:cc[- ]by|creative commons attribution) 3\.0(?: unported)?", "3.0", "creativecommons.org/licenses/by/3.0"),
    ("cc-by-2.0", r"(?:cc[- ]by|creative commons attribution) 2\.[05]", "2.", "creativecommons.org/licenses/by/2"),
    ("cc-by-sa-4.0", r"(?:cc[- ]by[- ]sa|creative commons attribution[- ]sharealike) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by-sa/4.0"),
    ("cc-by-sa-3.0", r"(?:cc[- ]by[- ]sa|creative commons attribution[- ]sharealike) 3\.0(?: unported)?", "3.0", "creativecommons.org/licenses/by-sa/3.0"),
    ("cc-by-nc-4.0", r"(?:cc[- ]by[- ]nc|creative commons attribution[- ]noncommercial) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by-nc/4.0"),
    ("cc-by-nc-3.0", r"(?:cc[- ]by[- ]nc|creative commons attribution[- ]noncommercial) 3\.0(?: unported)?", "3.0", "creativecommons.org/licenses/by-nc/3.0"),
    ("cc-by-nd-4.0", r"(?:cc[- ]by[- ]nd|creative commons attribution[- ]noderiv(?:ative)?s) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by-nd/4.0"),
    ("cc-by-nc-sa-4.0", r"(?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("cc-by-nc-nd-4.0", r"(?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderiv(?:ative)?s) 4\.0(?: international)?", "4.0", "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("cddl-1.0", r"common development and distribution licen[cs]e", "common development", "opensource.org/licenses/cddl"),
    ("cecill-2.1", r"cecill(?:[- ][bc])?(?: free software)?(?: licen[cs]e)?", "cecill", "cecill.info/licences"),
    ("cpl-1.0", r"common public licen[cs]e", "common public", "opensource.org/licenses/cpl"),
    ("ecl-2.0", r"educational community licen[cs]e", "educational community", "opensource.org/licenses/ecl"),
    ("epl-1.0", r"eclipse public licen[cs]e(?:,? version|[- ]v\.?)? ?1\.0", "eclipse", "eclipse.org/legal/epl-v10"),
    ("epl-2.0", r"eclipse public licen[cs]e(?:,? version|[- ]v\.?)? ?2\.0", "eclipse", "eclipse.org/legal/epl-2.0"),
    ("eupl-1.2", r"european union public licen[cs]e", "european union public", "joinup.ec.europa.eu/collection/eupl"),
    ("gfdl-1.3", r"gnu free documentation licen[cs]e", "free documentation", "gnu.org/licenses/fdl"),
    ("gpl-2.0", r"(?:gnu )?general public licen[cs]e,?(?: version| v\.?)? ?2", "general public", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("gpl-3.0", r"(?:gnu )?general public licen[cs]e,?(?: version| v\.?)? ?3", "general public", "gnu.org/licenses/gpl-3.0"),
    ("hippocratic-2.1", r"hippocratic licen[cs]e", "hippocratic", "firstdonoharm.dev"),
    ("isc", r"isc licen[cs]e", "isc", "opensource.org/licenses/isc"),
    ("json", r"json licen[cs]e", "json", "json.org/license"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public licen[cs]e,?(?: version| v\.?)? ?2(?:\.1)?", "general public", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?)? ?3", "lesser", "gnu.org/licenses/lgpl-3.0"),
    ("lppl-1.3c", r"latex project public licen[cs]e", "latex project", "latex-project.org/lppl"),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "licen", "opensource.org/licenses/mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?|mit-0", "mit", "opensource.org/licenses/mit-0"),
    ("mpl-1.1", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?1\.[01]", "mozilla", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?2\.0", "mozilla", "mozilla.org/mpl/2.0"),
    ("ms-pl", r"microsoft public licen[cs]e|ms-pl", ("ms-pl", "microsoft public"), "opensource.org/licenses/ms-pl"),
    ("ncsa", r"(?:university of illinois/?)?ncsa open source licen[cs]e", "ncsa", "opensource.org/licenses/ncsa"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e|odbl", ("odbl", "database licen"), "opendatacommons.org/licenses/odbl"),
    ("ofl-1.1", r"sil open font licen[cs]e", "open font", "scripts.sil.org/ofl"),
    ("osl-3.0", r"open software licen[cs]e", "open software", "opensource.org/licenses/osl"),
    ("php-3.01", r"php licen[cs]e", "php", "php.net/license"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", "postgresql.org/about/licence"),
    ("psf-2.0", r"python software foundation licen[cs]e|psf licen[cs]e", ("psf", "python software"), "docs.python.org/3/license"),
    ("ruby", r"ruby licen[cs]e", "ruby", "ruby-lang.org/en/about/license"),
    ("sspl-1.0", r"server side public licen[cs]e", "server side", "mongodb.com/licensing/server-side-public-license"),
    ("unlicense", r"the unlicen[cs]e|unlicense\b", "unlicen", "unlicense.org"),
    ("upl-1.0", r"universal permissive licen[cs]e", "universal permissive", "oss.oracle.com/licenses/upl"),
    ("vim", r"vim licen[cs]e", "vim", "vimdoc.sourceforge.net/htmldoc/uganda"),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", "w3c", "w3.org/consortium/legal"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", ("wtfpl", "do what the fuck"), "wtfpl.net"),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", "zlib.net/zlib_license"),
    ("zpl-2.1", r"zope public licen[cs]e", "zope", "opensource.org/licenses/zpl"),
]

#: The forms of a licence's rules: priority, doubt, keyword (none: the name's), expression.
FORMS = [
    (1, 0.01, "spdx", r"spdx-licen[cs]e-identifier:\s*{label}(?:-only|-or-later|\+)?\b"),
    (1, 0.02, "under", r"(?:licen[cs]ed|released|distributed|published|available|made available) under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?(?:{name})"),
    (2, 0.05, "licen", r"licen[cs]e:\s*(?:the )?(?:{name}|{label}\b)"),
    (2, 0.05, None, r"(?:subject to|governed by|covered by|terms of) the (?:{name})"),
    (3, 0.15, None, r"\b(?:{name})\b"),
    (3, 0.2, "/", r"https?://(?:www\.)?{host}"),
]

#: Rules of their own: label, priority, doubt, keyword, expression.
NOTICES = [
    ("copyright", 4, 0.6, "copyright", r"copyright (?:\(c\) |© )?(?:19|20)\d\d"),
    ("copyright", 4, 0.6, "(c)", r"\(c\) (?:copyright )?(?:19|20)\d\d"),
    ("proprietary", 3, 0.2, "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("public-domain", 3, 0.2, "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("permissive-text", 3, 0.1, "permission is hereby", r"permission is hereby granted,? free of charge,? to any person"),
    ("bsd-text", 3, 0.1, "redistribution", r"redistribution and use in source and binary forms"),
    ("no-warranty", 4, 0.5, "as is", r"\bprovided \"?as is\"?,? without warranty"),
    ("gpl-text", 3, 0.1, "redistribute it", r"you can redistribute it and/or modify it under the terms of"),
    ("cc-unversioned", 4, 0.4, "creative commons", r"\bcreative commons\b"),
    ("gpl-unversioned", 4, 0.4, "gpl", r"\bl?gpl(?:v[23])?\b"),
    ("licence-mention", 5, 0.8, "licen", r"\blicen[cs]ed under\b"),
]


#: Sentences that stand in the texts and notices of licences: label, keyword, expression; a space stands for any white space.
CLAUSES = [
    ("mit", "permission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit-0", "furnished", r"to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("isc", "permission", r"permission to use,? copy,? modify,?(?: and/or| and) distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission", r"permission to use,? copy,? modify,?(?: and/or| and) distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd-2-clause", "redistribution", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "redistribution", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "permission", r"neither the names? of [^\n\r]{1,80} nor the names of (?:its|their|any) contributors may be used to endorse or promote [^\n\r]{1,60} without specific prior written permission"),
    ("bsd-4-clause", "acknowledg", r"all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("apache-2.0", "licen", r"unless required by applicable law or agreed to in writing,? software distributed under the licen[cs]e"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "apache", r"the asf licenses this file to you under the apache licen[cs]e"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "licen", r"either version 2 of the licen[cs]e,? or (?:\(at your option\) )?any later version"),
    ("gpl-3.0", "licen", r"either version 3 of the licen[cs]e,? or (?:\(at your option\) )?any later version"),
    ("gpl-text", "gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl-text", "gnu", r"see the gnu general public licen[cs]e for more details"),
    ("gpl-text", "copyleft", r"the gnu general public licen[cs]e is a free,? copyleft licen[cs]e"),
    ("lgpl-2.1", "licen", r"either version 2\.1 of the licen[cs]e,? or (?:\(at your option\) )?any later version"),
    ("lgpl-text", "gnu", r"see the gnu (?:lesser|library) general public licen[cs]e for more details"),
    ("lgpl-text", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", "gnu", r"see the gnu affero general public licen[cs]e for more details"),
    ("agpl-3.0", "remotely", r"if your software can interact with users remotely through a computer network"),
    ("gfdl-1.3", "gnu", r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file,? you can obtain one at https?://mozilla"),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("epl-2.0", "licen", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cpl-1.0", "common", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("eupl-1.2", "licen", r"licensed under the eupl"),
    ("bsl-1.0", "licen", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("busl-1.1", "licen", r"use of the licensed work [^\n\r]{0,80}additional use grant"),
    ("sspl-1.0", "licen", r"server side public licen[cs]e version 1"),
    ("zlib", "warranty", r"this software is provided 'as-is',? without any express or implied warranty\. in no event will the authors be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unencumbered", r"free and unencumbered software"),
    ("wtfpl", "fuck", r"0\. you just do what the fuck you want to"),
    ("postgresql", "permission", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement"),
    ("hpnd", "permission", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission", r"the name [^\n\r]{1,60} not be used in advertising or publicity pertaining to distribution of the software without specific,? written prior permission"),
    ("x11", "advertising", r"except as contained in this notice,? the name of [^\n\r]{1,60} shall not be used in advertising or otherwise"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "openssl", r"openssl toolkit"),
    ("curl", "copyright", r"copyright and permission notice copyright \(c\)"),
    ("ruby", "copyrighted", r"ruby is copyrighted free software"),
    ("psf-2.0", "psf", r"psf is making python available to licensee on an [\"']?as is"),
    ("artistic-2.0", "copyright", r"the copyright holder intends that [^\n\r]{0,40}package remain available as open source"),
    ("afl-3.0", "academic", r"licensed under the academic free licen[cs]e version"),
    ("osl-3.0", "open", r"licensed under the open software licen[cs]e version"),
    ("ofl-1.1", "licen", r"this font software is licensed under the sil open font licen[cs]e"),
    ("lppl-1.3c", "latex", r"this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e"),
    ("w3c", "w3c", r"by obtaining,? using and/or copying this work,? you [^\n\r]{0,200}w3c"),
    ("cc0-1.0", "waive", r"to the extent possible under law,? [^\n\r]{1,80} has waived all copyright and related or neighbou?ring rights"),
    ("cc-unversioned", "licen", r"this (?:work|article|text) is licensed under a creative commons"),
    ("cc-by-text", "licen", r"you must give appropriate credit,? provide a link to the licen[cs]e,? and indicate if changes were made"),
    ("cc-by-sa-text", "licen", r"if you remix,? transform,? or build upon the material,? you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nd-text", "remix", r"if you remix,? transform,? or build upon the material,? you may not distribute the modified material"),
    ("odbl-1.0", "licen", r"is made available under the open database licen[cs]e"),
    ("pddl-1.0", "commons", r"open data commons public domain dedication"),
    ("ogl-uk-3.0", "licen", r"contains public sector information licensed under the open government licen[cs]e"),
    ("commercial", "licen", r"end[- ]user licen[cs]e agreement"),
    ("commercial", "licen", r"this software is licensed,? not sold"),
    ("proprietary", "reproduced", r"(?:no part of this|may not be) [^\n\r]{0,60}reproduced [^\n\r]{0,60}without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|reproduction|use) [^\n\r]{0,60}is strictly prohibited"),
    ("proprietary", "secret", r"contains? (?:proprietary|confidential) [^\n\r]{0,30}trade secrets?"),
    ("no-warranty", "warrant", r"without warranty of any kind,? express or implied"),
    ("no-warranty", "warranty", r"without even the implied warranty of merchantability"),
    ("no-warranty", "liable", r"in no event shall the (?:authors?|copyright (?:holders?|owner)) [^\n\r]{0,40}be liable"),
]


#: Whatever a rule matches holds one of these; other texts are not looked at further.
GATES = (
    "licen", "copyright", "bsd", "cc-by", "cc by", "creative commons", "cc0", "cecill", "gpl", "mit-0", "mit no attribution", "ms-pl", "odbl", "wtf", "http", "(c)",
    "proprietary", "public domain", "permission", "redistribution", "redistribute it", "as is", "acknowledg", "warrant", "furnished", "remotely", "misrepresented", "altered", "unencumbered", "fuck", "openssl", "psf", "apache",
    "w3c", "remix", "commons", "prohibited", "secret", "reproduced", "liable", "advertising",
)


def _fields(label: str, name: str, host: str) -> dict[str, str]:
    return {"label": label.replace(".", r"\."), "name": name, "host": host.replace(".", r"\.")}


def _grouped() -> list[tuple[int, tuple[int, str, str, float, str]]]:
    """Every rule in order with the number of its group: the rules of one form, the notices, the clauses. A rule of several keywords stands once for each, and of equal detections the first is left."""
    out = []
    for label, name, keyword, host in LICENSES:
        for group, (priority, doubt, own, form) in enumerate(FORMS):
            for word in [own] if own else [keyword] if isinstance(keyword, str) else keyword:
                out.append((group, (priority, label, word, doubt, form.format(**_fields(label, name, host)))))
    out += [(len(FORMS), (p, label, keyword, doubt, form)) for label, p, doubt, keyword, form in NOTICES]
    return out + [(len(FORMS) + 1, (3, label, keyword, 0.1, form.replace(" ", r"\s+"))) for label, keyword, form in CLAUSES]


def rules() -> list[tuple[int, str, str, float, str]]:
    """(priority, label, keyword, doubt, expression) of every rule in order; some 450."""
    return [rule for _, rule in _grouped()]


def unions() -> list[str]:
    """One expression a group, which matches wherever any of its rules does: a form's with all names, labels and hosts."""
    every = [_fields(label, name, host) for label, name, _, host in LICENSES]
    fields = {k: "(?:" + "|".join(dict.fromkeys(f[k] for f in every)) + ")" for k in ("label", "name", "host")}
    rest: dict[int, list[str]] = {}
    for group, rule in _grouped():
        if group >= len(FORMS):
            rest.setdefault(group, []).append(rule[-1])
    return [form.format(**fields) for *_, form in FORMS] + ["|".join(f"(?:{x})" for x in rest[g]) for g in sorted(rest)]


def _detections(text: Column) -> Column:
    """All detections of a lower-cased text as an array of (start, end, priority, rule, label, doubt)."""
    cells = lambda k, p, label, word, doubt, form: F.struct(F.lit(k).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(word).alias("keyword"), F.lit(doubt).alias("doubt"), F.lit(form).alias("form"))
    groups: dict[int, list[Column]] = {}
    for k, (group, rule) in enumerate(_grouped()):
        groups.setdefault(group, []).append(cells(k, *rule))
    empty = F.array().cast("array<struct<rule:int,priority:int,label:string,keyword:string,doubt:double,form:string>>")
    words: dict[int, dict[str, None]] = {}
    for group, rule in _grouped():
        words.setdefault(group, {})[rule[2]] = None
    has = lambda g: reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words[g]))
    # a group's own expression is compiled once a task; those of its rules, which come from a column, only for texts that it matches
    table = F.concat(*(F.when(has(g) & F.rlike(text, F.lit(union)), F.array(*groups[g])).otherwise(empty) for g, union in enumerate(unions())))
    gated = F.filter(table, lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["form"]))

    def places(r: Column) -> Column:
        # what stands between the matches, and the matches, give every match's place
        gaps = F.transform(F.split(text, r["form"], -1), lambda g: F.length(g))
        sizes = F.transform(F.regexp_extract_all(text, r["form"], F.lit(0)), lambda m: F.length(m))
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"))
        none = F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string,doubt:double>>")

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            found = F.struct(start.alias("start"), (start + p["size"]).alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["doubt"].alias("doubt"))
            return F.struct((start + p["size"]).alias("at"), F.concat(a["found"], F.array(found)).alias("found"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])

    return F.flatten(F.transform(gated, places))


def _resolved(found: Column) -> Column:
    """(label, doubt) of the detections that no other suppresses.

    Sorted by start, longest first, whatever contains a detection stands before it: it is enough to know the
    greatest end so far of each priority.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["doubt"].alias("doubt"))))
    highest = max(p for p, *_ in rules())
    start = F.struct(F.array_repeat(F.lit(-1), highest).alias("ends"), F.array().cast("array<struct<label:string,doubt:double>>").alias("kept"))

    def step(a: Column, d: Column) -> Column:
        end = -d["minus"]
        hidden = F.exists(F.slice(a["ends"], F.lit(1), d["priority"]), lambda e: e >= end)
        kept = F.when(hidden, a["kept"]).otherwise(F.array_union(a["kept"], F.array(F.struct(d["label"].alias("label"), d["doubt"].alias("doubt")))))
        ends = F.transform(a["ends"], lambda e, i: F.when(i + 1 == d["priority"], F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), kept.alias("kept"))

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def scanned(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, words, places of base phrases, labels and score."""
    low = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    # one space around every word
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    rows = rows.withColumn("spaced", spaced)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.withColumn("n_words", F.when(F.col("spaced") == "  ", 0).otherwise(spaces(F.col("spaced")) - 1).cast("long"))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains("low", F.lit(word))
    parts = {p: F.when(F.contains("spaced", F.lit(f" {p} ")), F.split("spaced", f" {p}(?= )", -1)) for p in PHRASES}
    rows = rows.select(
        "doc_id", "n_words", F.struct(*(c.alias(f"p{i}") for i, c in enumerate(parts.values()))).alias("parts"),
        F.when(gate, _resolved(_detections(F.col("low")))).otherwise(F.array().cast("array<struct<label:string,doubt:double>>")).alias("kept"),
    )
    n = [F.coalesce(F.size(F.col("parts")[f"p{i}"]) - 1, F.lit(0)) for i in range(len(PHRASES))]
    first = [spaces(F.get(F.col("parts")[f"p{i}"], F.lit(0))) for i in range(len(PHRASES))]
    last = [F.col("n_words") - spaces(F.element_at(F.col("parts")[f"p{i}"], -1)) + 1 - len(p.split()) for i, p in enumerate(PHRASES)]
    least = lambda cs: F.array_min(F.array(*cs))
    has = [F.when(c > 0, F.lit(label)) for c, label in zip(n, PHRASES.values(), strict=True)]
    base = F.array_compact(F.array(*has))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("kept", lambda k: k["label"]))))
    doubt = F.aggregate("kept", F.when(F.size(base) > 0, 0.3).otherwise(1.0), lambda a, k: a * k["doubt"])
    rows = rows.withColumn("n_base", sum(n[1:], n[0]).cast("long"))
    return rows.select("doc_id", "n_words", "n_base", least(first).cast("long").alias("first_word"), F.array_max(F.array(*last)).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), (1 - doubt).alias("score"))
