import re

from tessarine.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_scan(text):
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    starts = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in license_scan.PHRASES}
    at = sorted(i for s in starts.values() for i in s)
    base = sorted({license_scan.PHRASES[p] for p, s in starts.items() if s})
    found = [(m.start(), m.end(), p, k, label, doubt) for k, (p, label, word, doubt, form) in enumerate(license_scan.rules()) if word in low for m in re.finditer(form, low, re.ASCII)]

    def hidden(d):
        return any(e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[0], e[1]) == (d[0], d[1]) and e[3] < d[3])) for e in found)

    kept = {(d[4], d[5]) for d in found if not hidden(d)}
    doubt = 0.3 if base else 1.0
    for _, x in kept:
        doubt *= x
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base), ",".join(sorted({*base, *(label for label, _ in kept)})), round(1 - doubt, 9)


TEXTS = [
    None, "", " . ", "CC BY cc-by 4.0 cc by, cc by", "Licensed under CC BY-NC 4.0.\nmore text", "Éa cc\nby. All rights, reserved ALL RIGHTS RESERVED",
    "licensed under the Apache License, Version 2.0. See http://www.apache.org/licenses/LICENSE-2.0 now; Apache License 2.0",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public license general public license version 2",
    "SPDX-License-Identifier: MIT\nReleased under the MIT License. The mit licence and mit license", "Copyright (c) 2019 X. copyright 2020 (c) 2021",
    "mit no attribution; spdx-license-identifier: gpl-3.0-only gplv3 cc by", "nothing of this kind here", "lesser general public license 2.1 and library general public license",
    "creative commons attribution-sharealike 4.0 international https://creativecommons.org/licenses/by-sa/4.0/", "dedicated to the public domain the unlicense", "ccby cc byte occ by",
    "filler words " * 20_000 + "licensed under the mit license " * 300 + "all rights reserved", "日本 cc by 語", "terms of the mozilla public license, v. 2.0, license: bsd-3-clause 3-clause bsd license",
]


def test_labels_places_and_suppression(spark):
    rows = list(enumerate(TEXTS)) + [(None, "cc by"), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, low string").repartition(4)
    got = [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in license_scan.scanned(docs).collect()]
    small = [(i, slow_scan(t)) for i, t in rows if len(t or "") < 10_000]
    assert sorted((x for x in got if x[0] != 17), key=str) == sorted(small, key=str)
    long = dict(got)[17]
    assert long[1:4] == (1, long[0] - 3, long[0] - 3) and long[5] == "mit,reserved" and 0 <= long[6] <= 1
    assert len(license_scan.rules()) > 300 and all(re.compile(r[4]) for r in license_scan.rules())
    assert license_scan.scanned(docs.where("false")).count() == 0


def strings(parsed):
    """Texts that a parsed expression matches: all of its alternatives."""
    out = [""]
    for op, value in parsed:
        match str(op):
            case "LITERAL":
                some = [chr(value)]
            case "IN":
                some = [chr(v) if str(o) == "LITERAL" else "1" if "DIGIT" in str(v) else " " for o, v in value]
            case "BRANCH":
                some = [s for part in value[1] for s in strings(part)]
            case "SUBPATTERN":
                some = strings(value[-1])
            case "MAX_REPEAT":
                some = [s for s in strings(value[2])] + [""] * (value[0] == 0)
            case "AT":
                some = [""]
        out = [a + b for a in out for b in some]
    return out


def test_every_alternative_passes_its_own_gate(spark):
    words = {}
    for _, label, word, _, form in license_scan.rules():
        words.setdefault((label, form), []).append(word)
    for (label, form), keys in words.items():
        for s in strings(re._parser.parse(form)):
            assert any(k in s for k in keys) and any(g in s for g in license_scan.GATES), (label, s)
    names = {"creative commons zero": "cc0-1.0", "microsoft public license": "ms-pl", "open data commons open database license": "odbl-1.0", "python software foundation license": "psf-2.0", "do what the fuck you want to public license": "wtfpl"}
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scanned(docs).collect()}
    assert all(label in got[i] for i, label in enumerate(names.values())), got
