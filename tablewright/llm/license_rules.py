"""Signature rules of licenses: ordered regular expressions over words.

A rule is tried where its keyword, the first word of its expression, occurs.
Expressions see lower-case words parted by single spaces.  Most rules are made
from the families below: every name with every version, alone and with "only"
or "or later"; the sentences come from the licenses' own texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Priorities, and what a finding of each adds to the confidence.
BASE, NAME, VERSION, SCOPE, SENTENCE, IDENTIFIER = range(6)
CONFIDENCE = (0.5, 0.5, 0.8, 0.85, 0.9, 0.97)
# No expression is longer than this many words.
MOST_WORDS = 32

# Phrases that always count, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label: names; a name with ~ is an abbreviation that needs a version or the word license | versions
FAMILIES = """
gpl: gnu general public license, general public license, gnu public license, gnu gpl, gpl | 1.0 2.0 3.0
lgpl: gnu lesser general public license, gnu library general public license, lesser general public license, library general public license, gnu lgpl, lgpl | 2.0 2.1 3.0
agpl: gnu affero general public license, affero general public license, gnu agpl, agpl | 1.0 3.0
gfdl: gnu free documentation license, free documentation license, ~gfdl, ~fdl | 1.1 1.2 1.3
apache: apache software license, apache license, asf license, ~apache, ~asl | 1.0 1.1 2.0
mit: mit license, mit licence, expat license, ~mit, ~expat |
mit-0: mit no attribution, mit 0 |
x11: x11 license, x consortium license |
isc: isc license, internet systems consortium license |
bsd-4-clause: bsd 4 clause, 4 clause bsd, four clause bsd, original bsd license, bsd original |
bsd-3-clause: bsd 3 clause, 3 clause bsd, three clause bsd, new bsd license, modified bsd license, revised bsd license |
bsd-2-clause: bsd 2 clause, 2 clause bsd, two clause bsd, simplified bsd license, freebsd license |
bsd-0-clause: bsd 0 clause, 0 clause bsd, zero clause bsd, 0bsd |
bsd: bsd license, bsd style license, berkeley software distribution license |
mpl: mozilla public license, ~mpl | 1.0 1.1 2.0
npl: netscape public license, ~npl | 1.0 1.1
epl: eclipse public license, ~epl | 1.0 2.0
edl: eclipse distribution license, ~edl | 1.0
cpl: common public license, ~cpl | 1.0
ipl: ibm public license, ~ipl | 1.0
cddl: common development and distribution license, cddl | 1.0 1.1
cpal: common public attribution license, ~cpal | 1.0
eupl: european union public license, european union public licence, eupl | 1.0 1.1 1.2
osl: open software license, ~osl | 1.0 1.1 2.0 2.1 3.0
afl: academic free license, ~afl | 1.1 1.2 2.0 2.1 3.0
artistic: artistic license, perl artistic license, clarified artistic license | 1.0 2.0
apsl: apple public source license, ~apsl | 1.0 1.1 1.2 2.0
rpl: reciprocal public license, ~rpl | 1.1 1.5
rpsl: realnetworks public source license, ~rpsl | 1.0
spl: sun public license, ~spl | 1.0
sissl: sun industry standards source license, ~sissl | 1.1 1.2
qpl: q public license, ~qpl | 1.0
lppl: latex project public license, ~lppl | 1.0 1.1 1.2 1.3
ofl: sil open font license, open font license, ~ofl | 1.0 1.1
zpl: zope public license, ~zpl | 1.1 2.0 2.1
php: php license | 3.0 3.01
python: python software foundation license, python license, ~psf | 2.0
cnri-python: cnri python license |
ecl: educational community license, ~ecl | 1.0 2.0
cecill: cecill license, cecill | 1.0 1.1 2.0 2.1
cecill-b: cecill b |
cecill-c: cecill c |
cern-ohl: cern open hardware licence, ~cern ohl | 1.1 1.2 2.0
upl: universal permissive license, ~upl | 1.0
ms-pl: microsoft public license, ms pl |
ms-rl: microsoft reciprocal license, ms rl |
mulanpsl: mulan permissive software license, mulanpsl | 1.0 2.0
bsl: boost software license, ~bsl | 1.0
busl: business source license, ~busl | 1.1
sspl: server side public license, sspl | 1.0
elastic: elastic license | 2.0
polyform-nc: polyform noncommercial license | 1.0
commons-clause: commons clause license, commons clause |
json: json license |
zlib: zlib license, zlib libpng license |
libpng: libpng license | 2.0
openssl: openssl license, ssleay license |
postgresql: postgresql license |
ruby: ruby license |
vim: vim license |
curl: curl license |
freetype: freetype project license, freetype license, ~ftl |
ijg: independent jpeg group license, ijg license |
icu: icu license |
ncsa: university of illinois ncsa open source license, ncsa open source license |
ntp: ntp license |
hpnd: historical permission notice and disclaimer |
nasa: nasa open source agreement | 1.3
lucent: lucent public license | 1.0 1.02
sleepycat: sleepycat license |
unicode: unicode license agreement, unicode terms of use |
w3c: w3c software notice and license, w3c software license |
wtfpl: do what the fuck you want to public license, wtfpl | 1.0 2.0
beerware: beerware license, beer ware license |
unlicense: unlicense |
cc0: creative commons zero, cc0 | 1.0
cc-by: creative commons attribution, cc by | 1.0 2.0 2.5 3.0 4.0
cc-by-sa: creative commons attribution sharealike, creative commons attribution share alike, cc by sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nd: creative commons attribution noderivatives, creative commons attribution no derivatives, cc by nd | 1.0 2.0 2.5 3.0 4.0
cc-by-nc: creative commons attribution noncommercial, creative commons attribution non commercial, cc by nc | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa: creative commons attribution noncommercial sharealike, cc by nc sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd: creative commons attribution noncommercial noderivatives, cc by nc nd | 1.0 2.0 2.5 3.0 4.0
odbl: open database license, odbl | 1.0
odc-by: open data commons attribution license, odc by | 1.0
pddl: public domain dedication and license, ~pddl | 1.0
ogl-uk: open government licence | 1.0 2.0 3.0
cdla-permissive: community data license agreement permissive, cdla permissive | 1.0 2.0
cdla-sharing: community data license agreement sharing, cdla sharing | 1.0
openrail: openrail license, open rail license, bigscience rail license |
"""

# label: expression whose first word is the keyword.
SENTENCES = """
mit: hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
bsl: hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause: neither the names? of [a-z0-9]+(?: [a-z0-9]+){0,8} nor the names of (?:its|their|his|her|any) contributors may be used to endorse
bsd-4-clause: advertising materials mentioning features or use of this software must display the following acknowledge?ment
gpl: redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public licen[sc]e
lgpl: redistribute it and or modify it under the terms of (?:version [23] of )?the gnu (?:lesser|library) general public licen[sc]e
agpl: redistribute it and or modify it under the terms of (?:version 3 of )?the gnu affero general public licen[sc]e
apache: compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at
mpl: subject to the terms of the mozilla public licen[sc]e
mpl: subject to the mozilla public licen[sc]e
cddl: subject to the terms of the common development and distribution licen[sc]e
epl: accompanying materials are made available under the terms of the eclipse public licen[sc]e
unlicense: unencumbered software released into the public domain
zlib: provided as is without any express or implied warranty in no event will the authors be held liable
openssl: product includes software developed by the openssl project for use in the openssl toolkit
wtfpl: do what the fuck you want to
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ofl: font software is licensed under the sil open font licen[sc]e
beerware: you can buy me a beer in return
json: shall be used for good not evil
cc0: waived all copyright and related or neighboring rights
public-domain: dedicated to the public domain
public-domain: placed in the public domain
public-domain: released (?:in|in)to the public domain
public-domain: public domain dedication
proprietary: proprietary and confidential
proprietary: unauthorized copying of this file via any medium is strictly prohibited
proprietary: all rights reserved
noncommercial: non commercial use only
noncommercial: noncommercial use only
noncommercial: personal and noncommercial use
research-only: academic and research use only
research-only: research purposes only
"""

IDENTIFIER_START = "spdx licen[sc]e identifier "


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    expression: str


def _spelled(words: str) -> str:
    return words.replace("license", "licen[sc]e").replace("licence", "licen[sc]e")


def _keywords(expression: str) -> list[str]:
    """The first words an expression can have."""
    first = re.match(r"(?:[a-z0-9]|\[sc\])+", expression).group()
    return [first.replace("[sc]", c) for c in "sc"] if "[sc]" in first else [first]


def _numbers(version: str) -> str:
    """A version as words: trailing zeros can be left out."""
    major, _, minor = version.partition(".")
    return f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def _family(label: str, names: list[str], versions: list[str]):
    """(label, priority, expression) of all rules of a family."""
    for version in versions:
        own, number = f"{label}-{version}", _numbers(version)
        for name in names:
            short = name.startswith("~")
            name = _spelled(name.lstrip("~"))
            tail = "(?: public)?(?: licen[sc]e)?" if "licen[sc]e" not in name else ""
            versioned = f"{name}{tail}(?: international| unported| generic)?(?: version| ver| v| release)? {number}"
            yield own, VERSION, versioned
            yield f"{own}-only", SCOPE, f"{versioned} only"
            yield f"{own}-or-later", SCOPE, f"{versioned}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"
            if " " not in name:
                for glued in (f"{name}v{version[0]}", f"{name}{version[0]}"):
                    yield own, VERSION, glued + number[1:]
            if not short:
                yield own, VERSION, f"{name}{tail} v{version[0]}{number[1:]}"
        spdx = f"{_spelled(label.replace('-', ' '))} {version.replace('.', ' ')}"
        yield own, IDENTIFIER, IDENTIFIER_START + spdx
    for name in names:
        short = name.startswith("~")
        name = _spelled(name.lstrip("~"))
        yield label, NAME, f"{name} licen[sc]e" if short else name
    if not versions:
        yield label, IDENTIFIER, IDENTIFIER_START + _spelled(label.replace("-", " "))


def rules() -> list[Rule]:
    """All rules in order: base phrases, families, sentences; a repeated expression keeps its first rule."""
    made = [(label, BASE, phrase) for phrase, label in BASE_PHRASES.items()]
    for line in FAMILIES.strip().splitlines():
        label, _, rest = line.partition(": ")
        names, _, versions = rest.partition("|")
        made += _family(label, [n.strip() for n in names.split(",")], versions.split())
    for line in SENTENCES.strip().splitlines():
        label, _, expression = line.partition(": ")
        made.append((label, SENTENCE, _spelled(expression).replace("licen[sc]ed", "licensed")))
    kept = {}
    for label, priority, expression in made:
        kept.setdefault((expression, priority == BASE), (label, priority, expression))
    return [Rule(label, priority, keyword, expression) for label, priority, expression in kept.values() for keyword in _keywords(expression)]


def gate(keywords: list[str]) -> str:
    """An expression that finds any keyword as a whole word, whatever its case."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(keywords):
        by_first.setdefault(word[0], []).append(re.escape(word[1:]))
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return rf"(?i)(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:{words})(?:$|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
