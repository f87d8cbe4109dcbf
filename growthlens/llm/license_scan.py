"""License scans: ordered signature rules.

Rules are regular expressions over normalised words (A-Z lower-cased, words
joined by one space), each with a label, a priority and a keyword. A text is
searched for all keywords in one pass; only rules whose keyword occurs are run. Of
overlapping detections the one with the higher priority stays, and one that
lies within another of its priority or more is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Phrases whose every place counts, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: What most patterns need: a version, and how a grant begins.
_V = r"(?: version| v)? ?v?"
#: Signatures by priority, each written for one wording of one license over
#: normalised words: 95 license texts, 85 grants and notices, 75 names with a
#: version, 65 names, 55 short names where they stand as a license, 45 weak signs.
SIGNATURES: dict[int, tuple[tuple[str, str], ...]] = {
    95: (
        ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
        ("x11", r"except as contained in this notice the name of the (?:x consortium|copyright holders?|authors?) shall not be used in advertising"),
        ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
        ("bsd", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
        ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("bsd", r"this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
        ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
        ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
        ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
        ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
        ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("unlicense", r"this is free and unencumbered software released into the public domain"),
        ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
        ("wtfpl", r"do what the fuck you want to public license"),
        ("wtfpl", r"you just do what the fuck you want to"),
        ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
        ("beerware", r"you can buy me a beer in return"),
        ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
        ("gpl", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
        ("lgpl", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
        ("agpl", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
        ("agpl", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
        ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("gfdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free"),
        ("apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
        ("apache", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
        ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
        ("apache-1", r"this product includes software developed by the apache (?:group|software foundation)"),
        ("mpl", r"this source code form is subject to the terms of the mozilla public license"),
        ("mpl", r"the contents of this file are subject to the mozilla public license"),
        ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
        ("epl", r"the accompanying program is provided under the terms of this eclipse public license"),
        ("cpl", r"the accompanying program is provided under the terms of this common public license"),
        ("ipl", r"the accompanying program is provided under the terms of this ibm public license"),
        ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
        ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
        ("artistic", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
        ("ofl", r"this font software is licensed under the sil open font license"),
        ("ofl", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
        ("eupl", r"this european union public licence (?:the )?eupl applies to the work"),
        ("cc0", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights"),
        ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
        ("cc-by", r"you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon"),
        ("python", r"this license agreement is between the python software foundation"),
        ("python", r"psf is making python available to licensee on an as is basis"),
        ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
        ("php", r"this product includes php software freely available from"),
        ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
        ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
        ("icu", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
        ("libpng", r"the contributing authors and group 42 inc disclaim all warranties"),
        ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
        ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
        ("odbl", r"the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
        ("bsl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
        ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service"),
        ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
        ("jsonlicense", r"the software shall be used for good not evil"),
        ("proprietary", r"contains (?:the )?(?:confidential and )?proprietary information of"),
        ("proprietary", r"is the (?:confidential and )?proprietary property of"),
        ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ),
    85: (
        ("gpl", r"version 2 of the license or at your option any later version"),
        ("gpl", r"version 3 of the license or at your option any later version"),
        ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
        ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
        ("agpl", r"you should have received a copy of the gnu affero general public license"),
        ("gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?gpl"),
        ("gpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gnu general public licen[cs]e"),
        ("lgpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?lgpl"),
        ("agpl", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:gnu )?agpl"),
        ("mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?(?:expat |x11 )?mit"),
        ("mit", r"use of this source code is governed by an mit style license"),
        ("mit", r"subject to the terms of the mit license"),
        ("apache", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache"),
        ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("bsd", r"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?(?:new |modified |simplified |revised )?(?:[234] clause )?bsd"),
        ("bsd", r"use of this source code is governed by a bsd style license"),
        ("isc", r"(?:licensed|released|distributed|available) under (?:the )?isc"),
        ("mpl", r"(?:licensed|released|distributed|available) under (?:the )?mpl"),
        ("epl", r"(?:licensed|released|distributed|available) under (?:the )?epl"),
        ("boost", r"distributed under the boost software license"),
        ("artistic", r"(?:licensed|released|distributed|available) under (?:the )?artistic"),
        ("perl", r"under the same terms as perl itself"),
        ("ruby", r"under the same terms as ruby itself"),
        ("zlib", r"(?:licensed|released|distributed|available) under (?:the )?zlib"),
        ("wtfpl", r"(?:licensed|released|distributed|available) under (?:the )?wtfpl"),
        ("cc0", r"(?:licensed|released|dedicated|available) (?:under|to|into) (?:the )?(?:public domain (?:under|by|with) )?cc0"),
        ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike"),
        ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?derivat(?:iv)?e?s?(?: works)?"),
        ("cc-by-nc", r"creative commons attribution non ?commercial"),
        ("cc-by-nd", r"creative commons attribution no ?derivat(?:iv)?e?s?(?: works)?"),
        ("cc-by-sa", r"creative commons attribution share ?alike"),
        ("cc-by", r"(?:licensed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?creative commons attribution (?!non|share|no)"),
        ("public-domain", r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
        ("public-domain", r"this (?:work|file|software|code|document) is (?:hereby )?(?:in|part of) the public domain"),
        ("ogl", r"contains public sector information licensed under the open government licen[cs]e"),
        ("odbl", r"made available under the open database licen[cs]e"),
        ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced"),
        ("proprietary", r"may not be (?:copied|reproduced|redistributed|distributed) without (?:the )?(?:prior |express |written )+(?:permission|consent)"),
    ),
    75: (
        ("gpl", rf"gnu (?:gpl|general public licen[cs]e){_V}[123](?: 0)?(?: only| or later)?"),
        ("gpl", r"gpl ?v ?[123](?: 0)?(?: only| or later)?"),
        ("gpl", r"gpl (?:version )?[123](?: 0)?(?: only| or later)?"),
        ("lgpl", rf"gnu (?:lgpl|lesser general public licen[cs]e|library general public licen[cs]e){_V}[23](?: [01])?(?: only| or later)?"),
        ("lgpl", r"lgpl ?(?:v|version)? ?(?:2 1|2 0|3 0|[23])"),
        ("agpl", rf"gnu (?:agpl|affero general public licen[cs]e){_V}[13](?: 0)?(?: only| or later)?"),
        ("agpl", r"agpl ?(?:v|version)? ?[13](?: 0)?"),
        ("gfdl", r"gnu free documentation licen[cs]e(?: version)? 1 [123]"),
        ("apache", rf"apache (?:software )?licen[cs]e{_V}[12](?: [01])?"),
        ("apache", r"apache (?:2 0|v2|2) licen[cs]e"),
        ("mpl", rf"mozilla public licen[cs]e{_V}[12] [01]"),
        ("epl", rf"eclipse public licen[cs]e{_V}[12](?: 0)?"),
        ("cddl", rf"common development and distribution licen[cs]e{_V}1 [01]"),
        ("cpl", rf"common public licen[cs]e{_V}1 0"),
        ("boost", rf"boost software licen[cs]e{_V}1 0"),
        ("artistic", rf"artistic licen[cs]e{_V}[12] 0"),
        ("bsd", r"(?:bsd )?(?:zero|0|1|2|3|4|two|three|four) clause bsd(?: licen[cs]e)?"),
        ("bsd", r"bsd (?:0|1|2|3|4) clause(?: licen[cs]e)?"),
        ("bsd", r"(?:new|modified|simplified|revised|original) bsd licen[cs]e"),
        ("eupl", rf"european union public licen[cs]e{_V}1 [012]"),
        ("ofl", rf"(?:sil )?open font licen[cs]e{_V}1 [01]"),
        ("python", rf"python software foundation licen[cs]e{_V}2"),
        ("cc-by", r"creative commons attribution (?:4 0|3 0|2 5|2 0|1 0)(?: international| unported| generic)?"),
        ("cc-by-nc-sa", r"cc by nc sa(?: [1234] [05])?"),
        ("cc-by-nc-nd", r"cc by nc nd(?: [1234] [05])?"),
        ("cc-by-nc", r"cc by nc(?: [1234] [05])?"),
        ("cc-by-sa", r"cc by sa(?: [1234] [05])?"),
        ("cc-by-nd", r"cc by nd(?: [1234] [05])?"),
        ("cc-by", r"cc by [1234] [05]"),
        ("cc0", r"cc0 1 0(?: universal)?"),
        ("cecill", rf"cecill(?: free software licen[cs]e)?{_V}[12](?: [01])?"),
        ("afl", rf"academic free licen[cs]e{_V}[123] [012]"),
        ("osl", rf"open software licen[cs]e{_V}[123] [01]"),
        ("zpl", rf"zope public licen[cs]e{_V}[12] [01]"),
        ("php", rf"php licen[cs]e{_V}3 0"),
        ("npl", rf"netscape public licen[cs]e{_V}1 [01]"),
        ("ogl", rf"open government licen[cs]e{_V}[123](?: 0)?"),
        ("sspl", rf"server side public licen[cs]e{_V}1"),
        ("bsl", rf"business source licen[cs]e{_V}1 1"),
        ("elastic", rf"elastic licen[cs]e{_V}2(?: 0)?"),
        ("mulan", rf"mulan (?:permissive software licen[cs]e|psl){_V}[12]"),
    ),
    65: (
        ("mit", r"(?:the )?mit licen[cs]e"),
        ("mit", r"mit expat licen[cs]e"),
        ("apache", r"apache (?:software )?licen[cs]e"),
        ("gpl", r"gnu general public licen[cs]e"),
        ("gpl", r"gnu gpl"),
        ("gpl", r"gpl licen[cs]ed?"),
        ("lgpl", r"gnu lesser general public licen[cs]e"),
        ("lgpl", r"gnu library general public licen[cs]e"),
        ("lgpl", r"gnu lgpl"),
        ("lgpl", r"lgpl licen[cs]ed?"),
        ("agpl", r"(?:gnu )?affero general public licen[cs]e"),
        ("agpl", r"gnu agpl"),
        ("gfdl", r"gnu free documentation licen[cs]e"),
        ("mpl", r"mozilla public licen[cs]e"),
        ("epl", r"eclipse public licen[cs]e"),
        ("edl", r"eclipse distribution licen[cs]e"),
        ("cddl", r"common development and distribution licen[cs]e"),
        ("cpl", r"common public licen[cs]e"),
        ("bsd", r"bsd licen[cs]ed?"),
        ("bsd", r"berkeley software distribution licen[cs]e"),
        ("isc", r"isc licen[cs]e"),
        ("zlib", r"zlib(?: libpng)? licen[cs]e"),
        ("libpng", r"libpng licen[cs]e"),
        ("boost", r"boost software licen[cs]e"),
        ("artistic", r"(?:perl )?artistic licen[cs]e"),
        ("unlicense", r"the unlicen[cs]e"),
        ("wtfpl", r"do what the f[a-z]* you want to"),
        ("beerware", r"beer ?ware licen[cs]e"),
        ("cc0", r"creative commons zero"),
        ("cc0", r"creative commons cc0"),
        ("cc-by-nc-sa", r"attribution non ?commercial share ?alike"),
        ("cc-by-nc-nd", r"attribution non ?commercial no ?deriv[a-z]*"),
        ("cc-by-nc", r"creative commons non ?commercial"),
        ("cc-by-sa", r"creative commons share ?alike"),
        ("cc-by", r"creative commons attribution licen[cs]e"),
        ("creative-commons", r"creative commons licen[cs]e"),
        ("eupl", r"european union public licen[cs]e"),
        ("ofl", r"(?:sil )?open font licen[cs]e"),
        ("python", r"python software foundation licen[cs]e"),
        ("python", r"psf licen[cs]e"),
        ("ncsa", r"university of illinois ncsa open source licen[cs]e"),
        ("openssl", r"openssl licen[cs]e"),
        ("postgresql", r"postgresql licen[cs]e"),
        ("php", r"php licen[cs]e"),
        ("ruby", r"ruby licen[cs]e"),
        ("x11", r"x11 licen[cs]e"),
        ("x11", r"x consortium licen[cs]e"),
        ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e"),
        ("ms-pl", r"microsoft public licen[cs]e"),
        ("ms-rl", r"microsoft reciprocal licen[cs]e"),
        ("qpl", r"q public licen[cs]e"),
        ("sleepycat", r"sleepycat licen[cs]e"),
        ("upl", r"universal permissive licen[cs]e"),
        ("cecill", r"cecill licen[cs]e"),
        ("odbl", r"open (?:data commons )?database licen[cs]e"),
        ("odc-by", r"open data commons attribution licen[cs]e"),
        ("sspl", r"server side public licen[cs]e"),
        ("bsl", r"business source licen[cs]e"),
        ("elastic", r"elastic licen[cs]e"),
        ("vim", r"vim licen[cs]e"),
        ("ijg", r"independent jpeg group(?: s)? licen[cs]e"),
    ),
    55: (
        ("mit", r"licen[cs]e (?:is )?mit"),
        ("apache", r"licen[cs]e (?:is )?apache"),
        ("gpl", r"licen[cs]e (?:is )?(?:gnu )?gpl"),
        ("lgpl", r"licen[cs]e (?:is )?(?:gnu )?lgpl"),
        ("agpl", r"licen[cs]e (?:is )?(?:gnu )?agpl"),
        ("bsd", r"licen[cs]e (?:is )?bsd"),
        ("isc", r"licen[cs]e (?:is )?isc"),
        ("mpl", r"licen[cs]e (?:is )?mpl"),
        ("wtfpl", r"wtfpl"),
        ("gfdl", r"gfdl"),
        ("dual", r"dual licensed under"),
    ),
    45: (
        ("proprietary", r"all rights reserved"),
    ),
}
#: A weak sign of this label counts only where no license is granted.
WEAK = "proprietary"
#: SPDX identifiers in words, and their labels; a rule for each is derived.
SPDX = (("mit", "mit"), ("x11", "x11"), ("apache", "apache 2 0|apache 1 1|apache 1 0"), ("gpl", "gpl [123] 0"),
        ("lgpl", "lgpl (?:2 0|2 1|3 0)"), ("agpl", "agpl [13] 0"), ("gfdl", "gfdl 1 [123]"), ("mpl", "mpl [12] [01]"),
        ("bsd", "bsd [1234] clause"), ("0bsd", "0bsd"), ("isc", "isc"), ("epl", "epl [12] 0"), ("cddl", "cddl 1 [01]"),
        ("cpl", "cpl 1 0"), ("zlib", "zlib"), ("libpng", "libpng"), ("boost", "bsl 1 0"), ("bsl", "busl 1 1"),
        ("artistic", "artistic [12] 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", "cc0 1 0"),
        ("cc-by-nc-sa", "cc by nc sa [1234] [05]"), ("cc-by-nc-nd", "cc by nc nd [1234] [05]"), ("cc-by-nc", "cc by nc [1234] [05]"),
        ("cc-by-sa", "cc by sa [1234] [05]"), ("cc-by-nd", "cc by nd [1234] [05]"), ("cc-by", "cc by [1234] [05]"),
        ("ofl", "ofl 1 [01]"), ("eupl", "eupl 1 [012]"), ("python", "psf 2 0|python 2 0"), ("postgresql", "postgresql"),
        ("ncsa", "ncsa"), ("openssl", "openssl"), ("php", "php 3 0"), ("ruby", "ruby"), ("upl", "upl 1 0"), ("ms-pl", "ms pl"),
        ("afl", "afl [123] [012]"), ("osl", "osl [123] [01]"), ("odbl", "odbl 1 0"), ("sspl", "sspl 1 0"), ("elastic", "elastic 2 0"))

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]


_OPTIONAL = re.compile(r"\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\?|\{[^}]*\}|\+)?|\[[^]]*\][*+?]?(?:\{[^}]*\})?|\.\{[^}]*\}\??|.\?")


#: Runs that most texts hold.
_COMMON = ("under", "of", "the", "to", "in")


def _rule(priority: int, label: str, pattern: str) -> Rule:
    """The longest plain run of a pattern must occur in any match: its keyword."""
    runs = [run.strip() for run in re.sub(_OPTIONAL, "|", pattern).split("|")]
    keyword = max(runs, key=lambda run: (run not in _COMMON, len(run)) if run else (False, 0))
    return Rule(priority, label, keyword.encode(), re.compile(f"(?<= )(?:{pattern})(?= )".encode()))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first, then as written."""
    out = [_rule(100, label, f"spdx license identifier (?:{ids})") for label, ids in SPDX]
    return tuple(out + [_rule(p, label, s) for p, found in SIGNATURES.items() for label, s in found])


@cache
def _gate() -> ahocorasick.Automaton:
    """Finds the keywords of all rules in one pass."""
    out = ahocorasick.Automaton()
    by_keyword: dict[bytes, list[int]] = {}
    for k, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append(k)
    for keyword, held in by_keyword.items():
        out.add_word(keyword.decode("latin-1"), tuple(held))
    out.make_automaton()
    return out


#: Bytes of text around a weak sign that a granted license rules it out in.
NEAR = 3000


def detections(words: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in ``words`` (each between single spaces)
    after suppression, by start."""
    called = sorted({k for _, held in _gate().iter(words.decode("latin-1")) for k in held})
    found = [(m.start(), m.end(), rule.label, rule.priority) for rule in map(rules().__getitem__, called)
             for m in rule.pattern.finditer(words)]
    granted = [(a, b) for a, b, label, _ in found if label != WEAK]
    found = [d for d in found if d[3] != min(SIGNATURES) or not any(a - NEAR <= d[0] <= b + NEAR for a, b in granted)]
    # By start, the longest and highest first: whatever ends no later than a
    # kept one of its priority or more lies within it.
    found.sort(key=lambda d: (d[0], -d[1], -d[3]))
    inside: list[tuple[int, int, str, int]] = []
    reach: dict[int, int] = {}
    for d in found:
        if not any(p >= d[3] and end >= d[1] for p, end in reach.items()):
            inside.append(d)
            reach[d[3]] = max(reach.get(d[3], 0), d[1])
    # Partial overlaps: the lower priority goes, then the later one.
    kept: list[tuple[int, int, str, int]] = []
    for d in inside:
        while kept and kept[-1][1] > d[0] and kept[-1][3] < d[3]:
            kept.pop()
        if not kept or kept[-1][1] <= d[0]:
            kept.append(d)
    return kept


def scan_text(text: str) -> tuple[int, list[int], list[str], list[str], float]:
    """(words, first words of the base places, base labels, labels, score)."""
    split = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    joined = b" " + b" ".join(split) + b" "
    starts, base = [], set()
    for phrase, label in BASE_PHRASES:
        key = f" {phrase} ".encode()
        at = joined.find(key)
        while at >= 0:
            starts.append(joined.count(b" ", 0, at))
            base.add(label)
            at = joined.find(key, at + 1)
    found = detections(joined)
    covered = sum(e - s for s, e, _, _ in found)
    # How sure the surest detection is, a little more where it is much of the text.
    score = max((p for *_, p in found), default=60 if base else 0) / 100
    score = min(1.0, score + (1 - score) * covered / len(joined)) if found else score
    return len(split), starts, sorted(base), sorted(base | {d[2] for d in found}), score


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            n, starts, base, labels, score = scan_text(text.as_py() or "")
            rows.append((n, len(starts), min(starts, default=None), max(starts, default=None),
                         ",".join(base), ",".join(labels), score))
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
        columns = zip(*rows) if rows else ((),) * 7
        yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))],
                              names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base (places of the base phrases),
    first_word and last_word (smallest and largest start, words from 0; else
    null), base_labels and labels (distinct, sorted, comma-joined), score.

    A null or empty text has no words, places or labels and score 0; texts of any
    length are scanned whole. Repeated
    rows come out each, a null id stays null, other columns are ignored.
    """
    return map_arrow(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double")
