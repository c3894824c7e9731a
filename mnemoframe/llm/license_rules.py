"""Hand-written licence signatures: names, wordings and links of each licence, and the forms in which notices cite them.

Each entry of LICENSES is ``label: (priority, names, wordings, links)``.  Names
and wordings are regular expressions over lower-cased text; a space in them
stands for any white space.  A rule is a pattern with the keyword that must
occur in a text before the pattern is tried.  Where detections overlap, the
one of higher priority stays, and one whose span lies within another's goes.
"""

import re
from dataclasses import dataclass

LICENSES: dict[str, tuple[int, list[str], list[str], list[str]]] = {
    "mit": (50, [r"mit license", r"the mit licence", r"expat license"], [r"permission is hereby granted, free of charge, to any person obtaining a copy", r"the above copyright notice and this permission notice shall be included in all copies"], [r"opensource\.org/licenses?/mit"]),
    "mit-0": (60, [r"mit no attribution", r"mit-0"], [], [r"github\.com/aws/mit-0"]),
    "x11": (55, [r"x11 license", r"mit/x11"], [r"except as contained in this notice, the name of .{1,60} shall not be used in advertising"], []),
    "apache": (50, [r"apache license", r"apache licence", r"apache software license"], [], [r"www\.apache\.org/licenses/?(?!license)"]),
    "apache-1.1": (60, [r"apache (?:software )?license,? version 1\.1", r"apache-1\.1"], [], [r"apache\.org/licenses/license-1\.1"]),
    "apache-2.0": (60, [r"apache license,? (?:version )?2\.0", r"apache-2\.0", r"apache 2(?:\.0)? license"], [r"unless required by applicable law or agreed to in writing, software distributed under the license"], [r"apache\.org/licenses/license-2\.0"]),
    "gpl": (50, [r"general public license", r"general public licence", r"gnu gpl"], [r"this program is free software[;:,] you can redistribute it"], [r"gnu\.org/licenses/gpl(?!-)", r"gnu\.org/copyleft/gpl"]),
    "gpl-1.0": (60, [r"gpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?"], [], [r"gnu\.org/licenses/old-licenses/gpl-1\.0"]),
    "gpl-2.0": (60, [r"gnu general public license,? (?:as published .{1,60} )?version 2(?! ?\.?[1-9])", r"gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?"], [r"either version 2 of the license"], [r"gnu\.org/licenses/old-licenses/gpl-2\.0"]),
    "gpl-3.0": (60, [r"gnu general public license,? (?:as published .{1,60} )?version 3", r"gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [r"either version 3 of the license"], [r"gnu\.org/licenses/gpl-3\.0"]),
    "lgpl": (58, [r"(?:gnu )?lesser general public license", r"(?:gnu )?library general public license", r"gnu lgpl"], [], [r"gnu\.org/licenses/lgpl(?!-)"]),
    "lgpl-2.0": (64, [r"library general public license,? version 2(?!\.1)", r"lgpl-?v?2\.0(?:-only|-or-later|\+)?"], [], [r"gnu\.org/licenses/old-licenses/lgpl-2\.0"]),
    "lgpl-2.1": (64, [r"lesser general public license,? version 2\.1", r"lgpl-?v?2\.1(?:-only|-or-later|\+)?"], [], [r"gnu\.org/licenses/old-licenses/lgpl-2\.1"]),
    "lgpl-3.0": (64, [r"lesser general public license,? version 3", r"lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [], [r"gnu\.org/licenses/lgpl-3\.0"]),
    "agpl": (58, [r"(?:gnu )?affero general public license", r"gnu agpl"], [], [r"gnu\.org/licenses/agpl(?!-)"]),
    "agpl-3.0": (64, [r"affero general public license,? version 3", r"agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?"], [], [r"gnu\.org/licenses/agpl-3\.0"]),
    "gfdl": (58, [r"(?:gnu )?free documentation license", r"gfdl-?1\.[123]"], [], [r"gnu\.org/(?:licenses|copyleft)/fdl"]),
    "bsd": (45, [r"bsd license", r"bsd licence", r"bsd-style license", r"berkeley software distribution"], [], [r"opensource\.org/licenses?/bsd-license"]),
    "bsd-2-clause": (60, [r"(?:simplified|2-clause|two-clause) bsd(?: license)?", r"bsd[- ]2[- ]clause", r"freebsd license"], [], [r"opensource\.org/licenses?/bsd-2-clause"]),
    "bsd-3-clause": (60, [r"(?:new|revised|modified|3-clause|three-clause) bsd(?: license)?", r"bsd[- ]3[- ]clause"], [r"neither the name of .{1,80} nor the names of its contributors may be used to endorse"], [r"opensource\.org/licenses?/bsd-3-clause"]),
    "bsd-4-clause": (60, [r"(?:original|4-clause|four-clause) bsd(?: license)?", r"bsd[- ]4[- ]clause"], [r"all advertising materials mentioning features or use of this software must display"], []),
    "0bsd": (60, [r"zero-clause bsd", r"0bsd", r"bsd zero clause license"], [], [r"opensource\.org/licenses?/0bsd"]),
    "isc": (50, [r"isc license", r"isc licence"], [r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"], [r"opensource\.org/licenses?/isc"]),
    "mpl": (50, [r"mozilla public license", r"mozilla public licence"], [], [r"mozilla\.org/mpl/?(?![12])"]),
    "mpl-1.1": (60, [r"mozilla public license,? (?:version |v\.? ?)?1\.1", r"mpl-?1\.1"], [], [r"mozilla\.org/mpl/1\.1"]),
    "mpl-2.0": (60, [r"mozilla public license,? (?:version |v\.? ?)?2\.0", r"mpl-?2\.0"], [r"this source code form is subject to the terms of the mozilla public license"], [r"mozilla\.org/(?:en-us/)?mpl/2\.0"]),
    "epl": (50, [r"eclipse public license"], [], [r"eclipse\.org/legal/epl-(?!v)"]),
    "epl-1.0": (60, [r"eclipse public license,? (?:version |v\.? ?)?1\.0", r"epl-?1\.0"], [], [r"eclipse\.org/legal/epl-v10"]),
    "epl-2.0": (60, [r"eclipse public license,? (?:version |v\.? ?)?2\.0", r"epl-?2\.0"], [], [r"eclipse\.org/legal/epl-v?-?20"]),
    "edl-1.0": (60, [r"eclipse distribution license"], [], [r"eclipse\.org/org/documents/edl-v10"]),
    "cddl": (50, [r"common development and distribution license", r"cddl-?1\.[01]"], [], [r"opensource\.org/licenses?/cddl"]),
    "cpl-1.0": (50, [r"common public license"], [], [r"opensource\.org/licenses?/cpl"]),
    "ipl-1.0": (50, [r"ibm public license"], [], [r"opensource\.org/licenses?/ipl"]),
    "artistic": (50, [r"artistic license", r"artistic licence"], [], [r"opensource\.org/licenses?/artistic-license(?!-2)"]),
    "artistic-2.0": (60, [r"artistic license,? (?:version )?2\.0", r"artistic-2\.0"], [], [r"opensource\.org/licenses?/artistic-(?:license-)?2\.0"]),
    "zlib": (50, [r"zlib license", r"zlib/libpng license"], [r"altered source versions must be plainly marked as such"], [r"opensource\.org/licenses?/zlib"]),
    "bsl-1.0": (50, [r"boost software license"], [], [r"boost\.org/license_1_0"]),
    "busl-1.1": (60, [r"business source license"], [], [r"mariadb\.com/bsl11"]),
    "unlicense": (50, [r"the unlicense"], [r"this is free and unencumbered software released into the public domain"], [r"unlicense\.org"]),
    "wtfpl": (50, [r"do what the f[*u]ck you want to public license", r"wtfpl"], [], [r"wtfpl\.net"]),
    "cc0-1.0": (60, [r"creative commons zero", r"cc0(?:[- ]1\.0)?"], [], [r"creativecommons\.org/publicdomain/zero"]),
    "cc-by": (52, [r"creative commons attribution(?! ?-?(?:share|non|no))", r"cc[- ]by(?![- ](?:sa|nc|nd))"], [], [r"creativecommons\.org/licenses/by/"]),
    "cc-by-sa": (60, [r"creative commons attribution[- ]share ?alike", r"cc[- ]by[- ]sa"], [], [r"creativecommons\.org/licenses/by-sa/"]),
    "cc-by-nc": (60, [r"creative commons attribution[- ]non ?commercial(?! ?-?(?:share|no))", r"cc[- ]by[- ]nc(?![- ](?:sa|nd))"], [], [r"creativecommons\.org/licenses/by-nc/"]),
    "cc-by-nd": (60, [r"creative commons attribution[- ]no ?deriv", r"cc[- ]by[- ]nd"], [], [r"creativecommons\.org/licenses/by-nd/"]),
    "cc-by-nc-sa": (66, [r"creative commons attribution[- ]non ?commercial[- ]share ?alike", r"cc[- ]by[- ]nc[- ]sa"], [], [r"creativecommons\.org/licenses/by-nc-sa/"]),
    "cc-by-nc-nd": (66, [r"creative commons attribution[- ]non ?commercial[- ]no ?deriv", r"cc[- ]by[- ]nc[- ]nd"], [], [r"creativecommons\.org/licenses/by-nc-nd/"]),
    "public-domain": (40, [r"(?:in|into) the public domain", r"public domain dedication"], [], []),
    "odbl": (50, [r"open database license", r"odbl-?1\.0"], [], [r"opendatacommons\.org/licenses/odbl"]),
    "ofl-1.1": (50, [r"sil open font license", r"ofl-?1\.1"], [], [r"scripts\.sil\.org/ofl"]),
    "psf": (50, [r"python software foundation license", r"psf license", r"psf-2\.0"], [], [r"docs\.python\.org/3/license"]),
    "php": (50, [r"php license(?:,? version 3\.0[01]?)?", r"php-3\.0[01]?"], [], [r"php\.net/license"]),
    "ruby": (50, [r"ruby license"], [], [r"ruby-lang\.org/en/about/license"]),
    "openssl": (50, [r"openssl license"], [r"this product includes software developed by the openssl project"], []),
    "ncsa": (50, [r"university of illinois/ncsa open source license", r"ncsa license"], [], [r"opensource\.org/licenses?/ncsa"]),
    "w3c": (50, [r"w3c software (?:notice and )?license", r"w3c license"], [], [r"w3\.org/consortium/legal"]),
    "ms-pl": (50, [r"microsoft public license", r"ms-pl"], [], [r"opensource\.org/licenses?/ms-pl"]),
    "ms-rl": (50, [r"microsoft reciprocal license", r"ms-rl"], [], [r"opensource\.org/licenses?/ms-rl"]),
    "eupl": (50, [r"european union public licen[cs]e", r"eupl-?1\.[012]"], [], [r"joinup\.ec\.europa\.eu/.{0,40}eupl"]),
    "cecill": (50, [r"cecill(?:-[bc])?(?: license)?"], [], [r"cecill\.info"]),
    "osl-3.0": (50, [r"open software license(?:,? version)? 3\.0", r"osl-?3\.0"], [], [r"opensource\.org/licenses?/osl"]),
    "afl-3.0": (50, [r"academic free license", r"afl-?3\.0"], [], [r"opensource\.org/licenses?/afl"]),
    "upl-1.0": (50, [r"universal permissive license"], [], [r"opensource\.org/licenses?/upl"]),
    "postgresql": (50, [r"postgresql licen[cs]e"], [], [r"postgresql\.org/about/licence"]),
    "sspl-1.0": (50, [r"server side public license"], [], [r"mongodb\.com/licensing/server-side-public-license"]),
    "elastic-2.0": (50, [r"elastic license(?: 2\.0)?"], [], [r"elastic\.co/licensing/elastic-license"]),
    "json": (50, [r"json license"], [r"the software shall be used for good, not evil"], [r"json\.org/license"]),
    "beerware": (50, [r"beer-?ware license"], [r"you can buy me a beer in return"], []),
    "proprietary": (30, [r"proprietary license", r"commercial license"], [r"all rights reserved", r"unauthorized copying of this file", r"confidential and proprietary"], []),
}

#: Forms in which a notice cites a name: (pattern around the name, points of priority, confidence).
FORMS = [
    (r"spdx-license-identifier\s*:\s*\(?{}", 9, 1.0),
    (r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{}", 5, 0.95),
    (r"license\s*[:=]\s*[\"']?(?:the )?{}", 4, 0.9),
    (r"{}", 0, 0.8),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


def _keyword(pattern: str) -> str:
    """The longest stretch of plain characters that every match of the pattern holds."""
    plain = re.sub(r"\[[^\]]*\][?*+]?|\(\?![^()]*(?:\([^()]*\)[^()]*)*\)", "\n", pattern)
    while re.search(r"\([^()]*\)", plain):
        plain = re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", "\n", plain)
    plain = re.sub(r"\\\.", "\x00", plain)
    plain = re.sub(r"\\.|\.\{[^}]*\}|\.|.[?*]|[()|]", "\n", plain).replace("\x00", ".")
    return max(re.split(r"[\n ]+", plain), key=len)


def _spaced(pattern: str) -> str:
    pattern = pattern.replace("[- ]", r"(?:-|\s+)")
    return re.sub(r" (\??)", lambda m: r"\s*" if m[1] else r"\s+", pattern)


def rules() -> list[Rule]:
    """All rules in order of descending priority."""
    out = []
    for label, (priority, names, wordings, links) in LICENSES.items():
        for name in names:
            out += [Rule(label, priority + more, confidence, _keyword(name), re.compile(rf"(?<![a-z0-9]){_spaced(form.format(f'(?:{name})'))}(?![a-z0-9])", re.DOTALL)) for form, more, confidence in FORMS]
        out += [Rule(label, priority + 3, 0.95, _keyword(x), re.compile(_spaced(x), re.DOTALL)) for x in wordings]
        out += [Rule(label, priority + 2, 0.9, _keyword(x), re.compile(_spaced(x))) for x in links]
    return sorted(out, key=lambda r: -r.priority)


def _gate() -> tuple[str, ...]:
    """The rules' keywords without those that hold another one."""
    keywords = sorted({r.keyword for r in rules()}, key=lambda k: (len(k), k))
    kept: list[str] = []
    for k in keywords:
        if not any(x in k for x in kept):
            kept.append(k)
    return tuple(kept)


#: A text without any of these words has no detection: no rule is tried.  None holds white space.
GATE = _gate()
