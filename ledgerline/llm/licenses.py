"""License scans by ordered signature rules, in SQL functions only.

Each license name is written by hand; forms (tag, grant, title, web address) turn the names into some hundreds of rules, each a
regular expression with keywords, one of which must be in the text before the expression is tried (every match holds one, with runs
of white space and hyphens as one space, and the fixed words of the rule's form), a priority and a strength.
Detections are resolved by priority, then length, then place: one falls if it lies in, holds or otherwise overlaps one that stays,
and only then, so what a fallen one had covered is still judged by itself. Signature sentences come before titles, and titles
before the bare names inside them. The labels of what stays, and those of the base phrases, are the text's labels; the score is 1
less the product of what each leaves open. Resolving compares each of a text's detections with those kept: a text with thousands of
license names takes a second or two.

Base: places where a phrase's words stand one after the other, words being runs of letters, digits and other characters beyond
ASCII, A-Z lower-cased. Nulls count as empty texts: no words, no places (null first and last), empty labels, score 0. Long texts
are scanned whole; repeated rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"  # the same characters, said so that they are found five times faster
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, expression of the name (spaces stand for any run of spaces or hyphens), SPDX identifier, keywords (one of them is in every match), web address.
LICENSES = [
    ("mit", r"(?:the )?mit", "MIT", "mit", r"opensource\.org/licenses/mit"),
    ("mit-0", r"mit no attribution", "MIT-0", "mit", r"opensource\.org/licenses/mit-0"),
    ("apache-1.1", r"apache(?: software)?(?: licen[cs]e)?,? (?:version|v\.?)? ?1\.1", "Apache-1.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", r"apache(?: software)?(?: licen[cs]e)?,? (?:version|v\.?)? ?2(?:\.0)?", "Apache-2.0", "apache", r"apache\.org/licenses/license-2\.0"),
    ("bsd-1-clause", r"(?:1|one) clause bsd", "BSD-1-Clause", "bsd", r"spdx\.org/licenses/bsd-1-clause"),
    ("bsd-2-clause", r"(?:(?:2|two) clause|simplified|freebsd) bsd", "BSD-2-Clause", "bsd", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:(?:3|three) clause|modified|new|revised) bsd", "BSD-3-Clause", "bsd", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:(?:4|four) clause|original) bsd", "BSD-4-Clause", "bsd", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", r"(?:zero clause|0) ?bsd", "0BSD", "bsd", r"opensource\.org/licenses/0bsd"),
    ("gpl-1.0", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version|v\.?)? ?1(?:\.0)?", "GPL-1.0", "general public|gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version|v\.?)? ?2(?:\.0)?", "GPL-2.0", "general public|gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version|v\.?)? ?3(?:\.0)?", "GPL-3.0", "general public|gpl", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public licen[cs]e|lgpl),? (?:version|v\.?)? ?2(?:\.0)?(?![.\d])", "LGPL-2.0", "library general|lgpl", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version|v\.?)? ?2\.1", "LGPL-2.1", "lesser general|lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version|v\.?)? ?3(?:\.0)?", "LGPL-3.0", "lesser general|lgpl", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-1.0", r"affero general public licen[cs]e,? (?:version|v\.?)? ?1(?:\.0)?", "AGPL-1.0", "affero", r"affero\.org/oagpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[cs]e|agpl),? (?:version|v\.?)? ?3(?:\.0)?", "AGPL-3.0", "affero|agpl", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.2", r"(?:gnu )?free documentation licen[cs]e,? (?:version|v\.?)? ?1\.2", "GFDL-1.2", "documentation", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[cs]e,? (?:version|v\.?)? ?1\.3", "GFDL-1.3", "documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("mpl-1.1", r"mozilla public licen[cs]e,? (?:version|v\.?)? ?1\.1", "MPL-1.1", "mozilla", r"mozilla\.org/(?:mpl|en-us/mpl)/1\.1"),
    ("mpl-2.0", r"(?:mozilla public licen[cs]e|mpl),? (?:version|v\.?)? ?2(?:\.0)?", "MPL-2.0", "mozilla|mpl", r"mozilla\.org/(?:mpl|en-us/mpl)/2\.0"),
    ("epl-1.0", r"eclipse public licen[cs]e,? (?:version|v\.?)? ?1(?:\.0)?", "EPL-1.0", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"eclipse public licen[cs]e,? (?:version|v\.?)? ?2(?:\.0)?", "EPL-2.0", "eclipse", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", r"common development and distribution licen[cs]e,? (?:version|v\.?)? ?1\.0", "CDDL-1.0", "common development", r"opensource\.org/licenses/cddl-1\.0"),
    ("cpl-1.0", r"common public licen[cs]e,? (?:version|v\.?)? ?1\.0", "CPL-1.0", "common", r"opensource\.org/licenses/cpl1\.0"),
    ("cc0-1.0", r"(?:cc ?0(?: 1\.0)?|creative commons zero)", "CC0-1.0", "cc0|cc 0|cc-0|commons zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution) 3\.0", "CC-BY-3.0", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution)(?: international)? 4\.0", "CC-BY-4.0", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4]\.0)?", "CC-BY-SA", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4]\.0)?", "CC-BY-NC", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4]\.0)?", "CC-BY-ND", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4]\.0)?", "CC-BY-NC-SA", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4]\.0)?", "CC-BY-NC-ND", "cc by|cc-by|creative commons", r"creativecommons\.org/licenses/by-nc-nd"),
    ("unlicense", r"(?:the )?unlicen[cs]e", "Unlicense", "unlicen", r"unlicense\.org"),
    ("isc", r"isc", "ISC", "isc", r"opensource\.org/licenses/isc"),
    ("zlib", r"zlib(?:/libpng)?", "Zlib", "zlib", r"opensource\.org/licenses/zlib"),
    ("libpng", r"libpng(?: version 2)?", "Libpng", "libpng", r"libpng\.org/pub/png/src/libpng-license"),
    ("bsl-1.0", r"boost software licen[cs]e(?:,? version)?(?: 1\.0)?", "BSL-1.0", "boost", r"boost\.org/license_1_0"),
    ("busl-1.1", r"business source licen[cs]e(?:,? version)?(?: 1\.1)?", "BUSL-1.1", "business source", r"mariadb\.com/bsl11"),
    ("wtfpl", r"(?:wtfpl|do what the f\S* you want to public licen[cs]e)", "WTFPL", "wtfpl|do what", r"wtfpl\.net"),
    ("artistic-1.0", r"artistic licen[cs]e(?:,? version)? 1\.0", "Artistic-1.0", "artistic", r"opensource\.org/licenses/artistic-license-1\.0"),
    ("artistic-2.0", r"artistic licen[cs]e(?:,? version)? 2\.0", "Artistic-2.0", "artistic", r"opensource\.org/licenses/artistic-2\.0"),
    ("psf-2.0", r"python software foundation licen[cs]e(?:,? version)?(?: 2)?", "PSF-2.0", "python software", r"docs\.python\.org/\S*license"),
    ("ruby", r"ruby", "Ruby", "ruby", r"ruby-lang\.org/\S*license"),
    ("php-3.01", r"php licen[cs]e,? (?:version|v\.?)? ?3\.01", "PHP-3.01", "php", r"php\.net/license"),
    ("openssl", r"openssl", "OpenSSL", "openssl", r"openssl\.org/source/license"),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e(?:,? version)?(?: 1\.1)?", "OFL-1.1", "open font", r"scripts\.sil\.org/ofl"),
    ("ecl-2.0", r"educational community licen[cs]e(?:,? version)?(?: 2\.0)?", "ECL-2.0", "educational", r"opensource\.org/licenses/ecl-2\.0"),
    ("eupl-1.2", r"european union public licen[cs]e(?:,? version)?(?: 1\.2)?", "EUPL-1.2", "european union", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("ms-pl", r"microsoft public licen[cs]e", "MS-PL", "microsoft", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "MS-RL", "microsoft", r"opensource\.org/licenses/ms-rl"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "NCSA", "ncsa", r"opensource\.org/licenses/ncsa"),
    ("postgresql", r"postgresql", "PostgreSQL", "postgresql", r"opensource\.org/licenses/postgresql"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e(?:,? version)?(?: 1\.0)?", "ODbL-1.0", "database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e(?:,? version)?(?: 1\.0)?", "ODC-By-1.0", "data commons", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication and licen[cs]e(?:,? version)?(?: 1\.0)?", "PDDL-1.0", "public domain", r"opendatacommons\.org/licenses/pddl"),
    ("x11", r"x11", "X11", "x11", r"spdx\.org/licenses/x11"),
    ("curl", r"curl", "curl", "curl", r"curl\.se/docs/copyright"),
    ("ijg", r"independent jpeg group", "IJG", "independent", r"spdx\.org/licenses/ijg"),
    ("unicode", r"unicode(?:,? inc\.?)?", "Unicode-3.0", "unicode", r"unicode\.org/(?:copyright|license)"),
    ("vim", r"vim", "Vim", "vim", r"vimhelp\.org/uganda"),
    ("w3c", r"w3c software(?: notice and)?", "W3C", "w3c", r"w3\.org/consortium/legal/\S*software"),
    ("zpl-2.1", r"zope public licen[cs]e(?:,? version)?(?: 2\.1)?", "ZPL-2.1", "zope", r"opensource\.org/licenses/zpl-2\.1"),
    ("afl-3.0", r"academic free licen[cs]e(?:,? version)?(?: 3\.0)?", "AFL-3.0", "academic free", r"opensource\.org/licenses/afl-3\.0"),
    ("osl-3.0", r"open software licen[cs]e(?:,? version)?(?: 3\.0)?", "OSL-3.0", "open software", r"opensource\.org/licenses/osl-3\.0"),
    ("apsl-2.0", r"apple public source licen[cs]e(?:,? version)?(?: 2\.0)?", "APSL-2.0", "apple", r"opensource\.apple\.com/license/apsl"),
    ("sspl-1.0", r"server side public licen[cs]e(?:,? version)?(?: 1(?:\.0)?)?", "SSPL-1.0", "server", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", r"elastic licen[cs]e(?:,? version)?(?: 2\.0)?", "Elastic-2.0", "elastic", r"elastic\.co/licensing/elastic-license"),
    ("commons-clause", r"commons clause", "LicenseRef-Commons-Clause", "commons", r"commonsclause\.com"),
    ("openrail", r"open ?rail(?: [ms])?", "LicenseRef-OpenRAIL", "rail", r"licenses\.ai"),
    ("beerware", r"beer ?ware", "Beerware", "beer", r"spdx\.org/licenses/beerware"),
]
#: Rules without a license's name: label, expression, keyword, priority, strength.
GENERAL = [
    ("gpl", r"gnu general public licen[cs]e", "general public", 60, 0.7),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e", "general public", 55, 0.7),
    ("agpl", r"affero general public licen[cs]e", "affero", 55, 0.7),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd", 60, 0.6),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", 60, 0.6),
    ("creative-commons", r"creative commons licen[cs]e", "creative commons", 60, 0.6),
    ("public-domain", r"(?:released|dedicated|placed|put|is|are) (?:in|into|to) the public domain", "public domain", 40, 0.7),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 40, 0.8),
    ("reserved", r"all rights reserved", "rights reserved", 70, 0.5),
    ("copyright", r"(?:copyright|\(c\)|©) (?:\(c\) |© )?(?:19|20)\d\d", "copyright|(c)|©", 80, 0.3),
    ("mit", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", "permission is hereby", 30, 0.9),
    ("isc", r"permission to use,? copy,? modify,? and/?(?:or)? distribute this software", "permission to use", 30, 0.9),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution and use", 30, 0.9),
    ("gpl", r"this program is free software[:;,]? you can redistribute it", "free software", 30, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", "in compliance with", 30, 0.9),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice", 30, 0.9),
    ("mit-0", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files \(the .software.\),? to deal in the software without restriction,? including without limitation the rights to use,? copy,? modify,? merge,? publish,? distribute,? sublicense,? and/?or sell copies of the software,? and to permit persons to whom the software is furnished to do so\. the software is provided", "furnished to do so", 25, 0.95),
    ("bsd-3-clause", r"neither the names? of .{1,80} nor the names of its contributors may be used to endorse or promote", "endorse or promote", 28, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials", 28, 0.95),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|authors?) (?:and contributors )?.as is. and any express or implied warranties", "express or implied", 35, 0.8),
    ("gpl-2.0", r"either version 2 of the licen[cs]e,? or \(at your option\) any later version", "either version 2", 28, 0.95),
    ("gpl-3.0", r"either version 3 of the licen[cs]e,? or \(at your option\) any later version", "either version 3", 28, 0.95),
    ("lgpl", r"this library is free software[:;,]? you can redistribute it", "free software", 30, 0.9),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "you should have received", 28, 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "you should have received", 28, 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", "you should have received", 28, 0.95),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. 2\.0", "source code form", 28, 0.97),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1", "contents of this file", 28, 0.97),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents of this file", 28, 0.95),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v\. |version )?2\.0", "accompanying materials", 28, 0.97),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1\.0", "accompanying materials", 28, 0.97),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked", 30, 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 30, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 28, 0.97),
    ("bsl-1.0", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy", "person or organization", 28, 0.95),
    ("wtfpl", r"you just do what the \S+ you want to", "you just do what", 28, 0.95),
    ("cc0-1.0", r"has waived all copyright and related or neighbou?ring rights", "neighbo", 28, 0.95),
    ("ofl-1.1", r"this font software is licensed under the sil open font licen[cs]e", "font software", 28, 0.97),
    ("verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "verbatim copies", 70, 0.3),
    ("beerware", r"if we meet some day,? and you think this stuff is worth it,? you can buy me a beer", "buy me a beer", 28, 0.97),
    ("postgresql", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee", "without fee", 28, 0.95),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project", 28, 0.95),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg group", 28, 0.97),
    ("busl-1.1", r"the licensor hereby grants you the right to copy,? modify,? create derivative works,? redistribute,? and make non production use", "non production use", 28, 0.95),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed", 28, 0.95),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this \S+)?,? via any medium,? is strictly prohibited", "strictly prohibited", 40, 0.8),
    ("proprietary", r"this (?:document|file|software) contains (?:confidential|proprietary) (?:and \S+ )?information", "information", 45, 0.6),
    ("public-domain", r"no copyright (?:is )?(?:claimed|asserted)", "no copyright", 40, 0.7),
    ("government-work", r"this is a work of the (?:u\.s\. |united states )government", "government", 40, 0.7),
]
GRANTED = "licensed licenced released distributed available provided published covered".split()
#: A grant "under" a name is enough; one "by" it is a license only with that word, since many names are organisations' too.
GRANTS = {way: rf"(?:{'|'.join(v.replace('licenced', 'licen[cs]ed') for v in GRANTED if v != 'licensed')}) {way} (?:the )?(?:terms (?:and conditions )?of )?(?:the )?" for way in ("under", "by")}
#: What may not follow a name: more of a word, or of a version number.
ENDS = r"(?![\w-]|\.\d)"
#: Names that are products as well: alone they are no license.
PRODUCTS = {
    "apache-1.1": r"apache(?: software)? licen[cs]e,? (?:version|v\.?)? ?1\.1",
    "apache-2.0": r"(?:apache(?: software)? licen[cs]e,? (?:version|v\.?)? ?2(?:\.0)?|apache,? (?:version|v\.?)? ?2(?:\.0)? licen[cs]e)",
}
DETECTION = "array<struct<start:bigint,back:bigint,priority:int,label:string,strength:double>>"


def spaced(pattern: str) -> str:
    """An expression whose spaces stand for runs of white space and hyphens; optional groups may begin with a space."""
    return pattern.replace(" ?", r"[\s-]*").replace(" ", r"[\s-]+")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, expression, keywords, priority, strength) of all rules, best priority first."""
    out = [(label, spaced(p), keyword, priority, strength) for label, p, keyword, priority, strength in GENERAL]
    for label, name, spdx, keyword, address in LICENSES:
        alone = spaced(PRODUCTS.get(label, name))
        name = spaced(name)
        more = r"(?:[\s-]+(?:public[\s-]+)?licen[cs]e)"
        out += [
            (label, rf"spdx-licen[cs]e-identifier:\s*{spdx.lower().replace('.', '[.]')}(?:-only|-or-later|\+)?(?![\w.-])", "spdx-licen", 10, 0.99),
            (label, rf"(?:https?://)?(?:www\.)?{address}", address.split("/")[0].replace("\\", ""), 20, 0.9),
            (label, rf"{spaced(GRANTS['under'])}{name}{more}?{ENDS}", keyword, 30, 0.95),
            (label, rf"{spaced(GRANTS['by'])}{name}{more}{ENDS}" if "licen" not in name else rf"{spaced(GRANTS['by'])}{alone}{more}?{ENDS}", keyword, 30, 0.95),
            (label, rf"(?<![\w-]){name}[\s-]+licen[cs]e(?![\w-])" if "licen" not in name else rf"(?<![\w-]){alone}{ENDS}", keyword, 50, 0.6),
        ]
    return sorted(out, key=lambda r: (r[3], r[0], r[1]))


def holds(low: Column, words: list[str], every: bool) -> Column:
    tests = [F.contains(low, F.lit(w)) for w in words]
    return functools.reduce(operator.and_ if every else operator.or_, tests)


def phrase_places(text: Column, low: Column, phrase: str) -> Column:
    """The word positions at which a phrase begins: words before each match are counted piece by piece."""
    words = phrase.split(" ")
    pattern = rf"(?<!{WORD})(?i:{GAP.join(words)})(?!{WORD})"
    nothing = F.array().cast("array<bigint>")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.regexp_count(piece, F.lit(f"{WORD}++"))
        return F.struct((at + len(words)).cast("bigint").alias("at"), F.concat(acc["out"], F.array(at.cast("bigint"))).alias("out"))

    # The piece after the last match begins no place.
    found = F.aggregate(F.split(text, pattern, -1), begin, step, lambda acc: F.slice(acc["out"], 1, F.size(acc["out"]) - 1))
    return F.when(F.when(holds(low, words, True), text.rlike(pattern)), found).otherwise(nothing)


def rule_matches(text: Column, rule: Column) -> Column:
    pieces = F.arrays_zip(F.split(text, rule["pattern"], F.lit(-1)).alias("gap"), F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("hit"))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(DETECTION).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = (acc["at"] + F.length(p["gap"])).cast("bigint")
        end = (start + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("bigint")
        # back is minus the end: sorting puts the longer of two detections that begin together first.
        one = F.array(F.struct(start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["strength"].alias("strength")))
        return F.struct(end.alias("at"), F.when(p["hit"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # Most rules that are tried match nothing, which one search tells.
    return F.when(F.regexp_like(text, rule["pattern"]), F.aggregate(pieces, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(DETECTION))


def folded(low: Column) -> Column:
    """A lower-case text whose runs of white space and hyphens are one space each, as keywords are held against it."""
    return F.regexp_replace(low, r"[\s-]+", " ")


def also(pattern: str) -> str:
    """What else each match holds besides a keyword, once folded: the first words of a grant, or the last one of a title."""
    for way, grant in GRANTS.items():
        if pattern.startswith(spaced(grant)):
            return "|".join(f"{verb} {way} " for verb in GRANTED)
    return "licen" if pattern.endswith(r"[\s-]+licen[cs]e(?![\w-])") else ""  # elsewhere the word may be one of several ways


def detections(text: Column, fold: Column) -> Column:
    """All rules' matches whose keyword the folded text holds, resolved."""
    sharing: dict[tuple[str, str], list[Column]] = {}
    for label, p, k, pr, s in rules():
        sharing.setdefault((k.replace("-", " "), also(p)), []).append(F.struct(F.lit(label).alias("label"), F.lit(f"(?i){p}").alias("pattern"), F.lit(pr).alias("priority"), F.lit(s).alias("strength")))
    table = F.array(*[F.struct(F.array(*[F.lit(w) for w in k.split("|")]).alias("keywords"), F.array(*[F.lit(w) for w in more.split("|")]).alias("also"), F.array(*r).alias("rules")) for (k, more), r in sharing.items()])
    tried = F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(fold, k)) & F.exists(g["also"], lambda k: F.contains(fold, k)))
    found = F.flatten(F.transform(F.flatten(F.transform(tried, lambda g: g["rules"])), lambda r: rule_matches(text, r)))
    # Best priority first, then the longer one, then the earlier: each stays unless it overlaps one that does.
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["priority"].alias("priority"), (d["start"] + d["back"]).alias("shorter"), d["start"].alias("start"), d["back"].alias("back"), d["label"].alias("label"), d["strength"].alias("strength"))))
    nothing = F.array().cast(DETECTION)

    def step(kept: Column, d: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["start"] < -d["back"]) & (d["start"] < -k["back"]))
        one = F.struct(d["start"].alias("start"), d["back"].alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["strength"].alias("strength"))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(one)))

    # Besides sparing work, so many uses keep the optimiser from folding the text anew for each keyword.
    any_rule = holds(fold, sorted({w for k, _ in sharing for w in k.split("|")}), False)
    return F.when(any_rule, F.aggregate(ordered, nothing, step)).otherwise(nothing)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    text, low = F.col("_text"), F.col("_low")
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("_low"))
    rows = rows.withColumn("_fold", folded(low))
    rows = rows.withColumns({f"_p{i}": phrase_places(text, low, p) for i, p in enumerate(PHRASES)} | {"_found": detections(text, F.col("_fold"))})
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    rows = rows.select(
        "doc_id", F.regexp_count(text, F.lit(f"{WORD}++")).cast("long").alias("n_words"), F.concat(*[f"_p{i}" for i in range(len(PHRASES))]).alias("_places"), base.alias("_base"), "_found"
    )
    left_open = F.aggregate("_found", F.lit(1.0), lambda acc, d: acc * (1 - d["strength"])) * F.when(F.size("_base") > 0, 0.5).otherwise(1.0)
    return rows.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"), F.array_min("_places").alias("first_word"), F.array_max("_places").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("_found", lambda d: d["label"])))), ",").alias("labels"),
        (1 - left_open).alias("score"),
    )
