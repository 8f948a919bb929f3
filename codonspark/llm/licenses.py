"""Operator 10, license scans by ordered signature rules.

Each license has hand-written patterns in three forms: its identifier in a tag, its notice or full name, and
its addresses. A space of a pattern is any run of white space and comment marks. A rule is gated by a keyword: one Aho-Corasick pass over the lowered text, its lines joined, finds which keywords are there,
and only the rules of those run. Detections are ordered by priority (tag, notice, address, name), then
length, then place; one that lies inside an accepted detection is suppressed, unless it overlaps at the edge only.

Three base phrases are found besides, by words: every place where their words stand consecutively.

Defined cases: a null or empty text has no words and no labels; a text of any length is scanned whole; repeated
rows are scanned alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_words, read_table, slices

#: Base phrases and their labels, in words.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: Form, priority and confidence: lower goes first.
FORMS = {"tag": (0, 1.0), "notice": (1, 0.9), "address": (2, 0.8), "name": (3, 0.6)}


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    keyword: str
    pattern: str


def _gnu(short: str, keyword: str, name: str, versions: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """Rules of a GNU license: versions with their number patterns, each alone or with later ones."""
    out = []
    for v, number in versions.items():
        label = f"{short.lower()}-{v}"
        out += [
            (f"{label}-or-later", "tag", "spdx", rf"spdx-license-identifier:\s*{short}-{number}(?:-or-later|\+)"),
            (f"{label}-only", "tag", "spdx", rf"spdx-license-identifier:\s*{short}-{number}(?:-only)?(?![\w.+-])"),
            (f"{label}-or-later", "notice", keyword, rf"(?:gnu )?{name}\W+(?:as published by the free software foundation\W+)?(?:either\W+)?(?:\(?the\W+license\W*)?(?:version|v\.?)\W*{number}\W+(?:of the license\W+)?or\W+(?:at your option\W+)?any later"),
            (label, "notice", keyword, rf"(?:gnu )?{name}\W{{0,4}}(?:version|v\.?|,)?\s*{number}(?![\w.]\d)"),
            (label, "address", "gnu.org", rf"gnu\.org/licenses/(?:old-licenses/)?{short}-{number}"),
            (label, "name", short.lower(), rf"\b(?:gnu )?{short}[ -]?v?{number}(?![.\d])"),
        ]
    out.append((short.lower(), "name", keyword, rf"\b(?:gnu )?{name}"))
    return out


def _versioned(label: str, spdx: str, keyword: str, name: str, versions: tuple[str, ...], address: str | None = None) -> list[tuple[str, str, str, str]]:
    """Rules of a license with plain version numbers."""
    out = []
    for v in versions:
        number = re.escape(v) if v.count(".") and not v.endswith(".0") else re.escape(v.removesuffix(".0")) + r"(?:\.0)?"
        out += [
            (f"{label}-{v}", "tag", "spdx", rf"spdx-license-identifier:\s*{spdx}-{number}(?![\w.]\d)"),
            (f"{label}-{v}", "notice", keyword, rf"{name}\W{{0,3}}(?:\(?{spdx}\)?\W{{0,3}})?(?:version|v\.?|,)?\s*{number}(?![\w.]\d)"),
        ]
        if address:
            out.append((f"{label}-{v}", "address", address.split("/")[0].replace("\\", ""), rf"{address}{number}"))
    out.append((label, "name", keyword, rf"\b{name}"))
    return out


def _plain(label: str, spdx: str, keyword: str, name: str, notice: str | None = None, address: str | None = None) -> list[tuple[str, str, str, str]]:
    """Rules of a license without versions."""
    out = [(label, "tag", "spdx", rf"spdx-license-identifier:\s*(?:{spdx})(?![\w.-])"), (label, "name", keyword, rf"\b(?:{name})\b")]
    if notice:
        out.append((label, "notice", *notice.split("|", 1)))
    if address:
        out.append((label, "address", address.split("/")[0].replace("\\", ""), address))
    return out


def _creative() -> list[tuple[str, str, str, str]]:
    kinds = {
        "by": "attribution", "by-sa": "attribution[ -]*share[ -]?alike", "by-nd": "attribution[ -]*no[ -]?deriv(?:ative)?s?(?: works)?", "by-nc": "attribution[ -]*non[ -]?commercial",
        "by-nc-sa": "attribution[ -]*non[ -]?commercial[ -]*share[ -]?alike", "by-nc-nd": "attribution[ -]*non[ -]?commercial[ -]*no[ -]?deriv(?:ative)?s?(?: works)?",
    }
    out = []
    for kind, words in kinds.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number, label = re.escape(v), f"cc-{kind}-{v}"
            out += [
                (label, "tag", "cc", rf"\bcc[ -]{kind.replace('-', '[ -]')}[ -]v?{number}"),
                (label, "notice", "creative commons", rf"creative commons {words}\W+(?:license\W+)?(?:version |v)?{number}"),
                (label, "address", "creativecommons.org", rf"creativecommons\.org/licenses/{kind}/{number}"),
            ]
        out.append((f"cc-{kind}", "name", "creative commons", rf"creative commons {words}"))
    return out


_LISTED: list[tuple[str, str, str, str]] = [
    *_gnu("gpl", "general public", r"general public licen[cs]e", {"1.0": r"1(?:\.0)?", "2.0": r"2(?:\.0)?", "3.0": r"3(?:\.0)?"}),
    *_gnu("lgpl", "general public", r"(?:lesser|library) general public licen[cs]e", {"2.0": r"2(?:\.0)?", "2.1": r"2\.1", "3.0": r"3(?:\.0)?"}),
    *_gnu("agpl", "affero", r"affero general public licen[cs]e", {"1.0": r"1(?:\.0)?", "3.0": r"3(?:\.0)?"}),
    *_gnu("gfdl", "free documentation", r"free documentation licen[cs]e", {"1.1": r"1\.1", "1.2": r"1\.2", "1.3": r"1\.3"}),
    *_creative(),
    *_versioned("apache", "apache", "apache", r"apache (?:software )?licen[cs]e", ("1.0", "1.1", "2.0"), r"apache\.org/licenses/license-"),
    *_versioned("mpl", "mpl", "mozilla", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0"), r"mozilla\.org/mpl/"),
    *_versioned("epl", "epl", "eclipse", r"eclipse public licen[cs]e", ("1.0", "2.0"), r"eclipse\.org/legal/epl-v?"),
    *_versioned("edl", "edl", "eclipse", r"eclipse distribution licen[cs]e", ("1.0",)),
    *_versioned("cddl", "cddl", "distribution licen", r"common development and distribution licen[cs]e", ("1.0", "1.1")),
    *_versioned("cpl", "cpl", "common public", r"common public licen[cs]e", ("1.0",)),
    *_versioned("cpal", "cpal", "common public", r"common public attribution licen[cs]e", ("1.0",)),
    *_versioned("eupl", "eupl", "european union", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    *_versioned("artistic", "artistic", "artistic", r"artistic licen[cs]e", ("1.0", "2.0")),
    *_versioned("afl", "afl", "academic free", r"academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    *_versioned("osl", "osl", "open software", r"open software licen[cs]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    *_versioned("bsl", "bsl", "boost", r"boost software licen[cs]e", ("1.0",), r"boost\.org/license_1_"),
    *_versioned("ofl", "ofl", "open font", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
    *_versioned("ecl", "ecl", "educational community", r"educational community licen[cs]e", ("1.0", "2.0")),
    *_versioned("lppl", "lppl", "latex project", r"latex project public licen[cs]e", ("1.0", "1.2", "1.3")),
    *_versioned("zpl", "zpl", "zope", r"zope public licen[cs]e", ("1.1", "2.0", "2.1")),
    *_versioned("apsl", "apsl", "apple public", r"apple public source licen[cs]e", ("1.0", "1.1", "1.2", "2.0")),
    *_versioned("npl", "npl", "netscape", r"netscape public licen[cs]e", ("1.0", "1.1")),
    *_versioned("qpl", "qpl", "q public", r"q public licen[cs]e", ("1.0",)),
    *_versioned("php", "php", "php licen", r"php licen[cs]e", ("3.0", "3.01")),
    *_versioned("psf", "psf", "python software", r"python software foundation licen[cs]e", ("2.0",)),
    *_versioned("upl", "upl", "universal permissive", r"universal permissive licen[cs]e", ("1.0",)),
    *_versioned("sspl", "sspl", "server side", r"server side public licen[cs]e", ("1.0",)),
    *_versioned("busl", "busl", "business source", r"business source licen[cs]e", ("1.0", "1.1")),
    *_versioned("elastic", "elastic", "elastic", r"elastic licen[cs]e", ("1.0", "2.0")),
    *_versioned("cecill", "cecill", "cecill", r"cecill(?:-[bc])?(?: licen[cs]e)?", ("1.0", "1.1", "2.0", "2.1")),
    *_versioned("odbl", "odbl", "open database", r"open database licen[cs]e", ("1.0",)),
    *_versioned("openrail", "openrail", "openrail", r"(?:creativeml )?openrail(?:-m|\+\+)?", ("1.0",)),
    *_plain("mit", "mit", "mit", r"mit licen[cs]e", r"permission is hereby granted|permission is hereby granted,? free of charge,? to any person obtaining a copy", r"opensource\.org/licenses?/mit"),
    *_plain("mit-0", "mit-0", "mit", r"mit[ -]0|mit no attribution"),
    *_plain("x11", "x11", "x11", r"x11 licen[cs]e"),
    *_plain("isc", "isc", "isc", r"isc licen[cs]e", r"permission to use|permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", r"opensource\.org/licenses?/isc"),
    *_plain("0bsd", "0bsd", "bsd", r"(?:zero[ -]clause|0[ -]clause) bsd"),
    *_plain("bsd-1-clause", "bsd-1-clause", "bsd", r"(?:1|one)[ -]clause bsd|bsd[ -]1[ -]clause"),
    *_plain("bsd-2-clause", "bsd-2-clause", "bsd", r"(?:2|two)[ -]clause bsd|(?:simplified|freebsd) bsd|bsd[ -]2[ -]clause", None, r"opensource\.org/licenses?/bsd-2-clause"),
    *_plain("bsd-3-clause", "bsd-3-clause", "bsd", r"(?:3|three)[ -]clause bsd|(?:new|modified|revised) bsd|bsd[ -]3[ -]clause", r"neither the name|neither the name of .{1,120}? nor the names of (?:its|any|the) ?contributors", r"opensource\.org/licenses?/bsd-3-clause"),
    *_plain("bsd-4-clause", "bsd-4-clause", "bsd", r"(?:4|four)[ -]clause bsd|(?:original|old) bsd|bsd[ -]4[ -]clause", r"advertising materials|all advertising materials mentioning features or use of this software"),
    *_plain("bsd", "bsd", "bsd", r"bsd(?:-style)? licen[cs]e", r"redistribution and use|redistribution and use in source and binary forms,? with or without modification"),
    *_plain("zlib", "zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"altered source|altered source versions must be plainly marked as such"),
    *_plain("libpng", "libpng", "libpng", r"libpng licen[cs]e"),
    *_plain("unlicense", "unlicense", "unlicense", r"the unlicense", r"unencumbered|free and unencumbered software released into the public domain", r"unlicense\.org"),
    *_plain("wtfpl", "wtfpl", "wtfpl", r"wtfpl", r"do what the|do what the f\W{0,3}\w* you want to public licen[cs]e", r"wtfpl\.net"),
    *_plain("cc0-1.0", r"cc0-1\.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", r"public domain dedication|cc0 1\.0 universal.{0,40}public domain dedication", r"creativecommons\.org/publicdomain/zero"),
    *_plain("public-domain", "pddl-1.0", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    *_plain("ncsa", "ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    *_plain("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e"),
    *_plain("ms-pl", "ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-pl", "name", "ms-pl", r"\bms-pl\b"),
    *_plain("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("ms-rl", "name", "ms-rl", r"\bms-rl\b"),
    *_plain("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    *_plain("vim", "vim", "vim", r"vim licen[cs]e"),
    *_plain("ruby", "ruby", "ruby", r"ruby licen[cs]e"),
    *_plain("openssl", "openssl", "openssl", r"openssl licen[cs]e"),
    *_plain("curl", "curl", "curl", r"curl licen[cs]e"),
    *_plain("ftl", "ftl", "freetype", r"freetype (?:project )?licen[cs]e"),
    *_plain("icu", "icu", "icu", r"icu licen[cs]e"),
    *_plain("unicode", "unicode-dfs-2016", "unicode", r"unicode (?:data files and software )?licen[cs]e"),
    *_plain("w3c", "w3c", "w3c", r"w3c(?: software)? (?:notice and )?licen[cs]e"),
    *_plain("beerware", "beerware", "beer", r"(?:the )?beer-?ware licen[cs]e", r"buy me a beer|you can buy me a beer in return"),
    *_plain("json", "json", "json", r"json licen[cs]e", r"good, not evil|the software shall be used for good, not evil"),
    *_plain("commons-clause", "commons-clause", "commons clause", r"commons clause"),
    *_plain("hpnd", "hpnd", "historical permission", r"historical permission notice and disclaimer"),
    *_plain("fair", "fair", "fair licen", r"fair licen[cs]e"),
    *_plain("naist", "naist-2003", "naist", r"naist licen[cs]e"),
    *_plain("bittorrent", r"bittorrent-1\.[01]", "bittorrent", r"bittorrent open source licen[cs]e"),
    *_plain("llama", "llama[23]?", "llama", r"llama ?[0-9.]* community licen[cs]e"),
    *_plain("proprietary", "licenseref-proprietary", "rights reserved", r"all rights reserved"),
]
#: Sentences of notices and license texts, each written out, with a keyword that every match holds (or several, parted by |).
_NOTICES: list[tuple[str, str, str, str]] = [
    ("mit", "notice", "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions"),
    ("mit", "notice", "without limitation the rights", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,? and(?:/or)? sell"),
    ("mit-0", "notice", "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense,? and(?:/or)? sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("x11", "notice", "shall not be used in advertising", r"except as contained in this notice, the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale"),
    ("isc", "notice", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("0bsd", "notice", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("hpnd", "notice", "permission to use", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("hpnd", "notice", "supporting documentation", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "notice", "redistributions of source code", r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", "notice", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd-3-clause", "notice", "endorse or promote", r"may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "notice", "must display the following", r"must display the following acknowledge?ment: this product includes software developed by"),
    ("bsd-2-clause", "notice", "freebsd project", r"should not be interpreted as representing official policies, either expressed or implied, of the freebsd project"),
    ("bsd-3-clause-clear", "notice", "express or implied licenses", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-protection", "notice", "bsd protection", r"bsd protection license"),
    ("bsd-source-code", "notice", "bsd source code", r"bsd source code attribution"),
    ("apache-2.0", "notice", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "notice", "obtain a copy of the license", r"you may obtain a copy of the license at https?:? ?(?://)?www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "notice", "as is", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .{0,2}as is.{0,2} basis"),
    ("apache-2.0", "notice", "perpetual, worldwide", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-1.1", "notice", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "notice", "apache group", r"this product includes software developed by the apache group"),
    ("gpl", "notice", "you can redistribute it", r"is free software[;:,] you can redistribute it and(?:/or)? modify it under the terms of the gnu general public"),
    ("gpl", "notice", "without even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public"),
    ("gpl", "notice", "you should have received a copy", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", "notice", "terms of version 2", r"under the terms of version 2 of the gnu general public license"),
    ("gpl-2.0-only", "notice", "version 2 of the license", r"version 2 of the license only"),
    ("gpl-2.0-only", "notice", "published by the free software", r"as published by the free software foundation, version 2(?:\.0)?(?! of the license,? or)(?![.\d])"),
    ("gpl-3.0", "notice", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-2.0", "notice", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0-classpath", "notice", "classpath", r"classpath exception"),
    ("gpl-classpath-exception", "notice", "special exception", r"as a special exception, the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc-exception", "notice", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-bison-exception", "notice", "bison", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "notice", "configuration script", r"as a special exception to the gnu general public license, if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-font-exception", "notice", "font exception", r"gpl font exception"),
    ("gpl-openssl-exception", "notice", "openssl", r"in addition, as a special exception, .{1,160}? gives? permission to link .{1,80}? with the openssl"),
    ("lgpl", "notice", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "notice", "you can redistribute it", r"is free software[;:,] you can redistribute it and(?:/or)? modify it under the terms of the gnu (?:lesser|library) general public"),
    ("lgpl-2.1", "notice", "successor of the gnu library", r"this is the first released version of the lesser gpl\. it also counts as the successor of the gnu library public license"),
    ("lgpl-3.0", "notice", "additional permissions listed below", r"incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below"),
    ("agpl", "notice", "you should have received a copy", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "notice", "remote network interaction", r"remote network interaction; use with the gnu general public license"),
    ("gfdl", "notice", "free documentation", r"permission is granted to copy, distribute and(?:/or)? modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "notice", "invariant sections", r"with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("mpl-2.0", "notice", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "notice", "incompatible with secondary", r"this source code form is .{0,2}incompatible with secondary licenses"),
    ("mpl-1.1", "notice", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "notice", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("npl", "notice", "contents of this file are subject", r"the contents of this file are subject to the netscape public license"),
    ("cddl", "notice", "contents of this file are subject", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", "notice", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "notice", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2\.0"),
    ("cpl", "notice", "accompanying program", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "notice", "accompanying program", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "notice", "licensed under the eupl", r"licensed under the eupl"),
    ("artistic", "notice", "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "notice", "free software package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed,? and(?:/or)? redistributed"),
    ("perl", "notice", "same terms as perl", r"(?:under|on) the same terms as perl(?: itself)?"),
    ("ruby", "notice", "same terms as ruby", r"(?:under|on) the same terms as ruby"),
    ("python", "notice", "license agreement is between", r"this license agreement is between the python software foundation"),
    ("psf-2.0", "notice", "psf hereby", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license"),
    ("cnri-python", "notice", "cnri", r"cnri hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    ("zlib", "notice", "as-is|as is", r"this software is provided .{0,2}as-is.{0,2}, without any express or implied warranty"),
    ("zlib", "notice", "origin of this software", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("libpng", "notice", "png reference library", r"the png reference library is supplied .{0,2}as is"),
    ("bsl-1.0", "notice", "machine-executable object code", r"unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor"),
    ("bsl-1.0", "notice", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "notice", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"),
    ("unlicense", "notice", "author or authors", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "notice", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders"),
    ("cc0-1.0", "notice", "related or neighboring", r"has waived all copyright and related or neighboring rights to"),
    ("cc-by", "notice", "licensed under a creative commons|under a creative commons", r"(?:licensed|available|released) under a creative commons attribution"),
    ("public-domain", "notice", "public domain", r"this (?:file|software|code|work|program) is (?:hereby )?(?:in|placed in|released into) the public domain"),
    ("public-domain", "notice", "no copyright", r"no copyright is claimed|no copyright protection is asserted"),
    ("wtfpl", "notice", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("gpl", "notice", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("beerware", "notice", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("openssl", "notice", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "notice", "cryptographic software", r"this product includes cryptographic software written by eric young"),
    ("ofl-1.1", "notice", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl", "notice", "reserved font name", r"with reserved font name"),
    ("postgresql", "notice", "in no event shall the", r"in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages"),
    ("ntp", "notice", "permission to use", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies"),
    ("ncsa", "notice", "with the software without restriction", r"to deal with the software without restriction, including without limitation the rights"),
    ("w3c", "notice", "by obtaining", r"by obtaining,? (?:using )?(?:and(?:/or)? copying )?this work, you \(the licensee\) agree"),
    ("vim", "notice", "vim", r"you can distribute unmodified copies of vim"),
    ("ftl", "notice", "freetype", r"portions of this software are copyright .{0,20}the freetype project"),
    ("curl", "notice", "permission to use", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided .{0,2}as is.{0,2}, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement of third party rights"),
    ("unicode", "notice", "data files", r"to any person obtaining a copy of the unicode data files"),
    ("ms-pl", "notice", "if you use the software, you accept", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("sspl-1.0", "notice", "offering the program as a service", r"offering the program as a service"),
    ("busl-1.1", "notice", "change date|additional use grant", r"(?:change date|additional use grant) ?:"),
    ("elastic-2.0", "notice", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "notice", "grant of rights", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software"),
    ("polyform", "notice", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) license"),
    ("json", "notice", "good, not evil", r"the software shall be used for good, not evil"),
    ("tcl", "notice", "hereby grant permission to use", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation"),
    ("info-zip", "notice", "info-zip", r"info-zip license"),
    ("bzip2", "notice", "bzip2", r"bzip2 license|this program, bzip2, the associated library libbzip2"),
    ("sleepycat", "notice", "redistributions in any form", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl-1.0", "notice", "qt", r"this file is part of the qt .{0,40}may be distributed under the terms of the q public license"),
    ("zpl", "notice", "zope", r"zope corporation and contributors"),
    ("lppl", "notice", "latex project", r"this work may be distributed and(?:/or)? modified under the conditions of the latex project public license"),
    ("cecill", "notice", "cecill", r"ce logiciel est r[eé]gi par la licence cecill|this software is governed by the cecill"),
    ("openrail", "notice", "use-based restrictions", r"use-based restrictions"),
    ("llama", "notice", "llama", r"llama ?[0-9.]* is licensed under the llama"),
    ("gemma", "notice", "gemma", r"gemma terms of use"),
    ("proprietary", "notice", "confidential", r"(?:this (?:file|software|document) (?:is|contains) )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "notice", "unauthorized copying", r"unauthorized copying of this (?:file|software|document),? via any medium,? is strictly prohibited"),
    ("proprietary", "notice", "not open source|no license is granted", r"(?:this software is not open source|no license is granted)"),
]
RULES = tuple(Rule(*x) for x in _LISTED + _NOTICES)

#: What can stand between two words of a text that is broken over lines: white space, then comment marks too. Taken whole or not at all, so that a rule tries a gap once.
_GAP = r"(?>\s(?:[\s*#/;%>!]|--)*)"
#: Spaces for the keyword pass.
_MARKS = str.maketrans(dict.fromkeys("*#/;%>!", " "))


def wrapped(pattern: str) -> str:
    """The pattern with every space and short gap open to line breaks and comment marks."""
    pattern = re.sub(r"\[ -\]([*?]?)", lambda m: "(?:" + _GAP + "|-)" + m[1], pattern)
    pattern = re.sub(r"(?<=\}\?) ", lambda m: r"(?<!\s)(?:" + _GAP.replace(" ", "") + ")", pattern)  # after any characters a gap is met at its start alone
    pattern = re.sub(r" (\??)", lambda m: "(?:" + _GAP + ")" + m[1], pattern)
    return re.sub(r"\\W\{0,\d\}", lambda m: m[0] + "(?:" + _GAP + ")?", pattern)


def _joined(text: str) -> str:
    """The text on one line, without comment marks: where keywords are looked for."""
    return " ".join(text.translate(_MARKS).replace("--", " ").split())


class Scanner:
    """Compiled rules behind their keywords."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled: list[re.Pattern[str] | None] = [None] * len(rules)
        by: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            for k in r.keyword.split("|"):
                by[k].append(i)
        self.by = dict(by)
        self.gate = ahocorasick.Automaton()
        for k in self.by:
            self.gate.add_word(k, k)
        self.gate.make_automaton()

    def places(self, i: int, text: str) -> list[tuple[int, int]]:
        """Where rule i matches, with no regard to its keyword."""
        self.compiled[i] = self.compiled[i] or re.compile(wrapped(self.rules[i].pattern), re.DOTALL)
        return [m.span() for m in self.compiled[i].finditer(text)]

    def detect(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of the detections that are left, by place; text is lower case."""
        found = []
        for i in sorted({i for _, k in self.gate.iter(_joined(text)) for i in self.by[k]}):
            found += [(FORMS[self.rules[i].form][0], a - b, a, b, i) for a, b in self.places(i, text)]
        left: list[tuple[int, int, int]] = []
        longest = 0
        for _, _, a, b, i in sorted(found):
            near = left[bisect_left(left, (a - longest,)) : bisect_left(left, (a + 1,))]
            if not any(b <= y for _, y, _ in near):
                insort(left, (a, b, i))
                longest = max(longest, b - a)
        return [(a, b, self.rules[i]) for a, b, i in left]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a base phrase stands."""
    out = []
    for phrase, label in BASE:
        want = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return sorted(out)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, base array<struct<word, label>>, found array<struct<start, end, label, form>>, score) of each row; places in code points of the text."""

    base_kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("form", pa.string())]))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches, 4 << 20):
            n_words, base, found, score = [], [], [], []
            for value in batch.column(1).to_pylist():
                words = plain_words(value)
                n_words.append(len(words))
                base.append([{"word": w, "label": x} for w, x in base_places(words)])
                hits = scanner.detect((value or "").translate(lower))
                found.append([{"start": a, "end": b, "label": r.label, "form": r.form} for a, b, r in hits])
                score.append(max([0.6 if base[-1] else 0.0, *(FORMS[r.form][1] for _, _, r in hits)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, base_kind), pa.array(found, found_kind), pa.array(score, pa.float64())], names=["key", "n_words", "base", "found", "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, base array<struct<word:long,label:string>>, found array<struct<start:long,end:long,label:string,form:string>>, score double"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base, words = F.col("base.label"), F.col("base.word")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found.label"))), ",").alias("labels"),
        "score",
    )
