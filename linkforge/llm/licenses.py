"""License scans by ordered signature rules, in SQL expressions alone.

Rules are regular expressions over the text's words (lower-cased, joined by one space). A rule runs only on texts that
hold its keyword and one of its second keywords, and there only where one of its first words stands, on a window of its
own length. Where detections overlap, one that lies within another's span goes, unless it has the higher priority; equal
spans go to the higher priority. The words are worked off in segments longer than any match, so a detection meets only
those of its own segment and the one before: time is linear in the text. One projection: no shuffle and no Python.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import ascii_lower

#: Words: runs of other characters than these (after lower-casing A-Z), so of a-z, 0-9 and all that isn't ASCII.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: SPDX-like label, keyword, name pattern, version pattern (empty: none).
FAMILIES = (
    ("mit", "mit", "mit", ""), ("mit-0", "mit", "mit no attribution", ""), ("x11", "x11", "x11", ""), ("isc", "isc", "isc", ""), ("apache", "apache", "apache(?: software)?(?: foundation)?", "1 0|1 1|2 0|2"),
    ("gpl", "gnu", "gnu general public", "1|2|3|2 0|3 0"), ("gpl", "gpl", "gpl", "1|2|3|2 0|3 0"), ("lgpl", "lesser", "(?:gnu )?lesser general public", "2 1|3|3 0"), ("lgpl", "library", "(?:gnu )?library general public", "2|2 0"), ("lgpl", "lgpl", "lgpl", "2|2 1|3|3 0"),
    ("agpl", "affero", "(?:gnu )?affero general public", "1|3|3 0"), ("agpl", "agpl", "agpl", "1|3|3 0"), ("gfdl", "documentation", "(?:gnu )?free documentation", "1 1|1 2|1 3"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)", ""), ("bsd-2-clause", "freebsd", "freebsd", ""), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", ""), ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", ""), ("bsd", "bsd", "bsd", ""),
    ("mpl", "mozilla", "mozilla public", "1 0|1 1|2 0|2"), ("mpl", "mpl", "mpl", "1 0|1 1|2 0|2"), ("epl", "eclipse", "eclipse public", "1 0|2 0"), ("epl", "epl", "epl", "1 0|2 0"), ("cddl", "cddl", "cddl", "1 0|1 1"), ("cddl", "distribution", "common development and distribution", "1 0|1 1"), ("cpl", "common", "common public", "1 0"),
    ("eupl", "eupl", "eupl", "1 1|1 2"), ("eupl", "european", "european union public", "1 1|1 2"), ("artistic", "artistic", "artistic", "1 0|2 0"), ("bsl", "boost", "boost software", "1 0"), ("zlib", "zlib", "zlib(?: libpng)?", ""), ("libpng", "libpng", "libpng", "1 6|2 0"), ("unlicense", "unlicense", "(?:the )?unlicense", ""), ("wtfpl", "wtfpl", "wtfpl", "2"),
    ("psf", "python", "python software foundation", "2"), ("php", "php", "php", "3 0|3 01"), ("ruby", "ruby", "ruby", ""), ("perl", "perl", "perl", ""), ("openssl", "openssl", "openssl", ""), ("ofl", "sil", "sil open font", "1 0|1 1"), ("ofl", "ofl", "ofl", "1 0|1 1"), ("ncsa", "ncsa", "(?:uiuc )?ncsa", ""),
    ("ms-pl", "microsoft", "microsoft public", ""), ("ms-rl", "microsoft", "microsoft reciprocal", ""), ("osl", "osl", "osl", "1 0|2 0|3 0"), ("osl", "open", "open software", "1 0|2 0|3 0"), ("afl", "academic", "academic free", "2 1|3 0"), ("odbl", "database", "open (?:data commons open )?database", "1 0"), ("odc-by", "commons", "open data commons attribution", "1 0"),
    ("sspl", "server", "server side public", "1"), ("busl", "business", "business source", "1 1"), ("elastic", "elastic", "elastic", "2 0|2"), ("vim", "vim", "vim", ""), ("postgresql", "postgresql", "postgresql", ""), ("cecill", "cecill", "cecill", "1 0|2 0|2 1"), ("mulan", "mulan", "mulan (?:permissive software|psl)", "1|2"), ("upl", "universal", "universal permissive", "1 0"), ("ecl", "educational", "educational community", "1 0|2 0"),
)
#: Label and versions of names written as one word with their version (gplv3, lgplv2 1, apache2 0).
GLUED = (("gpl", "123"), ("lgpl", "23"), ("agpl", "13"), ("mpl", "12"), ("epl", "12"), ("apache", "2"))
#: Prefix, suffix (@: optional version), confidence and second keywords of the sentences that name a license.
SENTENCES = (
    ("(?:re)?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?", "(?: licen[sc]e)?@", 0.95, ("under",)), ("released under (?:the )?(?:terms of (?:the )?)?", "(?: licen[sc]e)?@", 0.95, ("under",)), ("distributed under (?:the )?(?:terms of (?:the )?)?", "(?: licen[sc]e)?@", 0.9, ("under",)), ("available under (?:the )?", "@(?: licen[sc]e)@", 0.85, ("under",)),
    ("spdx licen[sc]e identifier ", "@", 1.0, ("spdx",)), ("", "@ licen[sc]e@", 0.7, ("license", "licence")),
)
#: Creative Commons elements.
CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
#: Signatures of license texts and notices, a line each: label, confidence, keyword, pattern.
SIGNATURES = """
mit 1.0 permission permission is hereby granted free of charge to any person obtaining a copy
mit 0.9 sublicense without limitation the rights to use copy modify merge publish distribute sublicense
mit 0.9 substantial this permission notice shall be included in all copies or substantial portions of the software
mit 0.6 merchantability merchantability fitness for a particular purpose and non ?infringement in no event shall the authors
mit 0.8 expat expat licen[sc]e
x11 0.9 consortium the name of the x consortium shall not be used in advertising
x11 0.8 mit mit x11 licen[sc]e
mit-advertising 0.8 express without specific written prior permission the software is provided as is and any express
hpnd 0.9 documentation permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee
hpnd 0.8 historical historical permission notice and disclaimer
isc 1.0 fee permission to use copy modify and or distribute this software for any purpose with or without fee
isc 0.9 disclaims the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties
isc 0.8 isc isc licen[sc]ed
bsd 1.0 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 0.8 redistributions redistributions of source code must retain the above copyright notice this list of conditions
bsd 0.8 redistributions redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 0.9 endorse neither the name of .{1,80} nor the names of its contributors may be used to endorse
bsd-3-clause 0.8 endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause 0.9 advertising all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clause-clear 0.9 patent no express or implied licen[sc]es to any party s patent rights are granted
bsd-2-clause-patent 0.8 bsd bsd 2 clause plus patent
bsd-0-clause 0.9 0bsd 0bsd
bsd-0-clause 0.9 zero bsd zero clause
bsd-0-clause 0.9 zero zero clause bsd
bsd 0.8 bsd bsd style licen[sc]e
apache 1.0 apache licensed under the apache licen[sc]e version 2 0 the licen[sc]e
apache 0.9 compliance you may not use this file except in compliance with the licen[sc]e
apache 0.8 apache http www apache org licenses license 2 0
apache 0.8 apache this product includes software developed by the apache software foundation
apache 0.7 apache apache software licen[sc]e
apache 0.8 asf licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache 0.7 apache apache 2 0? licensed
gpl 1.0 redistribute you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl 0.9 gnu you should have received a copy of the gnu general public licen[sc]e
gpl 0.9 gnu without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
gpl 0.9 copyleft the gnu general public licen[sc]e is a free copyleft licen[sc]e
gpl 0.8 gnu see the gnu general public licen[sc]e for more details
gpl 0.7 gnu gnu gpl
gpl 0.8 gpl subject to the gpl
gpl 0.8 module module licen[sc]e gpl
gpl 0.8 gpl gpl compatible licen[sc]e
gpl-classpath 0.9 classpath with the classpath exception
gpl-classpath 0.9 linking linking this library statically or dynamically with other modules is making a combined work
gcc-exception 0.9 gcc gcc runtime library exception
lgpl 1.0 gnu you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl 0.9 gnu you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
lgpl 0.8 gnu see the gnu (?:lesser|library) general public licen[sc]e for more details
lgpl 0.7 lgpl gnu lgpl
agpl 1.0 affero you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
agpl 0.9 affero you should have received a copy of the gnu affero general public licen[sc]e
agpl 0.8 remotely all users interacting with it remotely through a computer network
agpl 0.7 agpl gnu agpl
gfdl 1.0 documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl 0.8 invariant with no invariant sections no front cover texts and no back cover texts
gfdl 0.8 gfdl (?:gnu )?gfdl
mpl 1.0 mozilla this source code form is subject to the terms of the mozilla public licen[sc]e
mpl 0.9 mozilla the contents of this file are subject to the mozilla public licen[sc]e
mpl 0.8 mpl a copy of the mpl was not distributed with this file
mpl 0.9 incompatible this source code form is incompatible with secondary licen[sc]es
epl 1.0 eclipse this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl 0.9 eclipse http www eclipse org legal epl
edl 0.9 eclipse eclipse distribution licen[sc]e
cpl 0.9 common the accompanying program is provided under the terms of this common public licen[sc]e
ipl 0.9 ibm ibm public licen[sc]e
cddl 1.0 development subject to the terms of the common development and distribution licen[sc]e
cddl 0.9 cddl the contents of this file are subject to the terms of the cddl
cddl 0.8 opensolaris usr src opensolaris licen[sc]e
apsl 0.9 apple apple public source licen[sc]e
npl 0.9 netscape netscape public licen[sc]e
spl 0.9 sun sun public licen[sc]e
sissl 0.9 sun sun industry standards source licen[sc]e
rpl 0.9 reciprocal reciprocal public licen[sc]e
qpl 0.9 q (?:the )?q public licen[sc]e
lppl 0.9 latex latex project public licen[sc]e
lppl 0.9 latex conditions of the latex project public licen[sc]e
lppl 0.8 lppl lppl
artistic 0.9 artistic the artistic licen[sc]e
artistic 0.8 package the intent of this document is to state the conditions under which a package may be copied
perl 0.9 perl under the same terms as perl itself
perl 0.9 perl under the same terms as the perl 5 programming language
ruby 0.8 ruby under the same terms as ruby
python 0.9 python this licen[sc]e agreement is between the python software foundation
psf 0.8 psf psf licen[sc]e agreement
php 0.9 php this product includes php software freely available from
zope 0.9 zope zope public licen[sc]e
w3c 0.9 w3c w3c software (?:notice and|and document) licen[sc]e
w3c 0.8 w3c w3c document licen[sc]e
unicode 0.9 unicode unicode (?:inc )?licen[sc]e agreement data files and software
icu 0.9 icu icu licen[sc]e
zlib 0.9 misrepresented the origin of this software must not be misrepresented
zlib 0.9 altered altered source versions must be plainly marked as such
libpng 0.9 png png reference library licen[sc]e
libtiff 0.9 sam the names of sam leffler and silicon graphics may not be used
ijg 0.9 jpeg this software is based in part on the work of the independent jpeg group
curl 0.8 stenberg copyright c .{1,40} daniel stenberg
openssl 0.9 openssl this product includes software developed by the openssl project
ssleay 0.9 cryptographic this product includes cryptographic software written by eric young
bsl 1.0 boost distributed under the boost software licen[sc]e
bsl 0.8 boost boost software licen[sc]e version 1 0 august 17th 2003
ncsa 0.9 illinois university of illinois (?:open source|ncsa open source) licen[sc]e
ecl 0.8 educational educational community licen[sc]e
postgresql 0.9 postgresql postgresql database management system
vim 0.8 vim vim licen[sc]e
wtfpl 1.0 fuck do what the fuck you want to public licen[sc]e
beerware 0.9 beer beer ?ware licen[sc]e
beerware 0.9 beer you can buy me a beer in return
unlicense 1.0 unencumbered this is free and unencumbered software released into the public domain
unlicense 0.9 unlicense http unlicense org
public-domain 0.8 dedicated dedicated to the public domain
public-domain 0.8 domain released into the public domain
public-domain 0.8 domain placed in the public domain
public-domain 0.7 domain this (?:work|file|code|software) is in the public domain
public-domain 0.7 disclaims hereby disclaims copyright to this source code
cc0 0.9 zero (?:cc|creative commons) zero(?: 1 0)?(?: universal)?
cc0 0.9 cc0 cc0(?: 1 0)?(?: universal)?
cc0 0.9 waived has waived all copyright and related or neighboring rights
cc0 0.8 dedication public domain dedication
pddl 0.9 pddl pddl
pddl 0.9 dedication public domain dedication and licen[sc]e
odbl 0.9 odbl odbl(?: v?1 0)?
odc-by 0.8 odc odc by
cc 0.7 commons creative commons licen[sc]e
cc 0.7 creativecommons http creativecommons org licenses
cc-by 0.9 creativecommons creativecommons org licenses by
cc-by-sa 0.9 creativecommons creativecommons org licenses by sa
cc-by-nc 0.9 creativecommons creativecommons org licenses by nc
cc-by-nd 0.9 creativecommons creativecommons org licenses by nd
cc-by-nc-sa 0.9 creativecommons creativecommons org licenses by nc sa
cc-by-nc-nd 0.9 creativecommons creativecommons org licenses by nc nd
cc-by-nc 0.7 commercial for non ?commercial use only
ofl 1.0 sil this font software is licensed under the sil open font licen[sc]e
ofl 0.9 reserved with reserved font name
ofl 0.9 scripts scripts sil org ofl
ubuntu-font 0.9 ubuntu ubuntu font licen[sc]e
bitstream-vera 0.9 bitstream bitstream vera is a trademark of bitstream
oasis 0.8 oasis oasis open all rights reserved
ietf 0.9 ietf bcp 78 and the ietf trust s legal provisions
ms-pl 0.9 microsoft microsoft public licen[sc]e
ms-rl 0.9 microsoft microsoft reciprocal licen[sc]e
ms-lpl 0.8 microsoft microsoft limited public licen[sc]e
ms-eula 0.8 microsoft microsoft software licen[sc]e terms
eupl 1.0 eupl licensed under the eupl
eupl 0.9 european european union public licen[sc]e
cecill 0.9 cecill this software is governed by the cecill(?: b| c)? licen[sc]e
cecill 0.9 cecill licence cecill
etalab 0.9 ouverte licence ouverte
ogl 0.9 government open government licen[sc]e
ogl 0.8 government contains public sector information licensed under the open government licen[sc]e
dl-de 0.9 datenlizenz datenlizenz deutschland(?: namensnennung| zero)?
sspl 0.9 server server side public licen[sc]e
busl 0.9 business business source licen[sc]e
busl 0.8 change change licen[sc]e .{1,60} change date
elastic 0.9 elastic elastic licen[sc]e
elastic 0.8 hosted you may not provide the software to third parties as a hosted or managed service
commons-clause 0.9 clause commons clause
commons-clause 0.9 sell the grant of rights under the licen[sc]e will not include .{1,60} the right to sell the software
polyform 0.9 polyform polyform (?:noncommercial|small business|strict|shield|perimeter)
confluent 0.9 confluent confluent community licen[sc]e
timescale 0.9 timescale timescale licen[sc]e
redis 0.9 redis redis source available licen[sc]e
hippocratic 0.9 hippocratic hippocratic licen[sc]e
json 0.9 evil the software shall be used for good not evil
openrail 0.9 openrail (?:bigscience )?openrail(?: m)?
openrail 0.8 responsible responsible ai licen[sc]e
patent-grant 0.6 patent patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants
upl 0.9 universal universal permissive licen[sc]e
mulan 0.9 mulan mulan (?:psl|permissive software licen[sc]e)
osl 0.9 open licensed under the open software licen[sc]e
afl 0.9 academic licensed under the academic free licen[sc]e
nposl 0.9 profit non profit open software licen[sc]e
cpal 0.9 attribution common public attribution licen[sc]e
rpsl 0.9 realnetworks realnetworks public source licen[sc]e
sleepycat 0.9 sleepycat sleepycat
intel 0.8 intel intel open source licen[sc]e
nasa 0.9 nasa nasa open source agreement
lucent 0.9 lucent lucent public licen[sc]e
gust 0.8 gust gust font licen[sc]e
proprietary 0.4 reserved all rights reserved
proprietary 0.8 proprietary proprietary and confidential
proprietary 0.8 confidential confidential and proprietary
proprietary 0.8 unauthorized unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
proprietary 0.7 reproduced no part of this (?:publication|book|work|document) may be reproduced
proprietary 0.7 agreement end user licen[sc]e agreement
proprietary 0.6 prohibited reproduction (?:or distribution )?without permission is prohibited
proprietary 0.4 vorbehalten alle rechte vorbehalten
proprietary 0.4 droits tous droits réservés
proprietary 0.4 derechos todos los derechos reservados
proprietary 0.6 nachdruck nachdruck(?: auch auszugsweise)? verboten
proprietary 0.6 reproduction reproduction interdite
proprietary 0.6 reproducción prohibida la reproducción
"""


def parsed(pattern: str) -> list:
    """Alternatives of a pattern as lists of (part, optional); a part is a character or alternatives. For the signs that
    the rules use: groups, choices, classes of single characters, "?", and .{1,n} for n characters at most."""
    at = 0

    def choices(closing: str) -> list:
        nonlocal at
        out: list = [[]]
        while at < len(pattern) and pattern[at] != closing:
            c = pattern[at]
            at += 1
            if c == "|":
                out.append([])
                continue
            if c == "[":
                end = pattern.index("]", at)
                part: object = [[(x, False)] for x in pattern[at:end]]
                at = end + 1
            elif pattern.startswith("(?:", at - 1):
                at += 2
                part = choices(")")
                at += 1
            elif pattern.startswith("{1,", at):
                end = pattern.index("}", at)
                # Characters of a gap may all be words of one letter.
                part = [[(" ", False)] * (int(pattern[at + 3 : end]) // 2)]
                at = end + 1
            else:
                part = c
            optional = pattern.startswith("?", at)
            at += optional
            out[-1].append((part, optional))
        return out

    return choices("")


def first_words(pattern: str) -> set[str]:
    """All words that a match can begin with."""

    def heads(options: list) -> tuple[set[str], set[str]]:
        whole, open_ = set(), set()
        for seq in options:
            now = {""}
            for part, optional in seq:
                ended, going = heads(part) if isinstance(part, list) else ({""}, set()) if part == " " else (set(), {part})
                whole |= {a + b for a in now for b in ended}
                now = {a + b for a in now for b in going} | (now if optional else set())
            open_ |= now
        return whole, open_

    whole, open_ = heads(parsed(pattern))
    return (whole | open_) - {""}


def most_words(pattern: str) -> int:
    """No match has more words than this."""
    blanks = lambda options: max(sum(blanks(p) if isinstance(p, list) else p == " " for p, _ in seq) for seq in options)
    return 1 + blanks(parsed(pattern))


def rules() -> list[tuple[str, tuple[str, ...], str, int, float, str]]:
    """(keyword, second keywords, pattern, priority, confidence, label) in falling priority: longer and more certain
    signatures first. A text that a rule matches holds its keyword and one of its second keywords as words."""
    out = []
    for (label, keyword, name, version), (prefix, suffix, sure, second) in product(FAMILIES, SENTENCES):
        tail = rf"(?: version)?(?: v?(?:{version}))?(?: or later| only)?" if version else ""
        out.append((keyword, second, prefix + name + suffix.replace("@", tail), sure, label))
    for label, n, v in ((label, n, v) for label, known in GLUED for n in known for v in ("v", "")):
        word, tail = f"{label}{v}{n}", "(?: [01])?(?: or later| only)?"
        out.append((word, (word,), word + tail, 0.6, label))
        out += [(word, second, prefix + word + tail + suffix.replace("@", ""), sure, label) for prefix, suffix, sure, second in SENTENCES]
    for (prefix, second), parts in product((("(?:licensed under )?(?:the )?(?:creative commons|cc)", ("by", "attribution")), ("spdx licen[sc]e identifier cc", ("spdx",))), CC):
        long = parts.replace("by", "(?:by|attribution)").replace("nc", "(?:nc|non ?commercial)").replace("nd", "(?:nd|no ?deriv(?:ative|atives|s))").replace("sa", "(?:sa|share ?alike)")
        out += [(k, second, f"{prefix} {long}(?: (?:1|2|2 5|3|4) ?0?)?(?: international)?", 0.9, "cc-" + parts.replace(" ", "-")) for k in ("cc", "commons")]
    for label, sure, keyword, pattern in (line.split(" ", 3) for line in SIGNATURES.strip().splitlines()):
        out.append((keyword, (keyword,), pattern, float(sure), label))
    out = sorted({(p, k, second): (k, second, p, sure, label) for k, second, p, sure, label in out}.values(), key=lambda r: (-r[3], -len(r[2]), r[2], r[0], r[1]))
    return [(k, second, p, len(out) - i, sure, label) for i, (k, second, p, sure, label) in enumerate(out)]


def literal(found: list[tuple]) -> Column:
    """The rules as one constant array of structs, written as SQL: column by column it takes the driver many seconds."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    list_ = lambda v: f"array({', '.join(map(text, sorted(v)))})"
    rows = (f"named_struct('keyword', {text(k)}, 'second', {list_(second)}, 'first', {list_(first_words(p))}, 'words', {most_words(p)}, 'pattern', {text(f'^(?:{p})(?= |$)')}, 'priority', {n}, 'sure', {sure}D, 'label', {text(lab)})" for k, second, p, n, sure, lab in found)
    return F.expr(f"array({', '.join(rows)})")


def matches(words: Column, anchors: Column, rule: Column) -> Column:
    """The longest match of one rule at each anchor (i, w) with one of its first words, as structs of word places."""
    window = lambda a: F.array_join(F.slice(words, a["i"] + 1, rule["words"]), " ")
    tried = F.transform(F.filter(anchors, lambda a: F.array_contains(rule["first"], a["w"])), lambda a: F.struct(a["i"].alias("a"), F.call_function("regexp_extract", window(a), rule["pattern"], F.lit(0)).alias("m")))
    size = lambda x: F.size(F.split(x["m"], " "))
    return F.transform(F.filter(tried, lambda x: x["m"] != ""), lambda x: F.struct(x["a"], (x["a"] + size(x)).alias("b"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["sure"].alias("sure")))


def inside(x: Column, y: Column) -> Column:
    """Whether detection y suppresses x: a longer one around it with the same label or no lower priority, or one of equal
    span with higher priority."""
    longer = y["b"] - y["a"] > x["b"] - x["a"]
    return (y["a"] <= x["a"]) & (x["b"] <= y["b"]) & F.when(longer, (y["priority"] >= x["priority"]) | (y["label"] == x["label"])).otherwise(y["priority"] > x["priority"])


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Base places are found on the array of words. detections: the rules' kept matches (label, word span, priority,
    confidence) in text order; score: the highest confidence among them, 1 if there is a base place (else 0). Null
    counts as empty; a text without words has no places. Texts of any length, in linear time. A rule runs on texts that
    hold its keywords (a common word, such as German "mit", is no use alone); the others skip it. Columns of df with
    the names of results are replaced, names that begin with "__" are the operator's own; an empty table gives an empty
    result, repeated rows repeated results.
    """
    lower = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__w", F.array_remove(F.split(lower, f"[{GAP}]+"), ""))
    known = rules()
    span = max(most_words(r[2]) for r in known)
    words, keys = F.col("__w"), sorted({r[0] for r in known})
    gate = sorted({*keys, *(w for r in known for w in r[1]), *(w for p, _ in BASE for w in (p.split()[0], p.split()[-1]))})
    df = df.withColumn("__g", F.array_intersect(words, F.array(*(F.lit(k) for k in gate))))
    places = []
    for phrase, label in BASE:
        parts = phrase.split()
        may = (F.size(words) >= len(parts)) & F.array_contains("__g", parts[0]) & F.array_contains("__g", parts[-1])
        places.append(F.when(may, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands(words, parts))).otherwise(F.array().cast("array<int>")).alias(label))
    df = df.withColumn("__b", F.struct(*places))
    due = F.filter(literal(known), lambda r: F.array_contains(F.col("__g"), r["keyword"]) & F.arrays_overlap(F.col("__g"), r["second"]))
    df = df.withColumn("__r", F.when(F.exists("__g", lambda k: k.isin(keys)), due))
    df = df.withColumn("__f", F.when(F.size("__r") > 0, F.array_distinct(F.flatten(F.transform("__r", lambda r: r["first"])))))
    # Anchors: the first words of due rules, by segments of span words.
    at = lambda s: F.transform(F.slice(words, s * span + 1, span), lambda w, k: F.struct((s * span + k).alias("i"), w.alias("w")))
    anchors = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / span).cast("int")), lambda s: F.filter(at(s), lambda a: F.array_contains(F.col("__f"), a["w"])))
    df = df.withColumn("__a", F.when(F.col("__f").isNotNull(), anchors))
    none = F.from_json(F.lit("[]"), "array<struct<a:int,b:int,priority:int,label:string,sure:double>>")
    df = df.withColumn("__d", F.transform("__a", lambda s: F.when(F.size(s) > 0, F.flatten(F.transform("__r", lambda r: matches(words, s, r)))).otherwise(none)))
    free = lambda x, held: ~F.coalesce(F.exists(held, lambda y: inside(x, y)), F.lit(False))
    kept = F.transform("__d", lambda found, s: F.filter(found, lambda x: free(x, found) & free(x, F.get(F.col("__d"), s - 1))))
    df = df.withColumn("__k", F.array_sort(F.flatten(kept)))
    detections = F.transform("__k", lambda x: F.struct(x["label"].alias("label"), x["a"].cast("long").alias("first_word"), x["b"].cast("long").alias("last_word"), x["priority"].alias("priority"), x["sure"].alias("confidence")))
    every = F.concat(*(F.col(f"__b.{label}") for _, label in BASE))
    base = F.array_compact(F.array(*(F.when(F.size(f"__b.{label}") > 0, F.lit(label)) for _, label in BASE)))
    found = F.coalesce(F.transform("__k", lambda x: x["label"]), F.array().cast("array<string>"))
    sure = F.coalesce(F.array_max(F.transform("__k", lambda x: x["sure"])), F.lit(0.0))
    out = {
        "n_words": F.size(words).cast("long"), "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"),
        "base_labels": F.array_join(F.array_sort(base), ","), "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ","),
        "score": F.when(F.size(every) > 0, F.lit(1.0)).otherwise(sure), "detections": F.coalesce(detections, F.from_json(F.lit("[]"), "array<struct<label:string,first_word:bigint,last_word:bigint,priority:int,confidence:double>>")),
    }
    return df.withColumns(out).drop("__w", "__g", "__b", "__r", "__f", "__a", "__d", "__k")


def stands(words: Column, parts: list[str]):
    """Whether parts stand in words from place i on; the last part, the rarest, is compared first."""
    return lambda i: reduce(and_, (F.get(words, i + k) == parts[k] for k in reversed(range(len(parts)))))


def license_report(df: DataFrame) -> DataFrame:
    """One row for each row of df (doc_id, text), without the detections; other columns aren't read."""
    return scan(df.select("doc_id", "text")).drop("text", "detections")
