"""License scans: ordered signature rules behind a keyword prefilter.

Rules are SIGNATURES of license texts, and notices of license FAMILIES in some forms. Every text is
cut into lower-case words joined by single spaces. Texts with none of the keywords stop there. For
the others the rules of each keyword that occurs are matched; a detection goes when a
detection of the same or a better priority covers its interval. All of it is DataFrame expressions
over one row, so there is no shuffle and no group.

Defined results: a null or empty text has no words, no places and score 0. Repeated rows are judged
alike; null ids, ties and other columns do not matter (`scan` adds the struct `__l_scan` and works
in columns that start with `__l_`). An empty table gives an empty table. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import once, running

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Text of licenses and of their notices. label, keyword (words that stand in every match), signature
#: over the lower-case words of a text; best priority first within a label.
SIGNATURES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("mit", "this permission notice shall", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-advertising", "except as contained", "except as contained in this notice the names? of (?:\\S+ ){1,12}shall not be used in advertising"),
    ("isc", "distribute this software", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", "(?:the author|internet systems consortium inc|isc) disclaims all warranties"),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:\\S+ ){1,16}may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted"),
    ("bsd-2-clause-patent", "patent license", "patent license (?:\\S+ ){0,6}bsd 2 clause"),
    ("apache-2.0", "required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0"),
    ("apache-1.1", "called apache", "products derived from this software may not be called apache"),
    ("apache-1.0", "apache group", "this product includes software developed by the apache group"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "along with this program", "you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("gpl-2.0-or-later", "at your option", "gnu general public licen[sc]e (?:\\S+ ){1,12}either version 2 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl-3.0-or-later", "at your option", "gnu general public licen[sc]e (?:\\S+ ){1,12}either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl-1.0-or-later", "at your option", "gnu general public licen[sc]e (?:\\S+ ){1,12}either version 1 (?:of the licen[sc]e )?or at your option any later version"),
    ("gpl-2.0-classpath", "classpath exception", "gpl (?:2 0|v2|version 2) with (?:the )?classpath exception"),
    ("gpl-linking-exception", "linking this library", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-autoconf-exception", "autoconf", "as a special exception (?:\\S+ ){0,30}configuration script generated by autoconf"),
    ("gpl-bison-exception", "bison parser", "as a special exception (?:\\S+ ){0,30}bison parser skeleton"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "along with this library", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library"),
    ("lgpl-2.1-or-later", "at your option", "gnu lesser general public licen[sc]e (?:\\S+ ){1,12}either version 2 1 (?:of the licen[sc]e )?or at your option any later version"),
    ("lgpl-3.0-or-later", "at your option", "gnu lesser general public licen[sc]e (?:\\S+ ){1,12}either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("agpl", "interacting with", "users interacting with it remotely through a computer network"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3.0-or-later", "affero", "gnu affero general public licen[sc]e (?:\\S+ ){1,12}either version 3 (?:of the licen[sc]e )?or at your option any later version"),
    ("gfdl", "invariant sections", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gfdl", "this document under", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2.0-no-copyleft", "secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public licen[sc]e"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("npl", "netscape", "netscape public licen[sc]e"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl-2.0", "eclipse org", "www eclipse org legal epl (?:2 0|v20)"),
    ("epl-1.0", "eclipse org", "www eclipse org legal epl (?:1 0|v10)"),
    ("cddl", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl", "accompanying materials", "the accompanying materials are made available under the terms of the common public licen[sc]e"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such"),
    ("zlib", "held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", "libpng", "libpng licen[sc]e"),
    ("bsl-1.0", "organization obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("bsl-1.0", "boost org", "www boost org licen[sc]e 1 0 txt"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "changing it is allowed", "copies of this licen[sc]e document and changing it is allowed"),
    ("wtfpl", "you just do", "0 you just do what the fuck you want to"),
    ("cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "publicdomain", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "creativecommons", "creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nd-4.0", "creativecommons", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", "creativecommons", "creativecommons org licenses by nc nd 3 0"),
    ("cc", "creative commons", "this (?:work|article|book|page|document) is licen[sc]ed under (?:a|the) creative commons"),
    ("cc", "creative commons", "some rights reserved (?:\\S+ ){0,4}creative commons"),
    ("artistic-1.0", "conditions under which", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "artistic license", "the artistic license 2 0"),
    ("perl", "perl", "(?:free software )?(?:you can|you may) redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("ofl-1.1", "font software", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("ofl", "with reserved font", "with reserved font names?"),
    ("python-2.0", "python software", "this license agreement is between the python software foundation"),
    ("python-2.0", "beopen", "beopen python open source license agreement"),
    ("cnri-python", "cnri", "cnri (?:open source )?license agreement"),
    ("php-3.01", "php software", "this product includes php software freely available from"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("beerware", "beer ware", "the beer ware licen[sc]e"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("vim", "charityware", "vim is charityware"),
    ("ruby", "bsdl", "under either the terms of the 2 clause bsdl"),
    ("lppl", "latex project", "(?:under the conditions of the )?latex project public licen[sc]e"),
    ("sspl-1.0", "server side public", "server side public licen[sc]e(?: version 1)?"),
    ("busl-1.1", "business source", "business source licen[sc]e(?: 1 1)?"),
    ("busl-1.1", "change date", "change date (?:\\S+ ){1,10}change licen[sc]e"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e (?:2 0|v2)"),
    ("commons-clause", "commons clause", "commons clause (?:license )?condition"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial licen[sc]e"),
    ("polyform-small-business", "polyform", "polyform small business licen[sc]e"),
    ("polyform-shield", "polyform", "polyform shield licen[sc]e"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? licen[sc]e(?: agreement)? (?:version )?2 1"),
    ("cecill-b", "cecill", "cecill b"),
    ("cecill-c", "cecill", "cecill c"),
    ("cecill", "cecill", "cecill"),
    ("eupl", "eupl", "licen[sc]ed under the eupl"),
    ("rpl", "reciprocal public", "reciprocal public licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat (?:software|licen[sc]e)"),
    ("qpl", "q public", "q public licen[sc]e"),
    ("ipl", "ibm public", "ibm public licen[sc]e"),
    ("apsl", "apple public source", "apple public source licen[sc]e"),
    ("sissl", "industry standards", "sun industry standards source licen[sc]e"),
    ("spl", "sun public", "sun public licen[sc]e"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e"),
    ("zpl", "zope", "zope public licen[sc]e"),
    ("efl", "eiffel forum", "eiffel forum licen[sc]e"),
    ("ecl", "educational community", "educational community licen[sc]e"),
    ("aal", "attribution assurance", "attribution assurance licen[sc]e"),
    ("lpl", "lucent", "lucent public licen[sc]e"),
    ("rpsl", "realnetworks", "realnetworks public source licen[sc]e"),
    ("rscpl", "ricoh", "ricoh source code public licen[sc]e"),
    ("wxwindows", "wxwindows", "wxwindows library licen[sc]e"),
    ("xfree86", "xfree86", "xfree86 licen[sc]e"),
    ("x11", "x consortium", "x consortium"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("info-zip", "info zip", "info zip licen[sc]e"),
    ("imagemagick", "imagemagick", "imagemagick licen[sc]e"),
    ("openldap", "openldap", "openldap public licen[sc]e"),
    ("unicode", "unicode", "unicode licen[sc]e agreement(?: data files and software)?"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e"),
    ("blueoak-1.0.0", "blue oak", "blue oak model licen[sc]e"),
    ("mulanpsl", "mulan", "mulan (?:permissive software licen[sc]e|psl)"),
    ("curl", "curl", "curl licen[sc]e"),
    ("vsl", "vovida", "vovida software licen[sc]e"),
    ("intel", "intel open source", "intel open source licen[sc]e"),
    ("nokia", "nokia open source", "nokia open source licen[sc]e"),
    ("nasa", "nasa open source", "nasa open source agreement"),
    ("cua-opl", "cua office", "cua office public licen[sc]e"),
    ("ms-lpl", "microsoft limited", "microsoft limited public licen[sc]e"),
    ("ms-eula", "microsoft software license", "microsoft software license terms"),
    ("pddl", "pddl", "pddl"),
    ("pddl", "open data commons", "open data commons public domain dedication and licen[sc]e"),
    ("odbl", "open data commons", "open data commons open database licen[sc]e"),
    ("cdla-permissive", "community data license", "community data license agreement permissive"),
    ("cdla-sharing", "community data license", "community data license agreement sharing"),
    ("ogl-uk", "open government", "open government licen[sc]e"),
    ("etalab", "etalab", "(?:licence ouverte )?etalab(?: 2 0)?"),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?"),
    ("rail", "responsible ai", "responsible ai licen[sc]e"),
    ("llama-community", "llama", "llama (?:2|3|3 1|3 2|4) community licen[sc]e"),
    ("gemma", "gemma terms", "gemma terms of use"),
    ("proprietary", "strictly prohibited", "unauthorized (?:copying|reproduction|distribution|use)(?: or \\S+)? of this (?:file|software|document|material) (?:\\S+ ){0,6}strictly prohibited"),
    ("proprietary", "confidential and proprietary", "(?:this (?:file|software|document) (?:is|contains) )?confidential and proprietary(?: information)?"),
    ("proprietary", "all rights reserved", "copyright (?:\\S+ ){1,10}all rights reserved"),
    ("proprietary", "trade secrets", "contains trade secrets"),
    ("non-commercial", "non commercial", "for (?:personal(?: and| or)? )?non commercial use only"),
    ("non-commercial", "noncommercial", "for noncommercial (?:use|purposes) only"),
    ("no-derivatives", "derivative works", "no derivative works (?:are )?(?:allowed|permitted)"),
    ("evaluation", "evaluation purposes", "for evaluation purposes only"),
)

#: label, versions, and the names of each keyword as regular expressions over the words of a text.
FAMILIES = (
    ("agpl", ("1 0", "3 0"), {"agpl": "agpl", "affero": "gnu affero general public licen[sc]e"}),
    ("lgpl", ("2 0", "2 1", "3 0"), {"lgpl": "lgpl", "general public": "gnu (?:lesser|library) general public licen[sc]e"}),
    ("gpl", ("1 0", "2 0", "3 0"), {"gpl": "(?:gnu )?gpl", "general public": "gnu general public licen[sc]e"}),
    ("gfdl", ("1 1", "1 2", "1 3"), {"gfdl": "gfdl", "free documentation": "gnu free documentation licen[sc]e"}),
    ("apache", ("1 0", "1 1", "2 0"), {"apache": "apache(?: software)?(?: licen[sc]e)?"}),
    ("mit", (), {"mit": "mit licen[sc]e", "expat": "expat licen[sc]e"}),
    ("bsd-2-clause", (), {"bsd": "(?:2|two) clause bsd licen[sc]e|simplified bsd licen[sc]e|bsd 2 clause"}),
    ("bsd-3-clause", (), {"bsd": "(?:3|three) clause bsd licen[sc]e|(?:new|modified) bsd licen[sc]e|bsd 3 clause"}),
    ("bsd", (), {"bsd": "bsd(?: style)? licen[sc]e"}),
    ("isc", (), {"isc": "isc licen[sc]e"}),
    ("mpl", ("1 0", "1 1", "2 0"), {"mpl": "mpl", "mozilla": "mozilla public licen[sc]e"}),
    ("epl", ("1 0", "2 0"), {"epl": "epl", "eclipse": "eclipse public licen[sc]e"}),
    ("cddl", ("1 0", "1 1"), {"cddl": "cddl", "common development": "common development and distribution licen[sc]e"}),
    ("cpl", ("0 5", "1 0"), {"common public": "common public licen[sc]e"}),
    ("eupl", ("1 0", "1 1", "1 2"), {"eupl": "eupl", "european union": "european union public licen[sc]e"}),
    ("osl", ("1 0", "2 0", "3 0"), {"osl": "osl", "open software": "open software licen[sc]e"}),
    ("afl", ("2 0", "2 1", "3 0"), {"afl": "afl", "academic free": "academic free licen[sc]e"}),
    ("artistic", ("1 0", "2 0"), {"artistic": "artistic licen[sc]e"}),
    ("bsl", ("1 0",), {"bsl": "bsl", "boost": "boost software licen[sc]e"}),
    ("zlib", (), {"zlib": "zlib(?: libpng)? licen[sc]e"}),
    ("unlicense", (), {"unlicense": "the unlicense"}),
    ("wtfpl", ("2 0",), {"wtfpl": "wtfpl", "do what the": "do what the fuck you want to public licen[sc]e"}),
    ("cc0", ("1 0",), {"cc0": "cc0", "creative commons": "creative commons zero"}),
    ("cc-by-nc-nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by nc": "cc by nc nd", "creative commons": "creative commons attribution non ?commercial no ?deriv\\w*"}),
    ("cc-by-nc-sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by nc": "cc by nc sa", "creative commons": "creative commons attribution non ?commercial share ?alike"}),
    ("cc-by-nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by nc": "cc by nc", "creative commons": "creative commons attribution non ?commercial"}),
    ("cc-by-nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by nd": "cc by nd", "creative commons": "creative commons attribution no ?deriv\\w*"}),
    ("cc-by-sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by sa": "cc by sa", "creative commons": "creative commons attribution share ?alike"}),
    ("cc-by", ("1 0", "2 0", "2 5", "3 0", "4 0"), {"cc by": "cc by", "creative commons": "creative commons attribution"}),
    ("odbl", ("1 0",), {"odbl": "odbl", "open database": "open database licen[sc]e"}),
    ("odc-by", ("1 0",), {"odc by": "odc by", "open data commons": "open data commons attribution licen[sc]e"}),
    ("ofl", ("1 0", "1 1"), {"ofl": "ofl", "open font": "(?:sil )?open font licen[sc]e"}),
    ("python", ("2 0",), {"python": "python(?: software foundation)? licen[sc]e", "psf": "psf licen[sc]e"}),
    ("php", ("3 0", "3 01"), {"php": "php licen[sc]e"}),
    ("postgresql", (), {"postgresql": "postgresql licen[sc]e"}),
    ("ms-pl", (), {"ms pl": "ms pl", "microsoft public": "microsoft public licen[sc]e"}),
    ("ms-rl", (), {"ms rl": "ms rl", "microsoft reciprocal": "microsoft reciprocal licen[sc]e"}),
    ("ncsa", (), {"ncsa": "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"}),
    ("public-domain", (), {"public domain": "public domain dedication|(?:released|placed|dedicated) (?:in|into|to) the public domain"}),
)

#: priority (0 is best), confidence, shape of a notice; {n}: a family's names, {v}: a version.
VERSIONED = (
    (0, 0.99, "spdx licen[sc]e identifier (?:{n}) {v}(?: (?:only|or later))?"),
    (0, 0.97, "(?:licen[sc]ed|released|distributed|published|available|provided) (?:under|subject to) (?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[sc]e)?(?: version| v)? {v}(?: (?:only|or later|or any later version))?"),
    (1, 0.9, "(?:{n})(?: licen[sc]e)?(?: version| v)? {v}"),
)
PLAIN = (
    (0, 0.95, "spdx licen[sc]e identifier (?:{n})"),
    (1, 0.9, "(?:licen[sc]ed|released|distributed|published|available|provided) (?:under|subject to) (?:the )?(?:terms of )?(?:the )?(?:{n})"),
    (2, 0.7, "(?:{n})"),
)


def rules() -> list[tuple[int, float, str, str, str]]:
    """(priority, confidence, label, keyword, regular expression), in order; no expression occurs twice."""
    out = [(0, 0.98, label, keyword, rx) for label, keyword, rx in SIGNATURES]
    for label, versions, named in FAMILIES:
        for keyword, names in named.items():
            for v in versions:
                tail = "?" if v.endswith(" 0") else ""
                text = f"{v[:-2]}(?: 0)?" if tail else v
                out += [(p, c, f"{label}-{v.replace(' ', '.')}", keyword, form.format(n=names, v=text)) for p, c, form in VERSIONED]
            out += [(p, c, label, keyword, form.format(n=names)) for p, c, form in PLAIN]
    return sorted(out, key=lambda r: (r[0], -r[1], r[2], r[3], r[4]))


#: Texts without any of them have no detection.
KEYWORDS = tuple(sorted({k for _, k, _ in SIGNATURES} | {k for f in FAMILIES for k in f[2]}))


def _rule_groups() -> str:
    """The rules of each keyword. A match takes the space before its first word and leaves the one after its last."""
    groups: dict[str, list[str]] = {}
    for p, c, label, key, rx in rules():
        groups.setdefault(key, []).append(f"named_struct('p', {p}, 'c', {c}D, 'l', '{label}', 'r', ' (?:{rx})(?= )')")
    return "array({})".format(", ".join(f"named_struct('k', ' {key} ', 'r', array({', '.join(rows)}))" for key, rows in groups.items())).replace("\\", "\\\\")


#: lower() instead of A-Z only: what else it changes stays above ASCII, so words keep their bounds,
#: but for the Kelvin sign, and no base phrase has a k.
_SPANS = (
    # Lengths of what lies between matches and of matches give the places of all matches of a rule.
    "transform(array(filter(zip_with(regexp_extract_all(__l_x, r.r, 0), split(__l_x, r.r, -1), (m, g) -> named_struct('m', length(m), 'g', length(g))), z -> z.m is not null)), z ->"
    f" transform(array(transform(array(transform(z, x -> x.g + x.m)), y -> {running('y')})[0]), w ->"
    " transform(z, (x, j) -> named_struct('s', get(w, j) + x.g, 'e', get(w, j) + x.g + x.m, 'p', r.p, 'l', r.l, 'c', r.c)))[0])[0]"
)
#: Sorted so that a covering interval comes first, with the furthest end so far of each priority.
_KEPT = (
    "aggregate(array_sort(__l_d, (x, y) -> case when x.s != y.s then x.s - y.s when x.e != y.e then y.e - x.e when x.p != y.p then x.p - y.p"
    " when x.l < y.l then -1 when x.l > y.l then 1 else 0 end),"
    " named_struct('a', -1, 'b', -1, 'c', -1, 'd', cast(array() as array<struct<l:string,c:double>>)),"
    " (t, d) -> named_struct('a', if(d.p = 0, greatest(t.a, d.e), t.a), 'b', if(d.p = 1, greatest(t.b, d.e), t.b), 'c', if(d.p = 2, greatest(t.c, d.e), t.c),"
    " 'd', if(d.e <= t.a or (d.p >= 1 and d.e <= t.b) or (d.p >= 2 and d.e <= t.c), t.d, array_union(t.d, array(named_struct('l', d.l, 'c', d.c))))), t -> t.d)"
)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct `__l_scan`: n_words, base places (array of start words), base_labels, found (label, confidence)."""
    starts = " or ".join("(" + " and ".join(f"get(__l_w, i + {k}) = '{w}'" if k else f"w = '{w}'" for k, w in enumerate(p.split())) + ")" for p in BASE)
    # One pass over the text, that leaves most words at their first letter.
    heads = sorted({k[0] for k in KEYWORDS})
    gate = "__l_x rlike ' (?:{})'".format("|".join(f"{h}(?:{'|'.join(k[1:] for k in KEYWORDS if k[0] == h)}) " for h in heads))
    steps = (
        {"__l_x": rf"concat(' ', btrim(regexp_replace(lower(coalesce(`{text}`, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ')), ' ')"},
        {"__l_n": "if(__l_x = '  ', 0L, cast(length(__l_x) - length(replace(__l_x, ' ', '')) - 1 as bigint))", "__l_g": gate},
        {"__l_w": "if(__l_g, split(btrim(__l_x), ' '), cast(array() as array<string>))",
         "__l_d": f"if(__l_g, flatten(transform(filter({_rule_groups()}, g -> contains(__l_x, g.k)), g -> flatten(transform(g.r, r -> {_SPANS})))), cast(array() as array<struct<s:int,e:int,p:int,l:string,c:double>>))"},
        {"__l_s": f"filter(transform(__l_w, (w, i) -> if({starts}, i, -1)), i -> i >= 0)", "__l_f": f"if(size(__l_d) = 0, cast(array() as array<struct<l:string,c:double>>), {_KEPT})"},
        {"__l_b": "array_compact(array({}))".format(", ".join(f"if(contains(__l_x, ' {p} '), '{label}', null)" for p, label in BASE.items()))},
        {"__l_scan": "named_struct('n_words', __l_n, 'starts', __l_s, 'base_labels', sort_array(array_distinct(__l_b)), 'found', __l_f)"},
    )
    for step in steps:
        docs = docs.withColumns({k: once(F.expr(v)) if k == "__l_scan" else F.expr(v) for k, v in step.items()})
    return docs.drop(*(k for s in steps[:-1] for k in s))


def digest(docs: DataFrame) -> DataFrame:
    s = "__l_scan"
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.expr(f"{s}.n_words").alias("n_words"),
        F.expr(f"cast(size({s}.starts) as bigint)").alias("n_base"),
        F.expr(f"cast(array_min({s}.starts) as bigint)").alias("first_word"),
        F.expr(f"cast(array_max({s}.starts) as bigint)").alias("last_word"),
        F.expr(f"array_join({s}.base_labels, ',')").alias("base_labels"),
        F.expr(f"array_join(sort_array(array_union({s}.base_labels, transform({s}.found, f -> f.l))), ',')").alias("labels"),
        F.expr(f"greatest(if(size({s}.starts) > 0, 0.9D, 0D), coalesce(array_max(transform({s}.found, f -> f.c)), 0D))").alias("score"),
    )
