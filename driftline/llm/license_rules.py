"""The signature rules of the license scan, written by hand as regexes over a text's words.

A text's words are joined by single spaces, in lower case and without punctuation, so that a rule
reads `apache license version 2 0`. A family has a label, the spellings of its name, its SPDX
identifiers, and phrases that only it uses; each yields rules by the forms below, and the order of
the forms is their priority. Further phrases, sentences of license texts and notices, are rules of
their own. Every rule carries a keyword that must stand in the text for the rule to be tried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: label, spellings of the name, SPDX identifiers, own phrases; in each the first word group is the keyword.
FAMILIES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("apache-2.0", [r"apache (?:software )?license,?(?: version)? 2(?: 0)?", r"apache 2(?: 0)? license"], ["apache 2 0"], [r"apache org licenses license 2 0"]),
    ("apache-1.1", [r"apache (?:software )?license(?: version)? 1 1"], ["apache 1 1"], []),
    ("apache-1.0", [r"apache (?:software )?license(?: version)? 1 0"], ["apache 1 0"], []),
    ("gpl-3.0", [r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?", r"gnu gpl(?: version| v)? ?3(?: 0)?", r"gplv3"],
     ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"], [r"gnu org licenses gpl 3 0"]),
    ("gpl-2.0", [r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?", r"gnu gpl(?: version| v)? ?2(?: 0)?", r"gplv2"],
     ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"], [r"gnu org licenses old licenses gpl 2 0"]),
    ("gpl-1.0", [r"gnu general public license(?: version| v) ?1(?: 0)?"], ["gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later"], []),
    ("gpl-any", [r"gnu general public license", r"gnu gpl"], [], [r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"]),
    ("lgpl-3.0", [r"gnu lesser general public license(?: version| v) ?3(?: 0)?", r"lgplv3"], ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"], [r"gnu org licenses lgpl 3 0"]),
    ("lgpl-2.1", [r"gnu lesser general public license(?: version| v) ?2 1", r"lgplv2 1"], ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"], [r"gnu org licenses old licenses lgpl 2 1"]),
    ("lgpl-2.0", [r"gnu library general public license(?: version| v)?(?: ?2(?: 0)?)?"], ["lgpl 2 0", "lgpl 2 0 only", "lgpl 2 0 or later"], []),
    ("lgpl-any", [r"gnu lesser general public license", r"gnu lgpl"], [], []),
    ("agpl-3.0", [r"gnu affero general public license(?:(?: version| v) ?3(?: 0)?)?", r"agplv3"], ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"], [r"gnu org licenses agpl"]),
    ("gfdl", [r"gnu free documentation license(?:(?: version| v) ?1 [123])?"], ["gfdl 1 1", "gfdl 1 2", "gfdl 1 3"], [r"gnu org licenses fdl"]),
    ("mit", [r"mit license", r"mit expat license", r"expat license"], ["mit"],
     [r"opensource org licenses mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("mit-0", [r"mit no attribution license"], ["mit 0"], []),
    ("x11", [r"x11 license"], ["x11"], []),
    ("bsd-3-clause", [r"(?:3|three) clause bsd license", r"(?:new|revised|modified) bsd license", r"bsd 3 clause(?: license)?"], ["bsd 3 clause"],
     [r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse"]),
    ("bsd-2-clause", [r"(?:2|two) clause bsd license", r"(?:simplified|freebsd) bsd license", r"bsd 2 clause(?: license)?"], ["bsd 2 clause"], []),
    ("bsd-4-clause", [r"(?:4|four) clause bsd license", r"original bsd license", r"bsd 4 clause(?: license)?"], ["bsd 4 clause"], [r"all advertising materials mentioning features or use of this software"]),
    ("bsd-any", [r"bsd license", r"bsd style license"], [], [r"redistribution and use in source and binary forms with or without modification are permitted"]),
    ("0bsd", [r"zero clause bsd license"], ["0bsd"], []),
    ("isc", [r"isc license"], ["isc"], [r"permission to use copy modify and or distribute this software for any purpose with or without fee"]),
    ("mpl-2.0", [r"mozilla public license(?: version| v)? ?2(?: 0)?"], ["mpl 2 0"], [r"mozilla org mpl 2 0"]),
    ("mpl-1.1", [r"mozilla public license(?: version| v)? ?1 1"], ["mpl 1 1"], []),
    ("mpl-any", [r"mozilla public license"], [], []),
    ("epl-2.0", [r"eclipse public license(?: version| v)? ?2(?: 0)?"], ["epl 2 0"], [r"eclipse org legal epl 2 0"]),
    ("epl-1.0", [r"eclipse public license(?: version| v)? ?1(?: 0)?"], ["epl 1 0"], [r"eclipse org legal epl v10"]),
    ("eupl", [r"european union public licen[cs]e(?:(?: version| v)? ?1 [0-2])?"], ["eupl 1 0", "eupl 1 1", "eupl 1 2"], []),
    ("cddl", [r"common development and distribution license(?:(?: version| v)? ?1 [01])?"], ["cddl 1 0", "cddl 1 1"], []),
    ("cpl-1.0", [r"common public license(?:(?: version| v)? ?1(?: 0)?)?"], ["cpl 1 0"], []),
    ("cecill", [r"cecill(?: [abc])? (?:free software )?license(?: agreement)?"], ["cecill 1 0", "cecill 2 0", "cecill 2 1", "cecill b", "cecill c"], []),
    ("artistic-2.0", [r"artistic license 2(?: 0)?"], ["artistic 2 0"], []),
    ("artistic-1.0", [r"artistic license(?: 1(?: 0)?)?"], ["artistic 1 0"], []),
    ("boost-1.0", [r"boost software license(?:(?: version| v)? ?1(?: 0)?)?"], ["bsl 1 0"], [r"boost org license 1 0"]),
    ("zlib", [r"zlib (?:libpng )?license"], ["zlib"], [r"altered source versions must be plainly marked as such"]),
    ("unlicense", [r"the unlicense"], ["unlicense"], [r"this is free and unencumbered software released into the public domain", r"unlicense org"]),
    ("wtfpl", [r"do what the fuck you want to public license"], ["wtfpl"], []),
    ("python-2.0", [r"python software foundation license(?: version 2)?", r"psf license"], ["python 2 0", "psf 2 0"], []),
    ("openssl", [r"openssl license"], ["openssl"], []),
    ("ms-pl", [r"microsoft public license"], ["ms pl"], []),
    ("ms-rl", [r"microsoft reciprocal license"], ["ms rl"], []),
    ("osl-3.0", [r"open software license(?:(?: version| v)? ?3(?: 0)?)?"], ["osl 3 0"], []),
    ("afl-3.0", [r"academic free license(?:(?: version| v)? ?3(?: 0)?)?"], ["afl 3 0"], []),
    ("ecl-2.0", [r"educational community license(?:(?: version| v)? ?2(?: 0)?)?"], ["ecl 2 0"], []),
    ("ncsa", [r"university of illinois ncsa open source license", r"ncsa license"], ["ncsa"], []),
    ("ofl-1.1", [r"sil open font license(?:(?: version| v)? ?1 [01])?", r"open font license(?: 1 1)?"], ["ofl 1 0", "ofl 1 1"], [r"scripts sil org ofl"]),
    ("php-3.01", [r"php license(?: version)?(?: 3 01)?"], ["php 3 01"], []),
    ("ruby", [r"ruby license"], ["ruby"], []),
    ("qpl-1.0", [r"q public license(?:(?: version| v)? ?1(?: 0)?)?"], ["qpl 1 0"], []),
    ("w3c", [r"w3c software (?:notice|license)(?: and (?:document )?license)?"], ["w3c"], []),
    ("postgresql", [r"postgresql license"], ["postgresql"], []),
    ("vim", [r"vim license"], ["vim"], []),
    ("json", [r"json license"], ["json"], [r"the software shall be used for good not evil"]),
    ("busl-1.1", [r"business source license(?: 1 1)?"], ["busl 1 1"], []),
    ("sspl-1.0", [r"server side public license(?:(?: version| v)? ?1)?"], ["sspl 1 0"], []),
    ("elastic-2.0", [r"elastic license(?: 2(?: 0)?)?"], ["elastic 2 0"], []),
    ("odbl-1.0", [r"open (?:data commons open )?database license(?: v?1 0)?"], ["odbl 1 0"], [r"opendatacommons org licenses odbl"]),
    ("odc-by-1.0", [r"open data commons attribution license"], ["odc by 1 0"], [r"opendatacommons org licenses by"]),
    ("pddl-1.0", [r"public domain dedication and license"], ["pddl 1 0"], []),
    ("cc0", [r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero"], ["cc0 1 0"], [r"creativecommons org publicdomain zero"]),
    ("cc-by-nc-nd", [r"cc by nc nd(?: [1-4] \d)?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"], ["cc by nc nd 2 0", "cc by nc nd 3 0", "cc by nc nd 4 0"], [r"creativecommons org licenses by nc nd"]),
    ("cc-by-nc-sa", [r"cc by nc sa(?: [1-4] \d)?", r"creative commons attribution non ?commercial share ?alike"], ["cc by nc sa 2 0", "cc by nc sa 3 0", "cc by nc sa 4 0"], [r"creativecommons org licenses by nc sa"]),
    ("cc-by-nc", [r"cc by nc(?: [1-4] \d)?", r"creative commons attribution non ?commercial"], ["cc by nc 2 0", "cc by nc 3 0", "cc by nc 4 0"], [r"creativecommons org licenses by nc"]),
    ("cc-by-nd", [r"cc by nd(?: [1-4] \d)?", r"creative commons attribution no ?deriv(?:ative)?s"], ["cc by nd 2 0", "cc by nd 3 0", "cc by nd 4 0"], [r"creativecommons org licenses by nd"]),
    ("cc-by-sa", [r"cc by sa(?: [1-4] \d)?", r"creative commons attribution share ?alike"], ["cc by sa 2 0", "cc by sa 3 0", "cc by sa 4 0"], [r"creativecommons org licenses by sa"]),
    ("cc-by-any", [r"cc by(?: [1-4] \d)?", r"creative commons attribution(?: [1-4] \d)?"], ["cc by 2 0", "cc by 3 0", "cc by 4 0"], [r"creativecommons org licenses by"]),
    ("proprietary", [r"proprietary (?:and confidential|license)"], [], [r"all rights reserved unauthorized copying"]),
    ("public-domain", [r"public domain dedication"], [], [r"dedicated to the public domain", r"released into the public domain"]),
]

#: Label and phrase: sentences and headings of license texts and notices, each a rule of its own.
PHRASES: list[tuple[str, str]] = [
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"dual licensed under (?:the )?(?:mit and apache|mit or apache|apache and mit|mit x11)"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract"),
    ("apache-2.0", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2.0", r"asl 2 0|apl 2 0|alv2"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl-any", r"see the gnu general public license for more details"),
    ("gpl-any", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-any", r"(?:either version \d of the license or at your option )?any later version of the gnu general public license"),
    ("gpl-any", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-any", r"distributed under (?:the )?gpl"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", r"gpl ?v? ?3(?: 0)? or (?:later|newer|greater)"),
    ("gpl-2.0", r"gpl ?v? ?2(?: 0)? or (?:later|newer|greater)"),
    ("gpl-2.0", r"gnu general public license version 2 june 1991"),
    ("gpl-2.0", r"as a special exception (?:.{1,200}? )?classpath exception|with the classpath exception"),
    ("lgpl-any", r"you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl-any", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.0", r"you should have received a copy of the gnu library general public license"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", r"interacting with it remotely through a computer network"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("bsd-any", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-any", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-any", r"this software is provided by the (?:regents|copyright holders) and contributors as is and any express or implied warranties"),
    ("bsd-any", r"in no event shall the (?:regents|copyright (?:owner|holder)s?) or contributors be liable for any direct indirect incidental special exemplary"),
    ("bsd-any", r"(?:released|distributed) under a bsd (?:style )?licen[cs]e"),
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-any", r"the initial developer of the original code is"),
    ("mpl-any", r"mpl tri license|mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-1.0", r"eclipse distribution license"),
    ("eupl", r"licensed under the eupl"),
    ("eupl", r"unless required by applicable law or agreed to in writing software distributed under the licence is distributed on an as is basis"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", r"when distributing covered code include this cddl header notice in each file"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license"),
    ("cecill", r"this software is governed by the cecill(?: [abc])? license under french law"),
    ("artistic-2.0", r"the intent is that this copyright holder maintains some artistic control over the development of that package"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-1.0", r"under the same terms as perl(?: itself)?"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", r"distributed under the boost software license"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", r"png reference library license"),
    ("libpng", r"the png reference library is supplied as is"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("beerware", r"the beer ?ware license"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("python-2.0", r"psf is making python available to licensee on an as is basis"),
    ("python-2.0", r"cnri open source license agreement|beopen com license agreement for python"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", r"reciprocal grants for any file you distribute that contains code from the software"),
    ("osl-3.0", r"licensed under the open software license version 3 0"),
    ("afl-3.0", r"licensed under the academic free license version 3 0"),
    ("ncsa", r"permission is hereby granted .{0,80}? to deal with the software without restriction"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"with reserved font name"),
    ("php-3.01", r"this product includes php software freely available from"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl|same license as ruby"),
    ("w3c", r"w3c liability trademark document use and software licensing rules apply"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", r"historical permission notice and disclaimer"),
    ("hpnd", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose is hereby granted without fee"),
    ("curl", r"curl license|copyright .{1,60}? daniel stenberg"),
    ("icu", r"unicode license(?: v3)?|icu license"),
    ("icu", r"unicode inc license agreement data files and software"),
    ("naist-2003", r"use reproduction and distribution of this software is permitted any copy of this software whether in its original form"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", r"change date .{1,60}? change license"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause(?: license)?(?: condition)?"),
    ("commons-clause", r"the license does not grant to you the right to sell the software"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|perimeter) license"),
    ("prosperity", r"prosperity public license"),
    ("parity", r"parity public license"),
    ("blueoak-1.0.0", r"blue oak model license"),
    ("mulan-2.0", r"mulan permissive software license(?: v ?2)?|mulanpsl 2 0"),
    ("ogl-uk", r"open government licence(?: v ?[123](?: 0)?)?"),
    ("ogl-uk", r"contains public sector information licensed under"),
    ("etalab", r"licence ouverte(?: open licence)?|etalab 2 0"),
    ("odbl-1.0", r"this .{1,80}? is made available under the open database license"),
    ("cdla-permissive", r"community data license agreement permissive"),
    ("cdla-sharing", r"community data license agreement sharing"),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: [ms]{1,2})?(?: license)?"),
    ("llama-community", r"llama [234](?: [123])? community license(?: agreement)?"),
    ("gemma", r"gemma terms of use"),
    ("cc0", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights"),
    ("cc0", r"no rights reserved cc0|public domain cc0"),
    ("cc-by-any", r"this work is licensed under a creative commons attribution(?: \d \d)? (?:international |unported )?license"),
    ("cc-by-sa", r"this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", r"this work is licensed under a creative commons attribution non ?commercial(?: \d \d)? (?:international |unported )?license"),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license"),
    ("cc-sampling", r"creative commons sampling plus"),
    ("proprietary", r"this (?:software|document|material) is (?:the )?(?:confidential and )?proprietary (?:information|property|to)"),
    ("proprietary", r"no part of this (?:publication|book|document) may be reproduced"),
    ("proprietary", r"end user licen[cs]e agreement"),
    ("proprietary", r"reproduction without (?:the )?(?:prior )?(?:written )?permission is (?:strictly )?prohibited"),
    ("all-rights-reserved", r"all rights reserved"),
    ("public-domain", r"this (?:work|file|software|document) is (?:hereby )?(?:placed )?in the public domain"),
    ("public-domain", r"no copyright is claimed in the united states under title 17"),
    ("freeware", r"this (?:software|program) is freeware"),
    ("shareware", r"this (?:software|program) is shareware"),
    ("non-commercial", r"for (?:personal and )?non ?commercial use only"),
    ("research-only", r"for (?:academic and )?research (?:purposes|use) only"),
]

#: Forms of a rule, by falling priority: name, pattern around {0}, confidence.
FORMS = [
    ("identifier", r"spdx license identifier {0}", 1.0),
    ("grant", r"(?:licensed|released|distributed|available|published|provided|made available|redistribute it|used) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{0}", 0.95),
    ("phrase", r"{0}", 0.9),
    ("header", r"(?:license|licence|licensing|copying) {0}", 0.8),
    ("name", r"(?:the )?{0}", 0.7),
]
PHRASE, CONFIDENCE = next((i, c) for i, (form, _, c) in enumerate(FORMS) if form == "phrase")


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: re.Pattern[bytes]


def _keyword(form: str, body: str) -> bytes:
    """The longest run of plain letters and digits that every match of the body holds."""
    if form == "identifier":
        return b"spdx"
    plain = re.sub(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\??|\[[^\]]*\]|.\?|\\.|\.\{[^}]*\}\??", "|", body)
    return max(re.split(r"[^a-z0-9]+", plain), key=len).encode()


def rules() -> list[Rule]:
    found = []
    for rank, (label, names, identifiers, phrases) in enumerate(FAMILIES):
        for priority, (form, around, confidence) in enumerate(FORMS):
            for body in {"identifier": identifiers, "phrase": phrases}.get(form, names):
                pattern = re.compile(rb"(?<= )" + around.format(body).encode() + rb"(?= )")
                found.append(Rule(label, form, priority * len(FAMILIES) + rank, confidence, _keyword(form, body), pattern))
    ranks = {label: rank for rank, (label, *_) in enumerate(FAMILIES)}
    for label, body in PHRASES:
        for part in body.split("|") if "(" not in body else [body]:
            pattern = re.compile(rb"(?<= )(?:" + part.encode() + rb")(?= )")
            found.append(Rule(label, "phrase", PHRASE * len(FAMILIES) + ranks.get(label, len(FAMILIES) - 1), CONFIDENCE, _keyword("phrase", part), pattern))
    return sorted(found, key=lambda r: r.priority)
