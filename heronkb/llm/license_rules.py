"""Signature rules of the license scan, in the order in which equal ones are preferred.

A rule is (label, form, keyword, pattern). Patterns match words joined by single spaces, A-Z lower-cased,
from word start to word end. ``v`` is the version, which is added to the label. The keyword is text that
every match contains; a rule runs only where it occurs.

Forms, by falling priority: ``denial`` (says that a license does not hold: gives no label, but suppresses
what lies inside), ``body`` (wording of the license itself), ``tag`` (a machine-readable identifier),
``grant`` (says that a work is under the license), ``title`` (the license's full name), ``short`` (a
short name, which counts only near a word for license).
"""

from __future__ import annotations

RULES = (
    # Denials.
    ("", "denial", "not", r"(?:is|are|was|were|be|been)? ?not (?:yet |currently |itself |being )?(?:re)?(?:licen[cs]ed|released|distributed|available|published|covered|offered) (?:to you )?(?:under|by|with|as)(?: [a-z0-9]+){1,8}? licen[cs]es?"),
    ("", "denial", "not", r"not (?:under|a|an|the|any)(?: [a-z0-9]+){1,6}? licen[cs]es?"),
    ("", "denial", "no longer", r"no longer (?:licen[cs]ed|released|distributed|available|covered) (?:under|by|with)(?: [a-z0-9]+){1,8}? licen[cs]es?"),
    ("", "denial", "never", r"never (?:been )?(?:licen[cs]ed|released|distributed|available|covered) (?:under|by|with)(?: [a-z0-9]+){1,8}? licen[cs]es?"),
    ("", "denial", "incompatible", r"incompatible with(?: [a-z0-9]+){1,8}? licen[cs]es?"),
    ("", "denial", "instead of", r"instead of(?: [a-z0-9]+){1,6}? licen[cs]es?"),
    ("", "denial", "rather than", r"rather than(?: [a-z0-9]+){1,6}? licen[cs]es?"),
    # MIT and its kin.
    ("mit", "body", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "body", "to deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "body", "shall be included in all copies", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "body", "shall the authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "body", "without restriction including", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("mit", "tag", "spdx license identifier mit", r"spdx license identifier mit"),
    ("mit-0", "tag", "spdx license identifier mit 0", r"spdx license identifier mit 0"),
    ("mit", "grant", "mit", r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:expat )?mit(?: x11)?(?: open source)? licen[cs]e"),
    ("mit", "grant", "under mit", r"(?:licen[cs]ed|released) under mit"),
    ("mit", "grant", "license mit", r"licen[cs]e mit"),
    ("mit", "title", "mit", r"(?:the )?(?:expat )?mit(?: x11| expat)?(?: open source| style)? licen[cs]e"),
    ("mit", "title", "expat license", r"(?:the )?expat license"),
    ("x11", "title", "x11 license", r"(?:the )?x11 license"),
    ("x11", "body", "name of the x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-0", "title", "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    # BSD.
    ("bsd", "body", "redistribution and use in source", r"redistribution and use in source and binary forms(?: of the software)?(?: as well as documentation)? with or without modification(?: are| is) permitted provided that the following conditions are met"),
    ("bsd", "body", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "body", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "body", "endorse or promote", r"neither the names? of (?:the )?[a-z0-9 ]{1,80}? nor the names of (?:its|their|any|the) ?contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "body", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "body", "this software is provided by", r"this software is provided by (?:the )?(?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("0bsd", "body", "permission to use copy modify and or distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "tag", "spdx license identifier bsd", r"spdx license identifier bsd (?P<v>[1234] clause)"),
    ("0bsd", "tag", "spdx license identifier 0bsd", r"spdx license identifier 0bsd"),
    ("bsd", "grant", "bsd", r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) (?:to you )?under (?:the )?(?:terms of )?(?:the |a )?(?:(?:new|modified|simplified|revised|original) )?(?:(?P<v>[1234] clause) )?bsd(?: style| type)? licen[cs]e"),
    ("bsd-3-clause", "title", "bsd", r"(?:new|modified|revised|three clause|bsd 3 clause new or revised) bsd licen[cs]e"),
    ("bsd-2-clause", "title", "bsd", r"(?:simplified|freebsd|two clause) bsd licen[cs]e"),
    ("bsd-4-clause", "title", "bsd", r"(?:original|old|four clause) bsd licen[cs]e"),
    ("bsd", "title", "bsd", r"(?P<v>[1234] clause) bsd licen[cs]e"),
    ("bsd", "title", "bsd", r"bsd (?P<v>[1234] clause)(?: licen[cs]e)?"),
    ("bsd", "title", "bsd", r"bsd(?: style| type)? licen[cs]e"),
    # ISC, zlib and other short ones.
    ("isc", "body", "with or without fee is hereby granted provided", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "body", "the author disclaims all warranties", r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", "tag", "spdx license identifier isc", r"spdx license identifier isc"),
    ("isc", "grant", "isc", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?"),
    ("isc", "title", "isc licen", r"(?:the )?isc licen[cs]e"),
    ("zlib", "body", "altered source versions must be", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "body", "the origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "body", "this software is provided as is without any", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "tag", "spdx license identifier zlib", r"spdx license identifier zlib"),
    ("zlib", "title", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("libpng", "title", "libpng", r"(?:the )?(?:png reference library|libpng) licen[cs]e"),
    ("bsl-1.0", "body", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl", "tag", "spdx license identifier bsl", r"spdx license identifier bsl (?P<v>1 0)"),
    ("bsl", "grant", "boost software license", r"(?:licen[cs]ed|released|distributed|available) under the boost software license(?: version (?P<v>1 0))?"),
    ("bsl", "title", "boost software license", r"boost software license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("unlicense", "body", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "body", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", "tag", "spdx license identifier unlicense", r"spdx license identifier unlicense"),
    ("unlicense", "title", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "body", "you just do what the", r"you just do what the [a-z]+ you want to"),
    ("wtfpl", "title", "do what the", r"do what the [a-z]+ you want to public licen[cs]e"),
    ("wtfpl", "tag", "spdx license identifier wtfpl", r"spdx license identifier wtfpl"),
    ("wtfpl", "short", "wtfpl", r"wtfpl"),
    ("beerware", "body", "you can buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("beerware", "title", "beer", r"(?:the )?beer ?ware licen[cs]e"),
    ("hpnd", "title", "historical permission notice", r"historical permission notice and disclaimer"),
    ("ntp", "title", "ntp license", r"(?:the )?ntp license"),
    ("curl", "body", "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty"),
    ("curl", "title", "curl license", r"(?:the )?curl license"),
    ("afl", "title", "academic free license", r"academic free license(?: version)?(?: (?:v ?)?(?P<v>[123] [012]))?"),
    ("afl", "tag", "spdx license identifier afl", r"spdx license identifier afl (?P<v>[123] [012])"),
    ("ecl", "title", "educational community license", r"educational community license(?: version)?(?: (?:v ?)?(?P<v>[12] 0))?"),
    ("ncsa", "title", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("ncsa", "body", "with the software without restriction", r"obtaining a copy of this software and associated documentation files to deal with the software without restriction"),
    ("ncsa", "tag", "spdx license identifier ncsa", r"spdx license identifier ncsa"),
    ("postgresql", "title", "postgresql licen", r"(?:the )?postgresql licen[cs]e"),
    ("postgresql", "tag", "spdx license identifier postgresql", r"spdx license identifier postgresql"),
    ("postgresql", "body", "university of california be liable", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("upl", "title", "universal permissive license", r"universal permissive license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("upl", "tag", "spdx license identifier upl", r"spdx license identifier upl (?P<v>1 0)"),
    ("blueoak", "title", "blue oak model license", r"blue oak model license(?: (?P<v>1 0 0))?"),
    ("blueoak", "tag", "spdx license identifier blueoak", r"spdx license identifier blueoak (?P<v>1 0 0)"),
    ("icu", "title", "icu license", r"(?:the )?icu license"),
    ("unicode", "title", "unicode", r"unicode(?: inc)? licen[cs]e(?: agreement)?"),
    ("ftl", "title", "freetype", r"(?:the )?freetype(?: project)? licen[cs]e"),
    ("ijg", "title", "independent jpeg group", r"independent jpeg group licen[cs]e"),
    # Apache.
    ("apache-2.0", "body", "licensed under the apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "body", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "body", "apache org licenses license 2 0", r"(?:http|https) (?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "body", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "body", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache", "tag", "spdx license identifier apache", r"spdx license identifier apache (?P<v>[12] [01])"),
    ("apache", "grant", "apache", r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) (?:to you )?under (?:the )?(?:terms of )?(?:the |an )?apache(?: software)?(?: public)? licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>[12](?: [01])?))?"),
    ("apache", "grant", "under apache", r"(?:licen[cs]ed|released) under apache (?P<v>2(?: 0)?)"),
    ("apache", "title", "apache", r"apache(?: software)? licen[cs]e(?: version)? (?:v ?)?(?P<v>[12](?: [01])?)"),
    ("apache", "title", "apache", r"apache (?P<v>2(?: 0)?) licen[cs]e"),
    ("apache", "title", "apache", r"apache(?: software)?(?: public)? licen[cs]e"),
    ("apache", "short", "apache 2", r"apache (?P<v>2 0)"),
    # GNU.
    ("agpl", "body", "gnu affero general public license", r"it under the terms of the gnu affero general public license as published by the free software foundation either version (?P<v>3)"),
    ("agpl", "body", "remote network interaction", r"notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("agpl", "tag", "spdx license identifier agpl", r"spdx license identifier agpl (?P<v>[13] 0)(?: only| or later)?"),
    ("agpl", "grant", "affero", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero (?:general public )?licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>[13](?: 0)?))?"),
    ("agpl", "title", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>[13](?: 0)?))?"),
    ("agpl", "title", "agpl", r"(?:gnu )?agpl ?v? ?(?P<v>3(?: 0)?)"),
    ("agpl-3", "title", "agplv3", r"(?:gnu )?agplv3"),
    ("agpl", "short", "agpl", r"agpl"),
    ("lgpl", "body", "lesser general public license as published", r"it under the terms of the gnu lesser general public license as published by the free software foundation either version (?P<v>2 1|3)"),
    ("lgpl", "body", "library general public license as published", r"it under the terms of the gnu library general public license as published by the free software foundation either version (?P<v>2)"),
    ("lgpl", "tag", "spdx license identifier lgpl", r"spdx license identifier lgpl (?P<v>2 [01]|3 0)(?: only| or later)?"),
    ("lgpl", "grant", "lesser general", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>2 1|3(?: 0)?))?"),
    ("lgpl", "title", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>2 1|3(?: 0)?))?"),
    ("lgpl", "title", "library general", r"(?:gnu )?library general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>2(?: 0)?))?"),
    ("lgpl", "title", "lgpl", r"(?:gnu )?lgpl ?v? ?(?P<v>2 [01]|3(?: 0)?)"),
    ("lgpl-3", "title", "lgplv3", r"(?:gnu )?lgplv3"),
    ("lgpl-2.1", "title", "lgplv2", r"(?:gnu )?lgplv2 1"),
    ("lgpl", "short", "lgpl", r"lgpl"),
    ("gpl", "body", "gnu general public license as published", r"it under the terms of the gnu general public license as published by the free software foundation either version (?P<v>[123])"),
    ("gpl", "body", "gnu general public license version", r"it under the terms of the gnu general public license version (?P<v>[123]) (?:only )?as published by the free software foundation"),
    ("gpl", "body", "you should have received a copy of the gnu general", r"you should have received a copy of the gnu general public license along with this (?:program|library|file|software)"),
    ("gpl", "body", "are designed to take away your freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl-3", "body", "the gnu general public license is a free copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "tag", "spdx license identifier gpl", r"spdx license identifier gpl (?P<v>[123] 0)(?: only| or later)?"),
    ("gpl", "grant", "general public", r"(?:licen[cs]ed|released|distributed|available|published|covered|provided) (?:to you )?(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>[123](?: 0)?))?"),
    ("gpl", "grant", "gpl", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: licen[cs]e)?(?: version)?(?: (?:v ?)?(?P<v>[123](?: 0)?))?"),
    ("gpl", "title", "general public", r"gnu general public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>[123](?: 0)?))?"),
    ("gpl", "title", "gpl", r"(?:gnu )?gpl(?: version)? ?v? ?(?P<v>[123](?: 0)?)"),
    ("gpl-2", "title", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3", "title", "gplv3", r"(?:gnu )?gplv3"),
    ("gpl", "short", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "body", "free documentation license version", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version (?P<v>1 [123])"),
    ("gfdl", "title", "free documentation license", r"(?:gnu )?free documentation license(?: version)?(?: (?:v ?)?(?P<v>1 [123]))?"),
    ("gfdl", "tag", "spdx license identifier gfdl", r"spdx license identifier gfdl (?P<v>1 [123])"),
    # Weak copyleft and corporate.
    ("mpl", "body", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license v (?P<v>2 0)"),
    ("mpl", "body", "mozilla public license version", r"the contents of this file are subject to the mozilla public license version (?P<v>1 [01])"),
    ("mpl", "tag", "spdx license identifier mpl", r"spdx license identifier mpl (?P<v>1 [01]|2 0)"),
    ("mpl", "grant", "mozilla public", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>1 [01]|2(?: 0)?))?"),
    ("mpl", "title", "mozilla public", r"mozilla public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>1 [01]|2(?: 0)?))?"),
    ("mpl", "short", "mpl", r"mpl(?: (?P<v>1 [01]|2 0))?"),
    ("epl", "body", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: version| v)? ?(?P<v>[12] 0)?"),
    ("epl", "tag", "spdx license identifier epl", r"spdx license identifier epl (?P<v>[12] 0)"),
    ("epl", "title", "eclipse public license", r"eclipse public license(?: version)?(?: (?:v ?)?(?P<v>[12](?: 0)?))?"),
    ("edl", "title", "eclipse distribution license", r"eclipse distribution license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("cpl", "title", "common public license", r"common public license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("cpl", "tag", "spdx license identifier cpl", r"spdx license identifier cpl (?P<v>1 0)"),
    ("ipl", "title", "ibm public license", r"ibm public license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("cddl", "body", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "tag", "spdx license identifier cddl", r"spdx license identifier cddl (?P<v>1 [01])"),
    ("cddl", "title", "common development and distribution license", r"common development and distribution license(?: cddl)?(?: version)?(?: (?:v ?)?(?P<v>1 [01]))?"),
    ("cddl", "short", "cddl", r"cddl(?: (?P<v>1 [01]))?"),
    ("eupl", "body", "european union public licence", r"licensed under the eupl(?: version)? (?P<v>1 [012])(?: only)? or as soon they will be approved by the european commission"),
    ("eupl", "tag", "spdx license identifier eupl", r"spdx license identifier eupl (?P<v>1 [012])"),
    ("eupl", "title", "european union public", r"european union public licen[cs]e(?: version)?(?: (?:v ?)?(?P<v>1 [012]))?"),
    ("eupl", "short", "eupl", r"eupl(?: (?P<v>1 [012]))?"),
    ("cecill", "body", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("cecill", "tag", "spdx license identifier cecill", r"spdx license identifier cecill (?P<v>1 [01]|2 [01])"),
    ("cecill", "title", "cecill", r"cecill(?: [bc])? (?:free software )?licen[cs]e"),
    ("artistic", "title", "artistic license", r"(?:the )?(?:perl )?artistic license(?: version)?(?: (?:v ?)?(?P<v>[12](?: 0)?))?"),
    ("artistic", "tag", "spdx license identifier artistic", r"spdx license identifier artistic (?P<v>[12] 0)"),
    ("artistic", "body", "same terms as perl", r"you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("osl", "title", "open software license", r"open software license(?: version)?(?: (?:v ?)?(?P<v>[123] [012]))?"),
    ("osl", "tag", "spdx license identifier osl", r"spdx license identifier osl (?P<v>[123] [012])"),
    ("ms-pl", "title", "microsoft public license", r"microsoft public license(?: ms pl)?"),
    ("ms-pl", "tag", "spdx license identifier ms pl", r"spdx license identifier ms pl"),
    ("ms-rl", "title", "microsoft reciprocal license", r"microsoft reciprocal license(?: ms rl)?"),
    ("ms-rl", "tag", "spdx license identifier ms rl", r"spdx license identifier ms rl"),
    ("psf", "title", "python software foundation license", r"(?:the )?python software foundation license(?: version)?(?: (?:v ?)?(?P<v>2(?: 0)?))?"),
    ("psf", "body", "between the python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("psf", "tag", "spdx license identifier psf", r"spdx license identifier psf (?P<v>2 0)"),
    ("php", "title", "php license", r"(?:the )?php license(?: version)?(?: (?:v ?)?(?P<v>3 0[01]?))?"),
    ("php", "body", "version 3 01 of the php license", r"this source file is subject to version 3 01 of the php license"),
    ("ruby", "title", "ruby license", r"(?:the )?ruby license"),
    ("ruby", "body", "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    ("openssl", "title", "openssl license", r"(?:the )?openssl license"),
    ("openssl", "body", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "title", "ssleay license", r"(?:original )?ssleay license"),
    ("ofl", "body", "sil open font license", r"this font software is licensed under the sil open font license version (?P<v>1 [01])"),
    ("ofl", "tag", "spdx license identifier ofl", r"spdx license identifier ofl (?P<v>1 [01])"),
    ("ofl", "title", "open font license", r"(?:sil )?open font license(?: version)?(?: (?:v ?)?(?P<v>1 [01]))?"),
    ("qpl", "title", "q public license", r"q public license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("sleepycat", "title", "sleepycat", r"(?:the )?sleepycat(?: software)? (?:public )?licen[cs]e"),
    ("mulan", "title", "mulan", r"mulan (?:psl|permissive software license)(?: version)?(?: v)? ?(?P<v>[12])?"),
    ("mulan-2", "body", "mulan psl v2", r"licensed under mulan psl v2"),
    ("vim", "title", "vim license", r"(?:the )?vim license"),
    ("tcl", "title", "tcl tk license", r"tcl tk license"),
    ("w3c", "title", "w3c", r"w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e"),
    ("zpl", "title", "zope public license", r"zope public license(?: version)?(?: (?:v ?)?(?P<v>[12] [01]))?"),
    ("lppl", "title", "latex project public license", r"latex project public license(?: version)?(?: (?:v ?)?(?P<v>1 [0123][abc]?))?"),
    ("lppl", "body", "conditions of the latex project", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("intel", "title", "intel open source license", r"intel open source license"),
    ("nasa", "title", "nasa open source agreement", r"nasa open source agreement(?: (?P<v>1 3))?"),
    ("apsl", "title", "apple public source license", r"apple public source license(?: version)?(?: (?:v ?)?(?P<v>[12] [01]))?"),
    ("sun", "title", "sun", r"sun (?:industry standards source|public) licen[cs]e"),
    # Source-available.
    ("busl", "title", "business source license", r"business source license(?: version)?(?: (?:v ?)?(?P<v>1 [01]))?"),
    ("busl", "body", "additional use grant", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", "tag", "spdx license identifier busl", r"spdx license identifier busl (?P<v>1 1)"),
    ("sspl", "title", "server side public license", r"server side public license(?: version)?(?: (?:v ?)?(?P<v>1))?"),
    ("sspl", "tag", "spdx license identifier sspl", r"spdx license identifier sspl (?P<v>1 0)"),
    ("elastic", "title", "elastic license", r"elastic license(?: version)?(?: (?:v ?)?(?P<v>[12](?: 0)?))?"),
    ("elastic", "body", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "title", "commons clause", r"commons clause(?: license)?(?: condition)?"),
    ("polyform", "title", "polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter|free trial|internal use) license(?: (?P<v>1 0 0))?"),
    ("fsl", "title", "functional source license", r"functional source license(?: version)?(?: (?:v ?)?(?P<v>1 [01]))?"),
    ("rail", "title", "responsible ai", r"(?:open ?rail(?: m)?|responsible ai(?: pubs| source code)?) licen[cs]es?"),
    # Data and content.
    ("odbl", "title", "open database license", r"(?:open data commons )?open database license(?: odbl)?(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("odc-by", "title", "open data commons attribution", r"open data commons attribution license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("pddl", "title", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license(?: version)?(?: (?:v ?)?(?P<v>1 0))?"),
    ("cdla", "title", "community data license agreement", r"community data license agreement (?:permissive|sharing)(?: version)?(?: (?:v ?)?(?P<v>[12] 0))?"),
    ("ogl", "title", "open government licence", r"open government licen[cs]e(?: version)?(?: ?(?:v ?)?(?P<v>[123](?: 0)?))?"),
    ("cc0", "body", "waives all copyright", r"(?:the person who associated a work with this deed|affirmer) (?:has )?(?:dedicated the work to the public domain by waiving|waives all copyright)"),
    ("cc0", "tag", "spdx license identifier cc0", r"spdx license identifier cc0 (?P<v>1 0)"),
    ("cc0", "title", "cc0", r"(?:creative commons )?cc0(?: (?P<v>1 0))?(?: universal)?"),
    ("cc0", "title", "creative commons zero", r"creative commons zero(?: licen[cs]e)?(?: ?(?:v ?)?(?P<v>1 0))?"),
    ("cc-by-nc-nd", "title", "by nc nd", r"cc by nc nd(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by-nc-sa", "title", "by nc sa", r"cc by nc sa(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by-nc", "title", "by nc", r"cc by nc(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by-nd", "title", "by nd", r"cc by nd(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by-sa", "title", "by sa", r"cc by sa(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by", "title", "cc by", r"cc by(?: licen[cs]e)?(?: (?P<v>[1234] [05]))?"),
    ("cc-by-nc-nd", "title", "creative commons attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative|ativework)?s(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "title", "creative commons attribution", r"creative commons attribution non ?commercial share ?alike(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc", "title", "creative commons attribution", r"creative commons attribution non ?commercial(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nd", "title", "creative commons attribution", r"creative commons attribution no ?deriv(?:ative|ativework)?s(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa", "title", "creative commons attribution", r"creative commons attribution share ?alike(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by", "title", "creative commons attribution", r"creative commons attribution(?: (?P<v>[1234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "body", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd (?P<v>[1234] [05])"),
    ("cc-by-nc-sa", "body", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa (?P<v>[1234] [05])"),
    ("cc-by-nc", "body", "creativecommons org licenses by nc", r"creativecommons org licenses by nc (?P<v>[1234] [05])"),
    ("cc-by-nd", "body", "creativecommons org licenses by nd", r"creativecommons org licenses by nd (?P<v>[1234] [05])"),
    ("cc-by-sa", "body", "creativecommons org licenses by sa", r"creativecommons org licenses by sa (?P<v>[1234] [05])"),
    ("cc-by", "body", "creativecommons org licenses by", r"creativecommons org licenses by (?P<v>[1234] [05])"),
    ("cc0", "body", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero (?P<v>1 0)"),
    ("cc", "title", "creative commons", r"creative commons licen[cs]e"),
    ("public-domain", "grant", "public domain", r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", "grant", "public domain", r"(?:is|are) in the public domain"),
    # Rights kept.
    ("proprietary", "body", "proprietary and confidential", r"(?:this (?:software|file|document|material) is )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "body", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "grant", "end user license agreement", r"end user license agreement"),
    ("proprietary", "title", "all rights reserved", r"all rights reserved"),
)
