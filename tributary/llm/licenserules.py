"""The signature rules of the license scan, in order of priority.

A line is: label; class; keywords; pattern. Patterns are over lower-cased words with one space between them; punctuation is no
word, so "Apache-2.0" reads `apache 2 0`. Every match holds one of the rule's keywords as a word. Class 1 is an identifier, a
notice or a title with its version, class 2 a clause of a license's own text, class 3 a name without a version.
"""

from __future__ import annotations

from dataclasses import dataclass

_RULES = """
mit; 1; spdx; spdx license identifier mit
apache-2.0; 1; spdx; spdx license identifier apache 2 0
gpl-2.0; 1; spdx; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later; 1; spdx; spdx license identifier gpl 2 0 or later
gpl-3.0; 1; spdx; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later; 1; spdx; spdx license identifier gpl 3 0 or later
lgpl-2.1; 1; spdx; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0; 1; spdx; spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0; 1; spdx; spdx license identifier agpl 3 0(?: only| or later)?
bsd-2-clause; 1; spdx; spdx license identifier bsd 2 clause
bsd-3-clause; 1; spdx; spdx license identifier bsd 3 clause
isc; 1; spdx; spdx license identifier isc
mpl-2.0; 1; spdx; spdx license identifier mpl 2 0
epl-2.0; 1; spdx; spdx license identifier epl 2 0
cc0-1.0; 1; spdx; spdx license identifier cc0 1 0
unlicense; 1; spdx; spdx license identifier unlicense
zlib; 1; spdx; spdx license identifier zlib
bsl-1.0; 1; spdx; spdx license identifier bsl 1 0
spdx-other; 3; spdx; spdx license identifier
gpl-1.0; 1; gnu; gnu (?:gpl|general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version| v) 1(?: 0)?
gpl-2.0-or-later; 1; gnu; gnu (?:gpl|general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later
gpl-2.0; 1; gnu; gnu (?:gpl|general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?
gpl-3.0-or-later; 1; gnu; gnu (?:gpl|general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later
gpl-3.0; 1; gnu; gnu (?:gpl|general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?
gpl-2.0; 1; gpl,gplv2,gpl2; (?:gpl (?:version )?v?2(?: 0)?|gplv2|gpl2)
gpl-2.0-or-later; 1; gpl,gplv2,gpl2; (?:gpl (?:version )?v?2(?: 0)?|gplv2|gpl2) (?:or (?:any )?later|plus)
gpl-3.0; 1; gpl,gplv3,gpl3; (?:gpl (?:version )?v?3(?: 0)?|gplv3|gpl3)
gpl-3.0-or-later; 1; gpl,gplv3,gpl3; (?:gpl (?:version )?v?3(?: 0)?|gplv3|gpl3) (?:or (?:any )?later|plus)
gpl; 2; gnu; free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 2; gnu; you should have received a copy of the gnu general public license(?: along with this (?:program|file|library|software|package))?
gpl; 2; warranty; this program comes with absolutely no warranty
gpl; 2; copyleft; gnu gpl is a free copyleft license for software and other kinds of works
gpl; 2; freedom; the licenses for most software(?: and other practical works)? are designed to take away your freedom
gpl-2.0; 1; franklin; free software foundation inc 51 franklin st(?:reet)?(?: fifth floor)? boston
gpl-2.0; 1; temple; free software foundation inc 59 temple place
lgpl-2.0; 1; gnu; gnu (?:lgpl|(?:lesser|library) general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?
lgpl-2.1; 1; gnu; gnu (?:lgpl|(?:lesser|library) general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?2 1
lgpl-3.0; 1; gnu; gnu (?:lgpl|lesser general public licen[cs]e)(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?
lgpl-2.1; 1; lgpl,lgplv2; (?:lgpl (?:version )?v?2 1|lgplv2 1)
lgpl-3.0; 1; lgpl,lgplv3,lgpl3; (?:lgpl (?:version )?v?3(?: 0)?|lgplv3|lgpl3)
lgpl; 2; gnu; terms of the gnu (?:lesser|library) general public license
lgpl; 2; gnu; you should have received a copy of the gnu (?:lesser|library) general public license
lgpl; 3; lesser,library; (?:lesser|library) general public licen[cs]e
lgpl; 3; lgpl; lgpl
agpl-1.0; 1; affero; affero general public licen[cs]e(?: version| v)? 1(?: 0)?
agpl-3.0; 1; affero; affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?
agpl-3.0; 1; agpl,agplv3,agpl3; (?:agpl (?:version )?v?3(?: 0)?|agplv3|agpl3)
agpl; 2; affero; you should have received a copy of the gnu affero general public license
agpl; 2; affero; terms of the gnu affero general public license
agpl; 3; affero; affero general public licen[cs]e
agpl; 3; agpl; agpl
gfdl-1.1; 1; documentation; gnu free documentation licen[cs]e(?: version| v)? 1 1
gfdl-1.2; 1; documentation; gnu free documentation licen[cs]e(?: version| v)? 1 2
gfdl-1.3; 1; documentation; gnu free documentation licen[cs]e(?: version| v)? 1 3
gfdl; 2; invariant; with no invariant sections no front cover texts and no back cover texts
gfdl; 3; documentation; gnu free documentation licen[cs]e
gfdl; 3; gfdl; gfdl
gpl-exception; 2; linking,classpath; (?:gpl|general public license)(?: [^ ]+){0,6} (?:linking|classpath) exception
apache-1.0; 1; apache; apache (?:software )?licen[cs]e(?: version| v)? 1 0
apache-1.1; 1; apache; apache (?:software )?licen[cs]e(?: version| v)? 1 1
apache-2.0; 1; apache; apache (?:software )?licen[cs]e(?: version)? v?2(?: 0)?
apache-2.0; 1; apache; apache v?2 0
apache-2.0; 1; asl; asl (?:version )?v?2 0
apache-2.0; 1; apache; www apache org licenses license 2 0(?: txt| html)?
apache-1.1; 1; apache; www apache org licenses license 1 1
apache-2.0; 2; apache; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; 2; warranties; distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0; 2; perpetual; hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache; 2; asf,apache; licensed to the apache software foundation(?: asf)? under one or more contributor license agreements
apache-1.1; 2; apache; this product includes software developed by the apache software foundation
mit; 1; mit; (?:the )?mit licen[cs]e mit
mit; 1; opensource; opensource org licenses mit(?: license)?(?: php| html)?
mit; 1; mit; (?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?mit licen[cs]e
mit; 2; charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 2; sublicense; to use copy modify merge publish distribute sublicense and or sell copies of the software
mit; 2; notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; 2; noninfringement; implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0; 1; mit; mit (?:no attribution|0) licen[cs]e
mit-0; 1; mit; mit 0
mit-x11; 1; x11; (?:mit x11|x11 mit) licen[cs]e
x11; 1; x11; x11 licen[cs]e
x11; 2; consortium; except as contained in this notice the name of the x consortium shall not be used in advertising
json; 2; evil; the software shall be used for good not evil
expat; 1; expat; expat licen[cs]e
isc; 1; isc; isc licen[cs]e
isc; 2; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 2; disclaims; the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software
0bsd; 1; bsd,0bsd; (?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)(?: licen[cs]e)?
bsd-1-clause; 1; bsd; (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd-2-clause; 1; bsd; (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?
bsd-2-clause; 1; bsd; (?:simplified bsd|freebsd bsd) licen[cs]e
bsd-2-clause; 1; freebsd; freebsd licen[cs]e
bsd-3-clause; 1; bsd; (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?
bsd-3-clause; 1; bsd; (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause; 1; bsd; (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?
bsd-4-clause; 1; bsd; (?:original|old) bsd licen[cs]e
bsd-3-clause; 1; opensource; opensource org licenses bsd 3 clause
bsd-2-clause; 1; opensource; opensource org licenses bsd 2 clause
bsd; 2; redistributions; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; 2; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd; 2; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; 2; endorse; neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause; 2; advertising; all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-patent; 1; bsd; bsd (?:2 clause )?plus patent
bsd; 3; bsd; bsd (?:style )?licen[cs]ed?
ncsa; 1; ncsa; (?:university of illinois )?ncsa (?:open source )?licen[cs]e
zlib; 1; zlib; zlib(?: libpng)? licen[cs]e
zlib; 2; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 2; altered; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng; 1; libpng; libpng licen[cs]e
bsl-1.0; 1; boost; boost software licen[cs]e(?: version)?(?: 1 0)?
bsl-1.0; 1; boost; www boost org license 1 0 txt
bsl-1.0; 2; boost; distributed under the boost software license
busl-1.1; 1; business; business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1.0; 1; sspl; sspl(?: v?1(?: 0)?)?
sspl-1.0; 1; server; server side public licen[cs]e
elastic-2.0; 1; elastic; elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?
mpl-1.0; 1; mozilla; mozilla public licen[cs]e(?: version)? v?1 0
mpl-1.1; 1; mozilla; mozilla public licen[cs]e(?: version)? v?1 1
mpl-2.0; 1; mozilla; mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-1.1; 1; mpl; mpl (?:version )?v?1 1
mpl-2.0; 1; mpl,mplv2; (?:mpl (?:version )?v?2 0|mplv2)
mpl-2.0; 2; mozilla; this source code form is subject to the terms of the mozilla public license
mpl-1.1; 2; contents; the contents of this file are subject to the mozilla public license
mpl; 3; mozilla; mozilla public licen[cs]e
npl-1.1; 1; netscape; netscape public licen[cs]e(?: version)?(?: 1 1)?
cddl-1.0; 1; cddl; cddl (?:version )?v?1 0
cddl-1.1; 1; cddl; cddl (?:version )?v?1 1
cddl; 3; cddl; cddl
cddl; 3; development; common development and distribution licen[cs]e
epl-1.0; 1; eclipse; eclipse public licen[cs]e(?: version)? v?1(?: 0)?
epl-2.0; 1; eclipse; eclipse public licen[cs]e(?: version)? v?2(?: 0)?
epl-1.0; 1; epl; epl (?:version )?v?1 0
epl-2.0; 1; epl; epl (?:version )?v?2 0
epl; 3; eclipse; eclipse public licen[cs]e
edl-1.0; 1; eclipse; eclipse distribution licen[cs]e(?: version)?(?: v?1(?: 0)?)?
cpl-1.0; 1; common; common public licen[cs]e(?: version)? v?1 0
ipl-1.0; 1; ibm; ibm public licen[cs]e(?: version)?(?: v?1 0)?
eupl-1.1; 1; eupl; eupl (?:version )?v?1 1
eupl-1.2; 1; eupl; eupl (?:version )?v?1 2
eupl; 3; european; european union public licen[cs]e
eupl; 3; eupl; eupl
cecill-2.1; 1; cecill; cecill (?:version )?v?2 1
cecill-b; 1; cecill; cecill b
cecill-c; 1; cecill; cecill c
cecill; 3; cecill; cecill
artistic-1.0; 1; artistic; artistic licen[cs]e(?: version)? 1 0
artistic-2.0; 1; artistic; artistic licen[cs]e(?: version)? 2 0
artistic; 3; artistic; artistic licen[cs]e
perl; 1; perl; (?:same terms as perl itself|licensed under the same terms as perl)
python-2.0; 1; python; python (?:software foundation )?licen[cs]e(?: version)?(?: 2(?: 0)?)?
php-3.01; 1; php; php licen[cs]e(?: version)? 3 01
php-3.0; 1; php; php licen[cs]e(?: version)? 3 0
ruby; 1; ruby; ruby licen[cs]e
openssl; 1; openssl; openssl licen[cs]e
openssl; 2; openssl; this product includes software developed by the openssl project
ssleay; 2; cryptographic; this product includes cryptographic software written by eric young
curl; 1; curl; curl licen[cs]e
vim; 1; vim; vim licen[cs]e
postgresql; 1; postgresql; postgresql licen[cs]e
unicode; 1; unicode; unicode (?:inc )?licen[cs]e agreement
w3c; 1; w3c; w3c (?:software (?:and document )?(?:notice and )?)?licen[cs]e
wtfpl; 1; wtfpl; wtfpl(?: version)?(?: v?2)?
wtfpl; 1; want; do what the fuck you want to public licen[cs]e
beerware; 1; beerware; beerware(?: licen[cs]e)?
beerware; 1; beer; the beer ware licen[cs]e
unlicense; 1; unlicense; (?:the )?unlicense
unlicense; 2; unencumbered; this is free and unencumbered software released into the public domain
public-domain; 1; domain; (?:dedicated|released|placed) (?:in|to|into) the public domain
public-domain; 3; domain; (?:is|are) in the public domain
afl-3.0; 1; academic; academic free licen[cs]e(?: version)?(?: v?3 0)?
osl-3.0; 1; osl; osl (?:version )?v?3 0
osl; 3; open; open software licen[cs]e
ofl-1.1; 1; sil; sil open font licen[cs]e(?: version)?(?: 1 1)?
ofl-1.1; 1; ofl; ofl (?:version )?v?1 1
ms-pl; 1; microsoft; microsoft public licen[cs]e
ms-pl; 1; ms; ms pl
ms-rl; 1; microsoft; microsoft reciprocal licen[cs]e
blueoak-1.0.0; 1; oak; blue oak model licen[cs]e(?: 1 0 0)?
mulan-psl-2.0; 1; mulan; mulan (?:psl|permissive software licen[cs]e)(?: version)?(?: v?2)?
hippocratic; 1; hippocratic; hippocratic licen[cs]e
odbl-1.0; 1; odbl; odbl(?: v?1 0)?
odbl-1.0; 1; database; open (?:data commons open )?database licen[cs]e
odc-by-1.0; 1; odc; odc by(?: 1 0)?
odc-by-1.0; 1; commons; open data commons attribution licen[cs]e
pddl-1.0; 1; pddl; pddl(?: 1 0)?
ogl-3.0; 1; government; open government licen[cs]e(?: v(?:ersion)?)?(?: v?3 0)?
cc0-1.0; 1; cc0; cc0 (?:version )?1 0(?: universal)?
cc0-1.0; 1; creativecommons; creativecommons org publicdomain zero 1 0
cc0-1.0; 1; universal; creative commons zero(?: v?1 0)? universal
cc0; 3; cc0; cc0
cc-pdm; 1; creativecommons; creativecommons org publicdomain mark 1 0
cc-by-1.0; 1; cc; cc by 1 0
cc-by-2.0; 1; cc; cc by 2 0
cc-by-2.5; 1; cc; cc by 2 5
cc-by-3.0; 1; cc; cc by 3 0
cc-by-4.0; 1; cc; cc by 4 0
cc-by-sa-2.0; 1; cc; cc by sa 2 0
cc-by-sa-2.5; 1; cc; cc by sa 2 5
cc-by-sa-3.0; 1; cc; cc by sa 3 0
cc-by-sa-4.0; 1; cc; cc by sa 4 0
cc-by-nc-3.0; 1; cc; cc by nc 3 0
cc-by-nc-4.0; 1; cc; cc by nc 4 0
cc-by-nd-3.0; 1; cc; cc by nd 3 0
cc-by-nd-4.0; 1; cc; cc by nd 4 0
cc-by-nc-sa-3.0; 1; cc; cc by nc sa 3 0
cc-by-nc-sa-4.0; 1; cc; cc by nc sa 4 0
cc-by-nc-nd-3.0; 1; cc; cc by nc nd 3 0
cc-by-nc-nd-4.0; 1; cc; cc by nc nd 4 0
cc-by-sa; 3; cc; cc by sa
cc-by-nc-sa; 3; cc; cc by nc sa
cc-by-nc-nd; 3; cc; cc by nc nd
cc-by-nc; 3; cc; cc by nc
cc-by-nd; 3; cc; cc by nd
cc-by-4.0; 1; creativecommons; creativecommons org licenses by 4 0
cc-by-3.0; 1; creativecommons; creativecommons org licenses by 3 0
cc-by-sa-4.0; 1; creativecommons; creativecommons org licenses by sa 4 0
cc-by-sa-3.0; 1; creativecommons; creativecommons org licenses by sa 3 0
cc-by-nc-4.0; 1; creativecommons; creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0; 1; creativecommons; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0; 1; creativecommons; creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0; 1; creativecommons; creativecommons org licenses by nd 4 0
cc-by-4.0; 1; attribution; creative commons attribution(?: licen[cs]e)?(?: version)? 4 0(?: international)?
cc-by-3.0; 1; attribution; creative commons attribution(?: licen[cs]e)?(?: version)? 3 0(?: unported)?
cc-by-sa-4.0; 1; attribution; creative commons attribution share ?alike(?: licen[cs]e)?(?: version)? 4 0(?: international)?
cc-by-sa-3.0; 1; attribution; creative commons attribution share ?alike(?: licen[cs]e)?(?: version)? 3 0(?: unported)?
cc-by-nc-4.0; 1; attribution; creative commons attribution non ?commercial(?: licen[cs]e)?(?: version)? 4 0(?: international)?
cc-by-nc-sa-4.0; 1; attribution; creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?(?: version)? 4 0(?: international)?
cc-by-nc-nd-4.0; 1; attribution; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?(?: version)? 4 0(?: international)?
cc-by; 3; attribution; creative commons attribution(?: licen[cs]e)?
cc; 3; creative; creative commons licen[cs]e
free-art-1.3; 1; art; free art licen[cs]e(?: 1 3)?
proprietary; 1; proprietary; (?:proprietary and confidential|confidential and proprietary)
all-rights-reserved; 3; rights; all rights reserved
copyright; 3; copyright; copyright(?: c)? (?:19|20)[0-9][0-9]
"""

#: The phrases of the base count, each with its label; none begins with a word that it ends with.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    kind: int
    keys: tuple[str, ...]
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """For words with a space on both sides, two between neighbours, so that matches share no space."""
        return " " + self.pattern.replace(" ?", "@").replace(" ", "  ").replace("@", "(?:  )?") + " "


def parsed(text: str) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        label, kind, keys, pattern = (x.strip() for x in line.split(";"))
        out.append(Rule(label, int(kind), tuple(keys.split(",")), pattern))
    return out


#: All rules in order; those of the base phrases come last. Names without a version are class 3.
RULES = parsed(_RULES) + [Rule(label, 3, (phrase.split()[0],), phrase, True) for label, phrase in BASE]
