"""Ordered licence signatures.

One rule per line: label | priority | keyword | pattern.  Patterns see the
text as lower-case words with one space between them (digits, letters and
all non-ASCII characters make words; every other character separates), so
"GPL-3.0+" reads ``gpl 3 0``.  A rule is tried only on texts that contain its
keyword as a word.  Higher priorities are more specific: a notice or an
identifier tag outranks a name, a versioned name outranks a bare one.
"""

from __future__ import annotations

import re
from typing import NamedTuple

RULES_TEXT = r"""
GPL-1.0-only | 70 | gpl | gpl (?:v|version )?1(?: 0)?(?: only)?
GPL-2.0-only | 70 | gpl | gpl (?:v|version )?2(?: 0)?(?: only)?
GPL-2.0-only | 70 | gplv2 | gplv2(?: only)?
GPL-2.0-or-later | 75 | gpl | gpl (?:v|version )?2(?: 0)? (?:or later|or any later version|plus)
GPL-3.0-only | 70 | gpl | gpl (?:v|version )?3(?: 0)?(?: only)?
GPL-3.0-only | 70 | gplv3 | gplv3(?: only)?
GPL-3.0-or-later | 75 | gpl | gpl (?:v|version )?3(?: 0)? (?:or later|or any later version|plus)
GPL-3.0-or-later | 75 | gplv3 | gplv3 or later
GPL-2.0-only | 80 | general | (?:gnu )?general public license,? (?:v|version )2(?: 0)?
GPL-3.0-only | 80 | general | (?:gnu )?general public license,? (?:v|version )3(?: 0)?
GPL-2.0-or-later | 85 | general | (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)? (?:of the license )?or (?:at your option )?any later version
GPL-3.0-or-later | 85 | general | (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)? (?:of the license )?or (?:at your option )?any later version
GPL | 50 | general | gnu general public licen[sc]e
GPL | 30 | gpl | (?:gnu )?gpl
GPL-2.0-or-later | 90 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
GPL-3.0-or-later | 90 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
GPL | 60 | received | you should have received a copy of the gnu general public license
GPL | 60 | gnu | www gnu org licenses gpl(?: [0-9] [0-9])?(?: html| txt)?
GPL-2.0-with-classpath-exception | 88 | classpath | gpl (?:v|version )?2(?: 0)? with (?:the )?classpath exception
GPL-2.0-with-classpath-exception | 85 | classpath | classpath exception 2 0
GPL-3.0-with-GCC-exception | 85 | gcc | gcc runtime library exception
LGPL-2.0-only | 70 | lgpl | lgpl (?:v|version )?2 0(?: only)?
LGPL-2.1-only | 70 | lgpl | lgpl (?:v|version )?2 1(?: only)?
LGPL-2.1-or-later | 75 | lgpl | lgpl (?:v|version )?2 1 (?:or later|plus)
LGPL-3.0-only | 70 | lgpl | lgpl (?:v|version )?3(?: 0)?(?: only)?
LGPL-3.0-or-later | 75 | lgpl | lgpl (?:v|version )?3(?: 0)? (?:or later|plus)
LGPL-3.0-only | 70 | lgplv3 | lgplv3
LGPL-2.1-only | 80 | lesser | (?:gnu )?lesser general public license (?:v|version )2 1
LGPL-3.0-only | 80 | lesser | (?:gnu )?lesser general public license (?:v|version )3(?: 0)?
LGPL-2.0-only | 80 | library | (?:gnu )?library general public license (?:v|version )2(?: 0)?
LGPL | 55 | lesser | gnu lesser general public licen[sc]e
LGPL | 55 | library | gnu library general public licen[sc]e
LGPL | 30 | lgpl | (?:gnu )?lgpl
LGPL | 60 | gnu | www gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: [0-9] [0-9])?(?: html| txt)?
AGPL-3.0-only | 70 | agpl | agpl (?:v|version )?3(?: 0)?(?: only)?
AGPL-3.0-or-later | 75 | agpl | agpl (?:v|version )?3(?: 0)? (?:or later|plus)
AGPL-3.0-only | 70 | agplv3 | agplv3
AGPL-3.0-only | 80 | affero | (?:gnu )?affero general public license (?:v|version )3(?: 0)?
AGPL-1.0-only | 80 | affero | affero general public license (?:v|version )1(?: 0)?
AGPL | 55 | affero | (?:gnu )?affero general public licen[sc]e
AGPL | 30 | agpl | (?:gnu )?agpl
GFDL-1.1 | 80 | documentation | (?:gnu )?free documentation license (?:v|version )1 1
GFDL-1.2 | 80 | documentation | (?:gnu )?free documentation license (?:v|version )1 2
GFDL-1.3 | 80 | documentation | (?:gnu )?free documentation license (?:v|version )1 3
GFDL | 50 | documentation | gnu free documentation licen[sc]e
GFDL | 30 | gfdl | (?:gnu )?gfdl
Apache-1.0 | 70 | apache | apache (?:software )?license,? (?:v|version )?1 0
Apache-1.1 | 70 | apache | apache (?:software )?license,? (?:v|version )?1 1
Apache-2.0 | 80 | apache | apache (?:software )?license,? (?:v|version )?2(?: 0)?
Apache-2.0 | 70 | apache | apache 2(?: 0)?(?: licen[sc]ed?)?
Apache-2.0 | 70 | asl | asl 2(?: 0)?
Apache-2.0 | 75 | apache | (?:www )?apache org licenses license 2 0(?: html| txt)?
Apache-2.0 | 90 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
Apache | 50 | apache | apache (?:software )?licen[sc]e
MIT | 60 | mit | mit licen[sc]e
MIT | 55 | mit | licen[sc]ed under (?:the )?(?:terms of the )?mit
MIT | 55 | expat | expat licen[sc]e
MIT | 65 | mit | opensource org licenses mit(?: license)?(?: php| html)?
MIT | 85 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
MIT-0 | 75 | attribution | mit no attribution(?: license)?
MIT-0 | 70 | mit | mit 0
MIT-Modern-Variant | 75 | modern | mit modern variant
X11 | 60 | x11 | x11 licen[sc]e
X11 | 55 | x11 | mit x11(?: license)?
0BSD | 70 | 0bsd | 0bsd
0BSD | 75 | zero | (?:bsd )?zero clause bsd(?: license)?
BSD-1-Clause | 70 | bsd | bsd 1 clause(?: license)?
BSD-2-Clause | 70 | bsd | bsd 2 clause(?: license)?
BSD-2-Clause | 70 | simplified | simplified bsd(?: license)?
BSD-2-Clause | 65 | freebsd | freebsd licen[sc]e
BSD-2-Clause-Patent | 80 | bsd | bsd 2 clause plus patent(?: license)?
BSD-2-Clause-Patent | 80 | bsd | bsd 2 clause patent
BSD-3-Clause | 70 | bsd | bsd 3 clause(?: license)?
BSD-3-Clause | 70 | bsd | (?:new|revised|modified) bsd(?: license)?
BSD-3-Clause | 70 | bsd | (?:three|3) clause bsd(?: license)?
BSD-2-Clause | 70 | bsd | (?:two|2) clause bsd(?: license)?
BSD-3-Clause-Clear | 80 | clear | (?:the )?clear bsd(?: license)?
BSD-3-Clause-Clear | 80 | clear | bsd 3 clause clear
BSD-4-Clause | 70 | bsd | bsd 4 clause(?: license)?
BSD-4-Clause | 70 | bsd | (?:original|old|four clause|4 clause) bsd(?: license)?
BSD-3-Clause | 85 | endorse | neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
BSD-4-Clause | 85 | advertising | all advertising materials mentioning features or use of this software must display
BSD | 60 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
BSD | 40 | bsd | bsd (?:style )?licen[sc]e
BSD | 65 | bsd | opensource org licenses bsd(?: license)?(?: php| html)?
ISC | 60 | isc | isc licen[sc]e
ISC | 85 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
HPND | 60 | historical | historical permission notice and disclaimer
NTP | 60 | ntp | ntp licen[sc]e
CC0-1.0 | 75 | cc0 | cc0 1 0(?: universal)?
CC0-1.0 | 60 | cc0 | cc0
CC0-1.0 | 75 | publicdomain | creativecommons org publicdomain zero 1 0
CC0-1.0 | 75 | zero | creative commons zero(?: v1 0)?(?: universal)?
PD | 40 | public | (?:released|dedicated|placed) (?:in|into|to) the public domain
PD | 30 | public | this (?:work|file|software) is in the public domain
CC-PDM-1.0 | 70 | mark | public domain mark 1 0
CC-BY-1.0 | 70 | cc | cc by 1 0
CC-BY-2.0 | 70 | cc | cc by 2 0
CC-BY-2.5 | 70 | cc | cc by 2 5
CC-BY-3.0 | 70 | cc | cc by 3 0
CC-BY-4.0 | 70 | cc | cc by 4 0
CC-BY | 40 | cc | cc by
CC-BY-SA-1.0 | 78 | sa | cc by sa 1 0
CC-BY-SA-2.0 | 78 | sa | cc by sa 2 0
CC-BY-SA-2.5 | 78 | sa | cc by sa 2 5
CC-BY-SA-3.0 | 78 | sa | cc by sa 3 0
CC-BY-SA-4.0 | 78 | sa | cc by sa 4 0
CC-BY-SA | 50 | sa | cc by sa
CC-BY-NC-2.0 | 78 | nc | cc by nc 2 0
CC-BY-NC-2.5 | 78 | nc | cc by nc 2 5
CC-BY-NC-3.0 | 78 | nc | cc by nc 3 0
CC-BY-NC-4.0 | 78 | nc | cc by nc 4 0
CC-BY-NC | 50 | nc | cc by nc
CC-BY-ND-2.0 | 78 | nd | cc by nd 2 0
CC-BY-ND-3.0 | 78 | nd | cc by nd 3 0
CC-BY-ND-4.0 | 78 | nd | cc by nd 4 0
CC-BY-ND | 50 | nd | cc by nd
CC-BY-NC-SA-2.0 | 82 | sa | cc by nc sa 2 0
CC-BY-NC-SA-3.0 | 82 | sa | cc by nc sa 3 0
CC-BY-NC-SA-4.0 | 82 | sa | cc by nc sa 4 0
CC-BY-NC-SA | 55 | sa | cc by nc sa
CC-BY-NC-ND-2.0 | 82 | nd | cc by nc nd 2 0
CC-BY-NC-ND-3.0 | 82 | nd | cc by nc nd 3 0
CC-BY-NC-ND-4.0 | 82 | nd | cc by nc nd 4 0
CC-BY-NC-ND | 55 | nd | cc by nc nd
CC-BY-4.0 | 72 | creative | creative commons attribution 4 0(?: international)?(?: (?:public )?license)?
CC-BY-3.0 | 72 | creative | creative commons attribution 3 0(?: unported)?(?: license)?
CC-BY | 45 | creative | creative commons attribution(?: license)?
CC-BY-SA-4.0 | 80 | sharealike | creative commons attribution sharealike 4 0(?: international)?(?: (?:public )?license)?
CC-BY-SA-3.0 | 80 | sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
CC-BY-SA | 55 | sharealike | creative commons attribution sharealike
CC-BY-SA | 55 | alike | creative commons attribution share alike
CC-BY-NC-4.0 | 80 | noncommercial | creative commons attribution noncommercial 4 0(?: international)?(?: (?:public )?license)?
CC-BY-NC-3.0 | 80 | noncommercial | creative commons attribution noncommercial 3 0(?: unported)?(?: license)?
CC-BY-NC | 55 | noncommercial | creative commons attribution noncommercial
CC-BY-NC | 55 | commercial | creative commons attribution non commercial
CC-BY-ND-4.0 | 80 | noderivatives | creative commons attribution noderivatives 4 0(?: international)?
CC-BY-ND | 55 | noderivatives | creative commons attribution noderivatives
CC-BY-ND | 55 | derivatives | creative commons attribution no derivatives
CC-BY-ND | 55 | noderivs | creative commons attribution noderivs
CC-BY-ND | 55 | derivs | creative commons attribution no derivs
CC-BY-NC-SA-4.0 | 84 | sharealike | creative commons attribution noncommercial sharealike 4 0(?: international)?
CC-BY-NC-SA | 58 | sharealike | creative commons attribution noncommercial sharealike
CC-BY-NC-ND-4.0 | 84 | noderivatives | creative commons attribution noncommercial noderivatives 4 0(?: international)?
CC-BY-NC-ND | 58 | noderivatives | creative commons attribution noncommercial noderivatives
CC-BY | 65 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
CC-BY-SA | 68 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
CC-BY-NC | 68 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
CC-BY-ND | 68 | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
CC-BY-NC-SA | 71 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
CC-BY-NC-ND | 71 | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
CC | 20 | creative | creative commons licen[sc]e
MPL-1.0 | 75 | mozilla | mozilla public license,? (?:v|version )?1 0
MPL-1.1 | 75 | mozilla | mozilla public license,? (?:v|version )?1 1
MPL-2.0 | 75 | mozilla | mozilla public license,? (?:v|version )?2(?: 0)?
MPL-1.0 | 70 | mpl | mpl 1 0
MPL-1.1 | 70 | mpl | mpl 1 1
MPL-2.0 | 70 | mpl | mpl 2 0
MPL-2.0 | 90 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
MPL-2.0 | 75 | mozilla | (?:www )?mozilla org mpl 2 0
MPL | 45 | mozilla | mozilla public licen[sc]e
EPL-1.0 | 75 | eclipse | eclipse public license,? (?:v|version )?1 0
EPL-2.0 | 75 | eclipse | eclipse public license,? (?:v|version )?2 0
EPL-1.0 | 70 | epl | epl 1 0
EPL-2.0 | 70 | epl | epl 2 0
EPL | 45 | eclipse | eclipse public licen[sc]e
EPL | 60 | eclipse | (?:www )?eclipse org legal epl(?: v10| v20| 2 0)?
EDL-1.0 | 70 | eclipse | eclipse distribution license(?: v| version)? 1 0
CDDL-1.0 | 75 | distribution | common development and distribution license(?: cddl)?(?: version)? 1 0
CDDL-1.1 | 75 | distribution | common development and distribution license(?: cddl)?(?: version)? 1 1
CDDL-1.0 | 70 | cddl | cddl 1 0
CDDL-1.1 | 70 | cddl | cddl 1 1
CDDL | 45 | distribution | common development and distribution licen[sc]e
CDDL | 30 | cddl | cddl
CPL-1.0 | 70 | common | common public license(?: version)? 1 0
CPL | 45 | common | common public licen[sc]e
CPAL-1.0 | 70 | attribution | common public attribution license(?: version)?(?: 1 0)?
IPL-1.0 | 70 | ibm | ibm public license(?: version)?(?: 1 0)?
EUPL-1.1 | 75 | eupl | eupl (?:v|version )?1 1
EUPL-1.2 | 75 | eupl | eupl (?:v|version )?1 2
EUPL | 45 | european | european union public licen[sc]e
EUPL | 30 | eupl | eupl
OSL-3.0 | 75 | open | open software license(?: v| version)? 3 0
OSL-2.1 | 75 | open | open software license(?: v| version)? 2 1
AFL-3.0 | 75 | academic | academic free license(?: v| version)? 3 0
AFL-2.1 | 75 | academic | academic free license(?: v| version)? 2 1
AFL | 45 | academic | academic free licen[sc]e
ECL-2.0 | 75 | educational | educational community license(?: version)? 2 0
ECL-1.0 | 75 | educational | educational community license(?: version)? 1 0
Artistic-1.0 | 75 | artistic | artistic license 1 0
Artistic-2.0 | 75 | artistic | artistic license 2 0
Artistic | 45 | artistic | artistic licen[sc]e
BSL-1.0 | 75 | boost | boost software license(?: version)?(?: 1 0)?
BSL-1.0 | 75 | boost | (?:www )?boost org license 1 0 txt
BUSL-1.1 | 75 | business | business source license(?: version)?(?: 1 1)?
SSPL-1.0 | 75 | server | server side public license(?: v| version)?(?: 1)?
Elastic-2.0 | 75 | elastic | elastic license(?: v| version)? 2 0
Unlicense | 60 | unlicense | (?:the )?unlicense
Unlicense | 85 | unencumbered | this is free and unencumbered software released into the public domain
WTFPL | 60 | wtfpl | wtfpl
WTFPL | 75 | fuck | do what the fuck you want to public license
Zlib | 60 | zlib | zlib licen[sc]e
Zlib | 85 | express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
Libpng | 60 | libpng | libpng licen[sc]e(?: version 2)?
Libpng-2.0 | 75 | png | png reference library license version 2
Python-2.0 | 70 | psf | psf license(?: version)?(?: 2)?
Python-2.0 | 70 | python | python software foundation license(?: version)?(?: 2)?
PHP-3.0 | 75 | php | php license(?: version)? 3 0
PHP-3.01 | 75 | php | php license(?: version)? 3 01
Ruby | 55 | ruby | ruby licen[sc]e
Vim | 55 | vim | vim licen[sc]e
PostgreSQL | 60 | postgresql | postgresql licen[sc]e
OpenSSL | 60 | openssl | openssl licen[sc]e
SSLeay | 60 | ssleay | (?:original )?ssleay licen[sc]e
curl | 55 | curl | curl licen[sc]e
ICU | 55 | icu | icu licen[sc]e
Unicode-3.0 | 70 | unicode | unicode license v3
Unicode-TOU | 60 | unicode | unicode terms of use
Unicode-DFS-2016 | 70 | unicode | unicode data files and software
NCSA | 70 | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
NCSA | 50 | ncsa | ncsa licen[sc]e
Sleepycat | 60 | sleepycat | sleepycat licen[sc]e
Intel | 55 | intel | intel open source licen[sc]e
MS-PL | 70 | microsoft | microsoft public licen[sc]e
MS-RL | 70 | microsoft | microsoft reciprocal licen[sc]e
MS-PL | 60 | ms | ms pl
MS-RL | 60 | ms | ms rl
APSL-2.0 | 75 | apple | apple public source license(?: version)?(?: 2 0)?
QPL-1.0 | 70 | q | q public license(?: version)?(?: 1 0)?
LPPL-1.3c | 75 | latex | latex project public license(?: version)? 1 3c?
LPPL | 50 | latex | latex project public licen[sc]e
LPPL | 30 | lppl | lppl
OFL-1.1 | 75 | sil | sil open font license(?: version)?(?: 1 1)?
OFL-1.1 | 60 | ofl | ofl 1 1
OFL-1.0 | 75 | sil | sil open font license(?: version)? 1 0
OFL | 45 | font | open font licen[sc]e
UPL-1.0 | 70 | permissive | universal permissive license(?: v| version)?(?: 1 0)?
BlueOak-1.0.0 | 70 | oak | blue oak model license(?: 1 0 0)?
MulanPSL-2.0 | 70 | mulan | mulan permissive software license(?: v| version)?(?: 2)?
MulanPSL-2.0 | 60 | mulan | mulan psl v2
W3C | 60 | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
ODbL-1.0 | 75 | database | open (?:data commons open )?database license(?: v| version)?(?: 1 0)?
ODbL-1.0 | 60 | odbl | odbl(?: 1 0)?
ODC-By-1.0 | 75 | commons | open data commons attribution license(?: v| version)?(?: 1 0)?
ODC-By-1.0 | 60 | odc | odc by(?: 1 0)?
PDDL-1.0 | 70 | pddl | pddl(?: 1 0)?
PDDL-1.0 | 75 | dedication | public domain dedication and license(?: v| version)?(?: 1 0)?
CDLA-Permissive-1.0 | 75 | cdla | cdla permissive 1 0
CDLA-Permissive-2.0 | 75 | cdla | cdla permissive 2 0
CDLA-Sharing-1.0 | 75 | cdla | cdla sharing 1 0
OGL-UK-3.0 | 75 | government | open government licen[sc]e (?:v|version )?3 0
OGL-UK | 50 | government | open government licen[sc]e
GSFDL | 40 | verbatim | verbatim copying and distribution of this entire (?:article|document) (?:is|are) permitted
OPL-1.0 | 60 | publication | open publication license(?: v| version)?(?: 1 0)?
RAIL | 50 | rail | (?:bigscience )?(?:open )?rail (?:m )?licen[sc]e
OpenRAIL-M | 60 | openrail | (?:creativeml )?openrail m
JSON | 60 | json | json licen[sc]e
JSON | 85 | evil | the software shall be used for good not evil
Beerware | 55 | beerware | beerware(?: license)?
Beerware | 85 | beer | you can buy me a beer in return
Jython | 50 | jython | jython licen[sc]e
TCL | 50 | tcl | tcl (?:tk )?licen[sc]e
Xnet | 50 | net | x net licen[sc]e
Zope-2.1 | 75 | zope | zope public license(?: zpl)?(?: v| version)?(?: 2 1)?
Zend-2.0 | 60 | zend | zend (?:engine )?license(?: version)?(?: 2 0)?
Sun-SISSL | 60 | industry | sun industry standards source licen[sc]e
Proprietary | 25 | reserved | all rights reserved
Proprietary | 35 | confidential | (?:proprietary and confidential|confidential and proprietary)
Commercial | 30 | commercial | commercial licen[sc]e
"""

#: A tag names its licence after these words.
TAG = "spdx license identifier "


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def compiled() -> list[Rule]:
    """All rules, the listed ones and an identifier-tag rule for each label, in order of priority."""
    rules, labels = [], []
    for line in RULES_TEXT.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        rules.append(Rule(label, int(priority), keyword.encode(), re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")))
        labels.append(label)
    for label in dict.fromkeys(labels):
        name = " ".join(re.findall(r"[0-9a-z]+", label.lower()))
        rules.append(Rule(label, 95, b"spdx", re.compile(b"(?<= )" + (TAG + name).encode() + b"(?= )")))
    return sorted(rules, key=lambda r: -r.priority)
