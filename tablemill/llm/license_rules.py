"""Signature rules for licence texts and mentions, as plain text in order of precedence.

One rule a line: label | keyword | regular expression. A rule is tried only on texts that hold its keyword. The
expressions are over lower-case words with one space between two words (punctuation is gone: "GPL-3.0" reads
"gpl 3 0"), and match whole words. Sections give the priority: 1 beats 2 beats 3 where one match lies within another.
"""

import re

#: Base phrases: counted by themselves, and their labels stay even where a longer match covers them.
BASE = """
mit | mit | mit license
apache | apache | apache license
gpl | general | general public license
"""

NOTICES = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | released | (is |are )?released under the( terms of the)? mit license
mit | licensed | (dual |also )?licensed under( the)?( terms of the)? mit( x11| expat)?( license| licence)?
mit | spdx | spdx license identifier mit
mit | opensource | opensource org licenses? mit( license( php)?)?
mit-0 | spdx | spdx license identifier mit 0
mit-0 | attribution | mit no attribution( license)?
apache-2.0 | apache | licensed under the apache license version 2( 0)?( the license)?
apache-2.0 | apache | apache org licenses license 2 0( txt| html)?
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-2.0 | apache | apache( software)? license version 2( 0)?
apache-1.1 | apache | apache( software)? license version 1 1
apache-1.0 | apache | apache( software)? license version 1 0
apache-2.0-llvm | exception | apache 2 0 with llvm exceptions?
gpl-1.0 | general | gnu general public license( as published by the free software foundation)?( either)? version 1( 0)?
gpl-2.0 | general | gnu general public license( as published by the free software foundation)?( either)? version 2( 0)?
gpl-3.0 | general | gnu general public license( as published by the free software foundation)?( either)? version 3( 0)?
gpl-2.0 | spdx | spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0 | spdx | spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-or-later | option | license or at your option any later version
gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | gnu | gnu org licenses gpl( [23] 0)?( html| txt| en html)?
gpl-2.0 | gnu | gnu org licenses old licenses gpl 2 0( html| txt| en html)?
gpl-3.0 | everyone | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-classpath | classpath | gpl 2 0 with classpath exception
gpl-classpath | linking | linking this library statically or dynamically with other modules is making a combined work
lgpl-2.0 | library | gnu library general public license( version 2( 0)?)?
lgpl-2.1 | lesser | gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1
lgpl-3.0 | lesser | gnu lesser general public license( as published by the free software foundation)?( either)? version 3( 0)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0( only| or later)?
lgpl | gnu | gnu org licenses lgpl( [23] [01])?( html| txt| en html)?
agpl-3.0 | affero | gnu affero general public license( as published by the free software foundation)?( either)? version 3( 0)?
agpl-3.0 | spdx | spdx license identifier agpl 3 0( only| or later)?
agpl-3.0 | gnu | gnu org licenses agpl( 3 0)?( html| txt| en html)?
fdl-1.1 | documentation | gnu free documentation license version 1 1
fdl-1.2 | documentation | gnu free documentation license version 1 2
fdl-1.3 | documentation | gnu free documentation license version 1 3
fdl | invariant | with no invariant sections no front cover texts and no back cover texts
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the( above)? copyright notice
bsd | redistributions | redistributions in binary form must reproduce the( above)? copyright notice
bsd-3-clause | endorse | neither the name of [^ ]+( [^ ]+)?( [^ ]+)?( [^ ]+)? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
mpl-1.1 | mozilla | mozilla public license version 1 1
mpl-2.0 | mozilla | mozilla public license( v| version)? 2 0
mpl-2.0 | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla | mozilla org mpl 2 0
mpl-1.1 | mozilla | mozilla org mpl mpl 1 1( html)?
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | eclipse | eclipse public license( v| version)? 1 0
epl-2.0 | eclipse | eclipse public license( v| version)? 2 0
epl-1.0 | eclipse | eclipse org legal epl v10( html)?
epl-2.0 | eclipse | eclipse org legal epl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
edl-1.0 | eclipse | eclipse distribution license( v| version)? 1 0
cddl-1.0 | common | common development and distribution license( cddl)?( version)? 1 0
cddl-1.1 | common | common development and distribution license( cddl)?( version)? 1 1
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cpl-1.0 | common | common public license( v| version)? 1 0
cpal-1.0 | attribution | common public attribution license( version)? 1 0
ipl-1.0 | ibm | ibm public license( version)? 1 0
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | spdx | spdx license identifier isc
isc | licensed | licensed under( the)?( terms of the)? isc license
zlib | origin | the origin of this software must not be misrepresented
zlib | altered | altered source versions must be plainly marked as such
zlib | spdx | spdx license identifier zlib
libpng | png | libpng license( version [12]( 0)?)?
bsl-1.0 | boost | boost software license version 1 0
bsl-1.0 | boost | boost org license 1 0 txt
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | business | business source license( version)? 1 1
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | server | server side public license( version 1| v1)?
sspl-1.0 | spdx | spdx license identifier sspl 1 0
elastic-2.0 | elastic | elastic license( version)? 2( 0)?
elastic-2.0 | spdx | spdx license identifier elastic 2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | (http |https )?unlicense org
unlicense | spdx | spdx license identifier unlicense
wtfpl | fuck | do what the fuck you want to public license( version 2)?
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | cc0 | cc0 1 0( universal)?( public domain dedication)?
cc0-1.0 | waived | has waived all copyright and related or neighboring rights to
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-1.0 | cc | cc by 1 0
cc-by-2.0 | cc | cc by 2 0
cc-by-2.5 | cc | cc by 2 5
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-4.0 | creative | creative commons attribution( license)? 4 0( international)?( license)?
cc-by-3.0 | creative | creative commons attribution( license)? 3 0( unported)?( license)?
cc-by-sa-4.0 | sharealike | creative commons attribution sharealike( license)? 4 0( international)?( license)?
cc-by-sa-3.0 | sharealike | creative commons attribution sharealike( license)? 3 0( unported)?( license)?
cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial( license)? 4 0( international)?( license)?
cc-by-nc-3.0 | noncommercial | creative commons attribution noncommercial( license)? 3 0( unported)?( license)?
cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial sharealike( license)? 4 0( international)?( license)?
cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial noderivatives( license)? 4 0( international)?( license)?
cc-by-nd-4.0 | noderivatives | creative commons attribution noderivatives( license)? 4 0( international)?( license)?
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-2.0 | creativecommons | creativecommons org licenses by 2 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
artistic-1.0 | artistic | artistic license( version)? 1 0
artistic-2.0 | artistic | artistic license( version)? 2 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
perl | perl | under the same terms as perl itself
python-2.0 | python | python software foundation license( version)?( 2( 0)?)?
python-2.0 | spdx | spdx license identifier python 2 0
php-3.01 | php | php license( version)? 3 01
ruby | ruby | under the same terms as ruby
openssl | openssl | this product includes software developed by the openssl project
openssl | spdx | spdx license identifier openssl
ncsa | ncsa | university of illinois ncsa open source license
ncsa | spdx | spdx license identifier ncsa
ofl-1.1 | sil | sil open font license( version)? 1 1
ofl-1.1 | spdx | spdx license identifier ofl 1 1
ofl-1.1 | scripts | scripts sil org ofl
eupl-1.1 | european | european union public licen[cs]e( v| version)? 1 1
eupl-1.2 | european | european union public licen[cs]e( v| version)? 1 2
eupl-1.2 | spdx | spdx license identifier eupl 1 2
osl-3.0 | open | open software license( v| version)? 3 0
afl-3.0 | academic | academic free license( v| version)? 3 0
afl-2.1 | academic | academic free license( v| version)? 2 1
odbl-1.0 | database | open database license( odbl)?( v| version)?( 1 0)?
odc-by-1.0 | commons | open data commons attribution license( v| version)?( 1 0)?
pddl-1.0 | commons | open data commons public domain dedication( and)?( license| licence)?
ogl-3.0 | government | open government licen[cs]e (v |version )?(3|v3)( 0)?
ogl-2.0 | government | open government licen[cs]e (v |version )?(2|v2)( 0)?
cecill-2.1 | cecill | cecill( free software)? license( agreement)?( version)? 2 1
cecill-b | cecill | cecill b( free software)?( license)?
cecill-c | cecill | cecill c( free software)?( license)?
ms-pl | microsoft | microsoft public license( ms pl)?
ms-rl | microsoft | microsoft reciprocal license( ms rl)?
mulan-2.0 | mulan | mulan (psl|permissive software license) (v |version )?(2|v2)
upl-1.0 | universal | universal permissive license( v| version)? 1 0
w3c | w3c | w3c software( notice and)?( document)? license
x11 | contained | except as contained in this notice the names? of the x( consortium)?
postgresql | postgresql | postgresql licen[cs]e
hpnd | historical | historical permission notice and disclaimer
beerware | beer | the beer ware license( revision 42)?
json | evil | the software shall be used for good not evil
blueoak-1.0 | oak | blue oak model license( 1 0 0)?
polyform-nc | polyform | polyform noncommercial license( 1 0 0)?
prosperity | prosperity | prosperity public license( 3 0 0)?
commons-clause | clause | commons clause license condition( v| version)?( 1 0)?
openrail | rail | (creativeml |bigscience )?(openrail|open rail)( plus plus)?( m)?( license)?
llama | llama | llama [23]( [123])? community license( agreement)?
gemma | gemma | gemma terms of use
"""

NAMES = """
apache-2.0 | apache | apache (license )?2( 0)?
apache | asl | asl 2 0
mit | mit | (the )?mit( style| like)? licen[cs]ed?
mit | expat | expat licen[cs]e
gpl | gpl | gnu gpl
gpl-2.0 | gpl | gpl( v| version)? 2( 0)?( or later| only)?
gpl-3.0 | gpl | gpl( v| version)? 3( 0)?( or later| only)?
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
lgpl | lgpl | (gnu )?lgpl( v| version)?( [23]( [01])?)?( or later| only)?
lgpl | lesser | lesser general public license
lgpl-2.1 | lgplv2 | lgplv2( 1)?
lgpl-3.0 | lgplv3 | lgplv3
agpl | agpl | (gnu )?agpl( v| version)?( 3( 0)?)?( or later| only)?
agpl | affero | affero general public license
agpl-3.0 | agplv3 | agplv3
fdl | gfdl | gfdl
fdl | documentation | free documentation license
bsd-3-clause | bsd | (bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( license| licence)?
bsd-2-clause | bsd | (bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( license| licence)
bsd-4-clause | bsd | (bsd 4 clause|4 clause bsd|original bsd)( license| licence)?
bsd | bsd | bsd( style| like)? licen[cs]ed?
mpl | mpl | mpl( v| version)? [12]( [01])?
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
cddl | cddl | cddl( v| version)?( 1( [01])?)?
isc | isc | isc licen[cs]ed?
zlib | zlib | zlib( libpng)? licen[cs]e
boost | boost | boost( software)? licen[cs]e
unlicense | unlicense | (the )?unlicense
cc0 | cc0 | cc0( licen[cs]ed?)?
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-sa | cc | cc by sa
cc-by | cc | cc by
creative-commons | creative | creative commons( attribution)?( licen[cs]ed?)?
creative-commons | creativecommons | creativecommons org( licenses)?
artistic | artistic | artistic licen[cs]e
ofl | font | open font licen[cs]e
psf | psf | psf licen[cs]e
eupl | eupl | eupl( v| version)?( 1( [12])?)?
osl | osl | osl 3 0
ms-pl | ms | ms pl
odbl | odbl | odbl
ogl | government | open government licen[cs]e
wtfpl | wtfpl | wtfpl
sspl | sspl | sspl
gpl-compatible | gpl | gpl compatible
copyleft | copyleft | copyleft
public-domain | domain | (released into|placed in|dedicated to|in) the public domain
public-domain | domain | public domain( dedication)?
"""

HINTS = """
proprietary | reserved | all rights reserved
proprietary | confidential | (proprietary and confidential|confidential and proprietary)
proprietary | proprietary | proprietary licen[cs]e
proprietary | agreement | end user licen[cs]e agreement
proprietary | eula | eula
proprietary | unauthorized | unauthorized copying of this (file|document|work)
commercial | commercial | commercial licen[cs]e
non-commercial | commercial | for non commercial use only
research-only | research | for research (purposes|use) only
open-source | source | open source licen[cs]e
free-software | software | free software licen[cs]e
spdx-other | spdx | spdx license identifier [^ ]+
licensed | licensed | (is |are )?licensed under( the)?( terms of)?
licence-file | license | see( the)? license( file)?
licence-file | copying | see( the)? copying( file)?
copyright | copyright | copyright( c)? (19|20)[0-9][0-9]
"""


def _rules(text: str, priority: int, base: bool = False) -> list[tuple[str, str, str, int, bool]]:
    rows = [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]
    return [(label, keyword, pattern, priority, base) for label, keyword, pattern in rows]


def words_pattern(pattern: str) -> str:
    """The expression over text in which each word has a space of its own on either side, so that matches are whole words."""
    out, depth = [], 0
    for c in pattern:
        depth += (c == "[") - (c == "]")
        out.append("  " if c == " " and not depth else c)
    return f" {''.join(out)} "


def always_holds(pattern: str, stem: str) -> bool:
    """Whether stem is in all that the expression matches, in whichever alternative; False where that can't be told."""
    left = re.sub(r"\[[^]]*\][?*+]?|[^()|][?*]", "\0", re.sub(r"\)[?*]", ")~", pattern))
    while (inner := re.sub(r"\(([^()]*)\)(~?)", lambda m: stem if not m[2] and all(stem in x for x in m[1].split("|")) else "\0", left)) != left:
        left = inner
    return all(stem in x for x in left.split("|"))


#: (rule_id, label, keyword, pattern, priority, is_base)
RULES = [
    (k, label, keyword, words_pattern(pattern), priority, base)
    for k, (label, keyword, pattern, priority, base) in enumerate([*_rules(BASE, 2, True), *_rules(NOTICES, 1), *_rules(NAMES, 2), *_rules(HINTS, 3)])
]
KEYWORDS = sorted({r[2] for r in RULES})
#: Most rules need this word stem; texts without it are searched only for the keywords of the other rules.
STEM = "licen"
OTHER_KEYWORDS = sorted({r[2] for r in RULES if not always_holds(r[3], STEM)})
