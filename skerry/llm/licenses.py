"""License scans with ordered signature rules.

A text is normalised once: lower-cased words joined by single blanks, so rules
need not care for punctuation, case or line breaks. Each of the hundreds of
rules names the words without which it can't match; only rules whose words all
occur in the text are run (most texts run none). The detections are then put
in order: a lower priority number wins, then the longer one, then the earlier.
A detection that lies inside the interval of one already accepted is
suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

#: Base phrases and their labels: every place counts, nothing suppresses them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label | words of every match of the name (numbers aside) | name as a pattern
#: over normalised words | identifier as normalised words.
SIGNATURES = r"""
gpl-1.0 | gnu 1 | gnu general public licen[sc]e (?:v|version )?1(?: 0)? | gpl 1 0
gpl-2.0 | gnu 2 | gnu general public licen[sc]e (?:v|version )?2(?: 0)? | gpl 2 0
gpl-3.0 | gnu 3 | gnu general public licen[sc]e (?:v|version )?3(?: 0)? | gpl 3 0
gpl-2.0 | gplv2 | (?:gnu )?gplv2 | gplv2
gpl-3.0 | gplv3 | (?:gnu )?gplv3 | gplv3
lgpl-2.0 | gnu general | gnu (?:lesser|library) general public licen[sc]e (?:v|version )?2(?: 0)? | lgpl 2 0
lgpl-2.1 | lesser 2 1 | gnu lesser general public licen[sc]e (?:v|version )?2 1 | lgpl 2 1
lgpl-3.0 | lesser 3 | gnu lesser general public licen[sc]e (?:v|version )?3(?: 0)? | lgpl 3 0
lgpl | lesser public | gnu lesser general public licen[sc]e | lgpl
agpl-3.0 | affero 3 | gnu affero general public licen[sc]e (?:v|version )?3(?: 0)? | agpl 3 0
agpl-1.0 | affero 1 | affero general public licen[sc]e (?:v|version )?1(?: 0)? | agpl 1 0
agpl | affero public | (?:gnu )?affero general public licen[sc]e | agpl
gfdl-1.1 | free documentation 1 | gnu free documentation licen[sc]e (?:v|version )?1 1 | gfdl 1 1
gfdl-1.2 | free documentation 2 | gnu free documentation licen[sc]e (?:v|version )?1 2 | gfdl 1 2
gfdl-1.3 | free documentation 3 | gnu free documentation licen[sc]e (?:v|version )?1 3 | gfdl 1 3
apache-1.0 | apache 1 | apache (?:software )?licen[sc]e (?:v|version )?1 0 | apache 1 0
apache-1.1 | apache 1 | apache (?:software )?licen[sc]e (?:v|version )?1 1 | apache 1 1
apache-2.0 | apache 2 | apache (?:software )?licen[sc]e (?:v|version )?2(?: 0)? | apache 2 0
mit | mit | (?:the )?mit (?:x11 )?licen[sc]e | mit
mit-0 | mit 0 | mit no attribution(?: licen[sc]e)? | mit 0
x11 | x11 | x11 licen[sc]e | x11
isc | isc | isc licen[sc]e | isc
bsd-1-clause | bsd 1 | (?:1|one) clause bsd licen[sc]e | bsd 1 clause
bsd-2-clause | bsd 2 | (?:2|two) clause bsd licen[sc]e | bsd 2 clause
bsd-3-clause | bsd 3 | (?:3|three) clause bsd licen[sc]e | bsd 3 clause
bsd-4-clause | bsd 4 | (?:4|four) clause bsd licen[sc]e | bsd 4 clause
bsd-new | bsd | (?:new|modified|revised) bsd licen[sc]e | bsd new
bsd-simplified | bsd | (?:simplified|freebsd) bsd licen[sc]e | bsd simplified
bsd | bsd | bsd (?:style )?licen[sc]e | bsd
0bsd | 0bsd | 0bsd licen[sc]e | 0bsd
mpl-1.0 | mozilla 1 | mozilla public licen[sc]e (?:v|version )?1 0 | mpl 1 0
mpl-1.1 | mozilla 1 | mozilla public licen[sc]e (?:v|version )?1 1 | mpl 1 1
mpl-2.0 | mozilla 2 | mozilla public licen[sc]e (?:v|version )?2(?: 0)? | mpl 2 0
epl-1.0 | eclipse 1 | eclipse public licen[sc]e (?:v|version )?1(?: 0)? | epl 1 0
epl-2.0 | eclipse 2 | eclipse public licen[sc]e (?:v|version )?2(?: 0)? | epl 2 0
edl-1.0 | eclipse 1 | eclipse distribution licen[sc]e (?:v|version )?1(?: 0)? | edl 1 0
cddl-1.0 | distribution 1 | common development and distribution licen[sc]e (?:v|version )?1 0 | cddl 1 0
cddl-1.1 | distribution 1 | common development and distribution licen[sc]e (?:v|version )?1 1 | cddl 1 1
cpl-1.0 | common 1 | common public licen[sc]e (?:v|version )?1(?: 0)? | cpl 1 0
ipl-1.0 | ibm 1 | ibm public licen[sc]e (?:v|version )?1(?: 0)? | ipl 1 0
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-zero | creative zero | creative commons zero(?: licen[sc]e)? | cc zero
cc-by-1.0 | cc by 1 | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc by 2 | cc by 2 0 | cc by 2 0
cc-by-2.5 | cc by 2 5 | cc by 2 5 | cc by 2 5
cc-by-3.0 | cc by 3 | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc by 4 | cc by 4 0 | cc by 4 0
cc-by-sa-2.0 | cc by sa 2 | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-2.5 | cc by sa 2 5 | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-3.0 | cc by sa 3 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc by sa 4 | cc by sa 4 0 | cc by sa 4 0
cc-by-nc-2.0 | cc by nc 2 | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-3.0 | cc by nc 3 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | cc by nc 4 | cc by nc 4 0 | cc by nc 4 0
cc-by-nd-3.0 | cc by nd 3 | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | cc by nd 4 | cc by nd 4 0 | cc by nd 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa 4 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-attribution | creative attribution | creative commons attribution(?: licen[sc]e)? | cc attribution
cc-attribution-sharealike | creative attribution sharealike | creative commons attribution sharealike(?: licen[sc]e)? | cc attribution sharealike
cc-attribution-noncommercial | creative attribution noncommercial | creative commons attribution noncommercial(?: licen[sc]e)? | cc attribution noncommercial
cc-attribution-noderivs | creative attribution | creative commons attribution no ?deriv(?:s|atives)(?: licen[sc]e)? | cc attribution noderivs
odbl-1.0 | open database | open (?:data commons )?(?:open )?database licen[sc]e | odbl 1 0
odc-by-1.0 | open data | open data commons attribution licen[sc]e | odc by 1 0
pddl-1.0 | domain dedication | public domain dedication and licen[sc]e | pddl 1 0
public-domain | public domain | (?:released|placed|dedicated) (?:in)?to the public domain | public domain
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl | wtfpl(?: licen[sc]e)? | wtfpl
zlib | zlib | zlib(?: libpng)? licen[sc]e | zlib
libpng | libpng | libpng licen[sc]e | libpng
bsl-1.0 | boost 1 | boost software licen[sc]e(?: (?:v|version )?1 0)? | bsl 1 0
artistic-1.0 | artistic 1 | artistic licen[sc]e (?:v|version )?1 0 | artistic 1 0
artistic-2.0 | artistic 2 | artistic licen[sc]e (?:v|version )?2 0 | artistic 2 0
python-2.0 | python | python (?:software foundation )?licen[sc]e(?: (?:v|version )?2)? | python 2 0
psf-2.0 | psf | psf licen[sc]e | psf 2 0
php-3.01 | php | php licen[sc]e(?: (?:v|version )?3 01)? | php 3 01
ruby | ruby | ruby licen[sc]e | ruby
perl | perl | same terms as perl(?: itself)? | perl
openssl | openssl | openssl licen[sc]e | openssl
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: (?:v|version )?1 1)? | ofl 1 1
eupl-1.1 | european 1 | european union public licen[sc]e (?:v|version )?1 1 | eupl 1 1
eupl-1.2 | european 2 | european union public licen[sc]e (?:v|version )?1 2 | eupl 1 2
ms-pl | microsoft public | microsoft public licen[sc]e | ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e | ms rl
osl-3.0 | open software 3 | open software licen[sc]e (?:v|version )?3 0 | osl 3 0
afl-3.0 | academic free 3 | academic free licen[sc]e (?:v|version )?3 0 | afl 3 0
ecl-2.0 | educational 2 | educational community licen[sc]e (?:v|version )?2 0 | ecl 2 0
cecill-2.1 | cecill | cecill(?: free software)? licen[sc]e(?: agreement)? | cecill 2 1
mulanpsl-2.0 | mulan | mulan psl v2 | mulanpsl 2 0
bsl-1.1 | business source | business source licen[sc]e(?: (?:v|version )?1 1)? | busl 1 1
sspl-1.0 | server side public | server side public licen[sc]e(?: (?:v|version )?1)? | sspl 1 0
elastic-2.0 | elastic | elastic licen[sc]e(?: (?:v|version )?2 0)? | elastic 2 0
llama-community | llama community | llama(?: \d)* community licen[sc]e | llama community
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)? | openrail
vim | vim | vim licen[sc]e | vim
postgresql | postgresql | postgresql licen[sc]e | postgresql
curl | curl | curl licen[sc]e | curl
"""

_GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?"

#: form | priority | confidence | pattern around the name (N) or identifier (I) | extra words.
FORMS = f"""
spdx | 1 | 0.99 | spdx license identifier I(?: only| or later)? | spdx
grant-name | 3 | 0.95 | {_GRANT}N | under
grant-id | 3 | 0.9 | {_GRANT}I(?: licen[sc]e)? | under
name | 5 | 0.8 | N(?: or (?:any )?later(?: version)?)? |
"""

#: Forms of the GNU licenses that allow later versions: label, name or identifier, then
#: priority and confidence as above. They contain, and so suppress, the plain forms.
LATER = """
gpl-1.0-or-later | gnu 1 | gnu general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?1(?: 0)? | gpl 1 0
gpl-2.0-or-later | gnu 2 | gnu general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?2(?: 0)? | gpl 2 0
gpl-3.0-or-later | gnu 3 | gnu general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?3(?: 0)? | gpl 3 0
lgpl-2.0-or-later | gnu general | gnu (?:lesser|library) general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?2(?: 0)? | lgpl 2 0
lgpl-2.1-or-later | lesser 2 1 | gnu lesser general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?2 1 | lgpl 2 1
lgpl-3.0-or-later | lesser 3 | gnu lesser general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?3(?: 0)? | lgpl 3 0
agpl-3.0-or-later | affero 3 | gnu affero general public licen[sc]e (?:as published by the free software foundation either )?(?:v|version )?3(?: 0)? | agpl 3 0
gfdl-1.2-or-later | free documentation 2 | gnu free documentation licen[sc]e (?:v|version )?1 2 | gfdl 1 2
gfdl-1.3-or-later | free documentation 3 | gnu free documentation licen[sc]e (?:v|version )?1 3 | gfdl 1 3
"""

LATER_FORMS = """
spdx-later | 0 | 0.99 | spdx license identifier I or later | spdx later
name-later | 2 | 0.95 | N or (?:at your option )?(?:\\(at your option\\) )?any later version | later
name-or-later | 2 | 0.9 | N or later(?: version)? | later
"""

#: Passages of license texts, headers, notices and exceptions: label | priority |
#: confidence | words that must occur | pattern.
NOTICES = r"""
mit | 4 | 0.95 | permission hereby granted charge | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | 0.7 | copyright permission included substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 | 4 | 0.6 | permission hereby granted deal without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
bsd | 4 | 0.9 | redistribution binary permitted | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 4 | 0.9 | neither endorse promote | neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 4 | 0.9 | advertising materials display | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 4 | 0.5 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
isc | 4 | 0.9 | permission modify distribute fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee
0bsd | 4 | 0.6 | permission modify distribute fee hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
gpl | 4 | 0.9 | redistribute foundation gnu | you can redistribute it and or modify it under the terms of the gnu
gpl | 4 | 0.7 | received gnu general | you should have received a copy of the gnu general public licen[sc]e
lgpl | 4 | 0.8 | received gnu lesser | you should have received a copy of the gnu lesser general public licen[sc]e
agpl | 4 | 0.8 | received gnu affero | you should have received a copy of the gnu affero general public licen[sc]e
gpl | 4 | 0.6 | merchantability fitness particular hope useful | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
gpl-3.0 | 4 | 0.8 | copyleft license software works | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl-2.0 | 4 | 0.8 | licenses designed freedom | the licen[sc]es for most software are designed to take away your freedom to share and change it
gpl-exception-classpath | 2 | 0.9 | classpath exception | (?:with )?(?:the )?(?:gnu )?classpath (?:linking )?exception(?: 2 0)?
gpl-exception-linking | 2 | 0.85 | linking executable independent modules | gives? you permission to link this library with independent modules to produce an executable
gpl-exception-runtime | 2 | 0.9 | gcc runtime library exception | gcc runtime library exception(?: (?:v|version )?3 1)?
gpl-exception-bison | 2 | 0.85 | bison exception | (?:with )?(?:the )?bison exception(?: 2 2)?
gpl-exception-autoconf | 2 | 0.85 | autoconf exception | (?:with )?(?:the )?autoconf exception(?: [23] 0)?
gpl-exception-font | 2 | 0.85 | font exception | (?:with )?(?:the )?font exception(?: 2 0)?
gpl-exception-syscall | 2 | 0.9 | linux syscall note | linux syscall note
llvm-exception | 2 | 0.9 | llvm | (?:with )?llvm exceptions?
apache-2.0 | 4 | 0.9 | except compliance license obtain | you may not use (?:this file|these files) except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e
apache-2.0 | 4 | 0.95 | www apache org licenses | www apache org licenses licen[sc]e 2 0
apache-2.0 | 4 | 0.8 | contributor hereby grants perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-notice | 4 | 0.6 | developed apache foundation | this product includes software developed (?:at|by) the apache software foundation
mpl-2.0 | 4 | 0.95 | source code form subject mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e(?: v(?:ersion)? ?2 0)?
mpl-1.1 | 4 | 0.85 | contents file subject mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
epl | 4 | 0.8 | accompanying materials available eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl | 4 | 0.8 | contents subject development distribution | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
unlicense | 4 | 0.95 | unencumbered released domain | this is free and unencumbered software released into the public domain
zlib | 4 | 0.9 | altered versions plainly marked | altered source versions must be plainly marked as such
zlib | 4 | 0.7 | origin misrepresented claim | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | 4 | 0.9 | permission hereby organization accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 | 4 | 0.8 | reserved font name | with reserved font names?
cc0-1.0 | 4 | 0.85 | waived copyright neighboring | has waived all copyright and related or neighboring rights
cc | 4 | 0.8 | creative corporation law firm | creative commons corporation is not a law firm and does not provide legal services
cc-by | 4 | 0.85 | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 4 | 0.9 | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 4 | 0.9 | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 4 | 0.9 | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa | 4 | 0.95 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 4 | 0.95 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0-1.0 | 4 | 0.95 | creativecommons org publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
artistic | 4 | 0.6 | artistic same terms | under the artistic licen[sc]e
ms-pl | 4 | 0.7 | microsoft limited public | microsoft limited public licen[sc]e
no-warranty | 4 | 0.5 | provided warranty | (?:the software )?is provided as is without warranty of any kind
no-warranty | 4 | 0.4 | warranties merchantability disclaimed | any express or implied warranties including but not limited to the implied warranties of merchantability
all-rights-reserved | 4 | 0.6 | rights reserved | all rights reserved
proprietary | 4 | 0.8 | proprietary confidential | proprietary and confidential
proprietary | 4 | 0.7 | unauthorized copying prohibited | unauthorized copying of this (?:file|software)(?: via any medium)? is strictly prohibited
non-commercial | 4 | 0.5 | non commercial only | for (?:personal and )?non commercial use only
copyright | 6 | 0.4 | copyright | copyright (?:c )?(?:19|20)\d\d
"""


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    needs: frozenset
    pattern: re.Pattern


def _rows(table: str):
    for line in table.strip().splitlines():
        yield [part.strip() for part in (line + " ").split(" | ")]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority."""
    found = []
    for names, forms in ((SIGNATURES, FORMS), (LATER, LATER_FORMS)):
        for at, (label, needs, name, ident) in enumerate(_rows(names)):
            for form, priority, confidence, shape, extra in _rows(forms):
                pattern = shape.replace("N", f"(?:{name})").replace("I", f"(?:{ident})")
                wanted = [w for w in needs.split() if not w.isdigit()] if "N" in shape else ident.split()
                wanted = [*wanted, *extra.split()]
                found.append(_rule(f"{label}:{form}:{at}", label, int(priority), float(confidence), wanted, pattern))
    for at, (label, priority, confidence, needs, pattern) in enumerate(_rows(NOTICES)):
        found.append(_rule(f"{label}:notice:{at}", label, int(priority), float(confidence), needs.split(), pattern))
    return tuple(sorted(found, key=lambda r: (r.priority, r.name)))


def _rule(name, label, priority, confidence, needs, pattern) -> Rule:
    compiled = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
    return Rule(name, label, priority, confidence, frozenset(w.encode() for w in needs), compiled)


@cache
def gate() -> dict[bytes, tuple[Rule, ...]]:
    """Rules by one of the words that they need (the longest)."""
    found = defaultdict(list)
    for rule in rules():
        found[max(rule.needs, key=lambda w: (len(w), w))].append(rule)
    return {k: tuple(v) for k, v in found.items()}


@cache
def _phrase_words() -> tuple[tuple[bytes, str, frozenset], ...]:
    return tuple((p.encode(), label, frozenset(p.encode().split())) for p, label in PHRASES.items())


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections ``(start, end, rule)`` without those inside a stronger one.

    The accepted intervals that no other accepted one contains are kept by
    start (and so by end), which makes each test a binary search.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for start, end, rule in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].name)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        first = at - 1 if at and starts[at - 1] == start else at
        last = first
        while last < len(starts) and ends[last] <= end:
            last += 1
        starts[first:last] = [start]
        ends[first:last] = [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def scan(text: bytes):
    """``(n_words, base places [(start word, label)], detections [(start, end, rule)])``."""
    found = common.words(text)
    present = set(found)
    phrases = [(p, label) for p, label, needs in _phrase_words() if needs <= present]
    index = gate()
    active = [r for w in present.intersection(index) for r in index[w] if r.needs <= present]
    if not phrases and not active:
        return len(found), [], []
    line = b" " + b" ".join(found) + b" "
    starts = list(accumulate((len(w) + 1 for w in found[:-1]), initial=1))
    base = []
    for phrase, label in phrases:
        padded = b" " + phrase + b" "
        at = line.find(padded)
        while at >= 0:
            base.append((bisect_right(starts, at + 1) - 1, label))
            at = line.find(padded, at + 1)
    hits = [
        (bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1), rule)
        for rule in active
        for m in rule.pattern.finditer(line)
    ]
    return len(found), sorted(base), suppressed(hits)


def scan_licenses(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Scan every whole text for license phrases and signatures.

    Adds to the columns ``carry`` (all, if None): ``n_words``; ``n_base``,
    ``first_word``, ``last_word`` (places of the base phrases); ``base_labels``
    and ``labels`` (base and rules, sorted, comma-joined); ``score`` (chance
    that some detection is right, taking rules as independent; 0.9 at least
    with a base phrase, 0 without any detection) and ``detections`` (rule,
    label, first word, end word exclusive), without suppressed ones.

    Defined cases: a null text counts as empty; long texts are scanned as a
    whole; without a base phrase ``first_word`` and ``last_word`` are null;
    repeated rows each get their own result; an empty table gives no rows;
    input columns named like an output column are left out, other names are
    free.
    """
    common.bound_batches(docs.sparkSession)
    own = common.Own(docs, carry, MADE)
    keep = own.names
    source = docs.select(*own.staged, common.named(text).alias("body"))
    detection = T.StructType(
        [
            T.StructField("rule", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    schema = T.StructType(
        [
            *common.fields(source, keep),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_base", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("detections", T.ArrayType(detection)),
        ]
    )
    return source.mapInArrow(_scan_batches(keep), schema).select(*own.restored, *MADE)


def _scan_batches(keep: list[str]):
    def run(batches):
        import pyarrow as pa

        kinds = [
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.string()),
            ("labels", pa.string()),
            ("score", pa.float64()),
            (
                "detections",
                pa.list_(
                    pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
                ),
            ),
        ]
        for batch in batches:
            rows = [_row(raw) for raw in common.as_bytes(batch.column("body"))]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *made], names=[*keep, *(name for name, _ in kinds)]
            )

    return run


def _row(raw: bytes) -> tuple:
    n, base, hits = scan(raw)
    base_labels = {label for _, label in base}
    miss = 1.0
    for _, _, rule in hits:
        miss *= 1.0 - rule.confidence
    score = max(1.0 - miss, 0.9 if base else 0.0)
    return (
        n,
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {rule.label for _, _, rule in hits})),
        score,
        [{"rule": r.name, "label": r.label, "start": s, "end": e} for s, e, r in hits],
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """License scan of all documents."""
    return scan_licenses(common.table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("detections")
