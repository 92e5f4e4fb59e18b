"""License scan by ordered signature rules.

Some hundreds of hand-written signatures of license texts, notices, SPDX tags and names make regular
expressions. A rule runs only where its keywords occur. Overlapping detections are resolved by
priority: one that lies inside an accepted detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import LOWER, buffers, byte_class, per_row, slices, spans

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
GAP = rb"[\x00-/:-`{-\x7f]+"
NO_WORD_BEFORE, NO_WORD_AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"

#: Phrases that are reported wherever their words stand in a row.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: How a rule is written: words in a row, with anything but words between them; ``(a|b)`` is one of
#: several words, ``a?`` a word that may be missing, ``...`` up to four words of any kind.
#: Signatures of license texts, by label.
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0: permission is hereby granted free of charge to any person ... copy of this software ... to deal in the software without restriction ... provided as is
x11: except as contained in this notice the name of ... shall not be used in advertising or otherwise to promote the sale
bsd: redistribution and use in source and binary forms with or without modification are permitted provided that
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause: neither the (name|names) of ... nor the names of its contributors may be used to endorse or promote products
bsd-3-clause: the (name|names) of the? (author|authors|contributors|copyright) ... may not be used to endorse or promote products
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement
isc: permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted the software is provided
ntp: permission to use copy modify and distribute this software and its documentation for any purpose ... is hereby granted without fee
historical-permission: permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng: the contributing authors and group 42 inc disclaim all warranties expressed or implied
boost: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
apache-2: subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive
apache-2: you may obtain a copy of the license at http www apache org licenses license 2 0
apache-1: this product includes software developed by the apache (group|software)
gpl: you should have received a copy of the gnu general public license along with this
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2: it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-2: it under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3: it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-3: the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3: gnu general public license version 3 29 june 2007
gpl-2: gnu general public license version 2 june 1991
gpl-1: gnu general public license version 1 february 1989
lgpl-2: gnu library general public license version 2 june 1991
lgpl-2.1: gnu lesser general public license version 2 1 february 1999
lgpl-3: gnu lesser general public license version 3 29 june 2007
lgpl-2.1: under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3: under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2: under the terms of the gnu library general public license as published by the free software foundation
lgpl: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3: gnu affero general public license version 3 19 november 2007
agpl-3: under the terms of the gnu affero general public license as published by the free software foundation
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1: the contents of this file are subject to the mozilla public license version 1
mpl-2: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2: if a copy of the mpl was not distributed with this file you can obtain one at
epl-1: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2: this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1: the accompanying program is provided under the terms of this eclipse public license
cpl-1: the accompanying program is provided under the terms of this common public license
ipl-1: the accompanying program is provided under the terms of this ibm public license
cddl: the contents of this file are subject to the terms of the common development and distribution license
artistic-1: the intent of this document is to state the conditions under which a package may be copied
artistic-2: this license establishes the terms under which a given free software package may be copied modified distributed
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
wtfpl: do what the fuck you want to public license
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
cc0: the person who associated a work with this deed has dedicated the work to the public domain
cc0: to the extent possible under law ... has waived all copyright and related or neighboring rights
cc0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc: the work as defined below is provided under the terms of this creative commons public license
cc: by exercising the licensed rights defined below you accept and agree to be bound by the terms
odbl: the open database license odbl is a license agreement intended to allow users to freely share modify and use
odc-by: you are free to share create and adapt ... as long as you attribute any public use of the database
ofl: this font software is licensed under the sil open font license
ofl: the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
python: psf is making python available to licensee on an as is basis
python: this license agreement is between the python software foundation
php: redistribution and use ... the php license ... products derived from this software may not be called php
ruby: you may make and give away verbatim copies of the source form of the software without restriction
vim: there are no restrictions on distributing unmodified copies of vim
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c: by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
ncsa: neither the names of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
mulan: software is distributed under mulan psl v2
ms-pl: a contribution is the original software or any additions or changes to the software
ms-rl: for any file you distribute that contains code from the software ... you must provide recipients the source code
eupl: licensed under the eupl version
cecill: ce logiciel est regi par la licence cecill
cecill: this software is governed by the cecill license under french law
qpl: you may distribute the software in object code form ... under the terms of the qpl
jpl: the end user understands that the program was developed for research purposes
llama: a copy of the llama community license agreement
openrail: use based restrictions ... you can use the model subject to this license
proprietary: unauthori(z|s)ed copying of this file via any medium is strictly prohibited
proprietary: this software contains confidential and proprietary information
proprietary: no part of this (publication|document|work) may be reproduced (stored|distributed|or)
"""
#: Notices and references that say which license holds.
NOTICES = """
mit: (licensed|released|distributed|available|published|provided|covered) under the? terms? of? the? (mit|expat|x11) licen(s|c)e
mit: (mit|expat) licen(s|c)e ... for details
mit: use of this source code is governed by an mit style license
bsd: use of this source code is governed by a bsd style license
bsd: (licensed|released|distributed|available) under the? terms? of? the? bsd licen(s|c)e
bsd-2-clause: (licensed|released|distributed|available) under the? (2|two) clause bsd licen(s|c)e
bsd-3-clause: (licensed|released|distributed|available) under the? (3|three) clause bsd licen(s|c)e
bsd-2-clause: (simplified|freebsd) bsd? licen(s|c)e
bsd-3-clause: (new|modified|revised) bsd licen(s|c)e
bsd-4-clause: (original|old|four|4) clause? bsd licen(s|c)e
isc: (licensed|released|distributed|available) under the? isc licen(s|c)e
zlib: (licensed|released|distributed|available) under the? (zlib|zlib libpng) licen(s|c)e
boost: distributed under the boost software license version 1
apache-2: licensed under the apache license version 2
apache-2: (licensed|released|distributed|available) under the? terms? of? the? apache (license|licence|software) ... 2
apache-2: (licensed|released|distributed|available) under the? apache 2
apache-1: (licensed|released|distributed|available) under the? apache (license|licence|software) ... 1
apache: (licensed|released|distributed|available) under the? terms? of? the? apache licen(s|c)e
gpl-2: (licensed|released|distributed|available) under the? terms? of? the? (gnu|gpl) ... (v2|2|gplv2)
gpl-3: (licensed|released|distributed|available) under the? terms? of? the? (gnu|gpl) ... (v3|3|gplv3)
gpl: (licensed|released|distributed|available) under the? terms? of? the? gnu? (gpl|general) public? licen(s|c)e?
lgpl: (licensed|released|distributed|available) under the? terms? of? the? gnu? (lgpl|lesser|library) general? public? licen(s|c)e?
agpl: (licensed|released|distributed|available) under the? terms? of? the? gnu? (agpl|affero) general? public? licen(s|c)e?
gpl: this program is free software you can redistribute it and or modify it
lgpl: this library is free software you can redistribute it and or modify it
gpl: alternatively this software may be distributed under the terms of the gnu general public license
gpl-2-only: this file is licensed under the gpl v2 only
gfdl: (licensed|released|available) under the? terms? of? the? gnu free documentation license
mpl: (licensed|released|distributed|available|subject) (under|to) the? terms? of? the? (mozilla|mpl) public? licen(s|c)e?
epl: (licensed|released|distributed|available) under the? terms? of? the? eclipse public license
cddl: (licensed|released|distributed|available) under the? terms? of? the? (cddl|common) development? and? distribution? license?
artistic: (licensed|released|distributed|available) under the? (same|perl|clarified)? terms? as? perl? artistic licen(s|c)e
perl: same terms as perl (5|itself)
ruby: same terms as ruby
python: licensed to psf under a contributor agreement
python: (licensed|released|distributed) under the? (psf|python) software? foundation? licen(s|c)e
php: this source file is subject to version 3 01? of the php license
public-domain: (placed|released|dedicated|is|are) (in|into|to) the public domain
public-domain: no copyright is claimed
public-domain: this (code|file|work|software|text|document) is in the public domain
unlicense: (licensed|released|available) under the? unlicense
wtfpl: (licensed|released|available) under the? wtfpl
cc0: (licensed|released|available|dedicated) (under|with|to|by) the? (cc0|cc) zero? (1|universal|license|licence)
cc0: creative commons (zero|0|cc0) (1|universal|license|licence|public|v1)
cc-by: (licensed|released|available|distributed|published) under a? the? creative commons attribution (4|3|2|license|licence|international|unported|generic)
cc-by-sa: (licensed|released|available|distributed|published) under a? the? creative commons attribution share alike
cc-by-sa: text is available under the creative commons attribution sharealike license
cc-by-nc: (licensed|released|available|distributed|published) under a? the? creative commons attribution non commercial
cc-by-nc: (licensed|released|available|distributed|published) under a? the? creative commons attribution noncommercial
cc-by-nd: (licensed|released|available|distributed|published) under a? the? creative commons attribution no derivatives
cc-by-nd: (licensed|released|available|distributed|published) under a? the? creative commons attribution (noderivatives|noderivs)
cc-by-nc-sa: creative commons attribution (noncommercial|non) commercial? (sharealike|share) alike?
cc-by-nc-nd: creative commons attribution (noncommercial|non) commercial? (noderivatives|noderivs|no) (derivatives|derivs)?
cc: some rights reserved
cc: (licensed|released|available|distributed|published) under a? the? creative commons licen(s|c)e
cc-by: creativecommons org licenses by (1|2|3|4)
cc-by-sa: creativecommons org licenses by sa
cc-by-nc: creativecommons org licenses by nc (1|2|3|4)
cc-by-nd: creativecommons org licenses by nd
cc-by-nc-sa: creativecommons org licenses by nc sa
cc-by-nc-nd: creativecommons org licenses by nc nd
cc0: creativecommons org publicdomain zero
public-domain: creativecommons org publicdomain mark
mit: opensource org licenses mit
bsd-3-clause: opensource org licenses bsd 3 clause
bsd-2-clause: opensource org licenses bsd 2 clause
isc: opensource org licenses isc
apache-2: apache org licenses license 2
gpl-3: gnu org licenses gpl 3
gpl-2: gnu org licenses gpl 2
gpl: gnu org licenses gpl
lgpl: gnu org licenses lgpl
agpl: gnu org licenses agpl
gfdl: gnu org licenses fdl
mpl-2: mozilla org mpl 2
epl-2: eclipse org legal epl 2
unlicense: unlicense org
wtfpl: wtfpl net
ofl: scripts sil org ofl
odbl: opendatacommons org licenses odbl
odc-by: opendatacommons org licenses by
pddl: opendatacommons org licenses pddl
odbl: (licensed|released|available) under the? open database license
odc-by: (licensed|released|available) under the? open data commons attribution
pddl: open data commons public domain dedication
ogl: contains public sector information licensed under the open government licence
ogl: (licensed|available) under the? open government licen(s|c)e
eupl: (licensed|released|available) under the? european union public licen(s|c)e
openrail: (licensed|released|available) under the? (bigscience|creativeml|bigcode) ... openrail
llama: (llama|meta) ... community licen(s|c)e
gemma: (gemma|google) terms of use ... gemma
sspl: (licensed|released|available) under the? server side public license
bsl: (licensed|released|available) under the? business source license
elastic: (licensed|released|available) under the? elastic license
commons-clause: the commons clause license condition
proprietary: all rights reserved
proprietary: all rights reserved no part of this
proprietary: for internal use only
proprietary: not for redistribution
proprietary: (confidential|proprietary) and (confidential|proprietary)
proprietary: unpublished proprietary source code
non-commercial: for (non|academic|personal) commercial? use only
non-commercial: (noncommercial|academic|research|educational) (use|purposes) only
"""
#: SPDX identifiers, read after the tag that announces them; by label.
SPDX = """
mit: mit
mit-0: mit 0
isc: isc
0bsd: 0bsd
x11: x11
bsd-2-clause: bsd 2 clause
bsd-3-clause: bsd 3 clause
bsd-4-clause: bsd 4 clause
zlib: zlib
libpng: libpng 2
boost: bsl 1 0
bsl: busl 1 1
apache-2: apache 2 0
apache-1: apache 1 (0|1)
gpl-2: gpl 2 0
gpl-3: gpl 3 0
lgpl-2: lgpl 2 0
lgpl-2.1: lgpl 2 1
lgpl-3: lgpl 3 0
agpl-3: agpl 3 0
gfdl: gfdl 1 (1|2|3)
mpl-1.1: mpl 1 1
mpl-2: mpl 2 0
epl-1: epl 1 0
epl-2: epl 2 0
cpl-1: cpl 1 0
ipl-1: ipl 1 0
cddl: cddl 1 (0|1)
artistic-1: artistic 1 0
artistic-2: artistic 2 0
unlicense: unlicense
wtfpl: wtfpl
cc0: cc0 1 0
cc-by: cc by (1|2|3|4)
cc-by-sa: cc by sa (1|2|3|4)
cc-by-nc: cc by nc (1|2|3|4)
cc-by-nd: cc by nd (1|2|3|4)
cc-by-nc-sa: cc by nc sa (1|2|3|4)
cc-by-nc-nd: cc by nc nd (1|2|3|4)
odbl: odbl 1 0
odc-by: odc by 1 0
pddl: pddl 1 0
ofl: ofl 1 (0|1)
openssl: openssl
python: (psf|python) 2 0
php: php 3 (0|01)
ruby: ruby
vim: vim
curl: curl
unicode: unicode (dfs|3|tou)
w3c: w3c
ncsa: ncsa
postgresql: postgresql
mulan: mulanpsl 2 0
ms-pl: ms pl
ms-rl: ms rl
eupl: eupl 1 (0|1|2)
cecill: cecill (1|2|b|c)
qpl: qpl 1 0
sspl: sspl 1 0
elastic: elastic 2 0
proprietary: licenseref proprietary
"""
#: Names that are no everyday words, wherever they stand.
NAMES = """
mit: (mit|expat) licen(s|c)e
isc: isc licen(s|c)e
bsd: bsd licen(s|c)e
bsd-2-clause: bsd 2 clause
bsd-2-clause: (2|two) clause bsd
bsd-3-clause: bsd 3 clause
bsd-3-clause: (3|three) clause bsd
zlib: zlib licen(s|c)e
boost: boost software license
apache-2: apache licen(s|c)e version? 2
apache-2: apache 2 0
apache-1: apache (software|license) license? version? 1
apache: apache licen(s|c)e
gpl: gnu general public license
gpl-2: gnu general public license version? (v2|2)
gpl-3: gnu general public license version? (v3|3)
gpl: gnu gpl
gpl-2: gpl (v2|2)
gpl-2: gplv2
gpl-3: gpl (v3|3)
gpl-3: gplv3
lgpl: gnu (lesser|library) general public license
lgpl: lgpl
lgpl-2.1: lgpl (v2|2) 1
lgpl-3: lgpl (v3|3)
lgpl-3: lgplv3
agpl: (gnu|affero) (affero|gpl) general? public? licen(s|c)e?
agpl: agpl
agpl-3: agplv3
gfdl: gnu free documentation license
gfdl: gfdl
mpl: mozilla public license
mpl-2: mozilla public license version? (v2|2)
mpl-2: mpl 2 0
epl: eclipse public license
epl-2: eclipse public license version? (v2|2)
cddl: common development and distribution license
cddl: cddl
artistic: artistic licen(s|c)e
artistic-2: artistic licen(s|c)e 2
unlicense: unlicense
wtfpl: wtfpl
public-domain: public domain
cc0: cc0
cc0: cc zero
cc-by: cc by (1|2|3|4)
cc-by: creative commons attribution
cc-by-sa: cc by sa
cc-by-sa: creative commons attribution (sharealike|share) alike?
cc-by-nc: cc by nc
cc-by-nc: creative commons attribution (noncommercial|non) commercial?
cc-by-nd: cc by nd
cc-by-nd: creative commons attribution (noderivatives|noderivs|no) derivatives?
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd: cc by nc nd
cc: creative commons licen(s|c)e
odbl: open database license
odbl: odbl
odc-by: odc by
pddl: pddl
ofl: (sil|open) open? font license
openrail: openrail
eupl: european union public licen(s|c)e
ogl: open government licen(s|c)e
sspl: server side public license
bsl: business source license
python: python software foundation license
php: php license
ncsa: (ncsa|illinois) open? source license
ms-pl: microsoft public license
cecill: cecill
"""
#: Of each kind of rule: its signatures, what stands before each, its priority and its weight.
KINDS = (
    (SPDX, "spdx license identifier ", 100, 1.0),
    (TEXTS, "", 90, 1.0),
    (NOTICES, "", 70, 0.9),
    (NAMES, "", 30, 0.5),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def phrase_pattern(phrase: str) -> re.Pattern:
    """The phrase's words in a row, whatever stands between them."""
    return re.compile(NO_WORD_BEFORE + GAP.join(re.escape(w).encode() for w in phrase.split()) + NO_WORD_AFTER)


def signature_pattern(signature: str) -> re.Pattern:
    """A signature's regular expression over lower-cased bytes."""
    found = b""
    for word in signature.split():
        if word == "...":
            found += rb"(?:[0-9a-z\x80-\xff]+" + GAP + rb"){0,4}?"
        elif word.endswith("?"):
            found += b"(?:" + word[:-1].encode() + GAP + b")?"
        else:
            found += re.sub(r"\(", "(?:", word).encode() + GAP
    # A word ends the match; the gap behind it does not belong to it.
    return re.compile(NO_WORD_BEFORE + found.removesuffix(GAP) + NO_WORD_AFTER)


def signature_keywords(signature: str) -> tuple[bytes, ...]:
    """The two longest of the words that must stand in the text as they are."""
    literal = (w.split("(")[0] for w in signature.split() if not w.endswith("?"))
    plain = [w for w in literal if w.isalnum()]
    return tuple(w.encode() for w in sorted(set(plain), key=lambda w: (-len(w), w))[:2])


def build_rules() -> list[Rule]:
    """All rules, the most specific first; within a kind a longer signature goes before a shorter one."""
    rules = []
    for table, before, priority, weight in KINDS:
        for line in table.strip().splitlines():
            label, _, signature = line.partition(": ")
            words = before + signature
            while words.endswith("?"):  # an optional word at the end adds nothing to a match
                words = words.rpartition(" ")[0]
            rules.append(Rule(label, priority * 1000 + len(words.split()), weight, signature_keywords(words), signature_pattern(words)))
    return sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


def resolve(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Drop each (start, end, priority, weight, label) that lies inside an accepted one of the same or a higher priority.

    Only detections of one overlapping stretch can contain each other, so stretches are settled one
    by one, each from the highest priority and the longest detection down.
    """
    kept, stretch, reach = [], [], -1
    for d in [*sorted(set(found)), (1 << 62, 1 << 62, 0, 0.0, "")]:
        if d[0] >= reach and stretch:
            accepted: list[tuple[int, int, int, float, str]] = []
            for x in sorted(stretch, key=lambda x: (-x[2], x[0] - x[1], x)):
                if not any(y[0] <= x[0] and x[1] <= y[1] for y in accepted):
                    accepted.append(x)
            kept += accepted
            stretch = []
        stretch.append(d)
        reach = max(reach, d[1])
    return sorted(kept)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label string, start long, end long, priority long>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = build_rules()
    keywords = sorted({k for r in rules for k in r.keywords})
    base = [(phrase_pattern(p), label, max(p.split(), key=len).encode()) for p, label in BASE_PHRASES.items()]
    out_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffers(part.column("text"))
            data = LOWER[data]
            starts, _ = spans(WORD[data], offsets)
            bounds = per_row(starts, offsets)
            raw = data.tobytes()
            # Code points before each byte, so that a place needs no decoding of what stands before it.
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            columns: list[list] = [[] for _ in range(7)]
            for r in range(part.num_rows):
                low = int(offsets[r])
                row = raw[low : int(offsets[r + 1])]
                places, labels, detections = [], set(), []
                for pattern, label, keyword in base:
                    if keyword in row:
                        at = [m.start() for m in pattern.finditer(row)]
                        places += at
                        labels |= {label} if at else set()
                present = {k for k in keywords if k in row}
                for rule in rules:
                    if present.issuperset(rule.keywords):
                        detections += [(m.start(), m.end(), rule.priority, rule.weight, rule.label) for m in rule.pattern.finditer(row)]
                kept = resolve(detections)
                words = np.searchsorted(starts, np.asarray(places, dtype=np.int64) + low) - bounds[r]
                point = lambda b, low=low, points=points: int(points[low + b] - points[low])
                values = (
                    len(places),
                    int(words.min()) if places else None,
                    int(words.max()) if places else None,
                    ",".join(sorted(labels)),
                    ",".join(sorted(labels | {d[4] for d in kept})),
                    max([0.0, *(d[3] for d in kept), *([0.9] if places else [])]),
                    [{"label": d[4], "start": point(d[0]), "end": point(d[1]), "priority": d[2]} for d in kept],
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), out_type)
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), type=pa.int64()), *arrays],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License findings of every whole text, one row per input row.

    A-Z are lower-cased first; a null text is empty, and a text without words has no findings, empty
    labels and score 0. Repeated rows and null ids are kept as they come. ``detections`` holds what
    is left after suppression, in code points; base labels are reported whatever is suppressed. An
    empty table gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scan, SCHEMA)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
