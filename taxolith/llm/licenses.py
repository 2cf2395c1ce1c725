"""License scans: ordered signature rules over the words of a text.

A text becomes its words, lower-cased, with one blank between them. Each rule is a regular expression with a label, a
priority, a confidence and keywords; a rule runs only on texts that have all its keywords. Detections are word
intervals. They are taken by priority, then length, then place; one that lies inside an interval already taken is
suppressed. Base phrases are found apart from the rules and always stay.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common

# Phrases whose places count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values, hand-written: label, what its name looks like as words, keywords (a+b, c: a text must have a and b, or c), words of its address.
FAMILIES = """
apache-2.0 | apache(?: software)?(?: licen[sc]e)?(?: version)?(?: v)? v?2(?: 0)? | apache | apache org licenses license 2 0
apache-1.1 | apache(?: software)?(?: licen[sc]e)?(?: version)? 1 1 | apache | apache org licenses license 1 1
apache | apache(?: software)? licen[sc]e | apache |
mit | (?:mit|expat|x11)(?: style)? licen[sc]e | mit+license, mit+licence, expat, x11 | opensource org licenses mit
mit-0 | mit (?:0|no attribution)(?: licen[sc]e)? | mit | opensource org licenses mit 0
bsd-2-clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)? | bsd, freebsd | opensource org licenses bsd 2 clause
bsd-3-clause | (?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)? | bsd | opensource org licenses bsd 3 clause
bsd-4-clause | (?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)? | bsd | spdx org licenses bsd 4 clause
bsd | bsd(?: style)? licen[sc]e | bsd | opensource org licenses bsd
isc | isc licen[sc]e | isc | opensource org licenses isc
gpl-1.0 | (?:gpl|general public licen[sc]e)(?: version)?(?: v)? v?1(?: 0)? | gpl, general+public | gnu org licenses gpl 1 0
gpl-2.0 | (?:gpl|general public licen[sc]e)(?: version)?(?: v)? v?2(?: 0)? | gpl, general+public | gnu org licenses gpl 2 0
gpl-2.0-or-later | (?:gpl|general public licen[sc]e)(?: version)?(?: v)? v?2(?: 0)? (?:or (?:any )?later|or at your option any later version) | gpl+later, general+public+later | spdx org licenses gpl 2 0 or later
gpl-3.0 | (?:gpl|general public licen[sc]e)(?: version)?(?: v)? v?3(?: 0)? | gpl, general+public | gnu org licenses gpl 3 0
gpl-3.0-or-later | (?:gpl|general public licen[sc]e)(?: version)?(?: v)? v?3(?: 0)? (?:or (?:any )?later|or at your option any later version) | gpl+later, general+public+later | spdx org licenses gpl 3 0 or later
gpl-any | (?:gnu gpl|gnu general public licen[sc]e) | gnu | gnu org licenses gpl
lgpl-2.0 | (?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version)?(?: v)? v?2(?: 0)? | lgpl, general+public | gnu org licenses lgpl 2 0
lgpl-2.1 | (?:lgpl|lesser general public licen[sc]e)(?: version)?(?: v)? v?2 1 | lgpl, lesser | gnu org licenses lgpl 2 1
lgpl-3.0 | (?:lgpl|lesser general public licen[sc]e)(?: version)?(?: v)? v?3(?: 0)? | lgpl, lesser | gnu org licenses lgpl 3 0
lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e | general | gnu org licenses lgpl
agpl-3.0 | (?:agpl|affero general public licen[sc]e)(?: version)?(?: v)? v?3(?: 0)? | agpl, affero | gnu org licenses agpl 3 0
agpl | (?:gnu )?affero general public licen[sc]e | affero | gnu org licenses agpl
gfdl-1.2 | (?:gfdl|free documentation licen[sc]e)(?: version)?(?: v)? v?1 2 | gfdl, documentation | gnu org licenses fdl 1 2
gfdl-1.3 | (?:gfdl|free documentation licen[sc]e)(?: version)?(?: v)? v?1 3 | gfdl, documentation | gnu org licenses fdl 1 3
gfdl | (?:gnu )?free documentation licen[sc]e | documentation | gnu org licenses fdl
mpl-1.0 | (?:mpl|mozilla public licen[sc]e)(?: version)?(?: v)? v?1(?: 0)? | mpl, mozilla | mozilla org mpl 1 0
mpl-1.1 | (?:mpl|mozilla public licen[sc]e)(?: version)?(?: v)? v?1 1 | mpl, mozilla | mozilla org mpl 1 1
mpl-2.0 | (?:mpl|mozilla public licen[sc]e)(?: version)?(?: v)? v?2(?: 0)? | mpl, mozilla | mozilla org mpl 2 0
mpl | mozilla public licen[sc]e | mozilla | mozilla org mpl
epl-1.0 | (?:epl|eclipse public licen[sc]e)(?: version)?(?: v)? v?1(?: 0)? | epl, eclipse | eclipse org legal epl v10
epl-2.0 | (?:epl|eclipse public licen[sc]e)(?: version)?(?: v)? v?2(?: 0)? | epl, eclipse | eclipse org legal epl 2 0
cddl-1.0 | (?:cddl|common development and distribution licen[sc]e)(?: version)?(?: v)? v?1(?: 0)? | cddl, distribution | opensource org licenses cddl 1 0
cddl-1.1 | (?:cddl|common development and distribution licen[sc]e)(?: version)?(?: v)? v?1 1 | cddl, distribution | spdx org licenses cddl 1 1
cpl-1.0 | common public licen[sc]e(?: version)?(?: v)?(?: 1 0)? | common | opensource org licenses cpl1 0
ipl-1.0 | ibm public licen[sc]e(?: version)?(?: v)?(?: 1 0)? | ibm | opensource org licenses ibmpl
eupl-1.1 | (?:eupl|european union public licen[sc]e)(?: version)?(?: v)? v?1 1 | eupl, european | joinup eu eupl 1 1
eupl-1.2 | (?:eupl|european union public licen[sc]e)(?: version)?(?: v)? v?1 2 | eupl, european | joinup eu eupl 1 2
cecill-2.1 | cecill(?: free software licen[sc]e)?(?: agreement)?(?: version)?(?: v)? v?2 1 | cecill | cecill info licences 2 1
cecill | cecill(?: b| c)?(?: licen[sc]e)? | cecill | cecill info licences
artistic-1.0 | artistic licen[sc]e(?: version)?(?: v)?(?: 1 0)? | artistic | opensource org licenses artistic 1 0
artistic-2.0 | artistic licen[sc]e(?: version)?(?: v)? v?2(?: 0)? | artistic | opensource org licenses artistic 2 0
bsl-1.0 | boost software licen[sc]e(?: version)?(?: v)?(?: 1 0)? | boost | boost org license 1 0
busl-1.1 | business source licen[sc]e(?: version)?(?: v)?(?: 1 1)? | business | mariadb com bsl11
zlib | zlib(?: libpng)? licen[sc]e | zlib | opensource org licenses zlib
libpng | libpng licen[sc]e | libpng | spdx org licenses libpng
openssl | openssl licen[sc]e | openssl | openssl org source license
python-2.0 | (?:psf|python(?: software foundation)?) licen[sc]e(?: version)?(?: 2(?: 0)?)? | psf, python | opensource org licenses python 2 0
php-3.01 | php licen[sc]e(?: version)?(?: 3 01)? | php | php net license 3 01
ruby | ruby licen[sc]e | ruby | ruby lang org about license
vim | vim licen[sc]e | vim | spdx org licenses vim
perl | same terms as perl(?: itself)? | perl | dev perl org licenses
wtfpl | (?:wtfpl|do what the fuck you want to public licen[sc]e) | wtfpl, fuck | wtfpl net about
unlicense | (?:the unlicense|unlicense org|released into the public domain unlicense) | unlicense | unlicense org
cc0-1.0 | (?:cc0|cc zero|creative commons zero)(?: licen[sc]e)?(?: 1 0)? | cc0, cc+zero, creative+zero | creativecommons org publicdomain zero 1 0
cc-by-1.0 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 1 0 | cc+by, creative+commons | creativecommons org licenses by 1 0
cc-by-2.0 | (?:cc by|creative commons attribution)(?: generic)?(?: licen[sc]e)? 2 0 | cc+by, creative+commons | creativecommons org licenses by 2 0
cc-by-2.5 | (?:cc by|creative commons attribution)(?: licen[sc]e)? 2 5 | cc+by, creative+commons | creativecommons org licenses by 2 5
cc-by-3.0 | (?:cc by|creative commons attribution)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by 3 0
cc-by-4.0 | (?:cc by|creative commons attribution)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by 4 0
cc-by-sa-3.0 | (?:cc by sa|creative commons attribution share ?alike)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | (?:cc by sa|creative commons attribution share ?alike)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by sa 4 0
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike) | cc+by, creative+commons | creativecommons org licenses by sa
cc-by-nc-3.0 | (?:cc by nc|creative commons attribution non ?commercial)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | (?:cc by nc|creative commons attribution non ?commercial)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by nc 4 0
cc-by-nc | (?:cc by nc|creative commons attribution non ?commercial) | cc+by, creative+commons | creativecommons org licenses by nc
cc-by-nd-3.0 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: unported)?(?: licen[sc]e)? 3 0 | cc+by, creative+commons | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: international)?(?: licen[sc]e)? 4 0 | cc+by, creative+commons | creativecommons org licenses by nc nd 4 0
odbl-1.0 | (?:odbl|open (?:data commons open )?database licen[sc]e)(?: version)?(?: 1 0)? | odbl, database | opendatacommons org licenses odbl
odc-by-1.0 | (?:odc by|open data commons attribution licen[sc]e)(?: 1 0)? | odc, commons+data | opendatacommons org licenses by
pddl-1.0 | (?:pddl|public domain dedication and licen[sc]e) | pddl, dedication | opendatacommons org licenses pddl
ofl-1.1 | (?:sil )?open font licen[sc]e(?: version)?(?: 1 1)? | font | scripts sil org ofl
osl-3.0 | open software licen[sc]e(?: version)?(?: v)?(?: 3 0)? | open+software | opensource org licenses osl 3 0
afl-3.0 | academic free licen[sc]e(?: version)?(?: v)?(?: 3 0)? | academic | opensource org licenses afl 3 0
ms-pl | (?:ms pl|microsoft public licen[sc]e) | ms+pl, microsoft | opensource org licenses ms pl
ms-rl | (?:ms rl|microsoft reciprocal licen[sc]e) | ms+rl, microsoft | opensource org licenses ms rl
ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa | opensource org licenses ncsa
upl-1.0 | universal permissive licen[sc]e(?: version)?(?: 1 0)? | permissive | opensource org licenses upl
w3c | w3c software(?: notice and)? licen[sc]e | w3c | w3 org consortium legal copyright software
sspl-1.0 | (?:sspl|server side public licen[sc]e)(?: version)?(?: v)?(?: 1)? | sspl, server+side | mongodb com licensing server side public license
elastic-2.0 | elastic licen[sc]e(?: version)?(?: v)?(?: ?2(?: 0)?)? | elastic | elastic co licensing elastic license
polyform-nc | polyform noncommercial licen[sc]e | polyform | polyformproject org licenses noncommercial
openrail | (?:open rail(?: m)?|openrail(?: m)?|responsible ai licen[sc]e) | open+rail, openrail, responsible | licenses ai
jsr-json | the software shall be used for good not evil | evil+software | json org license
public-domain | (?:in|into|to) the public domain | domain | creativecommons org publicdomain mark 1 0
proprietary | (?:proprietary and confidential|unauthorized copying of this|confidential and proprietary|trade secret of) | proprietary, unauthorized, trade+secret |
no-redistribution | (?:may not be (?:copied|reproduced|redistributed)|redistribution is prohibited|no part of this (?:publication|book|work) may be reproduced) | may+not, redistribution, reproduced |
copyright-notice | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])? | copyright |
mit-text | permission is hereby granted free of charge to any person obtaining a copy | permission |
bsd-text | redistribution and use in source and binary forms with or without modification are permitted | redistribution |
isc-text | permission to use copy modify and or distribute this software for any purpose | permission |
apache-text | you may not use this file except in compliance with the license | compliance |
gpl-text | this program is free software you can redistribute it and or modify it | redistribute |
gpl-warranty | without even the implied warranty of merchantability or fitness for a particular purpose | merchantability |
zlib-text | this software is provided as is without any express or implied warranty | warranty |
cc-text | this work is licensed under a creative commons | creative |
"""

#: How a license is named in a text, with the priority and the confidence of such a place. {name}, {id} and {address} are filled in.
FORMS = (
    (r"spdx licen[sc]e identifier {id}", 100, 0.99, "spdx"),
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed)(?: to you)? (?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: gnu)? {name}", 90, 0.95, ""),
    (r"(?:https? )?(?:www )?{address}", 80, 0.9, ""),
    (r"(?:gnu )?{name}", 60, 0.7, ""),
)


VERBS = "licensed licenced released distributed available provided published covered governed".split()


@dataclass(frozen=True)
class Rule:
    """gates: sets of words; a text that has none of them whole has no place for the rule. also: of these words it must have one, if there are any."""

    label: str
    priority: int
    confidence: float
    pattern: re.Pattern
    gates: tuple[frozenset, ...]
    also: frozenset


def gates_of(keywords: str) -> tuple[frozenset, ...]:
    """"a+b, c": a and b, or c."""
    return tuple(frozenset(w.encode() for w in option.strip().split("+") if w) for option in keywords.split(","))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """The forms of all families, strongest first; between equals the order of the list."""
    found = []
    for line in FAMILIES.strip().splitlines():
        label, name, keywords, address = (p.strip() for p in re.split(r"(?<= )\|(?= |$)", line))
        for form, priority, confidence, more in FORMS:
            if "{address}" in form and not address:
                continue
            body = form.format(name=f"(?:{name})", id=re.sub(r"[-.]", " ", label), address=address)
            gates = gates_of(keywords if "{name}" in form else more or address.replace(" ", "+"))
            verbs = frozenset(v.encode() for v in VERBS) if form.startswith("(?:licen") else frozenset()
            found.append(Rule(label, priority, confidence, re.compile(rf"(?<![^ ]){body}(?![^ ])"), gates, verbs))
    return tuple(sorted(found, key=lambda r: -r.priority))


@functools.cache
def by_word() -> dict[bytes, tuple[int, ...]]:
    """Of each gate its longest word: word → numbers of the rules it may open."""
    index: dict[bytes, set[int]] = {}
    for i, rule in enumerate(rules()):
        for gate in rule.gates:
            index.setdefault(max(sorted(gate), key=len), set()).add(i)
    return {w: tuple(sorted(n)) for w, n in index.items()}


_FOLD = bytes(32 if (c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words: runs of ASCII letters and digits, lower-cased, and of other characters beyond ASCII."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if w]


def base_places(words: list[bytes], present) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    found = []
    for phrase, label in BASE.items():
        parts = phrase.encode().split()
        if present.issuperset(parts):
            n, at = len(parts), -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + n] == parts:
                    found.append((at, label))
    return found


def detections(words: list[bytes], present) -> list[tuple[int, int, Rule]]:
    """(first word, end word, rule) of what is left after suppression, strongest first."""
    index = by_word()
    opened = sorted({i for w in index.keys() & present for i in index[w]})
    gated = [r for r in map(rules().__getitem__, opened) if any(g <= present for g in r.gates) and (not r.also or r.also & present)]
    if not gated:
        return []
    line = b" ".join(words).decode("utf-8", "replace")
    begins = [m.start() for m in re.finditer(r"(?:^|(?<= ))", line)]
    found = []
    for order, rule in enumerate(gated):
        for m in rule.pattern.finditer(line):
            start = bisect.bisect_right(begins, m.start()) - 1
            found.append((-rule.priority, -(m.end() - m.start()), m.start(), order, start, bisect.bisect_left(begins, m.end()), rule))
    found.sort(key=lambda x: x[:4])
    taken, reach = [], Reach(len(words))
    for *_, start, end, rule in found:
        if reach.upto(start) < end:
            taken.append((start, end, rule))
            reach.add(start, end)
    return taken


class Reach:
    """The largest end of all intervals that start at or before a place; both steps take the logarithm of the size."""

    def __init__(self, size: int):
        self.ends = [0] * (size + 1)

    def add(self, start: int, end: int) -> None:
        at = start + 1
        while at < len(self.ends):
            self.ends[at] = max(self.ends[at], end)
            at += at & -at

    def upto(self, start: int) -> int:
        at, best = start + 1, 0
        while at:
            best = max(best, self.ends[at])
            at &= at - 1
        return best


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and the detections as (label, first, end)."""
    words = words_of(text)
    present = set(words)
    base = base_places(words, present)
    found = detections(words, present)
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(r.label for *_, r in found)})
    miss = 0.5 if base else 1.0
    for rule_label in {r.label for *_, r in found}:
        miss *= 1 - max(r.confidence for *_, r in found if r.label == rule_label)
    starts = [at for at, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), 1 - miss, [(r.label, s, e) for s, e, r in found]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and the score 0. Identifiers pass through, null and repeated ones too;
    rows that repeat give a row each. Very long texts are scanned whole. An empty table gives no rows; other columns,
    whatever their names, are ignored. Of detections that tie in priority and length the first place wins, then the
    first rule.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [scan(t)[:7] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
