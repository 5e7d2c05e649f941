"""License scan by ordered signature rules.

An SPDX tag is read as an expression: every identifier in it is a license under its own
name, listed here or not, and what a tag covers is not read again by other rules.
Sentences of license texts and headers have rules of their own.

Each license below has hand-written name patterns and a keyword. A rule is one of them
in one setting (a tag, a grant, a title, an address or the bare name), with the
setting's priority. A text is searched for a rule only if it holds the rule's keyword,
which every match of the rule holds too; for an address it is its host. A text that holds
the first word of no keyword is not looked at any further.
Words may be any run of white space and comment marks apart, as where a name wraps in a
source header; starts and ends are those of the text as it is.
Detections are taken by falling priority, and one that lies inside a detection taken
before is suppressed; so a versioned name beats the family's name in it.

Three base phrases are found by whole words, wherever their words stand in a row, and
are never suppressed.

Nulls and ties: a null or empty text has no words, no label and score 0; detections of
equal priority are ordered by start, the longer first; rows are judged one by one,
repeated or not. An empty table gives no rows. A very long text is searched as one, and
a few copies of it are held. Other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.words import folded, rows_of

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, keyword, patterns of the name, patterns of its address (lower case).
LICENSES: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("apache-1.1", "apache", (r"apache(?: software)? licen[cs]e,? (?:version|v)\.? ?1\.1", r"apache-1\.1"), (r"apache\.org/licenses/license-1\.1",)),
    ("apache-2.0", "apache", (r"apache(?: software)? licen[cs]e,? (?:version|v)?\.? ?2(?:\.0)?", r"apache-2\.0"), (r"apache\.org/licenses/license-2\.0",)),
    ("apache", "apache", (r"apache(?: software)? licen[cs]e",), (r"apache\.org/licenses",)),
    ("mit", "expat", (r"expat licen[cs]e",), ()),
    ("mit", "x11", (r"x11 licen[cs]e",), ()),
    ("mit", "mit", (r"mit licen[cs]e",), (r"opensource\.org/licenses?/mit",)),
    ("mit-0", "mit", (r"mit no attribution", r"mit-0"), (r"opensource\.org/licenses?/mit-0",)),
    ("bsd-2-clause", "bsd", (r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e", r"bsd 2-clause", r"bsd-2-clause"), (r"opensource\.org/licenses?/bsd-2-clause",)),
    ("bsd-3-clause", "bsd", (r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e", r"bsd 3-clause", r"bsd-3-clause"), (r"opensource\.org/licenses?/bsd-3-clause",)),
    ("bsd-4-clause", "bsd", (r"(?:original|4-clause|four-clause) bsd licen[cs]e", r"bsd-4-clause"), ()),
    ("0bsd", "bsd", (r"zero-clause bsd", r"0bsd"), (r"opensource\.org/licenses?/0bsd",)),
    ("bsd", "bsd", (r"bsd(?:-style)? licen[cs]e",), (r"opensource\.org/licenses?/bsd",)),
    ("gpl-1.0", "gpl", (r"gplv1", r"gpl-1\.0(?:-only|-or-later)?"), ()),
    ("gpl-2.0", "gpl", (r"gpl ?v?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later)?"), (r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0",)),
    ("gpl-3.0", "gpl", (r"gpl ?v?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later)?"), (r"gnu\.org/licenses/gpl-3\.0",)),
    ("gpl-2.0", "general public", (r"general public licen[cs]e,? (?:version|v)\.? ?2",), ()),
    ("gpl-3.0", "general public", (r"general public licen[cs]e,? (?:version|v)\.? ?3",), ()),
    ("lgpl-2.1", "lgpl", (r"lgpl ?v?2\.1", r"lgpl-2\.1(?:-only|-or-later)?"), (r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1",)),
    ("lgpl-3.0", "lgpl", (r"lgpl ?v?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later)?"), (r"gnu\.org/licenses/lgpl-3\.0",)),
    ("lgpl", "general public", (r"(?:lesser|library) general public licen[cs]e",), (r"gnu\.org/licenses/lgpl",)),
    ("agpl-3.0", "agpl", (r"agpl ?v?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later)?"), (r"gnu\.org/licenses/agpl-3\.0",)),
    ("agpl", "general public", (r"affero general public licen[cs]e",), (r"gnu\.org/licenses/agpl",)),
    ("gfdl", "free documentation", (r"(?:gnu )?free documentation licen[cs]e",), (r"gnu\.org/licenses/fdl",)),
    ("mpl-1.1", "mozilla", (r"mozilla public licen[cs]e,? (?:version|v)?\.? ?1\.1",), (r"mozilla\.org/mpl/1\.1", r"mozilla\.org/mpl/mpl-1\.1")),
    ("mpl-1.1", "mpl-1", (r"mpl-1\.1",), ()),
    ("mpl-2.0", "mozilla", (r"mozilla public licen[cs]e,? (?:version|v)?\.? ?2(?:\.0)?",), (r"mozilla\.org/(?:en-us/)?mpl/2\.0",)),
    ("mpl-2.0", "mpl-2", (r"mpl-2\.0",), ()),
    ("mpl", "mozilla", (r"mozilla public licen[cs]e",), (r"mozilla\.org/mpl",)),
    ("epl-1.0", "eclipse", (r"eclipse public licen[cs]e,? (?:version|v|-)?\.? ?1(?:\.0)?",), (r"eclipse\.org/legal/epl-v10",)),
    ("epl-2.0", "eclipse", (r"eclipse public licen[cs]e,? (?:version|v|-)?\.? ?2(?:\.0)?",), (r"eclipse\.org/legal/epl-2\.0",)),
    ("edl-1.0", "eclipse", (r"eclipse distribution licen[cs]e",), (r"eclipse\.org/org/documents/edl-v10",)),
    ("cddl-1.0", "common development", (r"common development and distribution licen[cs]e",), ()),
    ("cpl-1.0", "common public", (r"common public licen[cs]e",), ()),
    ("cpal-1.0", "common public attribution", (r"common public attribution licen[cs]e",), ()),
    ("eupl-1.2", "european union public", (r"european union public licen[cs]e",), (r"joinup\.ec\.europa\.eu/collection/eupl",)),
    ("artistic-1.0", "artistic", (r"artistic licen[cs]e,? (?:version|v)?\.? ?1(?:\.0)?", r"artistic-1\.0"), ()),
    ("artistic-2.0", "artistic", (r"artistic licen[cs]e,? (?:version|v)?\.? ?2(?:\.0)?", r"artistic-2\.0"), (r"opensource\.org/licenses?/artistic-2\.0",)),
    ("artistic", "artistic", (r"artistic licen[cs]e",), ()),
    ("bsl-1.0", "boost", (r"boost software licen[cs]e",), (r"boost\.org/license_1_0\.txt",)),
    ("isc", "isc", (r"isc licen[cs]e",), (r"opensource\.org/licenses?/isc",)),
    ("isc", "internet systems", (r"internet systems consortium licen[cs]e",), ()),
    ("zlib", "zlib", (r"zlib(?:/libpng)? licen[cs]e",), (r"zlib\.net/zlib_license",)),
    ("libpng", "libpng", (r"libpng licen[cs]e",), ()),
    ("unlicense", "unlicense", (r"the unlicense",), (r"unlicense\.org",)),
    ("wtfpl", "wtfpl", (r"wtfpl",), (r"wtfpl\.net",)),
    ("psf-2.0", "python software", (r"python software foundation licen[cs]e",), (r"docs\.python\.org/\d/license",)),
    ("python-2.0", "python", (r"python licen[cs]e",), ()),
    ("php-3.01", "php", (r"php licen[cs]e",), (r"php\.net/license",)),
    ("ruby", "ruby", (r"ruby licen[cs]e",), ()),
    ("perl", "perl", (r"same terms as perl(?: itself)?",), ()),
    ("ofl-1.1", "open font", (r"sil open font licen[cs]e", r"open font licen[cs]e"), (r"scripts\.sil\.org/ofl",)),
    ("ncsa", "ncsa", (r"university of illinois/ncsa open source licen[cs]e", r"ncsa open source licen[cs]e"), ()),
    ("w3c", "w3c", (r"w3c software (?:notice and )?licen[cs]e",), (r"w3\.org/consortium/legal/copyright-software",)),
    ("openssl", "openssl", (r"openssl licen[cs]e",), (r"openssl\.org/source/license",)),
    ("curl", "curl", (r"curl licen[cs]e",), ()),
    ("postgresql", "postgresql", (r"postgresql licen[cs]e",), ()),
    ("ms-pl", "microsoft public", (r"microsoft public licen[cs]e",), ()),
    ("ms-rl", "microsoft reciprocal", (r"microsoft reciprocal licen[cs]e",), ()),
    ("busl-1.1", "business source", (r"business source licen[cs]e",), (r"mariadb\.com/bsl11",)),
    ("sspl-1.0", "server side public", (r"server side public licen[cs]e",), (r"mongodb\.com/licensing/server-side-public-license",)),
    ("elastic-2.0", "elastic", (r"elastic licen[cs]e",), (r"elastic\.co/licensing/elastic-license",)),
    ("odbl-1.0", "open database", (r"open database licen[cs]e",), (r"opendatacommons\.org/licenses/odbl",)),
    ("odc-by-1.0", "open data commons", (r"open data commons attribution licen[cs]e",), (r"opendatacommons\.org/licenses/by",)),
    ("pddl-1.0", "public domain dedication", (r"open data commons public domain dedication",), (r"opendatacommons\.org/licenses/pddl",)),
    ("cdla-permissive", "community data", (r"community data licen[cs]e agreement",), (r"cdla\.dev/permissive",)),
    ("cc0-1.0", "cc0", (r"cc0(?:[- ]1\.0)?", r"cc0 public domain dedication"), ()),
    ("cc0-1.0", "creativecommons", (), (r"creativecommons\.org/publicdomain/zero",)),
    ("cc-by-4.0", "cc", (r"cc[- ]by[- ]4\.0",), (r"creativecommons\.org/licenses/by/4\.0",)),
    ("cc-by-3.0", "cc", (r"cc[- ]by[- ]3\.0",), (r"creativecommons\.org/licenses/by/3\.0",)),
    ("cc-by-2.0", "cc", (r"cc[- ]by[- ]2\.[05]",), (r"creativecommons\.org/licenses/by/2\.[05]",)),
    ("cc-by-sa", "cc", (r"cc[- ]by-sa(?:[- ]\d\.\d)?",), (r"creativecommons\.org/licenses/by-sa",)),
    ("cc-by-nc", "cc", (r"cc[- ]by-nc(?:[- ]\d\.\d)?",), (r"creativecommons\.org/licenses/by-nc/",)),
    ("cc-by-nd", "cc", (r"cc[- ]by-nd(?:[- ]\d\.\d)?",), (r"creativecommons\.org/licenses/by-nd",)),
    ("cc-by-nc-sa", "cc", (r"cc[- ]by-nc-sa(?:[- ]\d\.\d)?",), (r"creativecommons\.org/licenses/by-nc-sa",)),
    ("cc-by-nc-nd", "cc", (r"cc[- ]by-nc-nd(?:[- ]\d\.\d)?",), (r"creativecommons\.org/licenses/by-nc-nd",)),
    ("cc-by", "creative commons", (r"creative commons attribution(?: \d\.\d)?(?: international)?(?: licen[cs]e)?",), (r"creativecommons\.org/licenses/by",)),
    ("cc-by-sa", "creative commons", (r"creative commons attribution[- ]share-?alike",), ()),
    ("cc-by-nc", "creative commons", (r"creative commons attribution[- ]non-?commercial",), ()),
    ("cc-by-nd", "creative commons", (r"creative commons attribution[- ]no-?deriv(?:ative)?s?",), ()),
    ("cc", "creative commons", (r"creative commons(?: licen[cs]e)?",), (r"creativecommons\.org",)),
    ("public-domain", "public domain", (r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"(?:is|are) in the public domain", r"public domain"), ()),
    ("proprietary", "proprietary", (r"proprietary and confidential", r"confidential and proprietary", r"proprietary licen[cs]e"), ()),
    ("commercial", "commercial", (r"commercial licen[cs]e", r"for non-?commercial use only", r"not for commercial use"), ()),
    ("no-redistribution", "redistribut", (r"redistribution (?:is )?(?:strictly )?prohibited",), ()),
    ("no-redistribution", "may not be", (r"may not be (?:reproduced|redistributed)",), ()),
    ("permissive-grant", "permission", (r"permission is hereby granted,? free of charge", r"permission to use,? copy,? modify"), ()),
    ("no-warranty", "warrant", (r"provided [\"']?as is[\"']?,? without (?:any )?warrant(?:y|ies)", r"without warrant(?:y|ies) of any kind"), ()),
    ("copyleft", "copyleft", (r"copyleft",), ()),
    ("copyright", "copyright", (r"copyright (?:\(c\)|\xc2\xa9)? ?(?:19|20)\d\d", r"\(c\) copyright"), ()),
)

#: label, keyword, pattern of a sentence of the license's own text or of its header.
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms,? with or without modification"),
    ("bsd-3-clause", "neither the name", r"neither the names? of [\x00-\x2d\x2f-\xff]{1,120}? nor the names of (?:its|their|any) contributors"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("mit", "obtaining", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("bsl-1.0", "obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "fee", r"permission to use,? copy,? modify,? (?:and/or|and|or) distribute this software for any purpose with or without fee"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("wtfpl", "what the", r"do what the f[a-z*][a-z*][a-z*]? you want to public licen[cs]e"),
    ("gpl-2.0", "general public", r"(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e(?: as published by the free software foundation)?[,;:]? (?:either )?version 2 of the licen[cs]e"),
    ("gpl-3.0", "general public", r"(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e(?: as published by the free software foundation)?[,;:]? (?:either )?version 3 of the licen[cs]e"),
    ("lgpl-2.1", "general public", r"lesser general public licen[cs]e(?: as published by the free software foundation)?[,;:]? (?:either )?version 2\.1 of the licen[cs]e"),
    ("lgpl-3.0", "general public", r"lesser general public licen[cs]e(?: as published by the free software foundation)?[,;:]? (?:either )?version 3 of the licen[cs]e"),
    ("agpl-3.0", "general public", r"affero general public licen[cs]e(?: as published by the free software foundation)?[,;:]? (?:either )?version 3 of the licen[cs]e"),
    ("mpl-1.1", "mpl", r"mpl ?v?1\.1"),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?:\.0)?"),
    ("epl-2.0", "epl", r"epl ?v?2(?:\.0)?"),
    ("epl-1.0", "epl", r"epl ?v?1(?:\.0)?"),
)
_TEXT = (75, 0.95)

#: An SPDX expression: identifiers, joined by operators, in brackets or not.
_TAG = re.compile(rb"spdx-license-identifier ?: ?((?:\( ?)*[a-z0-9][a-z0-9.+-]*+(?: ?\))*(?: (?:and|or|with) (?:\( ?)*[a-z0-9][a-z0-9.+-]*+(?: ?\))*)*)")
_IDENTIFIER = re.compile(rb"(with )?(?<![a-z0-9.+-])([a-z0-9][a-z0-9.+-]*)")
#: Identifiers whose label is not their own name without its ending.
_SAME = {"x11": "mit", "gfdl-1.1": "gfdl", "gfdl-1.2": "gfdl", "gfdl-1.3": "gfdl", "cc-by-2.5": "cc-by-2.0"}
_ENDING = re.compile(r"(?:-only|-or-later|\+)$|\.$")

#: setting, priority, confidence, pattern around a name.
SETTINGS = (
    ("tag", 90, 0.99, r"spdx-license-identifier: ?(?:{name})"),
    ("grant", 70, 0.95, r"(?:licen[cs]ed|released|distributed|available|published|covered|governed) (?:under|by)(?: the)?(?: terms? of)?(?: the)?(?: gnu)? (?:{name})"),
    ("title", 50, 0.8, r"(?:the |gnu ){{1,2}}(?:{name})"),
    ("name", 30, 0.6, r"(?:{name})"),
)
_ADDRESS = (80, 0.97, r"(?:https?://)?(?:www\.)?(?:{name})")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    confidence: float
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules in their order; a longer label of a family stands above a shorter."""
    out = []
    edge = r"(?<![a-z0-9\x80-\xff])", r"(?![a-z0-9\x80-\xff])"
    for label, keyword, names, addresses in LICENSES:
        exact = label.count("-") + any(c.isdigit() for c in label)
        for setting, priority, confidence, around in SETTINGS:
            own = (re.escape(label) + "(?![.+-])",) if setting == "tag" and keyword in label else ()  # its identifier
            if names:
                text = edge[0] + around.format(name="|".join(names + own)) + edge[1]
                out.append(Rule(label, keyword.encode(), priority + exact, confidence, re.compile(text.encode("latin-1"))))
        for address in addresses:
            text = edge[0] + _ADDRESS[2].format(name=address)
            host = re.match("[a-z0-9]+", address)[0]
            out.append(Rule(label, host.encode(), _ADDRESS[0] + exact, _ADDRESS[1], re.compile(text.encode("latin-1"))))
    for label, keyword, pattern in TEXTS:
        text = edge[0] + pattern + edge[1]
        out.append(Rule(label, keyword.encode(), _TEXT[0] + sum(c.isdigit() for c in label), _TEXT[1], re.compile(text.encode("latin-1"))))
    return sorted(out, key=lambda r: -r.priority)


RULES = rules()
_KEYWORDS = sorted({r.keyword for r in RULES})
#: The first words of all keywords: a text without one of them holds no keyword, wrapped or not.
_FIRST = {k.split(b" ")[0] for k in _KEYWORDS} | {b"spdx"}


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections left once those inside one of at least their priority are gone."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end among the detections up to each start
    by_priority: dict[int, list[tuple[int, int, Rule]]] = {}
    for d in found:
        by_priority.setdefault(d[2].priority, []).append(d)
    for priority in sorted(by_priority, reverse=True):
        end = -1
        fresh = []
        for d in sorted(by_priority[priority], key=lambda d: (d[0], -d[1])):
            at = bisect_right(starts, d[0]) - 1
            if d[1] <= end or (at >= 0 and reach[at] >= d[1]):
                continue
            end = max(end, d[1])
            fresh.append(d)
        kept += fresh
        starts, reach, end = [], [], -1
        for d in sorted(kept, key=lambda d: d[0]):
            end = max(end, d[1])
            starts.append(d[0])
            reach.append(end)
    return sorted(kept, key=lambda d: d[:2])


_MARK = rb"(?:[*#;%!|>/\"'\\]++|<!--++|--++>?+)"
_WRAP = rb"[\r\n](?:[ \t-\r]++|" + _MARK + rb"|(?:dnl|rem)(?=[ \t-\r]))*+"
#: Runs between two words but for a single blank: white space, comment marks that stand
#: free, and those beside a line's end. No part is tried twice, so long runs cost their length.
_APART = re.compile(
    rb"(?! [^ \t-\r*#;%!|>/\"'\\<-])[ \t\v\f]++(?:" + _MARK + rb"[ \t\v\f]++)*+(?:" + _MARK + rb"?+" + _WRAP + rb")?+"
    rb"|(?:[\"']|\*/)?+" + _WRAP
)


def declared(even: bytes) -> list[tuple[int, int, Rule]]:
    """The licenses of SPDX tags, each identifier under its own name; what stands after
    WITH is an exception to a license and no license. A tag's place is its expression's."""
    out = []
    for m in _TAG.finditer(even):
        for i in _IDENTIFIER.finditer(m[1]):
            word = i[2].decode()
            if i[1] or word in ("and", "or", "with"):
                continue
            name = _ENDING.sub("", word)
            out.append((m.start(), m.end(), Rule(_SAME.get(name, name), b"spdx", 99, 0.99, _TAG)))
    return out


def _original(low: bytes, found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections in ``low`` with its runs made blanks, by their places in ``low``."""
    blanks, gone, total = [], [0], 0
    for m in _APART.finditer(low):
        blanks.append(m.start() - total)
        total += m.end() - m.start() - 1
        gone.append(total)
    place = lambda at: at + gone[bisect_left(blanks, at)]
    return [(place(start), place(end - 1) + 1, r) for start, end, r in found]


def detections(text: bytes | None) -> list[tuple[int, int, Rule]]:
    """Start and end (bytes) of what is detected, and by which rule."""
    low = text.lower() if text else b""
    first = {k for k in _FIRST if k in low}
    if not first:
        return []
    even = _APART.sub(b" ", low)
    there = {k for k in _KEYWORDS if k.split(b" ")[0] in first and k in even}
    found = [(m.start(), m.end(), r) for r in RULES if r.keyword in there for m in r.pattern.finditer(even)]
    tags = declared(even) if b"spdx" in first else []
    if tags:
        spans = sorted({t[:2] for t in tags})  # one after the other
        starts = [a for a, _ in spans]
        found = [d for d in found if (at := bisect_right(starts, d[0]) - 1) < 0 or spans[at][1] < d[1]]
    if not found and not tags:
        return []
    return sorted(_original(low, suppressed(found)) + _original(low, tags), key=lambda d: (*d[:2], d[2].label))


_SPACES = re.compile(b" {2,}")
_PHRASES = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]


def base_places(text: bytes | None) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and the first word and label of each base phrase."""
    joined = b" %b " % _SPACES.sub(b" ", folded(text)).strip(b" ")
    places = []
    for phrase, label in _PHRASES:
        at = joined.find(phrase)
        word, counted = 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append((word, label))
            at = joined.find(phrase, at + 1)
    return (joined.count(b" ") - 1 if len(joined) > 2 else 0), places


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, score, and what was detected."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in texts:
                n_words, places = base_places(text)
                found = detections(text)
                base = sorted({label for _, label in places})
                doubt = 1.0
                for confidence in [0.9] * bool(places) + [r.confidence for r in {d[2] for d in found}]:
                    doubt *= 1 - confidence
                at = [word for word, _ in places]
                row = (
                    n_words, len(places), min(at, default=None), max(at, default=None), ",".join(base),
                    ",".join(sorted({*base, *(d[2].label for d in found)})), 1 - doubt,
                    [{"start": s, "end": e, "label": r.label} for s, e, r in found],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judge,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start: bigint, end: bigint, label: string>>",
    )
