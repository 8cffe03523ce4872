"""License scan with ordered signature rules.

A text is brought to its words joined by single blanks. A rule is looked at only where its keyword stands in the text;
its regex then gives detections as word intervals. A detection inside the interval of another with the same or a
higher priority is suppressed. Base phrases are always reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.llm.common import utf8

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

TEXT, NOTICE, NAME, HINT = 4, 3, 2, 1  # priorities
WEIGHT = {TEXT: 0.98, NOTICE: 0.95, NAME: 0.8, HINT: 0.4}

# label, keyword, pattern of the licence's name
_NAMES = (
    ("apache-1.0", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 0"), ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e(?: version)?(?: v)? ?2(?: 0)?"), ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e"), ("expat", "expat", r"expat licen[sc]e"), ("x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) licen[sc]e"), ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e"), ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"), ("0bsd", "0bsd", r"0bsd licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"), ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"), ("libpng", "libpng", r"libpng licen[sc]e"), ("boost-1.0", "boost", r"boost software licen[sc]e"),
    ("gpl-2.0", "general", r"gnu general public licen[sc]e(?: version)? (?:v)?2(?: 0)?"), ("gpl-3.0", "general", r"gnu general public licen[sc]e(?: version)? (?:v)?3(?: 0)?"),
    ("gpl-1.0", "general", r"gnu general public licen[sc]e(?: version)? (?:v)?1(?: 0)?"), ("gpl", "general", r"(?:gnu )?general public licen[sc]e"), ("gpl", "gpl", r"gpl(?:v[123])?(?: licen[sc]e)?"),
    ("lgpl-2.0", "library", r"gnu library general public licen[sc]e"), ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e(?: version)? 2 1"), ("lgpl-3.0", "lesser", r"gnu lesser general public licen[sc]e(?: version)? 3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"), ("lgpl", "lgpl", r"lgpl(?:v[23])?(?: licen[sc]e)?"), ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e"), ("agpl", "agpl", r"agpl(?:v3)?(?: licen[sc]e)?"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e"), ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e(?: version)? 1 0"), ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version)? (?:v )?2(?: 0)?"), ("mpl", "mozilla", r"mozilla public licen[sc]e"), ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version)?(?: v)? 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version)?(?: v)? 2 0"), ("epl", "eclipse", r"eclipse public licen[sc]e"), ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "common", r"common public licen[sc]e"), ("ipl-1.0", "ibm", r"ibm public licen[sc]e"), ("apsl", "apple", r"apple public source licen[sc]e"), ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version)? 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2 0"), ("artistic", "artistic", r"artistic licen[sc]e"), ("python-2.0", "python", r"python software foundation licen[sc]e"), ("php", "php", r"php licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"), ("zpl", "zope", r"zope public licen[sc]e"), ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[sc]e"), ("qpl", "q public", r"q public licen[sc]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e"), ("eupl", "european", r"european union public licen[sc]e"), ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[sc]e)?"), ("osl", "open software", r"open software licen[sc]e"),
    ("afl", "academic", r"academic free licen[sc]e"), ("ecl", "educational", r"educational community licen[sc]e"), ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"), ("upl", "universal permissive", r"universal permissive licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("beerware", "beer", r"beer ?ware licen[sc]e"), ("jsonlic", "json", r"json licen[sc]e"), ("vim", "vim", r"vim licen[sc]e"), ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"), ("postgresql", "postgresql", r"postgresql licen[sc]e"), ("curl", "curl", r"curl licen[sc]e"), ("unicode", "unicode", r"unicode(?: inc)? licen[sc]e(?: agreement)?"), ("icu", "icu", r"icu licen[sc]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"), ("ms-rl", "reciprocal", r"microsoft reciprocal licen[sc]e"), ("nokia", "nokia", r"nokia open source licen[sc]e"), ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("odbl", "open database", r"open (?:data commons )?open database licen[sc]e|open database licen[sc]e"), ("odc-by", "data commons", r"open data commons attribution licen[sc]e"), ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"), ("cc-by-4.0", "cc by", r"cc by 4 0"), ("cc-by-3.0", "cc by", r"cc by 3 0"), ("cc-by-2.0", "cc by", r"cc by 2 0"), ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"), ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"), ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"), ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?"), ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: licen[sc]e)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: licen[sc]e)?"), ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?(?: licen[sc]e)?"), ("cc", "creative", r"creative commons(?: licen[sc]e)?"),
)

# label, keyword, pattern, priority: sentences of licence texts and of notices
_SENTENCES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", TEXT), ("mit", "merge", r"use copy modify merge publish distribute sublicense and or sell copies", TEXT),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", TEXT), ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", TEXT),
    ("bsd", "binary form", r"redistributions in binary form must reproduce the above copyright notice", TEXT), ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", TEXT),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", TEXT), ("warranty", "as is", r"(?:software|work|material) is provided(?: by [^ ]+(?: [^ ]+){0,6})? as is", TEXT),
    ("warranty", "warranty", r"without warranty of any kind(?: express or implied)?", TEXT), ("warranty", "merchantability", r"implied warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose", TEXT),
    ("warranty", "liable", r"in no event shall (?:the )?[^ ]+(?: [^ ]+){0,8} be liable for any", TEXT), ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e", TEXT),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", TEXT), ("lgpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", TEXT),
    ("gpl-or-later", "later version", r"either version [123](?: 0)? of the licen[sc]e or at your option any later version", TEXT), ("gpl", "copy of the gnu", r"you should have received a copy of the gnu (?:general|lesser general|affero general) public licen[sc]e", TEXT),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e", TEXT), ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", TEXT),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e", TEXT), ("boost-1.0", "boost", r"distributed under the boost software licen[sc]e", TEXT), ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", TEXT),
    ("beerware", "beer", r"you can buy me a beer in return", TEXT), ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e", TEXT), ("cc0", "waive", r"has waived all copyright and related or neighboring rights", TEXT),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", NOTICE), ("public-domain", "public domain", r"public domain", HINT), ("proprietary", "proprietary", r"proprietary and confidential", NOTICE),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this [^ ]+ )?(?:is )?(?:strictly )?prohibited", NOTICE), ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?written permission", NOTICE),
    ("reserved", "rights reserved", r"all rights reserved", NOTICE), ("reserved", "rights reserved", r"some rights reserved", NOTICE), ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?(?: by)?", NOTICE),
    ("copyright", "copyright", r"copyright", HINT), ("unknown-license", "licen", r"licensed under", HINT), ("unknown-license", "licen", r"see (?:the )?licen[sc]e(?: file)?(?: for details)?", HINT), ("unknown-license", "terms", r"under the terms of the licen[sc]e", HINT),
    ("free-use", "free to", r"free to (?:use|share|copy|adapt|distribute)", HINT), ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", NOTICE), ("attribution", "attribution", r"attribution (?:is )?required", NOTICE),
    ("share-alike", "alike", r"share alike", HINT), ("no-derivatives", "derivatives", r"no derivatives", HINT), ("terms-of-use", "terms of", r"terms of (?:use|service)", HINT), ("trademark", "trademark", r"registered trademarks? of", HINT),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: for each licence name the notice, the tag and the plain name, then the sentences."""
    def rule(label: str, keyword: str, pattern: str, priority: int) -> Rule:
        return Rule(label, keyword.encode(), re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), priority)

    out = []
    for label, keyword, name in _NAMES:
        out.append(rule(label, keyword, rf"(?:licensed|distributed|released|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})", NOTICE))
        out.append(rule(label, keyword, rf"spdx licen[sc]e identifier (?:{name})", NOTICE))
        out.append(rule(label, keyword, name, NAME))
    return tuple(out + [rule(*s) for s in _SENTENCES])


@dataclass(frozen=True)
class Scan:
    n_words: int
    n_base: int
    first: int | None
    last: int | None
    base_labels: str
    labels: str
    score: float
    spans: list[tuple[int, int, str, int]]  # start word, end word, label, priority


def normal(text: bytes) -> tuple[bytes, int]:
    words = text.lower().translate(_WORD).split()
    return b" " + b" ".join(words) + b" ", len(words)


def _number(flat: bytes, at: list[int]) -> list[int]:
    """Word numbers of ascending byte places."""
    out, word, done = [], -1, 0
    for p in at:
        word, done = word + flat.count(b" ", done, p), p
        out.append(word)
    return out


def scan(text: bytes) -> Scan:
    flat, n = normal(text)
    starts, base = [], set()
    for phrase, label in BASE:
        sought = f" {phrase} ".encode()
        at = flat.find(sought)
        while at >= 0:
            starts.append(at + 1)
            base.add(label)
            at = flat.find(sought, at + 1)
    starts.sort()
    numbers = _number(flat, starts)
    spans = []
    for r in rules():
        if r.keyword in flat:
            found = [(m.start(), m.end()) for m in r.pattern.finditer(flat)]
            first = _number(flat, [s for s, _ in found])
            spans += [(a, a + flat.count(b" ", s, e) + 1, r.label, r.priority) for a, (s, e) in zip(first, found, strict=True)]
    kept = _uncontained(spans)
    missing = 1.0
    for label in {k[2] for k in kept}:
        missing *= 1 - max(WEIGHT[k[3]] for k in kept if k[2] == label)
    if base:
        missing *= 0.05
    labels = base | {k[2] for k in kept}
    return Scan(n, len(starts), min(numbers, default=None), max(numbers, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                1 - missing, kept)


def _uncontained(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections without those inside another of the same or a higher priority (equal intervals: the first rule stays)."""
    kept: list[tuple[int, int, str, int]] = []
    reach = [-1] * (TEXT + 1)  # by priority, the furthest end of what starts no later
    for s in sorted(spans, key=lambda s: (s[0], -s[1], -s[3])):
        if max(reach[s[3]:]) < s[1]:
            kept.append(s)
            reach[s[3]] = s[1]
    return kept


def licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and the detections as
    ``spans`` array<struct<start, end, label, priority>>.

    Null and empty texts have no words, empty label lists, null first and last word and score zero. Rows keep their
    number; an empty table gives no rows; no row leaves its task.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType())]))
    fields = [("id", docs.schema[id_column].dataType), ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()),
              ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", span)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))]

    def run(batches):
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            columns = [[s.n_words for s in got], [s.n_base for s in got], [s.first for s in got], [s.last for s in got], [s.base_labels for s in got],
                       [s.labels for s in got], [s.score for s in got],
                       [[{"start": a, "end": e, "label": x, "priority": p} for a, e, x, p in s.spans] for s in got]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]], schema.fieldNames())
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(run, schema)
