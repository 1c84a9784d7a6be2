"""License scan by sentence rules.

A text is cut into sentences; each is normalised (lower case, one space, plain quotes, no comment marks before
its lines, no punctuation at its ends) and looked up among known licence sentences, which gives a sequence of sentence identifiers.
Ordered rules, longest first, consume runs of that sequence and name licences.  A sentence that speaks of a
licence without being known is ``unknown``; one that a rule left over is reported by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences (full-match patterns over normalised sentences) by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("copyright", r"(?:copyright|\(c\)|©)(?: \(c\)| ©)?(?: \d{4}(?: ?[-,] ?\d{4})*)?(?: .{1,120})?"),
    ("all-rights", r"all rights (?:are )?reserved"),
    ("mit-ref", r"(?:this .{1,60} is )?(?:released|licensed|distributed|available) under the (?:terms of the )?(?:mit|expat) licen[sc]e"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  r"documentation files .{1,400}"),
    ("mit-notice", r"the above copyright notice and this permission notice .{0,20}shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided \"?as is\"?, without warranty of any kind.{0,300}"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable.{0,300}"),
    ("isc-grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted.{0,200}"),
    ("apache2-ref", r"(?:this .{1,60} is )?licensed under the apache licen[sc]e,? version 2(?:\.0)?(?: \(the \"?license\"?\))?"),
    ("apache2-limit", r"you may not use this file except in compliance with the license"),
    ("apache2-copy", r"you may obtain a copy of the license at.{0,100}"),
    ("apache2-warranty", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "
                         r"\"?as is\"? basis.{0,200}"),
    ("apache-other", r"(?:this .{1,60} is )?licensed under the apache licen[sc]e(?:,? version \d(?:\.\d)?)?"),
    ("bsd-head", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:1\.? |\* )?redistributions of source code must retain the above copyright notice.{0,200}"),
    ("bsd-binary", r"(?:2\.? |\* )?redistributions in binary form must reproduce the above copyright notice.{0,250}"),
    ("bsd-endorse", r"(?:3\.? |\* )?neither the name of .{1,150} may be used to endorse or promote products.{0,200}"),
    ("bsd-warranty", r"this software is provided by .{1,100}\"?as is\"? and any express or implied warranties.{0,300}"),
    ("bsd-ref", r"(?:this .{1,60} is )?(?:released|licensed|distributed) under the (?:(?:new|simplified|[234]-clause) )?bsd licen[sc]e"),
    ("gpl-3", r"(?:this .{1,60} is )?licensed under the gnu (?:general )?public licen[sc]e,? (?:version |v)3(?:\.0)?"),
    ("gpl-2", r"(?:this .{1,60} is )?licensed under the gnu (?:general )?public licen[sc]e,? (?:version |v)2(?:\.0)?"),
    ("gpl-other", r"(?:this .{1,60} is )?licensed under the gnu (?:general )?public licen[sc]e(?:,? (?:version |v)\d(?:\.\d)?)?"),
    ("gpl-free", r"this program is free software.{0,20}you can redistribute it and/or modify it under the terms of the gnu general public license as "
                 r"published by the free software foundation.{0,120}"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful, but without any warranty.{0,200}"),
    ("gpl-copy", r"you should have received a copy of the gnu general public license along with this program.{0,200}"),
    ("lgpl-ref", r"(?:this .{1,60} is )?licensed under the gnu lesser general public licen[sc]e.{0,40}"),
    ("agpl-ref", r"(?:this .{1,60} is )?licensed under the gnu affero general public licen[sc]e.{0,40}"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("cc-by", r"(?:this .{1,60} is )?licensed under (?:a )?(?:cc|creative commons) (?:by|attribution) ?(?P<version>\d\.\d)?(?: (?:international )?licen[sc]e)?"),
    ("cc-by-sa", r"(?:this .{1,60} is )?licensed under (?:a )?(?:cc|creative commons) (?:by-sa|attribution-sharealike) ?(?P<version>\d\.\d)?(?: .{0,30})?"),
    ("cc-by-nc", r"(?:this .{1,60} is )?licensed under (?:a )?(?:cc|creative commons) (?:by-nc|attribution-noncommercial) ?(?P<version>\d\.\d)?(?: .{0,30})?"),
    ("cc-by-nc-sa", r"(?:this .{1,60} is )?licensed under (?:a )?(?:cc|creative commons) (?:by-nc-sa|attribution-noncommercial-sharealike) ?(?P<version>\d\.\d)?(?: .{0,30})?"),
    ("cc-by-nc-nd", r"(?:this .{1,60} is )?licensed under (?:a )?(?:cc|creative commons) (?:by-nc-nd|attribution-noncommercial-noderivatives) ?(?P<version>\d\.\d)?(?: .{0,30})?"),
    ("cc0", r"(?:this .{1,60} is )?(?:released|licensed|dedicated|placed) (?:under|to|in) (?:cc0|the public domain)(?: ?1\.0)?"),
    ("spdx", r"spdx-license-identifier: ?(?P<version>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
]

# Ordered rules, (licence, the sentence identifiers in a row that establish it); ? marks an optional one.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-ref", "apache2-limit", "apache2-copy", "apache2-warranty"]),
    ("GPL", ["gpl-free", "gpl-hope", "gpl-copy?"]),  # the version is read from the sentence
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty?"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-warranty?"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty?", "mit-liability?"]),
    ("MIT", ["mit-ref"]),
    ("MIT-grant-only", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache", ["apache-other"]),
    ("BSD", ["bsd-ref"]),
    ("BSD-partial", ["bsd-head"]),
    ("GPL-3.0", ["gpl-3"]),
    ("GPL-2.0", ["gpl-2"]),
    ("GPL", ["gpl-other"]),
    ("GPL", ["gpl-free"]),
    ("LGPL", ["lgpl-ref"]),
    ("AGPL", ["agpl-ref"]),
    ("MPL-2.0", ["mpl-2"]),
    ("CC-BY", ["cc-by"]),
    ("CC-BY-SA", ["cc-by-sa"]),
    ("CC-BY-NC", ["cc-by-nc"]),
    ("CC-BY-NC-SA", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND", ["cc-by-nc-nd"]),
    ("CC0-1.0", ["cc0"]),
    ("SPDX", ["spdx"]),
    ("all-rights-reserved", ["copyright?", "all-rights"]),
]

CUE = re.compile(r"licen[sc]|copyright|©|\(c\)|rights|permission|warrant|redistribut|public domain|cc0|spdx|free software|\bas is\b", re.I)
ABOUT = re.compile(r"\blicen[sc]e[ds]?\b|\blicensing\b|\bcopyright(?:ed)?\b")
_END = re.compile(r"(?<=[.!?:;])\s+(?=[\"'(*A-Z0-9])|\n")
_KNOWN = [(name, re.compile(p, re.S)) for name, p in SENTENCES]
_MARKS = re.compile(r"^[ \t]*(?:(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--+|\brem\b)[ \t]*)+", re.M)
# First words of known sentences whose cue may be on a later line.
_OPENS = re.compile(r"in no event|neither the name|you may|you should have|unless required|this (?:program|software|source code)")
# Sentences with a free end, which is taken in up to the full stop.
_OPEN_END = re.compile(r".*-(?:grant|notice|warranty|liability|copy|hope|free|source|binary|endorse)")
_GPL_VERSION = re.compile(r"version (\d)")
# No sentence that runs over lines is longer: copyright lines and SPDX tags, which may be, stand on one line.
WIDEST = 1000


def normalise(sentence: str) -> str:
    s = sentence.lower().replace("“", '"').replace("”", '"').replace("’", "'").replace("`", "'")
    return " ".join(_MARKS.sub("", s).split()).strip(" .,;:!#/-*")


def _new_paragraph(text: str, before: int, start: int, end: int) -> bool:
    """Is there a blank line between the fragments that begin at ``before`` and at ``start``, or is the second one a blank
    line but for comment marks?"""
    first = text[before:start]
    return (first[len(first.rstrip()):].count("\n") > 1
            or (text[end - 1] == "\n" and not normalise(text[text.rfind("\n", 0, start) + 1:end])))


def sentence_ids(text: str) -> list[tuple[str, str, int, int]]:
    """(identifier, version, start, end) of the licence sentences of ``text``, in order; unknown ones included.

    A licence may run over a line end, so where one line is not known by itself it is tried with the lines after
    it, up to the end of its paragraph (a blank line, or one with comment marks only)."""
    out: list[tuple[str, str, int, int]] = []
    marks = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    parts = [(s, e) for s, e in zip(marks, marks[1:]) if e > s]
    k = 0
    while k < len(parts):
        start, end = parts[k]
        if not CUE.search(text, start, end) and not _OPENS.match(normalise(text[start:end])):
            k += 1
            continue
        best = None
        for reach in range(k, len(parts)):
            stop = parts[reach][1]
            if reach > k and _new_paragraph(text, parts[reach - 1][0], *parts[reach]):
                break
            body = normalise(text[start:stop])
            if reach > k and len(body) > WIDEST:
                break
            name = next(((n, m) for n, p in _KNOWN if (m := p.fullmatch(body))), None)
            if name and (best is None or best[0][0] == "copyright"):
                best = (name, reach, stop)
                if name[0] != "copyright":
                    break
            if name and name[0] == "copyright":
                break
        if best is None:
            if ABOUT.search(normalise(text[start:end])):
                out.append(("unknown", "", start, end))
            k += 1
            continue
        (name, m), reach, stop = best
        while _OPEN_END.fullmatch(name) and reach + 1 < len(parts) and not text[start:stop].rstrip(" \t\r\n*/#\"'").endswith((".", "!", "?")):
            after = parts[reach + 1]
            longer = m.re.fullmatch(normalise(text[start:after[1]]))
            if longer is None or _new_paragraph(text, parts[reach][0], *after):
                break
            m, reach, stop = longer, reach + 1, after[1]
        version = m.groupdict().get("version") or ""
        if name == "gpl-free" and (found := _GPL_VERSION.search(m.string)):
            version = f"{found[1]}.0-or-later" if "later version" in m.string else f"{found[1]}.0-only"
        out.append((name, version, start, stop))
        k = reach + 1
    return out


def apply_rules(ids: list[tuple[str, str, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end): at each place the first rule that fits consumes its sentences."""
    out = []
    at = 0
    while at < len(ids):
        for licence, pattern in RULES:
            to = at
            for want in pattern:
                if to < len(ids) and ids[to][0] == want.rstrip("?"):
                    to += 1
                elif not want.endswith("?"):
                    to = -1
                    break
            if to > at:
                version = ids[at][1]
                name = version if licence == "SPDX" else f"{licence}-{version}" if version else licence
                out.append((name, ids[at][2], ids[to - 1][3]))
                at = to
                break
        else:
            if ids[at][0] == "unknown":
                out.append(("unknown", ids[at][2], ids[at][3]))
            at += 1
    return out


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, licences (array of license, start, end in order of place) and sentences (the identifiers) for
    every row.  Null, empty and licence-free texts get empty arrays; null keys and repeated rows each give a row;
    only ``key`` and ``text`` are read.  Offsets count code points, the end is exclusive."""
    found = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            licences, names = [], []
            for t in batch.column(1).to_pylist():
                ids = sentence_ids(t) if t and CUE.search(t) else []
                names.append([i[0] for i in ids])
                licences.append([{"license": n, "start": s, "end": e} for n, s, e in apply_rules(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(licences, found), pa.array(names, pa.list_(pa.string()))],
                                             ["id", "licenses", "sentences"])
    return (docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "id long, licenses array<struct<license:string,start:int,end:int>>, sentences array<string>")
            .withColumnRenamed("id", key))
