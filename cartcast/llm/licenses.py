"""License scan: ordered signature rules with a keyword gate.

A rule is a regular expression over the lower-cased (A-Z) UTF-8 bytes of a
text, with a label, a priority and a keyword, a single word or part of one,
that each of its matches contains. Rules run only on texts holding their keyword. Detections are taken by priority,
then by length; one lying inside a detection already taken is suppressed. The
base phrases are rules too, exempt from suppression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartcast.llm.words import ALNUM, FOLD, blocks, find_words

GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"  # between two words
BEFORE, AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Weight of a detection in the score, by priority (0 is the most specific).
WEIGHT = (0.95, 0.9, 0.75, 0.5, 0.3)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern[bytes]


def _rule(label: str, priority: int, keyword: str, body: str) -> Rule:
    """``body`` is written with a space for any gap between words, ``~`` where there may be none."""
    inner = body.encode().replace(b" ", GAP).replace(b"~", b"(?:" + GAP + b")?")
    return Rule(label, priority, keyword.encode(), re.compile(BEFORE + b"(?:" + inner + b")" + AFTER))


def _version(v: str) -> str:
    """``3.0`` also as ``3``; the dot may be any gap."""
    major, _, minor = v.partition(".")
    return f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}" if minor else major


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, most specific first; families are written out over their versions."""
    out: list[Rule] = []

    def add(label, priority, keyword, *bodies):
        out.extend(_rule(label, priority, keyword, b) for b in bodies)

    # Creative Commons: every element set and version, short and spelled out.
    spelled = {"by": "attribution", "sa": "share~alike", "nd": "no~deriv(?:ative)?s?", "nc": "non~commercial"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        name, long = "-".join(parts), " ".join(spelled[p] for p in parts)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc-{name}-{v}", 0, "cc", f"cc {' '.join(parts)} {_version(v)}")
            add(f"cc-{name}-{v}", 0, "commons", f"creative commons {long} {_version(v)}", f"creative commons {long} license {_version(v)}")
        add(f"cc-{name}", 2, "cc", f"cc {' '.join(parts)}")
        add(f"cc-{name}", 2, "commons", f"creative commons {long}")
    add("cc0-1.0", 0, "cc0", "cc0(?: 1 0)?", "cc0 universal")
    add("cc-other", 4, "commons", "creative commons(?: license)?")

    # GNU licenses: each version, alone or with later ones.
    for short, name, versions in (
        ("gpl", "general public license", ("1.0", "2.0", "3.0")),
        ("lgpl", "(?:lesser|library) general public license", ("2.0", "2.1", "3.0")),
        ("agpl", "affero general public license", ("1.0", "3.0")),
        ("gfdl", "free documentation license", ("1.1", "1.2", "1.3")),
    ):
        for v in versions:
            n = _version(v)
            for label, tail in ((f"{short}-{v}-or-later", " (?:or|and)(?: at your option)?(?: any)? later"), (f"{short}-{v}", "")):
                first = 0 if tail else 1
                add(label, first, "license", f"(?:gnu )?{name}(?: as published by the free software foundation)?(?: either)?(?: version| v)? {n}(?: of the license)?{tail}")
                add(label, first, short, f"{short}~v?{n}{tail}", f"{short} version {n}{tail}")
        add(short, 2, "license", f"gnu {name}")
        add(short, 3, short, f"gnu {short}", f"{short} license")

    # Versioned families: long names and abbreviations.
    for label, keyword, names, versions in (
        ("apache", "apache", ("apache license", "apache software license", "apache"), ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", ("mozilla public license",), ("1.0", "1.1", "2.0")),
        ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", ("eclipse public license",), ("1.0", "2.0")),
        ("eupl", "european", ("european union public licen[cs]e",), ("1.0", "1.1", "1.2")),
        ("cddl", "development", ("common development and distribution license",), ("1.0", "1.1")),
        ("cpl", "common", ("common public license",), ("1.0",)),
        ("artistic", "artistic", ("artistic license",), ("1.0", "2.0")),
        ("bsl", "boost", ("boost software license",), ("1.0",)),
        ("osl", "open", ("open software license",), ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic", ("academic free license",), ("1.1", "2.0", "2.1", "3.0")),
        ("ofl", "font", ("sil open font license", "open font license"), ("1.0", "1.1")),
        ("odbl", "database", ("open database license",), ("1.0",)),
        ("lppl", "latex", ("latex project public license",), ("1.0", "1.1", "1.2", "1.3")),
        ("php", "php", ("php license",), ("3.0", "3.01")),
        ("python", "python", ("python software foundation license", "python license"), ("2.0",)),
        ("zpl", "zope", ("zope public license",), ("1.1", "2.0", "2.1")),
        ("ecl", "educational", ("educational community license",), ("1.0", "2.0")),
        ("cecill", "cecill", ("cecill(?: free software license agreement)?",), ("1.0", "1.1", "2.0", "2.1")),
    ):
        for name in names:
            for v in versions:
                add(f"{label}-{v}", 1, keyword, f"{name}(?: version| v)? {_version(v)}")
            add(label, 3, keyword, f"{name}" if name != "apache" else "apache licensed?")
    for n, words in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", 1, "bsd", f"bsd {n} clause", f"{n} clause bsd", f"{words} clause bsd")
    add("bsd-3-clause", 1, "bsd", "(?:new|modified|revised) bsd license")
    add("bsd-2-clause", 1, "bsd", "(?:simplified|freebsd) bsd license")
    add("bsd", 3, "bsd", "bsd(?: style)? licen[cs]ed?")
    add("bsd", 2, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted")

    # Single-text licenses: by name, and by a sentence of their text.
    add("mit", 1, "hereby", "permission is hereby granted free of charge to any person obtaining a copy")
    add("mit", 2, "mit", "mit licen[cs]e", "licen[cs]ed under the mit", "mit x11 licen[cs]e", "mit licen[cs]ed")
    add("isc", 1, "permission", "permission to use copy modify and or distribute this software for any purpose")
    add("isc", 2, "isc", "isc license")
    add("zlib", 2, "zlib", "zlib(?: libpng)? license")
    add("unlicense", 1, "unencumbered", "free and unencumbered software released into the public domain")
    add("unlicense", 2, "unlicense", "the unlicense")
    add("wtfpl", 2, "wtfpl", "wtfpl")
    add("ms-pl", 2, "microsoft", "microsoft public license")
    add("ms-rl", 2, "microsoft", "microsoft reciprocal license")
    add("openssl", 2, "openssl", "openssl license")
    add("postgresql", 2, "postgresql", "postgresql license")
    add("ncsa", 2, "illinois", "university of illinois ncsa open source license")
    add("w3c", 2, "w3c", "w3c software notice and license", "w3c license")
    add("curl", 2, "curl", "curl license")
    add("beerware", 2, "beer", "beer~ware license")
    add("public-domain", 2, "domain", "released into the public domain", "dedicated to the public domain", "is in the public domain")
    add("public-domain", 4, "domain", "public domain")

    # Identifiers as tools write them.
    for name in (
        "apache-2.0 mit bsd-2-clause bsd-3-clause isc mpl-2.0 epl-2.0 cc0-1.0 unlicense zlib bsl-1.0 artistic-2.0 "
        "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only "
        "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later"
    ).split():
        add(name, 0, "spdx", "spdx license identifier " + re.sub(r"[-.]", " ", name))

    # Notices that name no license.
    add("reserved", 2, "reserved", "(?:all|some|no) rights reserved", "all right reserved")
    add("reserved", 2, "droits", "tous droits réservés")
    add("reserved", 2, "rechte", "alle rechte vorbehalten")
    add("reserved", 2, "derechos", "todos los derechos reservados")
    add("copyright", 3, "copyright", "copyright(?: c)? [12][0-9]{3}", "copyright holders?", "copyright by")
    add("proprietary", 3, "proprietary", "proprietary and confidential", "confidential and proprietary")
    add("no-redistribution", 3, "permission", "without (?:the )?(?:express |prior )?(?:written )?permission")
    add("license-mention", 4, "licen", "licen[cs]ed under(?: the)?", "terms of the licen[cs]e", "licen[cs]e agreement")
    add("license-mention", 4, "released", "released under(?: the)?")
    return tuple(sorted(out, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def _by_keyword() -> tuple[tuple[bytes, tuple[Rule, ...]], ...]:
    words = dict.fromkeys(r.keyword for r in rules())
    return tuple((k, tuple(r for r in rules() if r.keyword == k)) for k in words)


@lru_cache(maxsize=1)
def _base() -> tuple[tuple[str, tuple[bytes, ...], re.Pattern[bytes]], ...]:
    return tuple(
        (label, tuple(phrase.encode().split()), re.compile(GAP.join(phrase.encode().split()) + AFTER))
        for phrase, label in BASE.items()
    )


_WORD_BYTE = ALNUM.tolist()


def base_places(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place of a base phrase in a lower-cased text."""
    found = []
    for label, words, pattern in _base():
        if all(w in text for w in words):
            for m in pattern.finditer(text):
                if m.start() == 0 or not _WORD_BYTE[text[m.start() - 1]]:
                    found.append((m.start(), m.end(), label))
    return found


def detect(text: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections left after suppression."""
    found = []
    for keyword, group in _by_keyword():
        if keyword in text:
            for r in group:
                found.extend((m.start(), m.end(), r.label, r.priority) for m in r.pattern.finditer(text))
    return outermost(found)


def outermost(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections that lie in none of those before them, by priority, then length, place and label.

    Of the ones taken, those inside another are of no use as containers; the
    rest have their starts and ends in the same order, so the last one that
    begins no later than a detection is the one that can contain it.
    """
    taken: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(set(found), key=lambda d: (d[3], d[0] - d[1], d[0], d[2])):
        at = bisect_right(starts, d[0])
        if at and ends[at - 1] >= d[1]:
            continue
        taken.append(d)
        at -= at > 0 and starts[at - 1] == d[0]  # begins there too and is shorter
        inside = bisect_right(ends, d[1], at)
        starts[at:inside], ends[at:inside] = [d[0]], [d[1]]
    return taken


def confidence(priorities: list[int]) -> float:
    """1 minus the chance that every detection is mistaken; 0 without any."""
    return float(1 - np.prod([1 - WEIGHT[p] for p in priorities])) if priorities else 0.0


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base phrases, labels, score and detections.

    ``first_word`` and ``last_word`` count words from 0; detections are byte
    spans of the text. A null text counts as empty: no words, no labels, score
    0. Repeated rows and null ids are scanned each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, out = batch.column(0).to_pylist(), 0, []
            for block in blocks(batch.column(1)):
                words = find_words(block, ALNUM, FOLD)
                data = block.data.tobytes().lower()
                for i in range(block.n):
                    begin = int(block.offsets[i])
                    text = data[begin : int(block.offsets[i + 1])]
                    places = base_places(text)
                    spans = detect(text)
                    base = sorted({p[2] for p in places})
                    first = last = None
                    if places:
                        zero = np.searchsorted(words.start, begin)
                        where = np.searchsorted(words.start, [begin + p[0] for p in places]) - zero
                        first, last = int(where.min()), int(where.max())
                    out.append(
                        {
                            "doc_id": ids[at],
                            "n_words": int(words.counts[i]),
                            "n_base": len(places),
                            "first_word": first,
                            "last_word": last,
                            "base_labels": ",".join(base),
                            "labels": ",".join(sorted({d[2] for d in spans} | set(base))),
                            "score": confidence([d[3] for d in spans] or [2] * len(base)),
                            "detections": [{"label": d[2], "start": d[0], "end": d[1]} for d in sorted(spans)],
                        }
                    )
                    at += 1
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, detections array<struct<label: string, start: long, end: long>>"
    )
    return source.mapInArrow(run, fields)
