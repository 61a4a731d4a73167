"""License statements in texts: ordered signature rules behind a keyword filter, overlaps settled by priority.

A text is read as lower-case words joined by single blanks. Every rule is a regular expression over that form, with the
words it cannot match without; a rule is tried only on texts that hold them all. Where detections overlap, one that lies
inside another of the same or a higher priority is suppressed, so "gnu lesser general public license v2.1" yields one
label. Phrases are literal word sequences that are reported wherever they stand, whatever surrounds them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.license_texts import SIGNATURES
from shelfline.llm.text import LOWER, NOT_ALNUM

# License families as (label, names, versions). Names are patterns over words; a version is appended to
# the label with a hyphen.
FAMILIES = [
    ("gpl", ["(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl"], ["2.0", "2.1", "3.0"]),
    ("agpl", ["(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl"], ["1.0", "3.0"]),
    ("gfdl", ["(?:gnu )?free documentation licen[cs]e", "(?:gnu )?gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache(?: software)? licen[cs]e"], ["1.0", "1.1", "2.0"]),
    ("mpl", ["mozilla public licen[cs]e"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public licen[cs]e"], ["1.0", "2.0"]),
    ("cddl", ["common development and distribution licen[cs]e"], ["1.0", "1.1"]),
    ("eupl", ["european union public licen[cs]e"], ["1.0", "1.1", "1.2"]),
    ("cpl", ["common public licen[cs]e"], ["1.0"]),
    ("osl", ["open software licen[cs]e"], ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free licen[cs]e"], ["1.1", "2.0", "2.1", "3.0"]),
    ("artistic", ["artistic licen[cs]e"], ["1.0", "2.0"]),
    ("bsl", ["boost software licen[cs]e"], ["1.0"]),
    ("busl", ["business source licen[cs]e"], ["1.1"]),
    ("ofl", ["sil open font licen[cs]e"], ["1.0", "1.1"]),
    ("lppl", ["latex project public licen[cs]e"], ["1.0", "1.3"]),
    ("cc-by", ["creative commons (?:attribution|by)", "cc (?:attribution|by)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", ["creative commons (?:attribution|by) (?:share ?alike|sa)", "cc (?:attribution|by) (?:share ?alike|sa)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", ["creative commons (?:attribution|by) (?:non ?commercial|nc)", "cc (?:attribution|by) (?:non ?commercial|nc)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", ["creative commons (?:attribution|by) (?:no ?deriv(?:ative)?s|nd)", "cc (?:attribution|by) (?:no ?deriv(?:ative)?s|nd)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-sa", ["creative commons (?:attribution|by) (?:non ?commercial|nc) (?:share ?alike|sa)", "cc (?:attribution|by) (?:non ?commercial|nc) (?:share ?alike|sa)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-nd", ["creative commons (?:attribution|by) (?:non ?commercial|nc) (?:no ?deriv(?:ative)?s|nd)", "cc (?:attribution|by) (?:non ?commercial|nc) (?:no ?deriv(?:ative)?s|nd)"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc0", ["creative commons zero", "cc zero", "cc0"], ["1.0"]),
    ("bsd-2-clause", ["(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd (?:2|two) clause(?: licen[cs]e)?"], []),
    ("bsd-3-clause", ["(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd (?:3|three) clause(?: licen[cs]e)?"], []),
    ("bsd-4-clause", ["(?:original|4 clause|four clause) bsd licen[cs]e", "bsd (?:4|four) clause(?: licen[cs]e)?"], []),
    ("bsd", ["bsd licen[cs]e"], []),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e"], []),
    ("isc", ["isc licen[cs]e"], []),
    ("zlib", ["zlib(?: libpng)? licen[cs]e"], []),
    ("unlicense", ["the unlicen[cs]e"], []),
    ("wtfpl", ["wtfpl"], ["2.0"]),
    ("postgresql", ["postgresql licen[cs]e"], []),
    ("python", ["python software foundation licen[cs]e", "psf licen[cs]e"], ["2.0"]),
    ("php", ["php licen[cs]e"], ["3.0", "3.01"]),
    ("ruby", ["ruby licen[cs]e"], []),
    ("openssl", ["openssl licen[cs]e"], []),
    ("curl", ["curl licen[cs]e"], []),
    ("odbl", ["open database licen[cs]e"], ["1.0"]),
    ("odc-by", ["open data commons attribution licen[cs]e"], ["1.0"]),
    ("pddl", ["public domain dedication and licen[cs]e"], ["1.0"]),
    ("ecl", ["educational community licen[cs]e"], ["1.0", "2.0"]),
    ("ms-pl", ["microsoft public licen[cs]e"], []),
    ("ms-rl", ["microsoft reciprocal licen[cs]e"], []),
    ("sspl", ["server side public licen[cs]e"], ["1.0"]),
    ("openrail", ["openrail(?: m)?(?: licen[cs]e)?", "open rail(?: m)?(?: licen[cs]e)?"], []),
]

# Sentences of license bodies and notices that name no license
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions? of source code must retain the above copyright notice"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(?:released|dedicated|placed)(?: in| into| to) the public domain"),
    ("proprietary", "all rights reserved"),
]

# What each form of statement is worth: priority and certainty
TAG, NOTICE, VERSIONED, BODY, NAME = (5, 1.0), (4, 0.95), (3, 0.85), (2, 0.8), (1, 0.6)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    words: frozenset[str]
    priority: int
    certainty: float


def _required(pattern: str) -> frozenset[str]:
    """Plain words a pattern cannot match without: those outside groups, options and classes."""
    bare, depth = [], 0
    for token in re.findall(r"\(\?:|\)\??|[^\s()]*?\[[^]]*\][^\s()]*|[^\s()]+\??| ", pattern):
        if token == "(?:":
            depth += 1
        elif token[0] == ")":
            depth -= 1
        elif depth == 0 and re.fullmatch(r"[a-z0-9]+", token):
            bare.append(token)
    return frozenset(bare)


def _rule(label: str, pattern: str, worth: tuple[int, float]) -> Rule:
    return Rule(label, re.compile(f"(?<= ){pattern}(?= )"), _required(pattern), *worth)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: for each family and version a tag, a notice and a title, then names alone, then sentences and
    the signatures of license texts."""
    granted = "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a )?(?:terms of )?(?:the )?"
    out = []
    for label, names, versions in FAMILIES:
        tag = label.replace("-", " ")
        for version in versions:
            major, _, minor = version.partition(".")
            tail = f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?"
            number = f"(?: version| ver| v)? v?{tail}(?: or later| only| international| unported| license)?"
            out.append(_rule(f"{label}-{version}", f"spdx license identifier {tag} {tail}(?: only| or later)?", TAG))
            for name in names:
                out.append(_rule(f"{label}-{version}", f"{granted}{name}{number}", NOTICE))
                out.append(_rule(f"{label}-{version}", f"{name}{number}", VERSIONED))
        out.append(_rule(label, f"spdx license identifier {tag}", TAG))
        for name in names:
            out.append(_rule(label, f"{granted}{name}", (NOTICE[0] - 2, NOTICE[1])))
            if "licen" in name or label in {"cc0", "wtfpl"}:
                out.append(_rule(label, name, NAME))
    out += [_rule(label, sentence, BODY) for label, sentence in SENTENCES]
    out += [_rule(label, pattern, BODY) for label, pattern, _, _ in SIGNATURES]
    if any(not rule.words for rule in out):
        raise ValueError("a rule without a word of its own would be tried on every text")
    return tuple(out)


# Bytes that are no part of a word become blanks, A-Z small letters
_PLAIN = bytes(np.where(NOT_ALNUM[LOWER], 0x20, LOWER).astype(np.uint8))


class Scanner:
    """Finds rules and phrases in texts. `phrases` maps word sequences to labels."""

    def __init__(self, phrases: dict[str, str]) -> None:
        self.rules = rules()
        self.phrases = [(f" {phrase} ", frozenset(phrase.split()), label, len(phrase.split())) for phrase, label in phrases.items()]
        self.gates = frozenset(w.encode() for words in [r.words for r in self.rules] + [p[1] for p in self.phrases] for w in words)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, float, bool]]]:
        """(number of words, detections as (start word, end word, label, certainty, phrase?))."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
        present = self.gates.intersection(words)
        if not present:
            return len(words), []
        have = {w.decode() for w in present}
        tried = [r for r in self.rules if r.words <= have]
        literal = [p for p in self.phrases if p[1] <= have]
        if not tried and not literal:
            return len(words), []
        body = b" " + b" ".join(words) + b" "
        blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20)
        joined = body.decode("latin-1")  # one character per byte, so places are byte places
        hits = []
        for order, rule in enumerate(tried):
            for m in rule.pattern.finditer(joined):
                a, b = np.searchsorted(blanks, [m.start(), m.end()])
                hits.append((-rule.priority, int(a) - 1, -int(b), order, rule))
        found = [(a, -b, rule.label, rule.certainty, False) for _, a, b, _, rule in _kept(hits)]
        for phrase, _, label, size in literal:
            at = joined.find(phrase)
            while at >= 0:
                a = int(np.searchsorted(blanks, at))
                found.append((a, a + size, label, NAME[1], True))
                at = joined.find(phrase, at + 1)
        return len(words), sorted(found)


def _kept(hits: list[tuple]) -> list[tuple]:
    """Hits that lie in no kept hit of their own or a higher priority; of equal intervals the first rule stays."""
    kept: list[tuple] = []
    starts: list[int] = []
    reach: list[int] = []
    for priority in sorted({h[0] for h in hits}):
        fresh = []
        furthest = -1
        for hit in sorted((h for h in hits if h[0] == priority), key=lambda h: h[1:4]):
            a, b = hit[1], -hit[2]
            i = bisect_right(starts, a)
            if b <= furthest or (i and reach[i - 1] >= b):
                continue
            furthest = max(furthest, b)
            fresh.append(hit)
        kept += fresh
        spans = sorted((h[1], -h[2]) for h in kept)
        starts = [a for a, _ in spans]
        reach = np.maximum.accumulate([b for _, b in spans]).tolist() if spans else []
    return kept


SCHEMA = "n_words long, found array<struct<start: long, end: long, label: string, certainty: double, phrase: boolean>>"


def scan(docs: DataFrame, phrases: dict[str, str], text_col: str = "text", into: str = "licenses") -> DataFrame:
    """Adds a struct column: the number of words of the text and all detections, in order of their place.

    A null text has no words, an empty one neither; texts of any length are scanned whole. Rows are independent of each
    other, and repeated ones get the same; of rules that find the same interval the first counts. An empty table gives an
    empty one; a column of the new name is replaced.
    """

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases)
        for series in texts:
            rows = []
            for text in series:
                n, found = scanner.scan(text if isinstance(text, str) else None)
                rows.append((n, [dict(zip(("start", "end", "label", "certainty", "phrase"), f, strict=True)) for f in found]))
            yield pd.DataFrame(rows, columns=["n_words", "found"])

    read.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(into, F.pandas_udf(read, SCHEMA)(F.col(text_col)))
