"""License scans by ordered signature rules.

A text is scanned as its words: A-Z lower-cased, a word is a run of ASCII
letters, digits and non-ASCII characters; words stand for themselves, one blank
between two.  Every rule is a regular expression over that form with a label,
a priority and the words that any match must contain.  A rule runs only on a text whose
words include them all (the keyword prefilter: rules are indexed by their rarest
required word, so a text without such words runs no rule).

All matches of all rules that ran are detections, intervals of words.  They are
taken in order of priority, then length, then rule order; one whose interval lies
inside an interval already kept is suppressed.  Detections that only overlap both stay.

Base phrases (fixed by the contract of op3) are reported beside the detections
and never suppressed.

Edge cases: null or empty texts have no words, no places, empty label
strings and score 0; a null id stays null; repeated rows are scanned alike; an empty
table gives an empty result; other columns are ignored; texts are scanned whole,
one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.llm.decontam import PLAIN_TABLE

#: Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Hand-written license families: label, name as words (a regular expression
#: whose literal words are required), confidence of the bare name.
FAMILIES = [
    ("gpl-1.0", "gnu general public license (?:version|v) 1", 0.9),
    ("gpl-2.0", "gnu general public license (?:version|v) 2", 0.9),
    ("gpl-3.0", "gnu general public license (?:version|v) 3", 0.9),
    ("gpl-2.0", "gpl v2", 0.8), ("gpl-3.0", "gpl v3", 0.8), ("gpl-2.0", "gplv2", 0.8), ("gpl-3.0", "gplv3", 0.8),
    ("gpl", "gnu general public license", 0.8), ("gpl", "gnu gpl", 0.7),
    ("lgpl-2.1", "gnu lesser general public license (?:version|v) 2 1", 0.9),
    ("lgpl-3.0", "gnu lesser general public license (?:version|v) 3", 0.9),
    ("lgpl", "gnu lesser general public license", 0.8), ("lgpl", "gnu library general public license", 0.8),
    ("agpl-3.0", "gnu affero general public license (?:version|v) 3", 0.9), ("agpl", "gnu affero general public license", 0.8),
    ("gfdl", "gnu free documentation license", 0.8),
    ("apache-1.1", "apache (?:software )?license version 1 1", 0.9), ("apache-2.0", "apache license version 2 0", 0.9),
    ("apache-2.0", "apache license 2 0", 0.9), ("apache-2.0", "apache 2 0 license", 0.9), ("apache", "apache license", 0.7),
    ("apache", "apache software license", 0.8),
    ("mit", "mit license", 0.8), ("mit", "x11 license", 0.7), ("mit-0", "mit no attribution license", 0.9),
    ("expat", "expat license", 0.8), ("isc", "isc license", 0.8),
    ("bsd-2-clause", "(?:2|two) clause bsd license", 0.9), ("bsd-2-clause", "simplified bsd license", 0.9), ("bsd-2-clause", "freebsd license", 0.8),
    ("bsd-3-clause", "(?:3|three) clause bsd license", 0.9), ("bsd-3-clause", "new bsd license", 0.9), ("bsd-3-clause", "modified bsd license", 0.9),
    ("bsd-4-clause", "(?:4|four) clause bsd license", 0.9), ("bsd-0-clause", "zero clause bsd license", 0.9), ("bsd", "bsd license", 0.7),
    ("mpl-1.1", "mozilla public license (?:version )?1 1", 0.9), ("mpl-2.0", "mozilla public license (?:version )?2 0", 0.9),
    ("mpl", "mozilla public license", 0.8),
    ("epl-1.0", "eclipse public license (?:version )?1 0", 0.9), ("epl-2.0", "eclipse public license (?:version )?2 0", 0.9),
    ("epl", "eclipse public license", 0.8), ("cddl", "common development and distribution license", 0.9),
    ("cpl-1.0", "common public license", 0.8), ("eupl", "european union public licen[cs]e", 0.9), ("cecill", "cecill free software license", 0.9),
    ("artistic-2.0", "artistic license 2 0", 0.9), ("artistic", "artistic license", 0.7), ("zlib", "zlib license", 0.8),
    ("boost-1.0", "boost software license", 0.9), ("python-2.0", "python software foundation license", 0.9), ("php-3.01", "php license", 0.7),
    ("ruby", "ruby license", 0.6), ("openssl", "openssl license", 0.8), ("unlicense", "the unlicense", 0.8), ("wtfpl", "wtfpl", 0.8),
    ("ms-pl", "microsoft public license", 0.9), ("ms-rl", "microsoft reciprocal license", 0.9), ("odbl", "open database license", 0.8),
    ("odc-by", "open data commons attribution license", 0.9), ("pddl", "public domain dedication and license", 0.8),
    ("ofl-1.1", "sil open font license", 0.9), ("elastic-2.0", "elastic license", 0.7), ("sspl", "server side public license", 0.9),
    ("busl-1.1", "business source license", 0.9), ("openrail", "openrail m license", 0.8),
    ("cc0", "cc0", 0.8), ("cc0", "creative commons zero", 0.9), ("public-domain", "public domain", 0.4),
    ("cc-by-nc-nd", "cc by nc nd", 0.8), ("cc-by-nc-sa", "cc by nc sa", 0.8), ("cc-by-nc", "cc by nc", 0.8),
    ("cc-by-nd", "cc by nd", 0.8), ("cc-by-sa", "cc by sa", 0.8), ("cc-by", "cc by", 0.6),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", 0.9), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", 0.9), ("cc-by-nc-4.0", "cc by nc 4 0", 0.9),
    ("cc-by-nd-4.0", "cc by nd 4 0", 0.9), ("cc-by-sa-4.0", "cc by sa 4 0", 0.9), ("cc-by-4.0", "cc by 4 0", 0.9),
    ("cc-by-nc-3.0", "cc by nc 3 0", 0.9), ("cc-by-sa-3.0", "cc by sa 3 0", 0.9), ("cc-by-3.0", "cc by 3 0", 0.9),
    ("cc-by-nc-nd", "creative commons attribution noncommercial no ?derivatives", 0.9),
    ("cc-by-nc-sa", "creative commons attribution noncommercial share ?alike", 0.9),
    ("cc-by-nc", "creative commons attribution noncommercial", 0.9), ("cc-by-sa", "creative commons attribution share ?alike", 0.9),
    ("cc-by-nd", "creative commons attribution no ?derivatives", 0.9), ("cc-by", "creative commons attribution", 0.8),
]

#: How a license is granted: phrase around the name, priority (lower goes
#: first), confidence added.
GRANTS = [("(?:is |are )?(?:licensed|released|distributed|published|provided) under (?:the )?(?:terms of )?(?:the )?{}", 1, 0.08),
          ("subject to the (?:terms (?:and conditions )?of the )?{}", 1, 0.06),
          ("(?:redistribute it|modify it|copy it|use this (?:file|work|software)) under the (?:terms of the )?{}", 1, 0.08),
          ("{}", 3, 0.0)]

#: Rules of their own: label, expression, priority, confidence.
SINGLE = [("spdx", "spdx license identifier [^ ]+(?: [0-9]+)*", 0, 1.0),
          ("all-rights-reserved", "all rights reserved", 2, 0.6),
          ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 2, 0.5),
          ("warranty-disclaimer", "without warranties or conditions of any kind", 2, 0.7),
          ("warranty-disclaimer", "provided as is without warranty of any kind", 2, 0.7),
          ("proprietary", "proprietary and confidential", 2, 0.7),
          ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
          ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
          ("isc", "permission to use copy modify and or distribute this software for any purpose", 1, 0.95)]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float

    @property
    def required(self) -> frozenset[str]:
        """Literal words outside of groups and classes."""
        plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", " ", self.pattern)
        return frozenset(w for w in plain.split() if re.fullmatch("[a-z0-9]+", w))


def rules() -> list[Rule]:
    """Every family under every grant, then the single rules: hundreds of
    expressions, in order of priority."""
    made = [Rule(label, grant.format(name), priority, round(min(1.0, sure + more), 2))
            for grant, priority, more in GRANTS for label, name, sure in FAMILIES]
    return sorted(made + [Rule(*x) for x in SINGLE], key=lambda r: r.priority)


class Scanner:
    """Compiled rules with their keyword index; one per task."""

    def __init__(self, all_rules: list[Rule]):
        self.rules = all_rules
        self.compiled = [re.compile(rb"(?<![^ ])(?:" + r.pattern.encode() + rb")(?![^ ])") for r in all_rules]
        needs = [frozenset(w.encode() for w in r.required) for r in all_rules]
        if not all(needs):
            raise ValueError("every rule needs a literal word")
        uses: dict[bytes, int] = {}
        for need in needs:
            for w in need:
                uses[w] = uses.get(w, 0) + 1
        self.index: dict[bytes, list[tuple[int, frozenset[bytes]]]] = {}
        for i, need in enumerate(needs):
            self.index.setdefault(min(need, key=lambda w: (len(w) < 3, uses[w], w)), []).append((i, need))
        self.keys = self.index.keys()
        self.base = [(p.encode(), re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in BASE]

    def places(self, joined: bytes) -> list[tuple[int, str]]:
        """Start word and label of every place of a base phrase."""
        return [(joined.count(b" ", 0, m.start()), label)
                for phrase, expression, label in self.base if phrase in joined for m in expression.finditer(joined)]

    def detections(self, joined: bytes, words: set[bytes]) -> list[tuple[int, int, int]]:
        """(rule, first word, word after the last) of the kept detections, in the order they were kept."""
        found = []
        for key in self.keys & words:
            for i, need in self.index[key]:
                if need <= words:
                    for m in self.compiled[i].finditer(joined):
                        start = joined.count(b" ", 0, m.start())
                        found.append((self.rules[i].priority, -(n := m[0].count(b" ") + 1), i, start, start + n))
        kept: list[tuple[int, int, int]] = []
        for _, _, i, a, b in sorted(found):
            if not any(x <= a and b <= y for _, x, y in kept):
                kept.append((i, a, b))
        return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """One row per text: doc_id, n_words, places (start word and label of each
    base place), detections (label, first and last word, confidence)."""
    all_rules = rules() if all_rules is None else all_rules
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    detection = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(all_rules)
        for batch in X.slices(batches, "text"):
            counts, places, found = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").translate(PLAIN_TABLE).split(b" ")
                words = [w for w in words if w]
                seen = set(words)
                counts.append(len(words))
                if scanner.keys & seen:
                    joined = b" ".join(words)
                    places.append([{"start": a, "label": label} for a, label in sorted(scanner.places(joined))])
                    found.append([{"label": scanner.rules[i].label, "first": a, "last": b - 1, "confidence": scanner.rules[i].confidence}
                                  for i, a, b in scanner.detections(joined, seen)])
                else:
                    places.append([])
                    found.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(place)),
                                              pa.array(found, pa.list_(detection))], ["doc_id", "n_words", "places", "detections"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, places array<struct<start:long,label:string>>, "
             "detections array<struct<label:string,first:long,last:long,confidence:double>>")


def report(scans: DataFrame) -> DataFrame:
    """The digest columns of op3."""
    base, own = F.col("places.label"), F.col("detections.label")
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return scans.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
                        F.array_max("places.start").alias("last_word"), joined(base).alias("base_labels"),
                        joined(F.concat(base, own)).alias("labels"),
                        F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)).alias("score"),
                        F.size("detections").cast("long").alias("n_detections"))
