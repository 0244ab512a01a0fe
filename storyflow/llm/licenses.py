"""License scans by an exact set-similarity join with prefix, length and positional filters.

A text block (a line, or a run of adjacent lines that have words) meets a template if it
holds at least ``threshold`` of the template's distinct words.  Template words are put
into one global order, rarest first, by the number of documents that hold them.  A
template of n words of which o are needed can only be met by a block that holds one of
its first n - o + 1 words in that order (prefix filter), that holds o template words at
all (length filter), and whose first shared word leaves enough words behind it on both
sides (positional filter).  The few pairs left are counted exactly.

A notice also has words that tell it from others: a block without them is another one's.  Of
notices of one family, which differ by a few words, the one that a block holds most words
of is meant.

Besides the templates, the fixed phrases are found wherever their words stand one after
another.  Templates are a library of bounded size, passed with the task; texts
are never shuffled.

Defined cases: a null text is empty and has no words; long texts are judged whole, in
time that grows with their length; a template without words meets nothing; repeated rows are judged alike; a null doc_id stays null; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Common notices: label, text, the words that tell it from other notices (all must be there), and the
#: family of notices that differ by a few words.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero", "gnu"),
    ("apache", "licensed under the apache license version 2 0", "apache", ""),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", ""),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions retain", ""),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution", "cc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", "creative commons noncommercial", "cc"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "cc"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives license", "creative commons noderivatives", "cc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "creative commons sharealike", "cc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", "cc"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public", "gnu"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted", ""),
    ("lgpl", "this library is licensed under the gnu lesser general public license", "gnu lesser", "gnu"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser", "gnu"),
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission granted charge", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted charge", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla", ""),
    ("reserved", "copyright all rights reserved", "copyright reserved", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
)

#: Lower-cases A-Z and turns all that parts words into spaces, but for line ends.
_TO_WORDS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or b == 10 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))


def _set(text: str) -> frozenset[bytes]:
    return frozenset(text.encode().translate(_TO_WORDS).split())


def _tokens(templates) -> list[tuple[str, frozenset[bytes]]]:
    """Labels and words of templates (label, text, and if they have them telling words and a family)."""
    out = [(t[0], _set(t[1])) for t in templates]
    return [x for x in out if x[1]]


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template word occurs: as many numbers as the library has words."""
    wanted = frozenset().union(*(t for _, t in _tokens(templates)))

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(wanted.intersection((text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["w", "c"])

    rows = docs.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
    return {bytes(r["w"]): r["c"] for r in rows}


class Index:
    """The prefix index of a library in a global order of words."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.templates = []
        words = sorted({w for _, t in _tokens(templates) for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(words)}
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        more = [(_set(" ".join(x[2:3])), "".join(x[3:4])) for x in templates if _set(x[1])]
        for (label, t), (telling, family) in zip(_tokens(templates), more):
            need = max(1, math.ceil(threshold * len(t) - 1e-9))
            ranked = sorted(t, key=self.order.__getitem__)
            for place, w in enumerate(ranked[: len(t) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.templates), place))
            self.templates.append((label, t, need, telling, family))

    def meets(self, block: list[bytes]) -> dict[str, float]:
        """The labels that a block meets, with the share of the template that it holds.

        It must hold a template's telling words; of a family the templates of which it holds the
        most words count."""
        held = sorted({w for w in block if w in self.order}, key=self.order.__getitem__)
        seen, met = set(), []
        for at, w in enumerate(held):
            for i, place in self.prefixes.get(w, ()):
                if i in seen:
                    continue
                label, t, need, telling, family = self.templates[i]
                if len(held) < need or 1 + min(len(t) - place - 1, len(held) - at - 1) < need:
                    continue
                seen.add(i)
                both = len(t.intersection(held))
                if both >= need and telling.issubset(held):
                    met.append((label, both, both / len(t), family))
        best: dict[str, int] = {}
        for _, both, _, family in met:
            best[family] = max(best.get(family, 0), both)
        out: dict[str, float] = {}
        for label, both, share, family in met:
            if not family or both == best[family]:
                out[label] = max(out.get(label, 0.0), share)
        return out


def _blocks(lines: list[bytes]):
    """The words of each line, and of each run of several adjacent lines that have words."""
    run: list[bytes] = []
    n = 0
    for line in [*lines, b""]:
        words = line.split()
        if words:
            yield words
            run += words
            n += 1
            continue
        if n > 1:
            yield run
        run, n = [], 0


def scan(docs: DataFrame, *, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each
    row of ``docs`` (doc_id, text).  The score is the largest share of a template that a
    block meeting it holds; a phrase counts as 1."""
    index = Index(templates, frequencies(docs, templates), threshold)
    rare = frozenset(index.prefixes)
    wanted = [(b" " + p.encode().translate(_TO_WORDS).strip() + b" ", label) for p, label in phrases.items()]

    def judge(text: str | None):
        plain = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)
        words = plain.split()
        n, starts, base, found = 0, [], set(), {}
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in wanted:
            at, seen, before = joined.find(phrase), 0, 0
            while at >= 0:
                before += joined.count(b" ", seen, at)  # words counted on from the last hit
                seen = at
                starts.append(before)
                base.add(label)
                n += 1
                at = joined.find(phrase, at + 1)
        if not rare.isdisjoint(words):
            for block in _blocks(plain.split(b"\n")):
                if not rare.isdisjoint(block):
                    for label, share in index.meets(block).items():
                        found[label] = max(found.get(label, 0.0), share)
        score = 1.0 if base else max(found.values(), default=0.0)
        return len(words), n, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, phrases and licenses."""
    return scan(common.table(spark, sf_dir, "documents"))


_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = f"list_filter(regexp_split_to_array({_LOW}, '{_GAP}'), lambda w: w <> '')"

#: The same rows by comparing every block with every template.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_LIST.format("t")} AS w FROM d),
ph(p, label) AS (VALUES {", ".join(f"('{p}', '{v}')" for p, v in PHRASES.items())}),
pl AS (SELECT p, label, string_split(p, ' ') AS q FROM ph),
b AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), pl WHERE w[i] = q[1] AND w[i:i + len(q) - 1] = q),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY r),
line AS (SELECT r, i, {_LIST.format("s[i]")} AS w FROM (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS s FROM d))),
grouped AS (SELECT r, i, w, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM line),
block AS (SELECT r, w FROM line WHERE len(w) > 0 UNION ALL SELECT r, flatten(list(w)) AS w FROM grouped WHERE len(w) > 0 GROUP BY r, g HAVING count(*) > 1),
tp(label, s, x, family) AS (VALUES {", ".join(f"('{v}', '{s}', '{x}', '{f}')" for v, s, x, f in TEMPLATES)}),
tl AS (SELECT label, list_distinct(string_split(s, ' ')) AS q, string_split(x, ' ') AS x, family FROM tp),
met AS (SELECT r, b, label, family, len(list_intersect(list_distinct(w), q)) AS shared, len(q) AS n FROM (SELECT r, w, row_number() OVER () AS b FROM block), tl
        WHERE len(list_intersect(list_distinct(w), q)) >= ceil({THRESHOLD} * len(q) - 1e-9) AND list_has_all(w, x)),
hit AS (SELECT r, label, shared / n AS share FROM met QUALIFY family = '' OR shared = max(shared) OVER (PARTITION BY b, family)),
lab AS (SELECT r, label, 1.0 AS share, TRUE AS base FROM b UNION ALL SELECT r, label, share, FALSE FROM hit),
res AS (SELECT r, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM lab GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN res USING (r)
"""
