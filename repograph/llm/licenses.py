"""License scans by a positional index of rare words.

Templates are short licence texts as word sequences. The words' document frequencies over all
documents come from one partial aggregate (as many numbers as the templates have words). A
template that must match in a share of its places can miss only so many words, so its few
highest-IDF words (one more than it may miss) are its anchors: the index maps an anchor to
(template, place). A file is looked up by the anchors it holds; each hit fixes the relative
position of template and file, all other words are compared at that position, and a template
counts only if its mandatory key phrases stand there word for word.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLICE = 4 << 20               # bytes of a text that are split into words at once

#: Base phrases (label, words). All their places count.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: Licence notices (label, words, mandatory key phrases).
TEMPLATES = (
    ("agpl-3.0", "gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("source and binary forms", "following conditions are met")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0", ("creative commons",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0-1.0", "creative commons zero v1 0 universal", ("creative commons zero",)),
    ("epl-2.0", "eclipse public license version 2 0", ("eclipse public license",)),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted", ("is hereby granted",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction", ("permission is hereby granted", "without restriction")),
    ("mpl-2.0", "mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
SHARE = 0.8                   # of a template's words that must stand in place


class Template:
    def __init__(self, label: str, text: str, keys: tuple, base: bool, vocab: dict[bytes, int]):
        words = text.encode().split()
        self.label, self.base, self.need = label, base, len(words) if base else math.ceil(SHARE * len(words))
        self.ids = np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int16)
        self.keys = []
        for key in keys:
            k = key.encode().split()
            self.keys.append(next(slice(i, i + len(k)) for i in range(len(words)) if words[i:i + len(k)] == k))


class LicenseIndex:
    """Anchors of all templates under given document frequencies."""

    def __init__(self, df: dict[bytes, int] | None = None, n_docs: int = 0):
        self.vocab: dict[bytes, int] = {}
        self.templates = [Template(label, text, (), True, self.vocab) for label, text in BASE]
        self.templates += [Template(label, text, keys, False, self.vocab) for label, text, keys in TEMPLATES]
        n = np.array([(df or {}).get(w, 0) for w in self.vocab], float)
        self.idf = np.log((n_docs + 1) / (n + 1))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            places = np.lexsort((np.arange(len(template.ids)), -self.idf[template.ids]))
            for place in places[:len(template.ids) - template.need + 1].tolist():
                self.postings.setdefault(int(template.ids[place]), []).append((t, place))
        self.anchor = np.zeros(len(self.vocab) + 1, bool)       # the last one: no licence word
        self.anchor[list(self.postings)] = True

    def word_ids(self, text: str | None) -> np.ndarray:
        """Licence-word id of every word of a text, -1 for all other words."""
        raw, parts, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
        while at < len(raw):
            end = at + SLICE
            if end < len(raw) and (m := WORD.match(raw, end)):
                end = m.end()
            words = WORD.findall(raw, at, end)
            parts.append(np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int16, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int16)

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, start, share of words in place), by start; a start can be negative
        where a file begins inside a template."""
        found, tried = [], set()
        for p in np.flatnonzero(self.anchor[ids]).tolist():
            for t, place in self.postings[int(ids[p])]:
                start = p - place
                if (t, start) in tried:
                    continue
                tried.add((t, start))
                template = self.templates[t]
                lo, hi = max(0, -start), min(len(template.ids), len(ids) - start)
                same = np.zeros(len(template.ids), bool)
                same[lo:hi] = ids[start + lo:start + hi] == template.ids[lo:hi]
                if same.sum() >= template.need and all(same[k].all() for k in template.keys):
                    found.append((t, start, float(same.mean())))
        return sorted(found, key=lambda m: (m[1], m[0]))


def license_word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Number of documents that hold each licence word, and of all documents."""
    def run(batches: Iterator) -> Iterator:
        index = LicenseIndex()
        df, n = np.zeros(len(index.vocab) + 1, np.int64), 0
        for b in arrow_batches(batches):
            n += b.num_rows
            for t in b.column(0):
                df[np.unique(index.word_ids(t.as_py()))] += 1
        yield pa.RecordBatch.from_pydict({"word": [*(w.decode() for w in index.vocab), ""],
                                          "n": [*df[:-1].tolist(), n]})

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    got = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w.encode(): n for w, n in got.items() if w}, got.get("", 0)


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words`` and ``found``, an array of (label, base,
    start, n, score) ordered by start: the template's first place in words from 0, its number of
    words and the share of them in place.

    Defined results: null or empty text has no words; repeated rows and null ids keep their own
    rows; an empty table gives an empty table; other columns are ignored; a text is read whole,
    a slice at a time, keeping two bytes a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    df, n_docs = license_word_frequencies(docs, text_col)

    def run(batches: Iterator) -> Iterator:
        index = LicenseIndex(df, n_docs)
        shape = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                                    ("n", pa.int64()), ("score", pa.float64())]))
        for b in arrow_batches(batches):
            n_words, found = [], []
            for text in b.column(1):
                ids = index.word_ids(text.as_py())
                n_words.append(len(ids))
                found.append([{"label": index.templates[t].label, "base": index.templates[t].base,
                               "start": s, "n": len(index.templates[t].ids), "score": x}
                              for t, s, x in index.matches(ids)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(found, shape)],
                names=["id", "n_words", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_words long, found array<struct<label:string,"
                               "base:boolean,start:bigint,n:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)
