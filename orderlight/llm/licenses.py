"""License notices through a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, table

# Phrases whose every place counts, and notices with the phrases that must stand in a match.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge", "copy of this software")),
    ("mit", "released under the terms of the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("apache-2", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons", "noncommercial")),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons", "sharealike")),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ("cc0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "are permitted")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

ENOUGH = 0.75  # share of a notice's weight that must stand in place

# Lower-cases A-Z and turns every other ASCII character but 0-9 and a-z into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """Postings (notice, position) of the rarest words of each notice, by the words' IDF in the corpus.

    A notice in place lacks at most 1 - ``enough`` of its weight, so one of the words that together weigh more stands
    in place; a base phrase is looked up by its rarest word. So no notice is passed over, whatever else a file holds."""

    def __init__(self, frequency: dict[bytes, int], documents: int, enough: float = ENOUGH):
        split = lambda t: t.encode().split()
        self.notices = [(label, split(p), (split(p),), True) for p, label in BASE.items()]
        self.notices += [(label, split(t), tuple(split(p) for p in keys), False) for label, t, keys in NOTICES]
        vocabulary = {w for _, words, _, _ in self.notices for w in words}
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.postings = defaultdict(list)
        for k, (_, words, _, base) in enumerate(self.notices):
            may_lack, weight = (1 - enough + 1e-9) * sum(self.idf[w] for w in words), 0.0
            for at in sorted(range(len(words)), key=lambda at: (-self.idf[words[at]], words[at], at)):
                self.postings[words[at]].append((k, at))
                weight += self.idf[words[at]]
                if base or weight > may_lack:
                    break
        self.enough = enough

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], set[str], float]:
        """Base places (start, words, label), labels of the notices found, and the best share of a notice in place."""
        if self.postings.keys().isdisjoint(words):
            return [], set(), 0.0
        starts = {(k, at - place) for at, w in enumerate(words) if w in self.postings for k, place in self.postings[w]}
        places, labels, best = [], set(), 0.0
        for k, start in starts:
            label, notice, keys, base = self.notices[k]
            if base:
                if start >= 0 and words[start : start + len(notice)] == notice:
                    places.append((start, len(notice), label))
                    best = 1.0
                continue
            here = [(w, 0 <= start + i < len(words) and words[start + i] == w) for i, w in enumerate(notice)]
            share = sum(self.idf[w] for w, ok in here if ok) / sum(self.idf[w] for w in notice)
            if share >= self.enough:
                window = b" %s " % b" ".join(words[max(0, start) : start + len(notice) + 2])
                if all(b" %s " % b" ".join(key) in window for key in keys):
                    labels.add(label)
                    best = max(best, share)
        return sorted(places), labels, min(1.0, best)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and the number of documents; counted over all rows, one
    row per task and word. The result has as many entries as the notices have words."""
    vocabulary = {w for t in [*BASE, *(t for _, t, _ in NOTICES)] for w in t.encode().split()}
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        found = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found[b""] += 1
                found.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], schema=schema)

    rows = docs.select(as_bytes(F.col(text)).alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in rows.collect()}
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the places of base phrases, labels and score.

    score: the largest share, by IDF, of a notice's words that stand at its positions relative to each other, among
    the notices found; 1 where a base phrase stands, 0 without any. Null text counts as empty; other columns are
    ignored; an empty table gives none.
    """
    counts, documents = frequencies(docs)
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ])
    ddl = "doc_id long, n_words long, starts array<long>, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def each(batches):
        index = Index(counts, documents, enough)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                places, labels, score = index.find(words)
                own = {label for _, _, label in places}
                starts = [s for s, _, _ in places]
                rows.append({
                    "doc_id": doc_id, "n_words": len(words), "starts": starts, "n_base": len(places), "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None), "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | labels)), "score": score,
                })
            yield pa.RecordBatch.from_pylist(rows, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("t")).mapInArrow(each, ddl)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("starts")
