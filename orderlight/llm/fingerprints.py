"""Threshold-scaled document sketches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, parts_for, shingle_hashes

WIDTH = 5  # words in a shingle
SCALE = 8  # one hash in so many is kept
SEED = 7


def sketch(text: bytes, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct shingle hashes below 2^64 / scale; where none is below, the smallest one,
    so that only a text without words has an empty sketch.

    The threshold is fixed, so sketches of parts merge by union, and the share of one sketch's
    hashes that the other holds estimates containment however unequal the texts are. A sketch that
    had to keep a hash above the threshold (see ``thin``) says only whether two texts are equal;
    with both texts at hand ``likeness`` compares such texts by all their shingles.
    """
    hashes = np.unique(shingle_hashes(text.lower().split(), width, SEED))
    kept = hashes[: np.searchsorted(hashes, np.uint64(2**64 // scale))]
    return kept if len(kept) else hashes[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other has; 1 for two empty sketches,
    0 if only one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def thin(own: np.ndarray, scale: int = SCALE) -> bool:
    """Whether a sketch holds only the one hash that it keeps for want of any below the threshold."""
    return len(own) == 1 and int(own[0]) >= 2**64 // scale


def likeness(a: bytes, b: bytes, own: np.ndarray, other: np.ndarray, width: int = WIDTH, scale: int = SCALE) -> tuple[float, float]:
    """Containment and Jaccard similarity of two texts by their sketches; if either sketch is ``thin``, exactly, by
    all shingles of both texts."""
    if thin(own, scale) or thin(other, scale):
        own, other = (np.unique(shingle_hashes(t.lower().split(), width, SEED)) for t in (a, b))
    return containment(own, other), jaccard(own, other)


def sketch_column(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """The sketch of a text column as hex, 16 digits a hash in ascending order. Null counts as empty text."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(bytes(t), width, scale).astype(">u8").tobytes().hex())

    return of(as_bytes(text))


def merged(sketches: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """Sketch of the texts together, from theirs."""
    every = np.unique(np.concatenate([np.empty(0, np.uint64), *sketches]))
    kept = every[: np.searchsorted(every, np.uint64(2**64 // scale))]
    return kept if len(kept) else every[:1]


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, jaccard_edited double"
)
_ENDS = "first_id long, first_h long, head string, doc_id long, open string"


def edited(text: str, after: str) -> str:
    """``text`` whose last third is replaced by as much of the start of ``after``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _compare(doc_id, text: str, own: np.ndarray, after: str, next_own: np.ndarray, width: int, scale: int) -> dict:
    changed = edited(text, after).encode()
    other = sketch(changed, width, scale)
    near_edited, jaccard_edited = likeness(text.encode(), changed, own, other, width, scale)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(),
        "fingerprint": own.astype(">u8").tobytes(), "edited_fingerprint": other.astype(">u8").tobytes(),
        "near_edited": near_edited, "jaccard_edited": jaccard_edited,
        "near_next": likeness(text.encode(), after.encode(), own, next_own, width, scale)[0],
    }


def _batches(rows, schema, size: int = 1000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def edit_likeness(docs: DataFrame, width: int = WIDTH, scale: int = SCALE, part_mb: float = 8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): sketch, sketch of the edited text, and likenesses.

    The next document is the one with the next smaller doc_id (null is smallest; equal ids in the
    order of a hash of their texts), and the first one for the last. Texts move once, to ranges that are walked in
    order; each range also gives its first and last text, one row a range, to close the gaps between ranges.
    A null text counts as empty; a table with one row is its own next; an empty table gives no rows.
    Other columns are ignored. Repeated rows each get a result. Texts so short that no shingle hash lies below the
    threshold are compared by all shingles.
    """
    schema = _arrow(_ROW)

    def walk(batches):
        def rows():
            held = None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = sketch(text.encode(), width, scale)
                    if held:
                        yield _compare(*held, text, own, width, scale)
                    held = (doc_id, text, own)

        yield from _batches(rows(), schema)

    def ends(batches):
        """The range's first text, and its last document, whose next text is the first of another range."""
        first = last = None
        for batch in batches:
            places = [(i is None, -(i or 0), h) for i, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            for k, better in ((min(range(len(places)), key=places.__getitem__), True), (max(range(len(places)), key=places.__getitem__), False)) if places else ():
                row = (places[k], batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if better and (first is None or row[0] < first[0]):
                    first = row
                elif not better and (last is None or row[0] > last[0]):
                    last = row
        if first:
            yield pa.RecordBatch.from_pylist([{"first_id": first[1], "first_h": first[0][2], "head": first[2], "doc_id": last[1], "open": last[2]}], _arrow(_ENDS))

    def close(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    yield _compare(
                        r["doc_id"], r["open"], sketch(r["open"].encode(), width, scale),
                        r["after"], sketch(r["after"].encode(), width, scale), width, scale,
                    )

        yield from _batches(rows(), schema)

    keys = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts_for(docs, "text", part_mb), *keys)
    done = ranges.sortWithinPartitions(*keys).mapInArrow(walk, _ROW)
    edge = ranges.mapInArrow(ends, _ENDS)
    # Ranges are told apart by their first row: a task's number would depend on the plan around it. One narrow row per
    # range, so the ordered window stays small; the texts come in by a join.
    order = Window.orderBy(F.col("first_id").desc_nulls_last(), "first_h")
    start = F.struct("first_id", "first_h")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = edge.select(start.alias("at"), F.coalesce(F.lead(start).over(order), F.first(start).over(whole)).alias("next"))
    heads = edge.select(start.alias("_start"), F.col("head").alias("after"))
    closed = edge.select("doc_id", "open", start.alias("_own")).join(following, F.col("_own").eqNullSafe(F.col("at")))
    closed = closed.join(heads, F.col("next").eqNullSafe(F.col("_start"))).select("doc_id", "open", "after")
    return done.unionByName(closed.mapInArrow(close, _ROW))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    from orderlight.llm.base import table

    found = edit_likeness(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
