"""Repeated byte strings across documents, by merging the Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, parts_for, table
from orderlight.session import stored

LENGTH = 50  # bytes of a string that counts
ANCHOR = 24  # bytes of the substring that brings equal strings together
RUN = 64  # strings of one segment, at most
CHUNK = 1 << 18  # bytes that numpy handles at once
LOT = 1 << 17  # bytes of segments whose transforms are merged at once, unless one anchor has more
END = 255  # closes a segment in a shard; no UTF-8 text has this byte
LAST = 2**63 - 1  # stands for a null doc_id

_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For every start of a ``length``-byte string of ``data``: the smallest hash of an ANCHOR-byte substring in it."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(raw.view(np.uint8), (len(data), 8), (1, 1)).copy().view("<u8").ravel()
    n = len(data) - ANCHOR + 1
    h = words[:n] * _MIX[0] + words[8 : n + 8] * _MIX[1]
    h ^= h >> np.uint64(31)
    h += words[16 : n + 16] * _MIX[2]
    h ^= h >> np.uint64(29)
    h *= _MIX[3]
    h ^= h >> np.uint64(32)
    span, wide = length - ANCHOR + 1, 1
    while wide * 2 <= span:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[: len(h) - (span - wide)], h[span - wide :]) if span > wide else h


def segments(texts: list[bytes], length: int = LENGTH):
    """Yields (texts' slice, their joined bytes, their ends in it, keys, starts, counts) per chunk of texts: runs of
    string starts with the same anchor. The strings of a segment start at ``start .. start + count - 1`` of the joined
    bytes. Equal strings always lie in segments of equal keys."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            size += len(texts[last])
            last += 1
        chunk = texts[first:last]
        data = np.frombuffer(b"".join(chunk), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, chunk), np.int64, len(chunk)))
        key, starts, counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(data) >= length:
            low = _anchors(data, length)
            valid = np.ones(len(low), bool)
            for back in range(1, length):  # no string crosses the end of a text
                at = ends - back
                valid[at[(at >= 0) & (at < len(low))]] = False
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
            starts = np.flatnonzero(new)
            stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
            counts = stop - starts
            if len(counts) and counts.max() > RUN:  # long repetitions are cut
                cuts = -(-counts // RUN)
                inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                whole = np.repeat(counts, cuts)
                starts = np.repeat(starts, cuts) + inner * RUN
                counts = np.minimum(RUN, whole - inner * RUN)
            key = low[starts]
        yield slice(first, last), data, ends, key, starts, counts
        first = last


def suffix_order(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of END-closed strings, sorted by their first ``depth`` symbols (None: by all), by prefix
    doubling from the first eight on; an END is smaller the earlier it stands."""
    n, closing = len(text), np.flatnonzero(text == END)
    raw = np.append(text, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    away = closing[np.searchsorted(closing, np.arange(n))] - np.arange(n)
    short = away < 8  # what lies behind an END does not count
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(7) - away[short].astype(np.uint64)))
    order = np.argsort(words, kind="stable")  # of equal words with an END, the earlier END stands first
    words, new = words[order], short[order]
    new[1:] |= words[1:] != words[:-1]
    reach = 8
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - new[0]
        if rank[order[-1]] == n - 1 or (depth and reach >= depth):
            return order
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key)
        new = np.append(False, np.diff(key[order]) != 0)
        reach *= 2


def transform(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of END-closed strings; a whole string is preceded by an END."""
    order = suffix_order(text, depth)
    return order, text[order - 1]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of several transforms whose suffixes are ordered by their first ``depth`` symbols, and the depth up
    to which each merged suffix equals the one before it.

    Starts with the shards one after the other. Each round reads the transforms in the current interleave and sorts
    the rows, stably, by the symbols read: that orders the suffixes by one symbol more. A row is then that of the suffix
    longer by the symbol, which within a shard is the same in every round. Two neighbours stay together for as many rounds
    as their common prefix is long. No suffix is compared or sorted again.
    """
    sizes = np.array([len(t) for t in transforms])
    symbols, base = np.concatenate(transforms), np.cumsum(sizes) - sizes
    n = len(symbols)
    longer = np.empty(n, np.int64)
    for t, at in zip(transforms, base.tolist()):
        longer[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t))
    closings = [int((t == END).sum()) for t in transforms]
    fixed = np.concatenate([np.arange(at + size - c, at + size) for at, size, c in zip(base, sizes, closings)])
    row = np.arange(n)
    common = np.zeros(n, np.int16)
    block = np.zeros(n, np.int32)
    parts = np.ones(n, bool)
    for _ in range(depth):
        read = symbols.take(row)
        order = np.argsort(read, kind="stable")
        row, read, before = longer.take(row.take(order)), read.take(order), block.take(order)
        row[n - len(fixed) :] = fixed  # suffixes that are only an END keep their order
        parts[1:] = read[1:] != read[:-1]
        parts[1:] |= before[1:] != before[:-1]
        parts[n - len(fixed) :] = True
        common += ~parts
        block = np.cumsum(parts, dtype=np.int32)
        if block[-1] == n:
            break
    return np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes).take(row), common


def least_owner(strings: list[bytes], owners: np.ndarray, length: int = LENGTH, shards: int = 4) -> list[np.ndarray]:
    """For each of the strings, and each start of a ``length``-byte substring in it: the smallest owner of any of the
    strings that holds the same substring. The strings are dealt to shards, whose transforms are merged; intervals of
    suffixes with a common prefix of ``length`` are the repeated substrings."""
    groups = [list(range(s, len(strings), shards)) for s in range(min(shards, len(strings)))]
    transforms, places = [], []
    sizes = np.array([len(s) + 1 for s in strings])
    for group in groups:
        text = np.frombuffer(b"\xff".join(strings[i] for i in group) + b"\xff", np.uint8)
        order, symbols = transform(text, length)
        ends = np.cumsum(sizes[group])
        which = np.searchsorted(ends, order, side="right")
        places.append((np.array(group)[which], order - (ends - sizes[group])[which]))
        transforms.append(symbols)
    shard, common = merge(transforms, length)
    row = np.empty(len(shard), np.int64)
    at = 0
    for s, t in enumerate(transforms):
        row[shard == s] = np.arange(at, at + len(t))
        at += len(t)
    string = np.concatenate([p[0] for p in places])[row]
    offset = np.concatenate([p[1] for p in places])[row]
    whole = offset + length < sizes[string]  # the END lies behind the substring
    starts = np.flatnonzero(common < length)
    least = np.minimum.reduceat(owners[string], starts)
    value = np.repeat(least, np.diff(np.append(starts, len(string))))
    first = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length))])
    out = np.empty(first[-1], np.int64)
    out[first[string[whole]] + offset[whole]] = value[whole]
    return [out[first[i] : first[i + 1]] for i in range(len(strings))]


def _texts(one: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return one.column("text").to_pylist(), one.column("doc").to_numpy()


def _names(data: np.ndarray, starts, counts, length: int) -> np.ndarray:
    """A 64-bit name of each segment's bytes."""
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    found = [digest(raw[s : s + c + length - 1], 11) for s, c in zip(starts.tolist(), counts.tolist())]
    return np.array(found, np.uint64)


def _joined(one: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in one.column(column).to_pylist())])


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of ``values`` that the sorted array ``known`` holds."""
    if not len(known):
        return np.empty(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values)


def _marks(key: np.ndarray) -> np.ndarray:
    """32 bits of each anchor: few segments have to be named to find those of known anchors."""
    return (key >> np.uint64(32)).astype(np.uint32)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _by_bucket(keys: np.ndarray, buckets: int):
    """Order of the keys by bucket, and the (bucket, from, to) that have any."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    return order, [(b, x, y) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]


def _shared(buckets: int, key: np.ndarray) -> np.ndarray:
    """An anchor's mark: its bucket and 32 other bits."""
    return (key % np.uint64(buckets)) << np.uint64(32) | key >> np.uint64(32)


def repeats(docs: DataFrame, length: int = LENGTH, batch_mb: float = 32, least: int = 24) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans and ``kept``, the text's bytes without each
    byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    Passes over texts that are dealt once, to batches by a hash of doc_id. (1) Each string belongs to its anchor, the
    substring in it with the smallest hash; a batch sends a mark of each anchor once. (2) Marks meet per bucket; each
    batch hears which of its own another document has too. Only those anchors can hold repeated strings. (3) Batches
    name their different segments of such anchors (all strings of one anchor in a row), each once, with its least
    document. An anchor with one segment everywhere is settled by that. (4) Of the others, one batch sends each
    segment's bytes; per bucket, shards of the segments get Burrows-Wheeler transforms, which are merged by interleave
    refinement; intervals with a common prefix of ``length`` give each string's least document. (5) Batches apply the
    answers to their documents. A passage in any number of documents costs one name a batch, and no list of documents
    is ever gathered.

    Null texts are empty; a null doc_id counts as larger than any other; rows with equal doc_id don't remove from
    each other. Segments go by 64-bit names. An empty table gives none.
    """
    batches = parts_for(docs, "text", batch_mb, least)
    buckets = batches * 8
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("doc"), as_bytes(F.col("text")).alias("text"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    marked = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("one", pa.binary()), ("more", pa.binary())])

    def anchors(one: pa.Table) -> pa.Table:
        texts, ids = _texts(one)
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for some, _, ends, key, starts, _ in segments(texts, length):
            keys.append(key)
            owners.append(ids[some][np.searchsorted(ends, starts, side="right")])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        many = owner[at] != owner[np.append(at[1:], len(key)) - 1] if len(key) else np.empty(0, bool)
        key = key[at]
        order, cuts = _by_bucket(key, buckets)
        mark, many = _marks(key[order]), many[order]
        batch = one.column("batch")[0].as_py()
        return _rows(marked, [(b, batch, mark[x:y][~many[x:y]].tobytes(), mark[x:y][many[x:y]].tobytes()) for b, x, y in cuts])

    heard = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("known", pa.binary())])

    def shared(one: pa.Table) -> pa.Table:
        bucket = one.column("bucket")[0].as_py()
        sides = [[np.unique(np.frombuffer(x, np.uint32)) for x in one.column(c).to_pylist()] for c in ("one", "more")]
        every = np.sort(np.concatenate([*sides[0], *sides[1]]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [np.concatenate([x[_among(twice, x)], y]) for x, y in zip(*sides)]
        return _rows(heard, [(b, bucket, f.tobytes()) for b, f in zip(one.column("batch").to_pylist(), found) if len(f)])

    named = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("key", pa.binary()), ("name", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])

    def names(left: pa.Table, right: pa.Table) -> pa.Table:
        """The batch's different segments of shared anchors, with the smallest and the largest document of each."""
        if not left.num_rows or not right.num_rows:
            return _rows(named, [])
        known = np.concatenate([np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(right.column("bucket").to_pylist(), right.column("known").to_pylist())])
        known.sort()
        texts, ids = _texts(left)
        parts: list[list] = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]]
        for some, data, ends, key, starts, counts in segments(texts, length):
            at = _among(known, _shared(buckets, key))
            for part, values in zip(parts, (key[at], _names(data, starts[at], counts[at], length), ids[some][np.searchsorted(ends, starts[at], side="right")])):
                part.append(values)
        key, name, doc = (np.concatenate(p) for p in parts)
        if not len(key):
            return _rows(named, [])
        order = np.lexsort((doc, name))
        key, name, doc = key[order], name[order], doc[order]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        key, name, low, high = key[at], name[at], doc[at], doc[np.append(at[1:], len(doc)) - 1]
        order, cuts = _by_bucket(key, buckets)
        key, name, low, high = key[order], name[order], low[order], high[order]
        batch = left.column("batch")[0].as_py()
        return _rows(named, [(b, batch, key[x:y].tobytes(), name[x:y].tobytes(), low[x:y].tobytes(), high[x:y].tobytes()) for b, x, y in cuts])

    def met(one: pa.Table):
        """All named segments of a bucket by anchor and name: key, name, batch, least, most, the place of each different
        segment, and which of those share their anchor with another."""
        key, name, low, high = (_joined(one, c, t) for c, t in (("key", np.uint64), ("name", np.uint64), ("least", np.int64), ("most", np.int64)))
        batch = np.repeat(np.array(one.column("batch").to_pylist()), [len(x) // 8 for x in one.column("key").to_pylist()])
        order = np.lexsort((batch, name, key))
        key, name, batch, low, high = key[order], name[order], batch[order], low[order], high[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
        same = key[at][1:] == key[at][:-1]
        return key, name, batch, low, high, at, np.append(same, False) | np.append(False, same)

    asked = pa.schema([("batch", pa.int32()), ("marks", pa.binary()), ("names", pa.binary())])

    def crowded(one: pa.Table) -> pa.Table:
        """Of anchors with several segments: each segment's anchor and name, to one batch that has it."""
        key, name, batch, _, _, at, several = met(one)
        at = at[several]
        at = at[np.argsort(batch[at], kind="stable")]
        return _rows(asked, [(int(batch[x[0]]), _marks(key[x]).tobytes(), name[x].tobytes()) for x in np.split(at, np.flatnonzero(np.diff(batch[at])) + 1) if len(x)])

    sent = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])

    def spelled(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the segments that the batch was asked for."""
        if not left.num_rows or not right.num_rows:
            return _rows(sent, [])
        wanted, anchored = np.unique(_joined(right, "names", np.uint64)), np.unique(_joined(right, "marks", np.uint32))
        known: dict[int, tuple[int, bytes]] = {}
        for _, data, _, key, starts, counts in segments(_texts(left)[0], length):
            at = _among(anchored, _marks(key))
            key, starts, counts = key[at], starts[at], counts[at]
            name = _names(data, starts, counts, length)
            raw = data.tobytes()
            for i in _among(wanted, name).tolist():
                if int(name[i]) not in known:
                    known[int(name[i])] = (int(key[i]), raw[starts[i] : starts[i] + counts[i] + length - 1])
        names_of = [*known]
        anchors_of = np.array([known[n][0] for n in names_of], np.uint64)
        order, cuts = _by_bucket(anchors_of, buckets)
        rows = []
        for b, x, y in cuts:
            members = [names_of[i] for i in order[x:y].tolist()]
            texts = [known[n][1] for n in members]
            rows.append((b, np.array(members, np.uint64).tobytes(), np.array([len(t) for t in texts], np.int32).tobytes(), b"".join(texts)))
        return _rows(sent, rows)

    answer = pa.schema([("batch", pa.int32()), ("marks", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])

    def resolved(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each batch's segments with the least document of each of their strings, where that is a smaller one than
        some document of the batch; one number where all strings have the same."""
        if not left.num_rows:
            return _rows(answer, [])
        key, name, batch, low, high, at, several = met(left)
        owner = np.minimum.reduceat(low, at)
        found: list[np.ndarray] = [owner[i : i + 1] for i in range(len(at))]
        which = np.flatnonzero(several)
        if len(which):
            texts: dict[int, bytes] = {}
            for n, sizes, raw in zip(*(right.column(c).to_pylist() for c in ("names", "sizes", "bytes"))):
                ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
                texts.update(zip(np.frombuffer(n, np.uint64).tolist(), (raw[a:b] for a, b in zip([0, *ends], ends))))
            strings = [texts[n] for n in name[at[which]].tolist()]
            # Equal strings share their anchor, so anchors can be settled in small lots that stay in the cache.
            size = np.cumsum([len(s) + 1 for s in strings])
            fresh = np.flatnonzero(np.append(True, key[at[which]][1:] != key[at[which]][:-1]))
            lot = (size[fresh] - 1) // LOT
            cuts = [0, *fresh[1:][lot[1:] != lot[:-1]].tolist(), len(strings)]
            for a, b in zip(cuts, cuts[1:]):
                for i, owners in zip(which[a:b].tolist(), least_owner(strings[a:b], owner[which[a:b]], length)):
                    found[i] = owners[:1] if (owners == owners[0]).all() else owners
        lowest = np.array([o.min() for o in found])
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        useful = np.flatnonzero(lowest[group] < high)
        useful = useful[np.argsort(batch[useful], kind="stable")]
        rows = []
        for some in np.split(useful, np.flatnonzero(np.diff(batch[useful])) + 1) if len(useful) else []:
            answers = [found[g] for g in group[some].tolist()]
            counts = np.array([len(a) for a in answers], np.int32)
            rows.append((int(batch[some[0]]), _marks(key[some]).tobytes(), name[some].tobytes(), counts.tobytes(), np.concatenate(answers).tobytes()))
        return _rows(answer, rows)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids = _texts(left)
        name, counts, owners = (_joined(right, c, t) for c, t in (("names", np.uint64), ("counts", np.int32), ("owners", np.int64)))
        anchored, begin = np.unique(_joined(right, "marks", np.uint32)), np.cumsum(counts) - counts
        order = np.argsort(name, kind="stable")
        name, counts, begin = name[order], counts[order], begin[order]
        rows = []
        for some, data, ends, key, starts, sizes in segments(texts, length):
            step = np.zeros(len(data) + 1, np.int32)
            at = _among(anchored, _marks(key))
            starts, sizes = starts[at], sizes[at]
            if len(starts):
                names_of = _names(data, starts, sizes, length)
                at = _among(name, names_of)
                place = np.searchsorted(name, names_of[at])
                starts, sizes = starts[at], sizes[at]
                doc = ids[some][np.searchsorted(ends, starts, side="right")]
                flat = counts[place] == 1
                gone = flat & (owners[begin[place]] < doc)
                np.add.at(step, starts[gone], 1)
                np.add.at(step, starts[gone] + sizes[gone] - 1 + length, -1)
                for s, n, b, d in zip(starts[~flat].tolist(), sizes[~flat].tolist(), begin[place][~flat].tolist(), doc[~flat].tolist()):
                    inside = s + np.flatnonzero(owners[b : b + n] < d)
                    np.add.at(step, inside, 1)
                    np.add.at(step, inside + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                out = gone[a:b]
                removed = int(np.count_nonzero(out))
                runs = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])) if removed else 0
                rows.append((b - a, removed, runs, data[a:b][~out].tobytes() if removed else data[a:b].tobytes()))
        return _rows(result, [(i, *r) for i, r in zip(left.column("doc_id").to_pylist(), rows)])

    per_batch = dealt.groupBy("batch")
    marks = per_batch.applyInArrow(anchors, "bucket int, batch int, one binary, more binary")
    lists = marks.groupBy("bucket").applyInArrow(shared, "batch int, bucket int, known binary")
    segments_of = per_batch.cogroup(lists.groupBy("batch")).applyInArrow(names, "bucket int, batch int, key binary, name binary, least binary, most binary")
    asks = segments_of.groupBy("bucket").applyInArrow(crowded, "batch int, marks binary, names binary")
    spelt = per_batch.cogroup(asks.groupBy("batch")).applyInArrow(spelled, "bucket int, names binary, sizes binary, bytes binary")
    answers = segments_of.groupBy("bucket").cogroup(spelt.groupBy("bucket")).applyInArrow(resolved, "batch int, marks binary, names binary, counts binary, owners binary")
    return per_batch.cogroup(answers.groupBy("batch")).applyInArrow(applied, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
