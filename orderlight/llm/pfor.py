"""Token ids in patched frame-of-reference blocks.

File: magic, then little-endian counts (documents u32, ids u64, ids in a block u32, blocks u32), the documents' ids
(i64), a flag per document (u8, 1: its id is null), their numbers of tokens (u32), the place of each block's start
(u64), the blocks. Block: minimum u32, width u8, values u16, exceptions u16, the low ``width`` bits of all differences
to the minimum, then the exceptions' positions (u16) and whole differences (u32).
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlight.llm.base import parts_for, table
from orderlight.session import scratch_path

MAGIC = b"PFR1"
HEAD = "<IQII"
BLOCK_HEAD = "<IBHH"
BLOCK_HEAD_SIZE = struct.calcsize(BLOCK_HEAD)
BLOCK = 512
PERCENTILE = 0.9  # of a block's values that the packed width holds
END = 1  # id after each document
LOT = 1 << 24  # bytes of texts whose words are looked up together
SOME = 1 << 16  # words that are split at once

# How a vocabulary of words treats and splits text, as such files state it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
SPECIAL = "<|"  # in every special token
PLAIN = "^[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*$"  # printable below U+0250, without U+0130
KNOWN = 0x3000  # code points that plain words lower-cased stay below
SPACE, LETTER, DIGIT, OTHER = range(4)
ODD = "[\x1c-\x1f]"  # white space to the split only


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(low.astype(kind).view(np.uint8).reshape(*low.shape, -1), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """Rows of packed bytes -> rows of ``n`` values."""
    kind, wide = ("<u2", 16) if width <= 16 else ("<u4", 32)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : n * width].reshape(len(raw), n, width)
    full = np.zeros((len(raw), n, wide), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full.reshape(len(raw), -1), axis=1, bitorder="little").view(kind).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``block`` ids, the last may be shorter."""
    out: list[bytes] = [b""] * -(-len(ids) // block)
    full = len(ids) // block
    for first, last, n in ((0, full, block), (full, len(out), len(ids) - full * block)):
        for at in range(first, last, 1024):
            some = ids[at * block : min(last, at + 1024) * block].astype(np.uint32).reshape(-1, n)
            least = some.min(axis=1)
            diff = some - least[:, None]
            need = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
            place = min(n - 1, int(percentile * n))
            width = np.partition(need, place, axis=1)[:, place]
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                raw = _pack(diff[rows] & np.uint32(2**w - 1), w) if w else np.empty((len(rows), 0), np.uint8)
                odd = need[rows] > w
                for k, i in enumerate(rows.tolist()):
                    where = np.flatnonzero(odd[k])
                    head = struct.pack(BLOCK_HEAD, int(least[i]), w, n, len(where))
                    out[at + i] = head + raw[k].tobytes() + where.astype("<u2").tobytes() + diff[i, where].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks that start at ``starts``; blocks of one width are unpacked together."""
    heads = [struct.unpack_from(BLOCK_HEAD, data, s) for s in starts.tolist()]
    out = np.zeros(total, np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, n, _) in enumerate(heads):
        groups.setdefault((w, n), []).append(i)
    for (w, n), members in groups.items():
        size = -(-w * n // 8)
        for at in range(0, len(members), 1024):
            some = members[at : at + 1024]
            raw = b"".join(data[int(starts[i]) + BLOCK_HEAD_SIZE : int(starts[i]) + BLOCK_HEAD_SIZE + size] for i in some)
            values = _unpack(np.frombuffer(raw, np.uint8).reshape(len(some), size), w, n) if w else np.zeros((len(some), n), np.uint32)
            for k, i in enumerate(some):
                least, _, _, odd = heads[i]
                row, s = values[k], int(starts[i]) + BLOCK_HEAD_SIZE + size
                if odd:
                    row[np.frombuffer(data, "<u2", odd, s)] = np.frombuffer(data, "<u4", odd, s + 2 * odd)
                out[i * block : i * block + n] = row + np.uint32(least)
    return out


def to_file(doc_ids: list, sizes: list[int] | np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = encode_blocks(ids, block)
    known = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack(HEAD, len(doc_ids), len(ids), block, len(blocks)) + known.tobytes() + null.tobytes() + np.array(sizes, "<u4").tobytes()
    lengths = np.array([0, *map(len, blocks)], np.int64)
    starts = len(head) + 8 * len(blocks) + np.cumsum(lengths)[:-1]
    return b"".join([head, starts.astype("<u8").tobytes(), *blocks])


def from_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Documents' ids, their numbers of tokens, and all token ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, total, block, blocks = struct.unpack_from(HEAD, data, 4)
    at = 4 + struct.calcsize(HEAD)
    known, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 13 * docs).astype(np.int64)
    return [None if n else d for d, n in zip(known.tolist(), null)], sizes, decode_blocks(data, starts, total, block)


def byte_letters() -> np.ndarray:
    """The letter that byte-level vocabularies use for each byte: itself where it prints, else the next from 256 on.
    Spaces stay."""
    own = {b: b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    letters = np.array([own[b] if b in own else next(rest) for b in range(256)], "<u4")
    letters[32] = 32
    return letters


def gathered(values: np.ndarray, counts: np.ndarray, picks: np.ndarray, lot: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values``, as long as ``counts`` says, that ``picks`` names, one after the other, and their ends."""
    begin, sizes = np.cumsum(counts) - counts, counts[picks]
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    at = 0
    for first in range(0, len(picks), lot):  # the places of few picks at a time take little memory
        some, size = picks[first : first + lot], sizes[first : first + lot]
        stop = int(ends[first + len(some) - 1])
        out[at:stop] = values[np.repeat(begin[some] - (ends[first : first + lot] - size), size) + np.arange(at, stop)]
        at = stop
    return out, ends


def of_words(tokenizer) -> bool:
    """Whether the vocabulary treats text by the rules that ``word_ids`` follows. Only then are a text's ids those of
    its words."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.post_processor is not None:
        return False
    rules = [json.loads(part.__getstate__()) for part in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    model = tokenizer.model
    plain = type(model).__name__ == "BPE" and not model.dropout and not model.unk_token and not model.byte_fallback
    special = tokenizer.get_added_tokens_decoder().values()
    return rules == [NORMAL, SPLIT] and plain and all(SPECIAL in t.content and not t.normalized for t in special)


def _joined(words: pa.Array) -> str:
    """All words, parted by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()


def _kinds() -> np.ndarray:
    """SPACE, LETTER, DIGIT or OTHER for each code point that lower-casing a plain word may give."""
    text = "".join(map(chr, range(KNOWN)))
    kinds = np.full(KNOWN, OTHER, np.uint8)
    for kind, of in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        kinds[[m.start() for m in regex.finditer(of, text)]] = kind
    return kinds


def split_parts(text: str, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What PIECES finds in lower-cased plain words parted by one space each, and the number of each part's word."""
    code = np.frombuffer((text + " " * 3).encode("utf-32-le"), "<u4")
    kind = kinds[code]
    new = np.ones(len(code), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # A contraction is a part of its own where no other sign stands before it.
    at = np.flatnonzero(new[:-3] & (code[:-3] == ord("'")))
    after = [code[at + 1], code[at + 2]]
    one = np.isin(after[0], [ord(c) for c in "stmd"])
    two = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (after[0] == ord(a)) & (after[1] == ord(b))
    new[at[one | two] + 1] = False
    new[at[one] + 2] = True
    new[at[two] + 2], new[at[two] + 3] = False, True
    space = kind == SPACE
    starts = np.flatnonzero(new & ~space)
    size = (~space).astype(np.uint8)
    size[code >= 0x80] = 2
    size[code >= 0x800] = 3
    ends = np.cumsum(size, dtype=np.int32)
    offsets = np.append(ends[starts] - size[starts], ends[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text.replace(" ", "").encode()))
    return parts, np.cumsum(space, dtype=np.int32)[starts]


def _slices(words: pa.Array, size: int = SOME):
    return (words[at : at + size] for at in range(0, len(words), size))


def word_ids(tokenizer, kind: str):
    """Function from different words to the ids of all, one after the other, and the number of each word's. A part that
    stands in several words goes to the vocabulary's model once."""
    kinds, letters, model, number = _kinds(), byte_letters(), tokenizer.model, attrgetter("id")

    def make(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Below U+0250 lower-casing is plain but for one letter, and composed forms stay as they are.
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, SPECIAL)).to_numpy(zero_copy_only=False)
        some = [split_parts(_joined(w).lower(), kinds) for w in _slices(words.filter(pa.array(plain)))]
        parts = pa.chunked_array([p for p, _ in some], pa.string()).dictionary_encode().combine_chunks()
        word = np.concatenate([np.empty(0, np.int64), *(w + k * SOME for k, (_, w) in enumerate(some))])
        # One array for all ids: words that never recur would take many small lists.
        values, counts = array("I"), array("I")
        for slice_ in _slices(parts.dictionary):
            for part in letters[np.frombuffer(_joined(slice_).encode(), np.uint8)].tobytes().decode("utf-32-le").split(" "):
                ids = model.tokenize(part)
                counts.append(len(ids))
                values.extend(map(number, ids))
        known = len(counts)
        for slice_ in _slices(words.filter(pa.array(~plain))):
            for whole in slice_.to_pylist():
                ids = tokenizer.encode(whole, add_special_tokens=False).ids
                counts.append(len(ids))
                values.extend(ids)
        each = np.ones(len(words), np.int64)
        each[plain] = np.bincount(word, minlength=int(plain.sum()))
        picks, split = np.empty(int(each.sum()), np.int64), np.repeat(plain, each)
        picks[split] = parts.indices.to_numpy()
        picks[~split] = np.arange(known, len(counts))
        found, ends = gathered(np.array(values, kind), np.array(counts, np.int64), picks)
        return found, np.diff(np.append(0, ends)[np.append(0, np.cumsum(each))])

    return make


class Encoder:
    """The vocabulary's ids of whole texts. In a vocabulary ``of_words`` white space parts words, so a text's ids are those
    of its words, and each different word of many texts is looked up once; any other vocabulary gets whole texts. Words of Latin
    letters and ASCII are lower-cased and split as the
    vocabulary does, and their parts go to its model; any other word goes through the tokenizer whole, as do words
    that may hold a special token. Nothing here refers back to the encoder, so a worker that runs many tasks frees
    each task's vocabulary at its end, without waiting for the cycle collector."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        small = max(self.tokenizer.get_vocab_size(), *self.tokenizer.get_added_tokens_decoder(), 0) < 2**16
        self.kind = "<u2" if small else "<u4"
        self.words = word_ids(self.tokenizer, self.kind) if of_words(self.tokenizer) else None

    def ids(self, text: str) -> bytes:
        """Little-endian ids of ``kind``: 16 bits where the vocabulary allows."""
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, ``end`` after each if given, and the number of each text's."""
        n = len(texts)
        whole = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.words else np.ones(n, bool)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        known = lists.flatten().dictionary_encode()
        values, counts = self.words(known.dictionary) if self.words else (np.empty(0, self.kind), np.zeros(len(known.dictionary), np.int64))
        # Behind the words come the ids of texts that are not split, and the end.
        rest = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.filter(pa.array(whole)).to_pylist()]
        rest.append([] if end is None else [end])
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        values = np.concatenate([values, np.fromiter(chain.from_iterable(rest), self.kind, int(sizes.sum()))])
        tail = np.full(n, len(counts) + len(rest) - 1)
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.concatenate([stops[whole], stops])
        extra = np.concatenate([len(counts) + np.arange(len(rest) - 1), tail])
        order = np.argsort(np.concatenate([np.flatnonzero(whole), np.arange(n)]), kind="stable")
        picks = np.insert(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), at[order], extra[order])
        ids, ends = gathered(values, np.concatenate([counts, sizes]), picks)
        return ids, np.diff(np.append(0, ends)[np.append(0, stops + np.cumsum(whole) + np.arange(1, n + 1))])


def _lots(batches, size: int = LOT):
    """Joins batches until they hold ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_tokens(docs: DataFrame, path: str, root: str, end: int = END, part_mb: float = 16) -> int:
    """Encodes ``docs`` (doc_id, text) and writes one file per range of ascending doc_id (null first, equal ids by a
    hash of their texts) to ``root``, a folder all executors reach. Null texts count as empty: just the end id.
    A file is written under a name of its attempt and then moved, so a repeated task replaces it by the same bytes.
    ``path`` is the vocabulary on the executors. Returns the number of files; an empty table may leave none."""
    done = pa.schema([("part", pa.int32()), ("docs", pa.int64())])

    def write(batches):
        task = TaskContext.get()
        encoder = Encoder(path)
        doc_ids, sizes, ids = [], [np.empty(0, np.int64)], [np.empty(0, encoder.kind)]
        for lot in _lots(batches):
            found, size = encoder.batch(lot.column(1).cast(pa.string()).fill_null(""), end)
            doc_ids += lot.column(0).to_pylist()
            sizes.append(size)
            ids.append(found)
        if doc_ids:
            store, folder = pafs.FileSystem.from_uri(root)
            store.create_dir(folder, recursive=True)
            name = f"{folder}/ids-{task.partitionId():06d}.pfor"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(to_file(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([len(doc_ids)], pa.int64())], schema=done)

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = ranges.repartitionByRange(parts_for(docs, "text", part_mb), *keys).sortWithinPartitions(*keys)
    return ranges.mapInArrow(write, "part int, docs long").where("docs > 0").count()


def read_tokens(spark, root: str, each, schema: str) -> DataFrame:
    """``each(part, doc_ids, sizes, ids) -> RecordBatch`` over the files of ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(root)
    files = files.select(F.regexp_extract("path", r"ids-(\d+)\.pfor$", 1).cast("long").alias("part"), "content")

    def walk(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield each(part, *from_file(content.as_py()))

    return files.mapInArrow(walk, schema)


def token_index(spark, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, from the decoded ids."""
    def each(part, doc_ids, sizes, ids):
        ends = np.cumsum(sizes.astype(np.int64))
        raw = ids.astype("<u4").tobytes()
        starts = ends - sizes
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        n = len(doc_ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())],
            names=["part", "doc_id", "place", "n_tokens", "ids_crc32"],
        )

    from orderlight.session import small_side, stored

    rows = stored(read_tokens(spark, root, each, "part long, doc_id long, place long, n_tokens long, ids_crc32 long"), "index")
    # One row per file, so the ordered window stays small.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return rows.join(small_side(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    root = scratch_path(docs.sparkSession, "tokens")
    if not write_tokens(docs, path, root):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return token_index(docs.sparkSession, root)


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
