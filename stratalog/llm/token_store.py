"""Token ids in binary files, coded by the adaptive range coder.

Documents go to files by ranges of doc_id, in ascending order within and across files.  A file holds its ids as
blocks of about two million (``range_coder``: each starts afresh and is checksummed) and an index of its documents.

    "SLTK" version  n_docs  n_blocks  | blocks | deflated index | index bytes, index crc32, "SLTK"

The index has, for each document, a presence flag of the id, the id and its number of tokens.  Each document ends
with the end id.  Reading checks every checksum.  A task begins another file after ``FILE_IDS`` ids, so what it holds in
memory doesn't grow with what it was dealt, but with one text at most.

Texts are encoded by the tokenizers library.  Its pre-tokenizer never joins across white space and drops it, and
parts punctuation from letters, so words without the marks at their ends are encoded once each and looked up after that,
by 64-bit hashes of their bytes; the test compares with encoding whole texts.

Defined results: null or empty text is the end id alone; a null doc_id comes first; rows that repeat a doc_id
are documents of their own, ordered by a hash of the text; very long texts are encoded whole; other columns are not
looked at, whatever their names; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, saved, scratch_path
from .files import write_whole
from .hashing import EXACT, U, slices, span_hashes, word_spans
from .range_coder import BLOCK, decode_block, encode_block

HEAD = struct.Struct("<4sIQQ")
TAIL = struct.Struct("<QI4s")
MAGIC = b"SLTK"
#: Bytes of text that a task is dealt, ids of a file, and files that a task may begin.
TASK_BYTES, FILE_IDS, TASK_FILES = 16 << 20, 4 * BLOCK, 1 << 20
#: Bytes of text that are encoded at once, words after which the store is emptied, and letters that a normaliser has to leave as they are.
PART, KEPT, LETTERS = 2 << 20, 700_000, "abcdefghijklmnopqrstuvwxyz a z"
#: Words that are looked up at once; slots of the table, more than twice those and ``KEPT``.
WORDS, SLOTS, SHIFT = 1 << 18, 1 << 21, U(64 - 21)
#: Marks that may end a word without being part of its letters, and how many of them are looked at in whole arrays.
ENDS, MARKS = b".,;:!?#$%&*", 8
#: A number for each byte that is such a mark (0: none), which bytes are ASCII letters, and A-Z in lower case.
MARK = np.zeros(256, np.int64)
MARK[list(ENDS)] = np.arange(1, len(ENDS) + 1)
LETTER, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER[65:91] += 32
#: Stems that are encoded as one text.
TOGETHER = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of many runs, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Growing:
    """An array that is added to at its end; ``n`` of its values count."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Numbers:
    """A table from 64-bit hashes to numbers, for whole arrays at a time: open addressing over ``SLOTS``."""

    def __init__(self) -> None:
        self.keys, self.values = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for those that aren't there."""
        slot = (hashes >> SHIFT).astype(np.int64)
        key = self.keys.take(slot)
        out = np.where(key == hashes, self.values.take(slot), -1).astype(np.int64)
        rest = np.flatnonzero((key != hashes) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            key, want = self.keys.take(slot[rest]), hashes[rest]
            hit = key == want
            out[rest[hit]] = self.values.take(slot[rest[hit]])
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that aren't there yet."""
        slot, rest = (hashes >> SHIFT).astype(np.int64), np.arange(len(hashes))
        while len(rest):
            free = rest[self.keys.take(slot[rest]) == 0]
            self.keys[slot[free]] = hashes[free]  # of several that want a slot one gets it
            own = free[self.keys.take(slot[free]) == hashes[free]]
            self.values[slot[own]] = values[own]
            rest = np.setdiff1d(rest, own, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)


class Encoder:
    """Ids of texts, through a store of words (by 64-bit hashes of their bytes) that is emptied when full.

    A word's ids are those of its stem, then those of the marks at its end.  New stems of letters alone are
    encoded many at a time: each of them ends with an id that only ends words, if the vocabulary has
    such ids.  Those of ASCII letters have a table of their own and don't become Python objects one by one; a copy of the
    tokenizer without its normaliser encodes them, if that does no more to them than put them in lower case.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        given = json.loads(self.tokenizer.to_str())
        suffix = given["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if suffix and x.endswith(suffix) and i < len(self.ends)]] = True
        normal = self.tokenizer.normalizer
        upper = normal.normalize_str(LETTERS.upper()) if normal else LETTERS.upper()
        self.case = LOWER if upper == LETTERS else np.arange(256, dtype=np.uint8)
        same = normal is not None and normal.normalize_str(LETTERS) == LETTERS and upper in (LETTERS, LETTERS.upper())
        self.plain = Tokenizer.from_str(json.dumps(given | {"normalizer": None})) if same else self.tokenizer
        self.empty()

    def empty(self) -> None:
        self.table, self.letters, self.stems = Numbers(), Numbers(), {}
        self.ids, self.places = Growing(np.uint32), Growing(np.int64)
        self.places.add(np.zeros(1, np.int64))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add words; the number of the first."""
        first = self.places.n - 1
        self.places.add(self.ids.n + np.cumsum(sizes))
        self.ids.add(ids)
        return first

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        starts = self.places.data.take(numbers)
        sizes = self.places.data.take(numbers + 1) - starts
        return self.ids.data.take(_joined(starts, sizes)), sizes

    def encoded(self, stems: list[str], joined: list[str] | None = None, tokenizer: Any = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stems, one after the other, and how many each has; ``joined``: stems of letters alone, some to a text."""
        if joined and self.ends.any():
            many = tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in many), np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(stems):
                return ids, np.diff(last, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(stems, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def others(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the stem and of the marks at the end (-1: none) of new words that aren't ASCII letters and marks."""
        stems, letters, rest, parts = self.stems, {}, {}, []
        for word in words:
            stem = word.rstrip(ENDS)
            if not stem.isascii() and (text := stem.decode()).isalpha() and text[-1].lower()[-1].isalpha():
                kind, end = letters, word[len(stem) :]
            elif not stem or not stem[-1:].isalnum() or b"<|" in word:  # the marks might not be encoded apart
                kind, stem, end = rest, word, b""
            else:
                kind, end = rest, word[len(stem) :]
            if stem not in stems:
                kind[stem] = None
            if end and end not in stems:
                rest[end] = None
            parts += (stem, end)
        for found, alone in ((letters, True), (rest, False)):
            if found:
                texts = [x.decode() for x in found]
                joined = [" ".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)] if alone else None
                first = self._add(*self.encoded(texts, joined, self.tokenizer))
                stems.update(zip(found, range(first, first + len(found)), strict=True))
        return np.array([stems[x] if x else -1 for x in parts], np.int64).reshape(-1, 2)

    def lettered(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of stems of ASCII letters."""
        letters, upto = self.case[data[_joined(starts, sizes)]], np.cumsum(sizes)
        hashes = span_hashes(letters, upto - sizes, upto, EXACT) | U(1)
        number = self.letters.get(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            names, at, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[at]
            size = sizes[at]
            begins = np.cumsum(size + 1) - (size + 1)
            text = np.full(int(size.sum()) + len(size), 32, np.uint8)
            text[_joined(begins, size)] = letters[_joined(upto[at] - size, size)]
            text = text.tobytes().decode()
            cuts = [*begins[::TOGETHER].tolist(), len(text)]
            joined = [text[i : j - 1] for i, j in zip(cuts, cuts[1:], strict=False)]
            first = self._add(*self.encoded(text.split(), joined, self.plain))
            found = np.arange(first, first + len(at))
            self.letters.add(names, found)
            number[new] = found[which]
        return number

    def numbers(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of new words, ascending in ``data``."""
        stops, marks, rest = ends.copy(), np.zeros(len(ends), np.int64), np.arange(len(ends))
        for _ in range(MARKS):
            mark = MARK[data[stops[rest] - 1]]
            rest, mark = rest[mark > 0], mark[mark > 0]
            marks[rest] = marks[rest] * (len(ENDS) + 1) + mark
            stops[rest] -= 1
            rest = rest[stops[rest] > begins[rest]]
        a, b = int(begins[0]), int(ends[-1])
        odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(~LETTER[data[a:b]])])
        plain = (stops > begins) & (odd[stops - a] == odd[begins - a])
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        out = np.full((len(begins), 2), -1, np.int64)
        if len(own):
            out[own, 0] = self.lettered(data, begins[own], (stops - begins)[own])
            _, at, which = np.unique(marks[own], return_index=True, return_inverse=True)
            kinds = [data[stops[i] : ends[i]].tobytes() for i in own[at].tolist()]
            new = [x for x in kinds if x and x not in self.stems]
            if new:
                first = self._add(*self.encoded([x.decode() for x in new]))
                self.stems.update(zip(new, range(first, first + len(new)), strict=True))
            out[own, 1] = np.array([self.stems[x] if x else -1 for x in kinds], np.int64)[which]
        if len(rest):
            out[rest] = self.others([data[i:j].tobytes() for i, j in zip(begins[rest].tolist(), ends[rest].tolist(), strict=True)])
        both = np.flatnonzero(out[:, 1] >= 0)
        ids, sizes = self._of(out[both].ravel())
        first = self._add(ids, sizes.reshape(-1, 2).sum(axis=1))
        out[both, 0] = np.arange(first, first + len(both))
        return out[:, 0]

    def _words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        if self.places.n > KEPT:
            self.empty()
        hashes = span_hashes(data, begins, ends, EXACT) | U(1)
        number = self.table.get(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            names, at, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            order, found = np.argsort(at), np.empty(len(at), np.int64)
            found[order] = self.numbers(data, begins[new[at[order]]], ends[new[at[order]]])
            self.table.add(names, found)
            number[new] = found[which]
        return self._of(number)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        begins, ends = word_spans(data, bounds)
        parts = [self._words(data, begins[i : i + WORDS], ends[i : i + WORDS]) for i in range(0, max(1, len(begins)), WORDS)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, bounds)]
        return np.insert(ids, upto[1:], np.uint32(self.end_id)), np.diff(upto) + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def file_of(ids: list[np.ndarray], names: list[int | None]) -> bytes:
    """A file from the ids (with end ids) and the doc_ids of its documents."""
    every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [encode_block(every[i : i + BLOCK]) for i in range(0, len(every), BLOCK)]
    index = np.array([[x is not None, x or 0, len(y)] for x, y in zip(names, ids, strict=True)], "<i8").reshape(-1, 3)
    packed = zlib.compress(np.ascontiguousarray(index.T).tobytes())
    return b"".join([HEAD.pack(MAGIC, 1, len(names), len(blocks)), *blocks, packed, TAIL.pack(len(packed), zlib.crc32(packed), MAGIC)])


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document; a block at a time is decoded."""
    magic, version, n_docs, n_blocks = HEAD.unpack_from(data)
    size, crc, end = TAIL.unpack_from(data, len(data) - TAIL.size)
    packed = data[len(data) - TAIL.size - size : len(data) - TAIL.size]
    if magic != MAGIC or end != MAGIC or version != 1 or zlib.crc32(packed) != crc:
        raise ValueError("damaged file")
    index = np.frombuffer(zlib.decompress(packed), "<i8").reshape(3, n_docs)
    at, have, view = HEAD.size, np.empty(0, np.uint32), memoryview(data)
    for present, name, n in index.T:
        parts, missing = [have[:n]], n - len(have)
        have = have[n:]
        while missing > 0:
            block, at = decode_block(view, at)
            parts.append(block[:missing])
            have, missing = block[missing:], missing - len(block)
        yield (int(name) if present else None), np.concatenate(parts)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS, part: int = PART) -> DataFrame:
    """Write the files; returns (file, docs, tokens, bytes) of each."""
    schema = pa.schema([("file", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, names, ids, held, files = encoder(tokenizer, end_id), TaskContext.get().partitionId(), [], [], 0, 0

        def written() -> pa.RecordBatch:
            nonlocal names, ids, held, files
            file, data = task * TASK_FILES + files, file_of(ids, names)
            write_whole(f"{folder}/part-{file:019d}.tok", data)
            out = pa.RecordBatch.from_pydict({"file": [file], "docs": [len(names)], "tokens": [held], "bytes": [len(data)]}, schema)
            names, ids, held, files = [], [], 0, files + 1
            return out

        for batch in batches:
            for i, j, data, bounds in slices(batch["text"], part):
                found, sizes = encode(data, bounds)
                names += batch["doc_id"].slice(i, j - i).to_pylist()
                ids += np.split(found, np.cumsum(sizes)[:-1])
                held += len(found)
                if held >= file_ids:
                    yield written()
        if names:
            yield written()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tid"))
    size = given.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    by = ["doc_id", "tid"]
    ordered = given.repartitionByRange(max(1, -(-size // task_bytes)), *by).sortWithinPartitions(*by).select("doc_id", "text")
    return saved(ordered.mapInArrow(run, "file long, docs long, tokens long, bytes long"), "token-files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, doc_id, at, n_tokens, ids_crc32, ids) of each document in the files; ``at``: ids before it in its file."""
    schema = pa.schema([("file", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                file, at, rows = int(path.as_py().rpartition("part-")[2].split(".")[0]), 0, []
                for place, (name, ids) in enumerate(read_file(data.as_py())):
                    rows.append((file, place, name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(f"{folder}/*.tok").select("path", "content")
    return files.mapInArrow(run, "file long, place long, doc_id long, at long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from files written and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    files = write_tokens(docs, folder, tokenizer or default_tokenizer(), end_id, text)
    if files.isEmpty():
        return files.select(F.col("file").alias("doc_id"), F.col("file").alias("start"), F.col("file").alias("n_tokens"), F.col("file").alias("ids_crc32"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = saved(files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base")), "token-starts")
    return join_groups(read_tokens(spark, folder), starts, ["file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
