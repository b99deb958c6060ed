"""Whole texts to token ids, in id order, kept in grammar-compressed frames.

Rows are put in order of ``doc_id`` by range, so a hot source or group of copies spreads over
the ranges. Each task encodes its texts and packs frames (see :mod:`grammar`); frames are
Parquet rows (shard, frame, n_tokens, payload), shards ascending with the ids. Reading takes
the frames and nothing else.

Null texts count as empty and give the end id only. Null ids come first; equal ids stay next
to each other, ordered by text. Very long texts are encoded whole and lie in one frame. An empty table gives no
rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.grammar import FRAME_TOKENS, pack, unpack
from songloom.llm.tables import fresh_path

END_ID = 2
#: Encoded chunks kept by a worker process.
KEPT = 1_000_000
#: White space other than the blank and the line feed.
_OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Letters below this code point are letters in every version of Unicode.
_LETTERS_END = "\u0250"
#: Marks that end words, and the length from which a run of them is not kept.
_MARKS, _SHORT = ",.;:!?", 4
_JOINED_SPACE = ("  ", " \n", "\n ", "\n\n")


#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others, in
#: order, for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BLANK = chr(_BYTE_SYMBOLS[32])


class _Known(dict):
    """Chunks and their ids; a chunk that is not there is encoded when it is looked up."""

    def __init__(self, encode: Callable[[str, dict], bytes]):
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self._encode(chunk, self)
        return found


class Encoder:
    """Encodes with the tokenizers library; equal chunks of text are encoded once.

    A byte-level vocabulary never merges across a blank or line feed that stands between two
    other characters, so chunks between them are encoded by themselves. Texts with any other
    white space are encoded in one piece.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._kept = kept
        self._first, self._later = (_Known(lambda chunk, known, lead=lead: self._new(chunk, known, lead)) for lead in ("", " "))
        self._merge = self._tokenizer.model.tokenize
        self._line = self.whole("\n")
        self._marks = _Known(lambda marks, known: self.whole(marks))

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, chunk: str, known: dict[str, bytes], lead: str) -> bytes:
        """Ids of a chunk; one of letters alone (after a blank) needs no splitting, only merging."""
        if not chunk.isalpha():
            # marks after a letter are split off, and a run of them is encoded by itself
            word = chunk.rstrip(_MARKS)
            if len(word) < len(chunk) and word[-1:].isalpha():
                marks = chunk[len(word) :]
                return known[word] + (self._marks[marks] if len(marks) < _SHORT else self.whole(marks))
            return self.whole(lead + chunk)
        if chunk.isascii():
            symbols = chunk
        elif max(chunk) < _LETTERS_END:
            symbols = chunk.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
        else:
            return self.whole(lead + chunk)
        of_id = self._bytes
        return b"".join([of_id[t.id] for t in self._merge(_BLANK + symbols if lead else symbols)])

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in _JOINED_SPACE) or any(s in text for s in _OTHER_SPACE) or any(s in text for s in self._added):
            return self.whole(text)
        for known in (self._first, self._later):
            if len(known) > self._kept:
                known.clear()
        first, later, out = self._first.__getitem__, self._later.__getitem__, []
        for line in text.split("\n"):
            start, *rest = line.split(" ")
            out.append(first(start) + b"".join(map(later, rest)))
        return self._line.join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process: what it has kept serves the tasks that follow."""
    return Encoder(path)


_FRAMES = pa.schema([("frame", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_FRAMES_SQL = "frame int, before long, doc_ids array<long>, n_tokens long, payload binary"


def _packer(path: str, frame_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        number, size, before = 0, 0, 0  # before: ids of the earlier frames of the shard
        ids: list = []
        parts: list[bytes] = []

        # very many small objects and no cycles among them: looking for some costs a fifth of the time
        collecting = gc.isenabled()
        gc.disable()

        def frame() -> pa.RecordBatch:
            data = b"".join(parts)
            payload = pack(np.frombuffer(data, "<u4"), np.array([len(p) // 4 for p in parts]))
            row = {"frame": number, "before": before, "doc_ids": ids, "n_tokens": len(data) // 4, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_FRAMES)

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids.append(doc_id)
                    parts.append(encode(text) + end)
                    size += len(parts[-1]) // 4
                    if size >= frame_tokens:
                        yield frame()
                        number, before, size, ids, parts = number + 1, before + size, 0, [], []
            if parts:
                yield frame()
        finally:
            if collecting:
                gc.enable()

    return run


def write_frames(docs: DataFrame, folder: str, vocabulary: str, frame_tokens: int = FRAME_TOKENS) -> None:
    """Encode ``docs`` and write their frames below ``folder``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ordered = texts.repartitionByRange(order[0]).sortWithinPartitions(*order)
    frames = ordered.mapInArrow(_packer(vocabulary, frame_tokens), _FRAMES_SQL)
    frames.withColumn("shard", F.shiftright(F.monotonically_increasing_id(), 33).cast("int")).write.option(
        "compression", "zstd"
    ).parquet(folder)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _unpacker(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                frame = unpack(row["payload"])
                ids, ends = frame.ids(), np.cumsum(frame.doc_lengths)
                docs = []
                for doc_id, length, stop in zip(row["doc_ids"], frame.doc_lengths.tolist(), ends.tolist()):
                    data = ids[stop - length : stop].tobytes()
                    docs.append((doc_id, row["start"] + stop - length, length, zlib.crc32(data), data if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs), _DOCS)], schema=_DOCS)

    return run


def read_documents(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of every document."""
    frames = spark.read.schema(_FRAMES_SQL + ", shard int").parquet(folder)
    # frames know what comes before them in their shard; the shards' totals are summed here
    total, starts = 0, []
    for row in frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one row a shard
        starts.append((row["shard"], total))
        total += row["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))  # one row a shard
    placed = frames.join(offsets, "shard")
    rows = placed.select("doc_ids", "payload", (F.col("shard_start") + F.col("before")).alias("start"))
    return rows.mapInArrow(_unpacker(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode all documents into new frames and read every document back."""
    folder = fresh_path(docs.sparkSession, "frames")
    write_frames(docs, folder, vocabulary)
    return read_documents(docs.sparkSession, folder)
