"""Token-id output: documents in id order as Simple-8b streams, and the way back.

A token table has one row for each segment: whole documents, about SEGMENT_IDS ids. Rows
carry the shard (its place in the order of ids), the segment's number in it, the ids that
stand before it in the shard, the documents' ids and lengths, and the stream (simple8b).
It is written by Spark's own Parquet writer, so any store that Spark can write to will do
and a lost executor's files are written again.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import mapped, resident, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEGMENT_IDS = 1 << 20
#: Pieces remembered by a worker, for each of two generations; longer ones are not.
REMEMBERED = 300_000
_LONGEST_REMEMBERED = 64

SEGMENTS = "shard int, segment long, ids_before long, n_ids long, doc_ids binary, doc_lengths binary, missing_ids binary, stream binary"

#: Bytes of text that are cut and looked up together; a document may go over several such windows.
WINDOW_BYTES = 4 << 20

# A piece of one word of plain letters, which the tokenizer's own splitting leaves whole.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

# Classes of bytes, by which texts are cut. C3 to C5, D0 and D1 lead letters alone, but for two in C3.
_SPACE, _LETTER, _ASCII_OTHER, _LEADS_TWO, _LEADS_LETTER = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 65), *range(91, 97), *range(123, 127)]] = _ASCII_OTHER
_CLASS[0xC3:0xE0] = _LEADS_TWO
_CLASS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] |= _LEADS_LETTER


def cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 text can be cut so that its pieces, encoded alone, give the ids of the whole: a flag for each byte.

    The tokenizer's own splitting never crosses these: white space after what isn't, and
    after a letter whatever is neither letter nor part of a longer character. Places that
    are harder to judge are left out. Pieces are a word each for the most part.
    """
    kind = _CLASS[data]
    now, before, two = kind[2:], kind[1:-1], kind[:-2]
    ends = data[1:-1] & 0xC0 == 0x80  # the character before has two bytes if ``two`` leads two
    sign = (data[:-2] == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7))
    letter = (before & _LETTER > 0) | ends & (two & _LEADS_LETTER > 0) & ~sign
    full = (before & (_LETTER | _ASCII_OTHER) > 0) | ends & (two & _LEADS_TWO > 0)
    out = np.zeros(len(data), bool)
    out[2:] = (now & _SPACE > 0) & full | (now & _ASCII_OTHER > 0) & letter
    if len(data) > 1 and kind[0] & (_LETTER | _ASCII_OTHER):
        out[1] = kind[1] & _SPACE or kind[0] & _LETTER and kind[1] & _ASCII_OTHER
    return out


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file, read on the driver and sent along with the tasks (1.6 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _visible_bytes() -> dict[int, str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable Latin-1
    ones stand for themselves, the others for those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TextEncoder:
    """The tokenizers library behind a bounded memory of pieces of text."""

    def __init__(self, json_text: str, remembered: int = REMEMBERED, window_bytes: int = WINDOW_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        special = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Tokens of their own, which a cut must not go through.
        self.special = re.compile(b"|".join(special) or rb"(?!)")
        self.model, self.visible, self.window_bytes, self.most = self.tokenizer.model, _visible_bytes(), window_bytes, remembered
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, piece: bytes) -> list[int]:
        if _WORD.fullmatch(piece):  # nothing to split, so the library's model sees it at once
            shown = piece.decode().replace(" ", self.visible[32]) if piece.isascii() else piece.decode("latin-1").translate(self.visible)
            return [x.id for x in self.model.tokenize(shown)]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers, from memory or made now."""
        known, old = self.known, self.old
        missing = [p for p in pieces if p not in known]
        if old:
            known.update((p, old[p]) for p in missing if p in old)
            missing = [p for p in missing if p not in known]
        found = [self._ids(p) for p in missing]
        ends = np.cumsum([0, *map(len, found)]) * 4
        flat = np.fromiter(chain.from_iterable(found), "<u4", int(ends[-1]) // 4).tobytes()
        new = {p: flat[a:b] for p, a, b in zip(missing, ends.tolist(), ends[1:].tolist(), strict=False)}
        out = [known[p] if p in known else new[p] for p in pieces]
        known.update((p, x) for p, x in new.items() if len(p) <= _LONGEST_REMEMBERED)
        if len(known) > self.most:
            self.known, self.old = {}, known
        return out

    def _window(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of ``data``, which begin at ``places``, and how many each has."""
        bounds = np.append(places, len(data)).astype("<i8")
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        packed = self._packed(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(lengths) - lengths
        which = pieces.indices.to_numpy()
        each = lengths[which]
        at = np.repeat(starts[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return np.frombuffer(b"".join(packed), "<u4")[at], each

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow string array, as unsigned 32-bit integers; null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        whole = [(int(a), int(b)) for a, b in zip(bounds, bounds[1:], strict=False) if self.special.search(data[a:b])] if self.special.search(data) else []
        ids, lengths, begins = [], [], []
        low, size = 0, self.window_bytes
        while low < len(data):
            high = min(len(data), low + size)
            here = cuts(data[low:high])
            here[bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low] = True
            here[0] = True
            places = np.flatnonzero(here)
            for a, b in whole:  # no cuts inside texts with tokens of their own
                places = places[(places + low <= a) | (places + low >= b)]
            if high < len(data):  # the last piece may go on
                if len(places) < 2:
                    size *= 2
                    continue
                high, places = low + int(places[-1]), places[:-1]
            found, each = self._window(np.ascontiguousarray(data[low:high]), places)
            ids.append(found)
            lengths.append(each)
            begins.append(places + low)
            low, size = high, self.window_bytes
        if not ids:
            return [np.zeros(0, "<u4")] * len(texts)
        ids, lengths, begins = map(np.concatenate, (ids, lengths, begins))
        upto = np.append(0, np.cumsum(lengths))[np.searchsorted(begins, bounds)]
        return [ids[a:b] for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian 32-bit integers."""
        return self.encode_all(pa.array([text]))[0].tobytes()


def encoder(json_text: str) -> TextEncoder:
    """One encoder for each tokenizer and worker."""
    return resident(("tokens", hash(json_text)), lambda: TextEncoder(json_text))


def encoded(json_text: str, end_id: int | None):
    """Pairs of (id, ids) for Arrow batches of (id, text), in order."""
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches):
        e = encoder(json_text)
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), e.encode_all(batch.column(1)), strict=True):
                yield name, ids.tobytes() + tail

    return run


def _segment(shard: int, number: int, before: int, docs: list[tuple]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    values = [
        shard, number, before, len(ids),
        np.array([i or 0 for i, _ in docs], "<i8").tobytes(), np.array([len(x) // 4 for _, x in docs], "<i8").tobytes(),
        np.array([i is None for i, _ in docs]).tobytes(), simple8b.pack(ids),
    ]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "segment", "ids_before", "n_ids", "doc_ids", "doc_lengths", "missing_ids", "stream"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def segments(json_text: str, end_id: int | None, segment_ids: int):
    def run(batches):
        shard, number, before, docs, n = TaskContext.get().partitionId(), 0, 0, [], 0
        for doc in encoded(json_text, end_id)(batches):
            docs.append(doc)
            n += len(doc[1]) // 4
            if n >= segment_ids:
                yield _segment(shard, number, before, docs)
                number, before, docs, n = number + 1, before + n, [], 0
        if docs:
            yield _segment(shard, number, before, docs)

    return run


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int | None = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all documents to a token table, in ascending order of the documents' ids.

    Null text counts as empty, texts of any length are encoded whole. Null ids come first; rows
    that share an id go by text. An empty table makes an empty token table. Other columns,
    whatever their names, are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.transform(mapped, segments(tokenizer_json(tokenizer), end_id, segment_ids), SEGMENTS).write.parquet(path)


def _located(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids before them in all shards."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # a row for each task that wrote
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), "shard").select((F.col("_base") + F.col("ids_before")).alias("start"), "doc_ids", "doc_lengths", "missing_ids", "stream")


def _documents(batch):
    """(id, first id's place, ids) for each document of segments, decoded from their streams."""
    for start, names, lengths, missing, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ids = simple8b.unpack(stream).astype("<u4")
        names, lengths, gone = np.frombuffer(names, "<i8").tolist(), np.frombuffer(lengths, "<i8"), np.frombuffer(missing, "?").tolist()
        ends = np.cumsum(lengths).tolist()
        for name, none, n, end in zip(names, gone, lengths.tolist(), ends, strict=True):
            yield None if none else name, start + end - n, ids[end - n : end]


def _read(batches):
    for batch in batches:
        rows = list(_documents(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
            names=["doc_id", "start", "ids"],
        )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document of a token table; ids are little-endian 32-bit integers."""
    return _located(spark, path).transform(mapped, _read, "doc_id long, start long, ids binary")


def _index(batches):
    for batch in batches:
        rows = [(name, start, len(ids), zlib.crc32(ids.tobytes())) for name, start, ids in _documents(batch)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the streams of a token table."""
    return _located(spark, path).transform(mapped, _index, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, count and checksum of every document, read back from the files. Null text is empty, rows that repeat have a place each,
    null ids come where the order of ids puts them, an empty table gives no rows: see ``write``."""
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return index(spark, path)
