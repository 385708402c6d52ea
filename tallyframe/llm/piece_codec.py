"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Encoding is exact and goes by backtracking: at each position the longest vocabulary match
(Aho-Corasick) is tried first, then shorter ones; a token may follow another only if merging
the two side by side again yields the same two; a bitfield keeps the positions from which no
continuation exists. A sequence whose neighbours are all compatible is the merge encoding,
so positions that failed once fail for good and the work is linear in the text.

Merges never cross the start of a run of word-begin marks, nor a line feed, nor the step from
a letter to certain punctuation, as no piece of the model does (checked when it is loaded).
Texts are cut there, and words that come often are looked up in a bounded memory of two
generations.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, let_go, mapped, resident, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Word pieces remembered by a worker, for each of two generations.
REMEMBERED = 200_000
_PAIRS = 1_000_000


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and sent along with the tasks (half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}  # the lower, the earlier a merge
        self.byte_ids, self.raw = [0] * 256, []
        self.is_byte = np.zeros(len(sp), bool)
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.is_byte[i] = i, True
                self.raw.append(bytes([value]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(b" \xe2\x81\x87 ")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.cost[piece] = i, -sp.get_score(i)
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in self.ids):
            raise ValueError("a piece of this model crosses a word boundary or a line feed")
        #: each piece as the one string that all that is remembered shares
        self.same = {x: x for x in self.ids}
        self.history: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # a piece that its own characters don't merge into is never made
        whole = [x for x in self.ids if len(x) > 1 and self._merges(x)[0]]
        made = set(whole)
        self.automaton = ahocorasick.Automaton()
        for piece in whole:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        #: the next shorter match at the same position
        shorter = ((x, next((x[:k] for k in range(len(x) - 1, 1, -1) if x[:k] in made), x[0])) for x in whole)
        self.shorter = {x: self.same.get(y, y) for x, y in shorter}
        inside = {m[1] for x in whole for m in re.finditer(r"[^\W\d_](?=([^\w\s]))", x)}
        stops = re.escape("".join(x for x in ".,;:!?*&%$#|()[]{}<>+=/\"-" if x not in inside))
        word = f"{MARK}*[^\\W\\d_]+(?=[{MARK}\n{stops}]|$)"
        self.cut = re.compile(f"{word}|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.packed = Remembered(self._pack, remembered)

    # merges of a single token

    def _merges(self, token: str) -> tuple:
        """(whether the token's characters merge into it, its merges in order as (cost, new
        first symbol or None, new last symbol or None))."""
        if (known := self.history.get(token)) is None:
            symbols, events = list(token), []
            while len(symbols) > 1:
                cost, at = min((self.cost.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if cost == np.inf:
                    break
                symbols[at : at + 2] = [new := self.same[symbols[at] + symbols[at + 1]]]
                events.append((cost, new if at == 0 else None, new if at == len(symbols) - 1 else None))
            known = self.history[token] = (len(symbols) == 1, tuple(events))
        return known

    def _compatible(self, left: str, right: str) -> bool:
        """Merge both tokens anew side by side: does nothing merge across their border?

        Of merges at equal cost the leftmost goes first: those of ``left``, then the one
        across, then those of ``right``.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b = self._merges(left)[1], self._merges(right)[1]
        last, first, i, j, good = left[-1], right[0], 0, 0, True
        while good:
            across = self.cost.get(last + first, np.inf)
            in_a = a[i][0] if i < len(a) else np.inf
            in_b = b[j][0] if j < len(b) else np.inf
            if across < in_a and across <= in_b:
                good = False
            elif in_a == in_b == np.inf:
                break
            elif in_a <= in_b:
                last = a[i][2] or last
                i += 1
            else:
                first = b[j][1] or first
                j += 1
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        self.pairs[self.same.get(left, left), self.same.get(right, right)] = good
        return good

    # encoding

    def tokens(self, text: str) -> list[str]:
        """The merge encoding of a text without word borders inside, as strings; a character
        that isn't in the vocabulary stands for itself."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            longest[end - size + 1] = size
        alive = bytearray(b"\xff") * (n // 8 + 1)  # a bit for each position
        pairs, shorter = self.pairs, self.shorter
        out: list[str] = []
        at, piece = 0, text[: longest[0]] if n else ""
        while at < n:
            while piece:
                end = at + len(piece)
                if alive[end >> 3] >> (end & 7) & 1 and (not out or (pairs.get((out[-1], piece)) or self._compatible(out[-1], piece))):
                    break
                piece = shorter.get(piece)
            if piece:
                out.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < n else ""
            else:  # nothing fits here, so nothing ever will
                alive[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                piece = out.pop()
                at -= len(piece)
                piece = shorter.get(piece)
        return out

    def _pack(self, text: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(text):
            if (i := self.ids.get(token)) is not None:
                ids.append(i)
            else:
                ids += [self.byte_ids[x] for x in token.encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.packed.__getitem__, self.cut.findall(MARK + text.replace(" ", MARK))))

    # decoding

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if raw.startswith(b" "):
            first = next(i for i in ids.tolist() if self.raw[i])
            if not self.is_byte[first]:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_bad_byte(raw)


def _each_bad_byte(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


def codec(proto: bytes) -> PieceCodec:
    """One codec for each model and worker. What it was made from is given back."""

    def made() -> PieceCodec:
        new = PieceCodec(proto)
        let_go()
        return new

    return resident(("pieces", hashlib.sha256(proto).digest()), made)


def encoding(proto: bytes):
    """Arrow batches of (id, text) to (id, ids): ids packed as little-endian 32-bit integers."""

    def run(batches):
        c = codec(proto)
        begin, end = (np.array([x], "<u4").tobytes() for x in (c.bos, c.eos))
        for batch in batches:
            ids = [begin + c.encode(text or "") + end for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def decoding(proto: bytes):
    """Arrow batches of (id, ids) to (id, ids, text)."""

    def run(batches):
        c = codec(proto)
        for batch in batches:
            texts = [c.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return run


def _slim(df: DataFrame, id_col: str, value: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(value).alias("value"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids) for each row, ids with begin and end, packed as little-endian 32-bit
    integers. Null text counts as empty and texts of any length are encoded whole; rows may
    repeat, share an id or have none; an empty table gives no rows; other columns, whatever
    their names, are not read."""
    return _slim(docs, id_col, text_col).transform(mapped, encoding(model_bytes(model)), "id long, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, ids, text) for each row of packed ids. Null or empty ids give empty text, rows that repeat or have no id have a
    row each, lists of any length are decoded whole; an empty table gives no rows, other columns are not read."""
    out = _slim(tokens, id_col, ids_col).transform(mapped, decoding(model_bytes(model)), "id long, ids binary, text string")
    return out.withColumnRenamed("id", id_col)


def digests(proto: bytes):
    """Both operators in one pass over the batches, and what the query shows of their results."""
    forth, back = encoding(proto), decoding(proto)

    def run(batches):
        for batch in back(forth(batches)):
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Each row's token count and the digests of its ids and of the text decoded from them. Nulls,
    empty and long texts, repeated rows, empty tables and other columns are as in ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _slim(docs, id_col, text_col).transform(mapped, digests(model_bytes(model)), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document. Null text is empty, long texts are encoded whole, rows that repeat or have no id have
    a row each, an empty table gives no rows, other columns are not read: see ``round_trip``."""
    return round_trip(table(spark, sf_dir, "documents"))
