"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The encoder keeps, for each end position in a window of twice the longest
piece, the last piece of the best segmentation that ends there and a
backpointer. Whenever the backpointer paths of all positions that a later
piece can still start from meet in one boundary, the ids before it are
committed and their state is dropped, so memory is bounded for any text.

Two kinds of models are supported, as the model file says:

* unigram: the best path has the largest sum of piece scores;
* BPE: the merge order admits exactly one segmentation for each prefix. A path
  may go on with a piece only if merging the last two pieces' characters on
  their own yields just these two pieces; that makes the surviving path equal
  to what the merges give, which a sum of scores would not.

Models with a compiled character map are refused; the others (identity
normalisation) are handled with dummy prefix, escaped spaces and byte fallback.
"""

from __future__ import annotations

import array
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, kept, map_rows, read

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Entries of a worker's memo of encoded words, and the longest word in it.
MEMO, MEMO_CHARS = 300_000, 40
#: Characters before a position by which the pieces that may end there are looked up.
TAIL = 4
NEVER = float("-inf")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces and flags of a SentencePiece model file, given as bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, squeeze, escape, charsmap = UNIGRAM, True, True, True, b""
        for n, value in _fields(data):
            if n == 1:
                x = dict(_fields(value))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(x.get(3, NORMAL))
            elif n == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                x = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze, escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        if charsmap or not escape or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalisation and escaped white space are supported")
        self.squeeze = squeeze
        self.vocab = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unk = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.unk_score = min(self.scores, default=0.0) - 10.0
        self.rank = {p: self.scores[i] for p, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab), default=1)
        #: Pairs of characters that stand together in some piece.
        self.joined = joined = {p[i : i + 2] for p in self.vocab for i in range(len(p) - 1)}
        #: No piece goes over the start of a run of spaces, or over a line end.
        self.words_apart = not any(x[1] == SPACE and x[0] != SPACE or "\n" in x for x in joined)
        tails: dict[str, set[int]] = {}
        for p in self.vocab:
            if len(p) > TAIL:
                tails.setdefault(p[-TAIL:], set()).add(len(p))
        self._tails = {k: sorted(v, reverse=True) for k, v in tails.items()}
        self.decoded = [self._out(i) for i in range(len(self.pieces))]

    def ends(self, tail: str) -> list[tuple[int, str | None]]:
        """Lengths of the pieces of two characters or more that may end with a tail, longest first; the piece where the tail holds it."""
        short = [(n, tail[-n:]) for n in range(min(TAIL, len(tail)), 1, -1) if tail[-n:] in self.vocab]
        return [(n, None) for n in self._tails.get(tail, ())] + short

    def _out(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()


class Codec:
    """encode() and decode() of whole texts."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.fits = Memo(self._fit, MEMO)
        self.ends = Memo(self.model.ends, MEMO)
        self.memo = Memo(self._word, MEMO)

    def _fit(self, pair: tuple[str, str]) -> bool:
        """Whether the merges of a pair of pieces, or of a first piece, leave it as it is: best score first, then leftmost."""
        rank, parts, left = self.model.rank, list(pair[0] + pair[1]), len(pair[0])
        joins = [rank.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while joins and (top := max(joins)) > NEVER:
            i = joins.index(top)
            if i == left - 1:
                return False
            left -= i < left
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(joins):
                joins[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return parts == [p for p in pair if p]

    def _unknown(self, piece: str) -> list[int]:
        return [self.model.bytes[b] for b in piece.encode("utf-8", "replace")] if self.model.bytes else [self.model.unk]

    def stream(self, s: str, window: int | None = None):
        """Yield runs of ids of an escaped string as they are committed."""
        m, vocab, longest, ends, fits = self.model, self.model.vocab, self.model.longest, self.ends, self.fits
        window = window or 2 * longest
        bpe, rank, unk_score = m.kind == BPE, m.rank, m.unk_score
        base, last, best = 0, [""], [0.0]  # state of positions base, base + 1, ...
        for i in range(1, len(s) + 1):
            at, chosen = i - base, s[i - 1]
            if bpe:
                for n, piece in ends[s[i - TAIL if i > TAIL else 0 : i]]:
                    if n <= at and (piece or (piece := s[i - n : i]) in vocab) and fits[last[at - n], piece]:
                        chosen = piece
                        break
            else:
                top, tied = best[-1] + rank.get(chosen, unk_score), True
                for n, piece in ends[s[i - TAIL if i > TAIL else 0 : i]]:
                    if n <= at and (piece or (piece := s[i - n : i]) in vocab):
                        score = best[at - n] + rank[piece]
                        if score > top or tied and score == top:
                            chosen, top, tied = piece, score, False
                best.append(top)
            last.append(chosen)
            if at >= window and at % longest == 0:
                meet = self._meet(last, range(at - longest + 1, at + 1))
                if meet > 0:
                    yield self._run(last, meet)
                    last, best, base = last[meet:], best[meet:], base + meet
        if s:
            yield self._run(last, len(last) - 1)

    @staticmethod
    def _meet(last: list[str], live: range) -> int:
        """The last boundary on every path from the live positions back to the first."""
        heads = set(live)
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            heads.add(far - len(last[far]) if far > 0 else 0)
        return heads.pop()

    def _run(self, last: list[str], end: int) -> list[int]:
        parts = []
        while end > 0:
            piece = last[end]
            parts.append(piece)
            end -= len(piece)
        get, out = self.model.vocab.get, []
        for p in reversed(parts):
            k = get(p)
            if k is None:
                out += self._unknown(p)
            else:
                out.append(k)
        return out

    def _word(self, s: str) -> bytes:
        # No piece holds the last two characters, such as a letter and a comma: the last one stands alone.
        if 1 < len(s) <= MEMO_CHARS and s[-2:] not in self.model.joined:
            return self.memo[s[:-1]] + self.memo[s[-1]]
        return b"".join([array.array("i", run).tobytes() for run in self.stream(s)])

    def encode(self, text: str) -> np.ndarray:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.empty(0, "<i4")
        s = (" " if m.dummy_prefix else "") + text
        if not m.words_apart:
            return np.array([x for run in self.stream(s.replace(" ", SPACE)) for x in run], "<i4")
        if "  " in s:
            words = [w for line in re.findall("\n|[^\n]+", s) for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line.replace(" ", SPACE))]
        else:
            words = s.replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")
        if max(map(len, words)) > MEMO_CHARS:
            return np.frombuffer(b"".join([self._word(w) if len(w) > MEMO_CHARS else self.memo[w] for w in words]), "<i4")
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<i4")

    def decode(self, ids: list) -> str:
        """The text of ids; null ids and ids that the model doesn't have are unknown pieces."""
        table = self.model.decoded
        if ids and (None in ids or min(ids) < 0 or max(ids) >= len(table)):
            ids = [i if i is not None and 0 <= i < len(table) else self.model.unk for i in ids]
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def codec_of(data: bytes) -> Codec:
    """The worker's codec of a model; its tasks share the memos."""
    return kept("codec", data, Codec)


def encode_documents(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, ids, round_trip) of each row.

    ids_crc32: of the ids as little-endian 32-bit integers; round_trip: decoding
    gives the text again. A null text is an empty one: no ids, round_trip true.
    A repeated row gives a repeated row; a null id stays null; other columns are
    ignored. Texts are encoded whole, at any length, in bounded memory beyond
    the text and its ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        codec = codec_of(shared.value)

        def run(rows):
            ids = [codec.encode(t or "") for t in rows["text"]]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i4")
            flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
            return {
                "id": rows["id"],
                "n_ids": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                "round_trip": [codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, rows["text"])],
            }

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "id long, n_ids long, ids_crc32 long, ids array<int>, round_trip boolean", "text").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null or empty ids give an empty text, ids that the model doesn't have unknown marks."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def make():
        codec = codec_of(shared.value)
        return lambda rows: {"id": rows["id"], "text": [codec.decode(x or []) for x in rows["ids"].to_pylist()]}

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_rows(rows, make, "id long, text string").withColumnRenamed("id", id_col)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), model_bytes())
