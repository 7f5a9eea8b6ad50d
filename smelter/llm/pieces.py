"""SentencePiece encoding by backtracking, and decoding, of models that merge pairs of pieces and fall back to bytes.

An encoding by merges is the one row of pieces in which every neighbouring pair is compatible: merging the text of the
two anew gives the same two. So a text is read from the left. An Aho-Corasick automaton over the reversed pieces tells
the longest piece at every place in one pass; the encoder takes it if it is compatible with the piece before, else the
next shorter one, and where none fits it marks the place as failed in a bitfield and takes the piece before back. Each
place fails at most once, so the work grows with the text's length, and no heap of merges is kept.

Texts are cut where no piece can reach across: before white space that follows something else, and around characters
that are in no piece. Encoded cuts and answers on pairs are kept in tables of bounded size in each Python worker.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from .common import Kept

SPACE = "▁"
#: Fixed value: what an unknown id decodes to, where the model names nothing else.
UNKNOWN_SURFACE = " ⁇ "
#: A worker keeps up to twice so many encoded cuts, none longer than this, and answers on pairs.
KEPT_CUTS, KEPT_CUT_CHARS, KEPT_PAIRS = 1 << 18, 48, 1 << 19
#: Rows are returned in batches of about so many ids.
BATCH_IDS = 1 << 21
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class PieceModel:
    """A vocabulary: every id's piece and kind, the rank of each piece that merges may make (equal scores share one), the
    ids of the 256 bytes, and for each piece the next shorter one it starts with (-1: none)."""

    pieces: list[str]
    kinds: list[int]
    rank: dict[str, int]
    byte_ids: list[int]
    shorter: list[int]
    end_id: int
    dummy_prefix: bool
    unknown_surface: str
    digest: str = field(default="")


def read_model(path: str) -> PieceModel:
    """Read a model file. It must merge pairs (BPE), leave texts as they are but for spaces, and fall back to bytes."""
    from sentencepiece import sentencepiece_model_pb2 as schema
    with open(path, "rb") as file:
        raw = file.read()
    proto = schema.ModelProto()
    proto.ParseFromString(raw)
    rules, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("the model must merge pairs, fall back to bytes and put white space before words")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("the model must leave texts as they are, but for spaces")
    pieces, kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
    if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("the model has pieces of other kinds than normal ones, bytes and marks")
    scores = sorted({p.score for p in proto.pieces if p.type == _NORMAL}, reverse=True)
    place = {score: i for i, score in enumerate(scores)}
    rank = {p.piece: place[p.score] for p in proto.pieces if p.type == _NORMAL}
    if any(c not in rank for piece in rank for c in piece):
        raise ValueError("a piece holds a character that is no piece")
    if any(SPACE in piece.lstrip(SPACE) for piece in rank):
        raise ValueError("a piece goes on after white space that follows something else")
    byte_ids = [-1] * 256
    for i, (piece, kind) in enumerate(zip(pieces, kinds)):
        if kind == _BYTE:
            byte_ids[int(piece[1:-1], 16)] = i
    # Pieces that merges never make of their own text cannot stand in an encoding.
    made = {piece: i for i, (piece, kind) in enumerate(zip(pieces, kinds)) if kind == _NORMAL and merged(piece, rank) == [piece]}
    shorter = [-1] * len(pieces)
    for piece, i in made.items():
        shorter[i] = next((made[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in made), -1)
    ends = [i for i, piece in enumerate(pieces) if piece == trainer.eos_piece and kinds[i] == _CONTROL]
    return PieceModel(pieces, kinds, rank, byte_ids, shorter, ends[0] if ends else -1, rules.add_dummy_prefix,
                      trainer.unk_surface or UNKNOWN_SURFACE, hashlib.sha256(raw).hexdigest())


def merged(text: str, rank: dict[str, int]) -> list[str]:
    """Merge a short text's characters: the best rank first, the leftmost of equals. The cost grows with the square."""
    parts, rank_of, none = list(text), rank.get, len(rank)
    ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) != none:
        i = ranks.index(best)
        parts[i] += parts.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank_of(parts[i] + parts[i + 1], none)
        if i:
            ranks[i - 1] = rank_of(parts[i - 1] + parts[i], none)
    return parts


def _fine_cuts(model: PieceModel) -> re.Pattern:
    """What a word is cut into: letters before a punctuation mark, line ends that are in no piece, and the rest. Letters
    that some piece has before a mark are not cut off, so no piece reaches across a cut."""
    marks, line_ends = ".,;:!?", "".join(c for c in "\n\t\r" if c not in model.rank)
    bound = {a for piece in model.rank for a, b in zip(piece, piece[1:]) if b in marks and re.match(r"[^\W\d_]", a)}
    letter = rf"[^\W\d_{''.join(sorted(bound))}]"
    rest = f"[^{line_ends}]++|[{line_ends}]" if line_ends else "(?s:.)++"
    return re.compile(f"{SPACE}*+{letter}++(?=[{marks}])|{rest}")


class PieceCoder:
    """Encoder and decoder of one model in one Python process."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        made = [i for i, kind in enumerate(model.kinds) if kind == _NORMAL and (
            model.shorter[i] >= 0 or len(model.pieces[i]) == 1)]
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(model.pieces[i][::-1], i)
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in model.pieces]
        #: White space and what follows it up to the next white space.
        self.words, self.cuts = re.compile(f"{SPACE}++[^{SPACE}]*+|[^{SPACE}]++"), _fine_cuts(model)
        self.kept, self.pairs = Kept(KEPT_CUTS), Kept(KEPT_PAIRS)
        self.kind_of = np.array(model.kinds)
        self.surfaces = [self._surface(i) for i in range(len(model.pieces))]

    # --- encoding ---

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        """The ids of one text as 32-bit integers, with the end id last if asked."""
        last = np.int32(self.model.end_id).tobytes() if end else b""
        if not text:
            return np.frombuffer(last, np.int32)
        plain = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        known, found = self.kept.young, []
        for word in self.words.findall(plain):
            ids = known.get(word)
            if ids is None:
                ids = self._word(word)
                known = self.kept.young
            found.append(ids)
        found.append(last)
        return np.frombuffer(b"".join(found), np.int32)

    def _word(self, word: str) -> bytes:
        """The ids of a word that is not among the young ones kept: cut further, the cuts looked up or encoded."""
        ids = self.kept.from_old(word)
        if ids is not None:
            return ids
        cuts = self.cuts.findall(word)
        if len(cuts) > 1:
            parts = []
            for cut in cuts:
                part = self.kept.young.get(cut) or self.kept.from_old(cut)
                parts.append(self._keep(cut, self._encode_cut(cut)) if part is None else part)
            return self._keep(word, b"".join(parts))
        return self._keep(word, self._encode_cut(word))

    def _keep(self, cut: str, ids: bytes) -> bytes:
        return self.kept.put(cut, ids) if len(cut) <= KEPT_CUT_CHARS else ids

    def _encode_cut(self, cut: str) -> bytes:
        n = len(cut)
        longest = [-1] * n
        for at, piece in self.automaton.iter(cut[::-1]):
            start = n - 1 - at
            if longest[start] < 0:  # of pieces that end at one place of the reversed text the longest comes first
                longest[start] = piece
        ids: list[int] = []
        start = 0
        while start < n:
            if longest[start] < 0:  # in no piece: its bytes
                ids += [self.model.byte_ids[b] for b in cut[start].encode()]
                start += 1
                continue
            stop = start
            while stop < n and longest[stop] >= 0:
                stop += 1
            ids += self._backtrack(longest, start, stop)
            start = stop
        return array("i", ids).tobytes()

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        """Pieces from ``start`` to ``stop``, all neighbours compatible."""
        lengths, shorter, compatible = self.lengths, self.model.shorter, self.compatible
        failed = bytearray((stop - start) // 8 + 1)
        out: list[int] = []
        at, piece = start, longest[start]
        while True:
            end = at + lengths[piece]
            place = end - start
            if not failed[place >> 3] >> (place & 7) & 1 and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                if at == stop:
                    return out
                piece = longest[at]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                place = at - start
                failed[place >> 3] |= 1 << (place & 7)
                piece = out.pop()
                at -= lengths[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both anew gives these two."""
        key = left << 32 | right
        answer = self.pairs.young.get(key)
        if answer is None:
            answer = self.pairs.from_old(key)
        if answer is None:
            pieces = self.model.pieces
            answer = self.pairs.put(key, merged(pieces[left] + pieces[right], self.model.rank) == [pieces[left], pieces[right]])
        return answer

    # --- decoding ---

    def _surface(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == _CONTROL:
            return b""
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        return (self.model.unknown_surface if kind == _UNKNOWN else piece.replace(SPACE, " ")).encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, without the one space that encoding puts first. Bytes that are no UTF-8 become
        U+FFFD, one each; marks such as the end id have no text and part the bytes on their sides."""
        ids = np.asarray(ids, np.int32)
        kinds, surfaces = self.kind_of[ids], self.surfaces
        bounds = np.flatnonzero(kinds == _CONTROL)
        first = next(iter(np.flatnonzero(kinds != _CONTROL)), None)
        texts = []
        for start, stop in zip([0, *(bounds + 1)], [*bounds, len(ids)]):
            text = b"".join([surfaces[i] for i in ids[start:stop].tolist()])
            if start == first and self.model.dummy_prefix and kinds[start] == _NORMAL and text.startswith(b" "):
                text = text[1:]
            texts.append(text.decode("utf-8", "each-byte"))
        return "".join(texts)


def _each_byte(error: UnicodeError):
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)

_CODERS: dict[str, PieceCoder] = {}


def coder_of(model: PieceModel) -> PieceCoder:
    """The coder of this Python process: tasks that follow in the same worker find it built."""
    if model.digest not in _CODERS:
        _CODERS.clear()
        _CODERS[model.digest] = PieceCoder(model)
    return _CODERS[model.digest]


def encode_column(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str = "decoded",
                  end: bool = True) -> DataFrame:
    """``docs`` with the token ids of a text column and the text they decode to.

    NULL texts are empty: the end id only, an empty text. Texts are read whole, however long; rows that repeat stay; an
    empty table gives an empty table; other columns pass through and may have any names but those of the two results,
    which they give way to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the vocabulary's size
    names = [c for c in docs.columns if c not in (ids, decoded)]
    source = "__piece_text__"
    rows = docs.select(*[F.col(quoted(c)) for c in names], F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias(source))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
                           T.StructField(decoded, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            texts, first, coded, texts_out, held = batch.column(batch.num_columns - 1), 0, [], [], 0
            for at in range(batch.num_rows):
                found = coder.encode(texts[at].as_py(), end)
                coded.append(found)
                texts_out.append(coder.decode(found))
                held += len(found)
                if held >= BATCH_IDS or at == batch.num_rows - 1:
                    offsets = np.zeros(len(coded) + 1, np.int32)
                    np.cumsum([len(c) for c in coded], out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))
                    kept = [batch.column(c).slice(first, len(coded)) for c in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(texts_out, pa.string())], [*names, ids, decoded])
                    first, coded, texts_out, held = at + 1, [], [], 0
    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every text, an end id last, and the text they decode to."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return encode_column(rows, read_model(model_path)).select("doc_id", "ids", "decoded")
