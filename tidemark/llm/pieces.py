"""Encoding and decoding with merge-type sentencepiece vocabularies.

A text's spaces become U+2581, one more is put before it, and its characters are the first symbols. An agenda holds the
adjacent pairs that join to a piece of the vocabulary, best score first and leftmost among equals; a pair that is taken
off joins its symbols, and the pairs with the new neighbours enter. A symbol that is no piece is spelt in bytes. No piece
of these vocabularies has U+2581 after another character, so no merge crosses the start of a run of them, nor a character
that no longer piece has: the agenda runs over the stretches between, and a worker remembers what it gave for short ones.
New short stretches of a batch are merged together: their agendas are the rows of a matrix of ranks, from which each step
takes every row's least, leftmost first. Decoding puts the pieces' texts together:
begin and end ids are silent, U+2581 is a space, the first space goes, and runs of byte pieces are read as UTF-8.

In each Arrow batch the sentencepiece library encodes and decodes the same texts; column `agrees` says whether it gave the
same ids and the same text. The ids and texts that are returned are those of the agenda.

Defined cases. A null text is empty; an empty text has only begin and end ids and decodes to an empty text. Very long texts
are encoded whole, stretch by stretch; a stretch without spaces costs n log n. U+2581 in a text comes back as a space, as
with the library. Rows with equal ids stay separate, a null id stays null, repeated rows are repeated. Extra columns are
ignored; an empty table gives an empty result. Vocabularies of another kind (no merges, no byte pieces, own normalisation,
user-defined symbols) are refused with a ValueError.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_ids import CHARS_AT_ONCE, slices, vocabulary

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches remembered by a worker, and the longest of them in characters; longer ones have an agenda of their own.
MOST_STRETCHES, LONGEST = 300_000, 32
NO_PAIR = np.int32(2**31 - 1)


class PieceModel:
    """A merge-type vocabulary: packed ids of texts, texts of ids."""

    def __init__(self, name: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=vocabulary(name))
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        norm, train, kind = proto.normalizer_spec, proto.trainer_spec, proto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain:
            raise ValueError(f"{name} isn't a merge-type vocabulary with byte pieces, plain normalisation and a space in front")
        if any(p.type == kind.USER_DEFINED for p in proto.pieces):
            raise ValueError(f"{name} has user-defined symbols")
        merges = {p.piece: (i, -p.score, p.type == kind.UNUSED) for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.UNUSED)}
        self.ids = {piece: i for piece, (i, _, _) in merges.items()}
        self.ranks = {piece: rank for piece, (_, rank, _) in merges.items()}
        self.unused = {piece for piece, (_, _, unused) in merges.items() if unused}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        #: The bytes that an id stands for, U+2581 as a space; None for the unknown piece, empty for control pieces.
        self.bytes_of: list[bytes | None] = []
        self.byte_piece = np.zeros(len(proto.pieces), bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
                self.byte_piece[i] = True
            else:
                self.bytes_of.append({kind.CONTROL: b"", kind.UNKNOWN: None}.get(p.type, p.piece.replace(SPACE, " ").encode()))
        self.unknown_text = train.unk_surface
        joined = {c for piece in merges if len(piece) > 1 for c in piece} - {SPACE}
        inside = any(SPACE in piece.lstrip(SPACE) for piece in merges)
        own = "".join(re.escape(c) for c in sorted(joined)) or SPACE
        self.stretches = re.compile(r"(?s).+" if inside else f"{SPACE}*[{own}]+|{SPACE}+|[^{own}{SPACE}]+").findall
        self.known: dict[str, bytes] = {}
        self.tables(joined | {SPACE}, {} if inside or self.unused else merges)

    def tables(self, chars: set[str], merges: dict) -> None:
        """For merging many stretches at once: a symbol's number is its id, or one beyond for a character that is no piece;
        all pairs of symbols that join, in order, with the rank and the number of what they give."""
        numbers = dict(self.ids)
        for c in sorted(chars):
            numbers.setdefault(c, self.library.get_piece_size() + len(numbers))
        self.spread = max(numbers.values(), default=0) + 1
        order = {rank: k for k, rank in enumerate(sorted({rank for _, rank, _ in merges.values()}))}
        pairs = sorted((numbers[p[:k]] * self.spread + numbers[p[k:]], order[rank], i) for p, (i, rank, _) in merges.items() for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers)
        self.pairs = np.array([x[0] for x in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs] or [NO_PAIR], np.int32)
        self.pair_ids = np.array([x[2] for x in pairs] or [0], np.int32)
        self.number = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.number[ord(c)] = numbers[c]
        self.at_once = bool(merges)

    def joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, NO_PAIR where they don't join, and the ids they join to."""
        keys = left.astype(np.int64) * self.spread + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]

    def merged_together(self, stretches: list[str]) -> list[bytes] | None:
        """Packed ids of stretches of one length; None where some symbol that is left is no piece."""
        width, n = len(stretches[0]), len(stretches)
        symbols = self.number[np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")].reshape(n, width)
        ranks, ids = self.joins(symbols[:, :-1], symbols[:, 1:])
        rows, out = np.arange(n), [b""] * n
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            going = ranks[np.arange(len(rows)), best] < NO_PAIR if ranks.shape[1] else np.zeros(len(rows), bool)
            done = ~going
            if done.any():
                if (symbols[done] >= len(self.bytes_of)).any():
                    return None
                data, size = symbols[done].astype("<u4").tobytes(), 4 * symbols.shape[1]
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = data[size * k : size * (k + 1)]
            if not going.any():
                return out
            symbols, ranks, ids, rows, best = symbols[going], ranks[going], ids[going], rows[going], best[going]
            each, first = np.arange(len(rows)), best[:, None]
            joined = ids[each, best]
            place = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, place + (place > first), 1)
            symbols[each, best] = joined
            place = place[:-1] + (place[:-1] >= first)
            ranks, ids = np.take_along_axis(ranks, place, 1), np.take_along_axis(ids, place, 1)
            for some, left in ((best > 0, best - 1), (best < symbols.shape[1] - 1, best)):  # the pairs with the new neighbours
                r, c = each[some], left[some]
                if len(r):
                    ranks[r, c], ids[r, c] = self.joins(symbols[r, c], symbols[r, c + 1])

    def learn(self, stretches: set[str]) -> None:
        """Remember the ids of stretches."""
        by_length: dict[int, list[str]] = {}
        for stretch in stretches:
            if 1 < len(stretch) <= LONGEST and self.at_once and self.number[ord(stretch[-1])] >= 0:
                by_length.setdefault(len(stretch), []).append(stretch)
            else:
                self.known[stretch] = self.packed(stretch)
        for some in by_length.values():
            self.known.update(zip(some, self.merged_together(some) or map(self.packed, some), strict=True))

    def merged(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of a stretch of text."""
        symbols, ranks = list(text), self.ranks
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        agenda = []
        for left in range(last):
            if (rank := ranks.get(text[left : left + 2])) is not None:
                agenda.append((rank, left, left + 1, 2))
        heapq.heapify(agenda)
        joined_from = {}
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue  # one of the two has been joined to another since
            ab = a + b
            if ab in self.unused:
                joined_from[ab] = (a, b)
            symbols[left], symbols[right] = ab, ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                if (rank := ranks.get(ab + symbols[following])) is not None:
                    heapq.heappush(agenda, (rank, left, following, length + len(symbols[following])))
            if (previous := before[left]) >= 0 and (rank := ranks.get(symbols[previous] + ab)) is not None:
                heapq.heappush(agenda, (rank, previous, left, length + len(symbols[previous])))
        out = [s for s in symbols if s]
        while any(s in joined_from for s in out):  # pieces that only serve to build others fall apart again
            out = [part for s in out for part in joined_from.get(s, (s,))]
        return out

    def packed(self, stretch: str) -> bytes:
        ids = []
        for symbol in self.merged(stretch):
            i = self.ids.get(symbol)
            ids.extend([i] if i is not None else [self.byte_ids[b] for b in symbol.encode()])
        return array("I", ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.stretches(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MOST_STRETCHES:
            self.known.clear()
        new: set[str] = set()
        for stretches in split:
            new.update(stretches)
        new.difference_update(self.known)
        long = [s for s in new if len(s) > LONGEST]
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, stretches)) for stretches in split]
        for s in long:
            del self.known[s]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it for any ids: control pieces are silent, but end a run of byte pieces."""
        texts = [self.bytes_of[i] for i in ids]
        while texts and texts[-1] == b"":
            texts.pop()
        head = 0
        while head < len(texts) and texts[head] == b"":
            head += 1
        if head == len(texts):
            return ""
        if all(texts[head:]):
            try:
                whole = b"".join(texts).decode()
                return whole[1:] if whole[0] == " " and not self.byte_piece[ids[head]] else whole
            except UnicodeDecodeError:
                pass  # some run of byte pieces isn't UTF-8
        out, run, first = [], b"", True
        for i, text in zip(ids[: len(texts)], texts, strict=True):
            if self.byte_piece[i]:
                run, first = run + text, False
                continue
            out.append(utf8(run))
            run = b""
            if text is None:
                out.append(self.unknown_text)
            elif text:
                out.append(text.decode()[1:] if first and text[:1] == b" " else text.decode())
            first = first and text == b""
        return "".join([*out, utf8(run)])


def utf8(run: bytes) -> str:
    """Bytes as UTF-8, each byte that begins no character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(run[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def piece_model(name: str) -> PieceModel:
    """One for each worker process, which later tasks use again."""
    return PieceModel(name)


def round_trips(name: str, begin: bool, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(name)
        head = array("I", [model.begin] if begin else []).tobytes()
        tail = array("I", [model.end] if end else []).tobytes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), CHARS_AT_ONCE):
                packed = [head + ids + tail for ids in model.encode_all(texts)]
                ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
                decoded = [model.decode(i) for i in ids]
                library = model.library.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
                agrees = [a == b for a, b in zip(ids, library, strict=True)]
                agrees = [a and x == y for a, x, y in zip(agrees, decoded, model.library.decode(library, num_threads=1), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(map(len, ids), pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(decoded, pa.string()),
                        pa.array(agrees, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded", "agrees"],
                )
                at += len(texts)

    return run


def round_trip(docs: DataFrame, model: str = VOCABULARY, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers), decoded text, agrees with the library."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(round_trips(model, begin, end), "doc_id long, n_tokens long, ids binary, decoded string, agrees boolean")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(common.table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
