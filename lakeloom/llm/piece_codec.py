"""SentencePiece encoding and decoding by a streaming Viterbi search.

Pieces and their scores come from a model file; the segmentation is the one with the greatest sum
of scores, characters without a piece go to bytes. The search takes text in blocks and holds scores
and backpointers from the last committed boundary on. Where no piece reaches past a position, all
paths meet there; otherwise, after the length of the longest piece and whenever what is held has
doubled, the surviving backpointers are followed to where they converge. What lies before that boundary is final: its ids are committed and
its text, scores and backpointers dropped. So the window is as long as the longest piece, and as much
longer as the paths really disagree.

Scores of a unigram model are log-probabilities and used as they are. A model made by merging has the
ranks of its merges instead (they fall by one from piece to piece); a rank r stands for the
log-probability of a Zipf-Mandelbrot law, -log(r + ``SHIFT``) less the normaliser. The ids are the most
probable ones under that law, not those that merging in order gives: the README has figures.

No piece of the usual vocabularies goes on past a blank, so paths always agree there; such places
are found from the vocabulary (letter pairs inside no piece). The search starts anew at each of them, so
what it has committed between two is kept in a bounded memo and not searched again. The result is that
of one search over the text.

Blanks become U+2581 and one goes before the text, as the model's normaliser does. A U+2581 of the
text itself is written in bytes, so decoding restores every text exactly.

Defined results. Null or empty text: no ids; it decodes to the empty text. Repeated rows and ties are
no special case (the first of equal paths by start, then by length, wins). Columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import shipped

BLANK = "▁"
#: Vocabulary file of the installed package of public tokenizers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the memo, in characters and entries times ``ENTRY``.
MEMO, ENTRY = 3_000_000, 8
UNKNOWN_PENALTY = 10.0
#: Shift of the law that turns ranks into log-probabilities.
SHIFT = 100
EXACT = 1 << 24


def log_probabilities(scores: list[float]) -> list[float]:
    """Scores as they are, or if they are ranks of merges, those of the law of ranks."""
    steps = sum(a - b == 1 for a, b in zip(scores, scores[1:], strict=False))
    if steps < 0.9 * (len(scores) - 1) or len(scores) < 2:
        return scores
    norm = math.log(sum(1 / (SHIFT - s) for s in scores))
    return [-math.log(SHIFT - s) - norm for s in scores]


class Vocabulary:
    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        worth = log_probabilities([model.get_score(i) for i in plain])
        # multiples of a power of two have exact sums, so that equal paths are equal wherever a search begins
        self.pieces = {model.id_to_piece(i): (i, round(w * EXACT) / EXACT) for i, w in zip(plain, worth, strict=True)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no piece for every byte")
        self.longest = max(map(len, self.pieces))
        #: Pieces as a tree: character -> (tree of what may follow, id or -1, score).
        self.tree: dict = {}
        for piece, (i, worth) in sorted(self.pieces.items()):
            node = self.tree
            for char in piece[:-1]:
                node = node.setdefault(char, ({}, -1, 0.0))[0]
            node[piece[-1]] = (node[piece[-1]][0] if piece[-1] in node else {}, i, worth)
        self.singles = {piece for piece in self.pieces if len(piece) == 1}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.joined = set("".join(self.inside))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        #: True if no piece runs from a letter into a blank: paths agree before every such blank.
        self.ends_at_blanks = not any(b == BLANK and a != BLANK for a, b in self.inside)
        self.of_id: list[bytes] = [b""] * len(ids)
        for piece, (i, _) in self.pieces.items():
            self.of_id[i] = piece.replace(BLANK, " ").encode()
        for value, i in self.bytes.items():
            self.of_id[i] = bytes([value])

    def spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]


class StreamingViterbi:
    """Feed blocks of text, take committed ids. ``widest`` is the longest stretch that was ever searched
    without a boundary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""
        #: Places whose pieces are added, the furthest place that a piece has reached, and the place of
        #: the last look for a boundary.
        self.done = self.reach = self.checked = 0
        # by place since the last committed boundary: score, where its best last piece starts, and which
        # that is (-1 for bytes)
        self.score: list[float] = [0.0]
        self.start: list[int] = [0]
        self.piece: list[int] = [-1]
        self.widest = 0

    def feed(self, block: str, last: bool = False) -> list[int]:
        v = self.v
        text = self.text + block if self.text else block
        score, start, piece = self.score, self.start, self.piece
        n, longest, root, singles, unknown = len(text), v.longest, v.tree, v.singles, v.unknown
        more = n + 1 - len(score)
        score += [-math.inf] * more
        start += [0] * more
        piece += [-1] * more
        at, reach, boundary, checked, widest = self.done, self.reach, 0, self.checked, self.widest
        stop_at = n if last else n - longest + 1
        while at < stop_at:
            base, node, end = score[at], root, at
            for char in text[at : at + longest]:
                found = node.get(char)
                if found is None:
                    break
                node, i, worth = found
                end += 1
                if i >= 0 and base + worth > score[end]:
                    score[end], start[end], piece[end] = base + worth, at, i
                    if end > reach:
                        reach = end
            at += 1
            if text[at - 1] not in singles and base + unknown > score[at]:
                score[at], start[at], piece[at] = base + unknown, at - 1, -1
            if reach <= at:  # no piece reaches on: all paths meet here
                reach = at
                if at - boundary > widest:
                    widest = at - boundary
                boundary = checked = at
            elif at - checked >= longest and at - checked >= checked - boundary:
                boundary, checked = self._converged(at, reach, boundary), at
        self.widest = widest
        if not boundary:
            self.text, self.done, self.reach, self.checked = text, at, reach, checked
            return []
        out: list[int] = []
        place = boundary
        while place:
            if piece[place] >= 0:
                out.append(piece[place])
                place = start[place]
            else:
                place = start[place]
                out += v.spelled(text[place])[::-1]
        out.reverse()
        if boundary < n:
            base = score[boundary]
            self.score = [s - base for s in score[boundary:]]
            self.start, self.piece = [s - boundary for s in start[boundary:]], piece[boundary:]
        else:
            self.score, self.start, self.piece = [0.0], [0], [-1]
        self.text = text[boundary:]
        self.done, self.reach, self.checked = at - boundary, reach - boundary, checked - boundary
        return out

    def _converged(self, at: int, reach: int, least: int) -> int:
        """The last boundary on which the best paths to all open places agree; ``least`` is one."""
        start, score = self.start, self.score
        open_ = {p for p in range(at, reach + 1) if score[p] > -math.inf}
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(max(start[top], least))
        return open_.pop()


class Codec:
    def __init__(self, model_file: str = MODEL):
        self.v = Vocabulary(model_file)
        #: Ready for the next text whenever the last block of one has been fed: all of it is committed.
        self.search = StreamingViterbi(self.v)
        # ids as packed 32-bit numbers, in two generations: when the young one is full it becomes the old
        # one, so what is in use stays
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.filled = 0
        alone = "".join(c for c in "\n\t\r" if c not in self.v.joined)  # paths agree on both sides of these
        self.chunks = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+") if self.v.ends_at_blanks else None

    def _searched(self, text: str) -> bytes:
        search, longest, n, at = self.search, self.v.longest, len(text), 0
        out = b""
        while at < n:
            stop = at + max(longest, len(search.text))
            out += array("i", search.feed(text[at:stop], stop >= n)).tobytes()
            at = stop
        return out

    def _stretch(self, text: str, out: bytearray) -> None:
        """Adds the ids of a text in which U+2581 stands for blanks only."""
        if self.chunks is None:
            out += self._searched(text)
            return
        memo = self.memo
        for chunk in self.chunks.findall(text):
            ids = memo.get(chunk)
            if ids is None:
                ids = self.old.get(chunk) or self._searched(chunk)
                self.filled += len(chunk) + ENTRY
                if self.filled > MEMO:
                    self.old, self.memo, self.filled = memo, {}, len(chunk) + ENTRY
                    memo = self.memo
                memo[chunk] = ids
            out += ids

    def packed(self, text: str | None) -> bytearray:
        """The ids of a text as 32-bit numbers of this machine."""
        out = bytearray()
        if text:
            first, *others = text.split(BLANK)
            self._stretch(BLANK + first.replace(" ", BLANK), out)
            for part in others:
                out += array("i", self.v.spelled(BLANK)).tobytes()
                self._stretch(part.replace(" ", BLANK), out)
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("i", bytes(self.packed(text))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the blank before the text is taken off."""
        return b"".join(map(self.v.of_id.__getitem__, ids))[1:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec_of(model_file: str) -> Codec:
    """One codec a Python worker: its memo serves all tasks that the worker runs."""
    return Codec(model_file)


def encode_texts(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, ids) of each row."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for frame in frames:
            sizes, parts = [0], bytearray()
            for text in frame.column("text").to_pylist():
                parts += codec.packed(text)
                sizes.append(len(parts) // 4)
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(parts, np.int32)))
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), ids], ["doc_id", "ids"])

    return shipped(docs).select("doc_id", "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, text): ``ids_sha256`` is the digest of the ids as little-endian
    32-bit numbers."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for frame in frames:
            lists = frame.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            counts, digests, texts = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                ids = values[a:b]
                counts.append(b - a)
                digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                texts.append(codec.decode(ids.tolist()))
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_pieces", "ids_sha256", "text"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return shipped(encoded).select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, n_pieces bigint, ids_sha256 string, text string")
