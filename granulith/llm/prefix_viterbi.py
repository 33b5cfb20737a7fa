"""SentencePiece encoding by a shared-prefix Viterbi, and decoding.

A text is cut into marked words (a word with the marks before it); no piece spans two of them, so each distinct marked
word is segmented once. The distinct words of a block are sorted, which lays them out as a trie in depth-first order,
and a word reuses the forward states of the prefix it shares with the word before it.

The forward state of a prefix is its best last piece. For a unigram vocabulary that is the piece of the highest summed
score. Summed scores cannot give the merges of a BPE vocabulary; there a transition scores 0 if the two pieces, merged
alone, stay these two pieces, and is forbidden otherwise. Exactly one path per prefix survives, and it is the one the
merges give.
"""

import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from granulith.llm import flat

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Distinct words a task keeps from block to block before it starts anew.
KEPT_WORDS = 1 << 18
KEPT_PAIRS = 1 << 17
#: What a task holds of texts, words, ids and decoded bytes follows it, several times over.
BLOCK_CHARS = 1 << 19
#: Longer words are walked in order.
DEEP = 100
UNIGRAM = 1


class Vocabulary:
    """Pieces, scores and byte pieces of a model file's content."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = pb.ModelProto.FromString(model)
        self.unigram = spec.trainer_spec.model_type == UNIGRAM
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with the identity normalizer and a dummy prefix are supported")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(sp)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.pieces = {sp.id_to_piece(i): i for i in range(len(sp)) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans two marked words")
        self.text = {i: p for p, i in self.pieces.items()}
        self.score = [sp.get_score(i) for i in range(len(sp))]
        self.unknown_score = min((self.score[i] for i in self.text), default=0.0) - 10
        raw = [b""] * len(sp)
        for i, p in self.text.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        lens = np.array([len(r) for r in raw], np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lens) - lens, lens
        self.stays: dict = {}
        self.history: dict[int, list] = {}
        if not self.unigram:  # pieces that merging never produces can't be part of a path
            self.pieces = {p: i for p, i in self.pieces.items() if len(p) == 1 or self.merged(p) == [p]}
        #: Every ending of a piece, with the piece's id where the ending is itself a piece, else -1.
        self.endings = {p[k:]: -1 for p in self.pieces for k in range(len(p))} | self.pieces

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """Merge the best-scored neighbouring pair, leftmost first, until none is a piece.

        `steps` takes, for each merge, its score and the first and last part that it leaves.
        """
        parts, ids, score = list(text), self.pieces, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def _steps(self, piece: int) -> list:
        if piece not in self.history:
            steps: list = []
            self.merged(self.text[piece], steps)
            self.history[piece] = steps
        return self.history[piece]

    def _apart(self, a: int, b: int) -> bool:
        """Replays the merges of a and of b side by side, the better one first, a's on a tie: nothing else can meet than
        the part at a's right edge and the one at b's left edge."""
        left, right, ids, score = self._steps(a), self._steps(b), self.pieces, self.score
        edge, start, i, j = self.text[a][-1], self.text[b][0], 0, 0
        while True:
            x = left[i][0] if i < len(left) else None
            y = right[j][0] if j < len(right) else None
            met = ids.get(edge + start)
            if met is not None and (x is None or score[met] > x) and (y is None or score[met] >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                edge = left[i][2]
                i += 1
            else:
                start = right[j][1]
                j += 1

    def together(self, a: int, b: int) -> bool:
        """Whether pieces a and b, side by side, are left as they are by the merges."""
        key = a << 32 | b
        found = self.stays.get(key)
        if found is None:
            if len(self.stays) > KEPT_PAIRS:
                self.stays = dict(islice(self.stays.items(), KEPT_PAIRS // 2, None))     # the older half goes
            found = self.stays[key] = self._apart(a, b)
        return found


class Trie:
    """Forward states along the current path of the depth-first walk.

    A unigram state needs those of all shorter prefixes. In a BPE vocabulary one path leads to each prefix, so only states
    that a path asks for are made; they stay for the words that share the prefix.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.word = vocabulary, ""
        self.last, self.back, self.total = [-1], [0], [0.0]

    def _pieces(self, i: int) -> list[tuple[int, int]]:
        """Pieces that end at i, with their starts, shortest first."""
        word, endings, found, j = self.word, self.v.endings, [], i - 1
        while j >= 0 and (piece := endings.get(word[j:i])) is not None:
            if piece >= 0:
                found.append((piece, j))
            j -= 1
        return found

    def _scored(self, i: int) -> None:
        v, found, best = self.v, self._pieces(i), None
        for piece, j in reversed(found):
            s = self.total[j] + v.score[piece]
            if best is None or s > best[0]:
                best = s, piece, j
        if not (found and found[0][1] == i - 1):
            s = self.total[i - 1] + v.unknown_score
            best = best if best and best[0] >= s else (s, -1, i - 1)
        self.total[i], self.last[i], self.back[i] = best

    def _merged(self, i: int) -> int:
        """The last piece of the only path to i: the longest that stays apart from the path before it."""
        last, together = self.last, self.v.together
        for piece, j in reversed(self._pieces(i)):
            before = last[j]
            if before is None:
                before = self._merged(j)
            if before < 0 or together(before, piece):
                last[i], self.back[i] = piece, j
                return piece
        last[i], self.back[i] = -1, i - 1                         # unknown character: its bytes
        return -1

    def encode(self, word: str) -> list[int]:
        v, shared = self.v, len(os.path.commonprefix([word, self.word]))
        last, back = self.last, self.back
        rest = len(word) - shared
        for states, empty in ((last, None), (back, 0), (self.total, 0.0)):
            del states[shared + 1:]
            states += [empty] * rest
        self.word = word
        if v.unigram or len(word) > DEEP:                            # in order, so that no state waits for many others
            step = self._scored if v.unigram else self._merged
            for i in range(1, len(word) + 1):
                if last[i] is None:
                    step(i)
        out, i = [], len(word)
        while i:
            piece = last[i]
            if piece is None:
                piece = self._merged(i)
            if piece < 0:
                out += [v.byte_ids[b] for b in reversed(word[i - 1].encode())]
            else:
                out.append(piece)
            i = back[i]
        return out[::-1]


def ragged(values: np.ndarray, at: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches values[at:at + len] of each code, end to end, and the lengths."""
    n = lens[codes]
    ends = np.cumsum(n)
    where = np.repeat(at[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    return values[where], n


class Encoder:
    """Encodes the blocks of one task; keeps the segmentations of earlier blocks up to a bound."""

    def __init__(self, model: bytes):
        self.v = _vocabulary(model)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.kept, self.at = array("i"), array("q", [0])

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        units = []
        for t in texts:
            parts = t.split(" ")
            if "" in parts or MARK in t:
                # keys leave out the first mark of a unit, as in the plain case
                units.append([u[1:] for u in UNITS.findall(MARK + t.replace(" ", MARK))] if t else [])
            else:
                units.append(parts)
        if len(self.code) > KEPT_WORDS:
            self.forget()
        code, trie = self.code, Trie(self.v)
        for w in sorted({u for us in units for u in us if u not in code}):
            code[w] = len(code)
            self.kept.extend(trie.encode(MARK + w))
            self.at.append(len(self.kept))
        own = np.fromiter((code[u] for us in units for u in us), np.int64)
        at = np.array(self.at)
        ids, n = ragged(np.array(self.kept), at[:-1], np.diff(at), own)
        per_unit = np.concatenate([[0], np.cumsum(n)])
        at = np.cumsum([0, *map(len, units)])
        return ids, np.diff(per_unit[at])

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, the first space of each dropped, and how many each has."""
        data, n = ragged(*self.v.raw, ids)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        keep = np.ones(len(data), bool)
        keep[first] = data[first] != 32
        ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
        return data[keep], np.diff(ends)


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """The last model's vocabulary stays with the process; what a task has encoded goes with the task."""
    if model not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[model] = Vocabulary(model)
    return _vocabularies[model]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def read_model(path: str) -> bytes:
    """The model file's content, read on the driver and sent with the tasks (a vocabulary: half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(enc: Encoder, batch: pa.RecordBatch, names: list[str]):
    """The batch's rows of `encode`, a block of texts at a time."""
    size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for part in _slices(batch, size, BLOCK_CHARS):
        null = pc.is_null(part.column(1))
        texts = pc.fill_null(part.column(1), "").to_pylist()
        ids, counts = enc.block(texts)
        out = [part.column(0), pa.array(counts, pa.int64()),
               pc.if_else(null, pa.scalar(None, pa.list_(pa.int32())), _lists(counts, ids))]
        if "round_trip" in names:
            data, n = enc.decoded(ids, counts)
            raw, at = data.tobytes(), np.concatenate([[0], np.cumsum(n)])
            out.append(pa.array([raw[at[i]:at[i + 1]] == t.encode() for i, t in enumerate(texts)], pa.bool_()))
        yield pa.RecordBatch.from_arrays(out, names=names)


def encode(docs: DataFrame, model_path: str, check: bool = False) -> DataFrame:
    """doc_id, n_tokens long and ids array<int> per row; with `check` also round_trip: decoding gives the text again.

    A null text has null ids, 0 tokens and a true round trip; an empty one has an empty list. A text that itself holds
    the mark U+2581 decodes to spaces there, as in the library, so its round trip is false. Whole texts are encoded,
    rows are independent (repeated rows and null ids are rows like others), nothing is shuffled.
    """
    model = read_model(model_path)
    docs = flat.in_small_batches(docs)

    def run(batches):
        enc = Encoder(model)
        for batch in batches:
            yield from _encoded(enc, batch, names)

    names = ["doc_id", "n_tokens", "ids"] + ["round_trip"] * check
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids array<int>" + ", round_trip boolean" * check
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text, bytes that are no UTF-8 the replacement character."""
    model = read_model(model_path)

    def run(batches):
        enc = Encoder(model)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, size, BLOCK_CHARS):
                lists = part.column(1)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, n = enc.decoded(pc.list_flatten(lists).to_numpy(zero_copy_only=False), counts)
                raw, at = data.tobytes(), np.concatenate([[0], np.cumsum(n)])
                texts = [raw[at[i]:at[i + 1]].decode(errors="replace") for i in range(len(n))]
                texts = [t if ok else None for t, ok in zip(texts, pc.is_valid(lists).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
