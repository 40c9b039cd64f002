"""SentencePiece encoding and decoding by a streaming Viterbi search.

Of the ways to spell a text in pieces the one with the greatest sum of weights
is taken. For a unigram model a piece weighs its score. For a BPE model scores
only say in which order pairs are joined, so every piece weighs nothing and the
path is held to what BPE would do: a piece may follow another only if BPE of the
two joined gives these two again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers

SPACE = "▁"
# Where no piece holds a space mark behind another character, every such place is a boundary on all paths.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
REMEMBERED = 400_000
SHORT = 64


UNIGRAM = 1
UNKNOWN_PENALTY = 10.0


def model_kind(raw: bytes) -> int:
    """model_type of the trainer's settings in a model file: field 3 of field 2 of its protocol buffer; UNIGRAM where none is set."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                out |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if data[at - 1] < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, data[at : at + size]
                at += size

    for name, value in fields(raw):
        if name == 2 and isinstance(value, bytes):
            return next((v for k, v in fields(value) if k == 3 and isinstance(v, int)), UNIGRAM)
    return UNIGRAM


class Pieces:
    """Vocabulary of a model: id and score by piece, bytes or the unknown id for characters outside it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
        other = lambda i: model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i)
        with open(path, "rb") as f:
            kind = model_kind(f.read())
        self.fill(names, {names[i]: (i, model.get_score(i)) for i in range(len(names)) if not other(i)}, byte, model.unk_id(), kind == UNIGRAM)

    def fill(self, names: list[str], pieces: dict[str, tuple[int, float]], byte: dict[int, int], unknown: int, unigram: bool) -> Pieces:
        """names by id, (id, score) by piece, ids of bytes, the id of what is unknown, whether scores are weights."""
        self.text, self.byte, self.unknown, self.unigram = names, byte, unknown, unigram
        self.id = {p: i for p, (i, _) in pieces.items()}
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.outside = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY if unigram else 0.0
        self.longest = max(map(len, self.id), default=1)
        self.value = {i: b for b, i in byte.items()}
        # Neighbours inside some piece; between any others every path has a boundary.
        self.inside = {piece[i : i + 2] for piece in self.id for i in range(len(piece) - 1)}
        self.stretches = not any(pair[0] != SPACE == pair[1] for pair in self.inside)
        self.follows: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.edge: dict[str, tuple[list, list]] = {}
        # A node of the trie: children by character, the piece that ends there or None, its weight.
        self.trie: dict = {}
        for piece in self.id:
            kids, node = self.trie, None
            for c in piece:
                node = kids.setdefault(c, [{}, None, 0.0])
                kids = node[0]
            node[1:] = piece, self.score[piece] if unigram else 0.0
        return self

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE of a short string, and the last pair that was joined.

        The best-scored pair of neighbours is joined first, the leftmost of equal ones.
        """
        parts, pair = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, pair
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, piece: str) -> tuple[list, list]:
        """What stands at a piece's left and right edge while it is put together: (string, score at which it grows)."""
        got = self.edge.get(piece)
        if got is None:
            out = []
            for side in (0, 1):
                at, chain = piece, [(piece, -np.inf)]
                while len(at) > 1:
                    score = self.score[at]
                    at = self.merge(at)[1][side]
                    chain.append((at, score))
                out.append(chain[::-1])
            got = self.edge[piece] = tuple(out)
        return got

    def allowed(self, left: str | None, right: str) -> bool:
        """Whether right may follow left (None: the beginning, or a character outside the vocabulary).

        It may if no pair across the border is ever joined while both grow, in
        the order of scores; at equal scores the left one of two pairs goes first.
        Runs of space marks share one score and are put together in full.
        """
        if self.unigram:
            return True
        got = self.follows.get((left, right))
        if got is None:
            own = self.own.get(right)
            if own is None:
                own = self.own[right] = self.merge(right)[0] == [right]
            if len(self.follows) > 500_000:
                self.follows.clear()
            got = self.follows[left, right] = own and (left is None or self._apart(left, right))
        return got

    def _apart(self, left: str, right: str) -> bool:
        if left.endswith(SPACE):
            return self.merge(left + right)[0] == [left, right]
        xs, ys = self.edges(left)[1], self.edges(right)[0]
        i = j = 0
        while True:
            (x, sx), (y, sy) = xs[i], ys[j]
            cross = self.score.get(x + y)
            if cross is not None and cross > sx and cross >= sy:
                return False
            if sx >= sy and i + 1 < len(xs):
                i += 1
            elif j + 1 < len(ys):
                j += 1
            elif i + 1 < len(xs):
                i += 1
            else:
                return True

    def raw(self, char: str) -> bytes:
        """Ids of the bytes of a character outside the vocabulary, or the unknown id."""
        if not self.byte:
            return self.unknown.to_bytes(4, "little")
        return b"".join(self.byte[b].to_bytes(4, "little") for b in char.encode("utf-8", "surrogatepass"))


def search(stretch: str, pieces: Pieces) -> Iterator[str]:
    """Pieces of a stretch, committed as soon as all surviving paths agree on them.

    From every place that a path reaches all pieces that begin there are tried;
    a place keeps the best path to it, of equal ones that whose last piece begins
    first. Held is a window of five longest pieces since the last committed
    boundary: once four of them are read, the paths that may go on (those that end
    within the longest piece of the front) are followed back, and what lies before
    the last boundary they share is committed.
    """
    longest, trie, follows, allowed, unigram, outside = pieces.longest, pieces.trie, pieces.follows, pieces.allowed, pieces.unigram, pieces.outside
    size, window = len(stretch), 4 * longest
    base = 0  # place of the last committed boundary
    held = min(size, window + longest) + 1
    # By place less base: the best weight to there; where its last piece begins; that piece, None for a character outside the vocabulary, "" for no path.
    best, back = [-np.inf] * held, [0] * held
    last: list[str | None] = [""] * held
    best[0], last[0] = 0.0, None
    j, check = 0, window
    while j < size:
        left = last[j - base]
        if left != "":
            so_far = best[j - base]
            node = trie.get(stretch[j])
            i = j - base + 1
            if (node is None or node[1] is None and unigram) and best[i] < so_far + outside:
                best[i], last[i], back[i] = so_far + outside, None, j
            while node is not None:
                kids, piece, weight = node
                if piece is not None and best[i] < so_far + weight:
                    good = unigram or follows.get((left, piece))
                    if good is None:
                        good = allowed(left, piece)
                    if good:
                        best[i], last[i], back[i] = so_far + weight, piece, j
                if i + base == size:
                    break
                node = kids.get(stretch[i + base])
                i += 1
        j += 1
        if j - base >= check and j < size:
            paths = {k + base for k in range(j - base, len(last)) if last[k] != ""}
            while len(paths) > 1:
                top = max(paths)
                paths.discard(top)
                paths.add(back[top - base])
            low = paths.pop()
            if base < low <= j:
                yield from _path(stretch, back, base, low)
                cut = low - base
                best, back, last = best[cut:] + [-np.inf] * cut, back[cut:] + [0] * cut, last[cut:] + [""] * cut
                base = low
            # Paths that have not met yet are looked at again a piece's length later, in a wider window.
            check = max(window, j - base + longest)
            short = check + longest + 1 - len(last)
            if short > 0:
                best, back, last = best + [-np.inf] * short, back + [0] * short, last + [""] * short
    yield from _path(stretch, back, base, size)


def _path(stretch: str, back: list[int], base: int, end: int) -> list[str]:
    out = []
    while end > base:
        out.append(stretch[back[end - base] : end])
        end = back[end - base]
    return out[::-1]


class Encoder(dict):
    """Ids of stretches as little-endian unsigned 32-bit numbers; short ones are remembered, in two generations of bounded size."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.old = pieces, {}

    def __missing__(self, stretch: str) -> bytes:
        blob = self.old.get(stretch)
        inside = self.pieces.inside
        cuts = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in inside] if blob is None else ()
        if cuts:
            blob = b"".join([self[stretch[i:j]] for i, j in zip([0, *cuts], [*cuts, len(stretch)])])
        elif blob is None:
            ids = self.pieces.id
            blob = b"".join([ids[p].to_bytes(4, "little") if p in ids else self.pieces.raw(p) for p in search(stretch, self.pieces)])
        if len(stretch) <= SHORT:
            if len(self) > REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[stretch] = blob
        return blob

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        return b"".join([self[x] for x in (STRETCH.findall(marked) if self.pieces.stretches else [marked])])

    def decode(self, blob: bytes) -> str:
        """The text of ids: pieces joined, runs of bytes as UTF-8, space marks as spaces without the first."""
        names, value = self.pieces.text, self.pieces.value
        ids = np.frombuffer(blob, "<u4")
        lo, hi = min(value, default=0), max(value, default=-1)
        raw = (ids >= lo) & (ids <= hi)
        edges = np.flatnonzero(np.diff(raw.astype(np.int8))) + 1
        out = []
        for part in np.split(ids, edges) if len(ids) else []:
            run = part.tolist()
            if run[0] in value:
                out.append(bytes([value[i] for i in run]).decode("utf-8", "replace"))
            else:
                out.append("".join([names[i] for i in run]))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(Pieces(path))


def encode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids, decoded, with keep_text also text) of every whole text; ids are little-endian unsigned 32-bit numbers.

    The ids are those of the sentencepiece library for the same model file.
    decoded is the text that they give back: the text itself, with the space
    mark U+2581 as a space. Null and empty texts have no ids and decode to
    the empty text; repeated rows give repeated results, null ids like any other;
    an empty table gives no rows; columns other than id and text are not read.
    What a text holds in memory is its ids and the window of the search, however
    long its words are.
    """
    ensure_workers(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    names, width = ["doc_id", "n_ids", "ids", "decoded", "text"], 5 if keep_text else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                blobs = [enc.encode(t.as_py() or "") for t in part.column(1)]
                back = [enc.decode(x) for x in blobs]
                cols = [part.column(0), pa.array([len(x) // 4 for x in blobs], pa.int64()), pa.array(blobs, pa.binary()), pa.array(back, pa.string()), part.column(1)]
                yield pa.RecordBatch.from_arrays(cols[:width], names=names[:width])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids binary, decoded string" + ", text string" * keep_text)
