"""Byte-level BPE encoding of whole corpora with merges on length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

#: The public pattern that splits text before merging (fixed value); \s is written as the Unicode property it stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: Bytes of the rows that a longer piece is cut into; a cut that a merge would cross is taken back, so rows can grow.
ROW_BYTES = 128
#: Places around each multiple of ROW_BYTES among which the cut goes to the one least likely to be merged over.
ROW_PLAY = 12
#: Cells of one matrix at most, unless one row has more.
MATRIX_CELLS = 1 << 21
#: Distinct pieces whose ids a Python worker keeps; beyond that it forgets all and goes on (results don't depend on it).
KEPT_PIECES = 200_000

NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """Ranks of a vocabulary as a hash table from a pair of ids to the id it merges to. Size follows the vocabulary alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        waiting, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slot(waiting)
        while len(waiting):  # all insert at once; of those that meet in a free slot one stays, the others probe on
            free = self.keys[slots] == -1
            self.keys[slots[free]] = waiting[free]
            won = self.keys[slots] == waiting
            self.values[slots[won]] = values[won]
            waiting, values, slots = waiting[~won], values[~won], (slots[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none; a negative id is padding."""
        out = np.full(left.shape, NONE, np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[real].astype(np.int64) << 20 | right.ravel()[real]
        slots, flat = self._slot(keys), out.ravel()
        while len(real):
            at = self.keys[slots]
            hit = at == keys
            flat[real[hit]] = self.values[slots[hit]]
            on = ~hit & (at != -1)
            real, keys, slots = real[on], keys[on], (slots[on] + 1) & self.mask
        return flat.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes], width: int, edges: dict[int, tuple[list, list]] = {}) -> list[np.ndarray]:  # noqa: B006 - only read where given
        """Ids of pieces of at most ``width`` bytes. Each round every row merges its leftmost pair of minimum rank.

        Further places of the same pair merge in the same round, from left to right, unless a merge makes a pair of lower
        rank: that pair would come first. For the rows in ``edges`` it is noted how their first and their last token change:
        (rank merged, highest rank so far).
        """
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1).astype(np.int32)
        rank = np.full((n, width), NONE, np.int32)  # of each token with the one behind it
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * n
        rows, noted, highest = np.arange(n), np.zeros(n, bool), np.full(n, -1, np.int32)
        noted[list(edges)] = True
        while True:
            least = rank.min(1)
            done = least == NONE
            for i in np.flatnonzero(done):  # finished rows leave the matrix
                out[rows[i]] = ids[i, : length[i]]
            if done.any():
                go = ~done
                rows, ids, rank, least, length = rows[go], ids[go], rank[go], least[go], length[go]
            if not len(rows):
                return out
            r, c = np.nonzero(rank == least[:, None])
            beside = np.zeros(len(r), bool)
            beside[1:] = (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 1)
            if beside.any():  # of places that overlap every other one
                place = np.arange(len(r))
                even = (place - np.maximum.accumulate(np.where(beside, 0, place))) % 2 == 0
                r, c = r[even], c[even]
            first = np.ones(len(r), bool)
            first[1:] = r[1:] != r[:-1]
            if not first.all():
                token, w = least[r], ids.shape[1]
                right = np.where(c + 2 < w, ids[r, np.minimum(c + 2, w - 1)], -1)
                left = np.where(c > 0, ids[r, np.maximum(c - 1, 0)], -1)
                merged = np.zeros(len(r), bool)
                merged[1:] = ~first[1:] & (c[1:] == c[:-1] + 2)
                left = np.where(merged, token, left)
                lower = (self.ranks(token, right) < token) | (self.ranks(left, token) < token)
                alone = np.zeros(len(rows), bool)
                alone[r[lower]] = True
                some = first | ~alone[r]
                r, c, first = r[some], c[some], first[some]
            if edges:
                highest[rows] = np.maximum(highest[rows], least)
                for side, at in ((0, c == 0), (1, c == length[r] - 2)):
                    for i in r[at & noted[rows[r]]]:
                        edges[rows[i]][side].append((int(least[i]), int(highest[rows[i]])))
            ids[r, c] = least[r]
            keep = np.arange(ids.shape[1]) < length[:, None]
            keep[r, c + 1] = False
            length = keep.sum(1)
            place = np.cumsum(keep, 1) - 1
            at, c = place[r, c], np.nonzero(keep)
            to = c[0], place[c]
            ids, old = np.full((len(rows), length.max()), -1, np.int32), (ids[c], rank[c])
            rank = np.full(ids.shape, NONE, np.int32)
            ids[to], rank[to] = old
            w = ids.shape[1]
            rank[r, at] = self.ranks(ids[r, at], np.where(at + 1 < w, ids[r, np.minimum(at + 1, w - 1)], -1))
            before = at > 0
            rank[r[before], at[before] - 1] = self.ranks(ids[r[before], at[before] - 1], ids[r[before], at[before]])

    def _cuts(self, piece: bytes) -> list[int]:
        """Where a piece is cut into rows: near each multiple of ROW_BYTES, between the bytes that merge last or never."""
        if len(piece) <= 2 * ROW_BYTES:
            return [0, len(piece)]
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        at = np.arange(ROW_BYTES, len(piece) - ROW_BYTES // 2, ROW_BYTES)
        places = at[:, None] + np.array(sorted(range(-ROW_PLAY, ROW_PLAY + 1), key=abs))
        best = self.ranks(ids[places - 1], ids[places]).argmax(1)
        return [0, *places[np.arange(len(at)), best].tolist(), len(piece)]

    def _crossed(self, a: int, left: list[tuple[int, int]], b: int, right: list[tuple[int, int]]) -> bool:
        """Whether a merge of the whole piece might cross a cut. a and b are the bytes' ids beside it, left and right how the last and the first token change.

        The two tokens at the cut stand side by side from when the later of them came to be until the first of them is
        merged into its own row. If they make a token of a rank not above that, the cut does not hold. At equal rank the row on the left merges first.
        """
        i = j = 0
        since = -1
        while True:
            rank = self.pair(a, b)
            mine, own = left[i] if i < len(left) else (NONE, NONE)
            theirs = right[j][1] if j < len(right) else NONE
            if rank != NONE:
                when = max(rank, since)
                first = when > own or when == own == mine == rank
                if not first and when <= theirs:
                    return True
            if own == theirs == NONE:
                return False
            if own <= theirs:
                a, i, since = mine, i + 1, max(since, own)
            else:
                b, j, since = right[j][0], j + 1, max(since, theirs)

    def pair(self, left: int, right: int) -> int:
        key = left << 20 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while True:
            at = int(self.keys[slot])
            if at == key:
                return int(self.values[slot])
            if at == -1:
                return int(NONE)
            slot = slot + 1 & self.mask

    def _merge_all(self, pieces: list[bytes], edges: dict[int, tuple[list, list]]) -> list[np.ndarray]:
        """Ids of each piece; pieces are bucketed by length, so that padding at most doubles a matrix."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list = [None] * len(pieces)
        low, width, longest = 0, 4, int(lengths.max(initial=0))
        while low < longest:
            where = np.flatnonzero((lengths > low) & (lengths <= width))
            most = max(1, MATRIX_CELLS // width)
            for part in range(0, len(where), most):
                some = where[part : part + most].tolist()
                for i, ids in zip(some, self.merge_matrix([pieces[i] for i in some], width, {k: edges[i] for k, i in enumerate(some) if i in edges})):
                    out[i] = ids
            low, width = width, width * 2
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces of any length become rows of the matrices: long ones several, of which those are joined again whose cut a merge would cross."""
        cuts = [self._cuts(p) for p in pieces]
        done: list[dict[int, tuple]] = [{} for _ in pieces]  # per piece: start of a row -> (end, ids, changes of its first and last token)
        todo = [(i, a, b) for i, c in enumerate(cuts) for a, b in zip(c, c[1:])]
        while todo:
            edges = {k: ([], []) for k, (i, a, b) in enumerate(todo) if b - a < len(pieces[i])}
            for k, ids in enumerate(self._merge_all([pieces[i][a:b] for i, a, b in todo], edges)):
                i, a, b = todo[k]
                done[i][a] = (b, ids, *edges.get(k, ([], [])))
            again = {i for i, a, b in todo if b - a < len(pieces[i])}
            todo = []
            for i in again:
                piece, rows, kept, free = pieces[i], done[i], [0], 0
                for a, c in zip(cuts[i], cuts[i][1:-1]):
                    if c < free:
                        continue
                    if self._crossed(int(self.byte_ids[piece[c - 1]]), rows[a][3], int(self.byte_ids[piece[c]]), rows[c][2]):
                        free = 2 * c - a  # a joined row is at least twice as long, so that joining ends after few rounds
                    else:
                        kept.append(c)
                kept.append(len(piece))
                todo += [(i, a, b) for a, b in zip(kept, kept[1:]) if rows[a][0] != b]
                cuts[i] = kept
        return [list(itertools.chain.from_iterable(done[i][a][1].tolist() for a in c[:-1])) if len(p) else [] for i, (p, c) in enumerate(zip(pieces, cuts))]


class Encoder:
    """Text to ids: pattern split, then merges of the pieces not seen before."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        import regex

        self.merges, self.split, self.seen = merges, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) if t else () for t in texts]
        if len(self.seen) > KEPT_PIECES:
            self.seen.clear()
        fresh = [p for p in dict.fromkeys(itertools.chain.from_iterable(split)) if p not in self.seen]
        self.seen.update(zip(fresh, self.merges.encode_pieces([p.encode() for p in fresh])))
        seen = self.seen
        return [list(itertools.chain.from_iterable([seen[p] for p in pieces])) for pieces in split]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_text(spark: SparkSession, text: Column, ranks_path: str) -> Column:
    """Token ids (array of int) of a string column by the byte-level vocabulary at ``ranks_path``, without special tokens.

    Null and empty texts have no ids: the empty array. Whole texts are encoded whatever they contain, strings that look
    like special tokens as ordinary text. The rank table is broadcast; its size is that of the vocabulary, not the data.
    """
    shared = spark.sparkContext.broadcast(Merges(read_ranks(ranks_path)))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for texts in batches:
            out = []
            for part in range(0, len(texts), 512):
                out += encoder.encode(texts.iloc[part : part + 512].tolist())
            yield pd.Series(out, dtype=object)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(encode, ArrayType(IntegerType(), False))(text)
