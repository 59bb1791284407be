"""SentencePiece encoding by Viterbi over a double-array trie, and decoding.

The pieces come from a public model file, which only the driver reads. A unigram segmentation needs log scores;
files of merge models hold ranks instead, so by default a piece of rank r (0 is the best) scores -ln(r + 1), as
Zipf's law has it (up to a constant that is the same for every piece). A character that no piece spells is
encoded by its bytes, each 10 below the worst piece.

A space is the marker of the pieces (U+2581), and one is put before the text. A literal U+2581 is encoded by
its bytes, so decoding an encoded text always gives the text.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .text import portions, whole

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PENALTY = 10.0
#: Encoded runs of characters that a task remembers, and their bytes; when full it starts afresh.
CACHE, CACHE_BYTES = 1 << 19, 32 << 20
#: Runs up to so many bytes are segmented together.
SHORT = 64


@dataclass
class Pieces:
    """spelling: bytes of each id, with the marker as a space (None for control pieces); score: log scores;
    byte_ids: the id of each byte."""

    spelling: list[bytes | None]
    score: list[float]
    byte_ids: list[int]


def read_pieces(model_file: str = MODEL, ranks: bool = True) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    spelling: list[bytes | None] = [None] * n
    score = [0.0] * n
    for rank, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i))):
        spelling[i] = m.id_to_piece(i).replace(MARK, " ").encode()
        score[i] = -math.log(rank + 1) if ranks else m.get_score(i)
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    low = min((score[i] for i in plain), default=0.0) - BYTE_PENALTY
    for b, i in enumerate(byte_ids):
        spelling[i], score[i] = bytes([b]), low
    return Pieces(spelling, score, byte_ids)


class Trie:
    """A double array: the child of state s by byte c is t = base[s] + c if check[t] == s; value[t] is the id of
    the piece that ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = -2
        start: dict[int, int] = {}  # by number of children: where the search for room goes on
        todo = deque([(0, tree)])
        while todo:
            state, node = todo.popleft()
            labels = sorted(c for c in node if c >= 0)
            if not labels:
                continue
            kind = min(len(labels), 8)
            at = start.get(kind, 1)
            while True:
                need = at + labels[-1] + 1
                if need > len(self.check):
                    more = max(need - len(self.check), len(self.check) // 2)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[at + c] == -1 for c in labels):
                    break
                at += 1
            start[kind] = at + 1
            self.base[state] = at
            for c in labels:
                self.check[at + c] = state
                self.value[at + c] = node[c].get(-1, -1)
                todo.append((at + c, node[c]))
        # So that a step from any state stays inside.
        pad = max(self.base) + 257 - len(self.check)
        if pad > 0:
            self.base += [0] * pad
            self.check += [-1] * pad
            self.value += [-1] * pad

    def arrays(self) -> tuple[list[int], list[int], list[int]]:
        return self.base, self.check, self.value


class _Numbers(dict):
    """Numbers runs in the order in which they first come."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, run: bytes) -> int:
        self[run] = i = len(self.names)
        self.names.append(run)
        return i


def _grown(x: np.ndarray, need: int) -> np.ndarray:
    return x if need <= len(x) else np.concatenate((x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)))


def _gathered(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces of x that begin at start and have n elements, one after the other."""
    ends = np.cumsum(n)
    return x[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Codec:
    """Encodes and decodes texts. Runs of characters, beyond which no piece reaches, are segmented once and remembered."""

    def __init__(self, pieces: Pieces, trie: tuple[list[int], list[int], list[int]] | None = None):
        self.pieces = pieces
        as_bytes = set(pieces.byte_ids)
        self.trie = trie or Trie({s: i for i, s in enumerate(pieces.spelling) if s is not None and i not in as_bytes}).arrays()
        plain = [s.decode() for i, s in enumerate(pieces.spelling) if s is not None and i not in as_bytes]
        # Where no piece has a space after another character, or a line end, texts may be cut there.
        self.cut = not any("\n" in s or " " in s.lstrip(" ") for s in plain)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in self.trie)
        self.score = np.array(pieces.score)
        self.byte_score = self.score[pieces.byte_ids]
        self.length = np.array([len(s or b"") for s in pieces.spelling], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(s or b"" for s in pieces.spelling), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.first, self.count, self.scores = (np.zeros(1 << 16, t) for t in (np.int32, np.int64, np.int64, np.float64))
        self.used = self.held = 0

    def viterbi(self, data: bytes) -> tuple[tuple[int, ...], float]:
        """The ids of the best segmentation of a run as it stands, and its score. Of equal scores, the one
        whose last piece begins first."""
        base, check, value = self.trie
        score, byte_ids = self.pieces.score, self.pieces.byte_ids
        n = len(data)
        best = array("d", [-math.inf]) * (n + 1)
        from_, by = array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            c = data[at]
            char_end = at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, state, alone = best[at], 0, False
            for end in range(at, n):
                t = base[state] + data[end]
                if check[t] != state:
                    break
                state = t
                piece = value[t]
                if piece >= 0:
                    alone = alone or end + 1 == char_end
                    s = here + score[piece]
                    if s > best[end + 1]:
                        best[end + 1], from_[end + 1], by[end + 1] = s, at, piece
            if not alone:
                s = here + sum(score[byte_ids[b]] for b in data[at:char_end])
                if s > best[char_end]:
                    best[char_end], from_[char_end], by[char_end] = s, at, -1
            at = char_end
        out: list[int] = []
        at = n
        while at:
            start, piece = from_[at], by[at]
            out += [piece] if piece >= 0 else [byte_ids[b] for b in reversed(data[start:at])]
            at = start
        return tuple(reversed(out)), best[n]

    def viterbi_many(self, runs: list[bytes]) -> list[tuple[tuple[int, ...], float]]:
        """viterbi for many short runs: the same steps, each taken for all runs at once."""
        n, width = len(runs), max(map(len, runs))
        data = np.zeros((n, width), np.uint8)
        size = np.fromiter(map(len, runs), np.int64, n)
        data[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
        best = np.full((n, width + 1), -math.inf)
        best[:, 0] = 0.0
        from_, by = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        char_end = np.zeros(n, np.int64)
        for at in range(width):
            c = data[:, at]
            rows = np.flatnonzero((at < size) & (c & 0xC0 != 0x80))
            if not len(rows):
                continue
            first = c[rows]
            char = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
            char_end[rows] = at + char
            alone = np.zeros(n, bool)
            live, state = rows, np.zeros(len(rows), np.int32)
            for end in range(at, width):
                inside = end < size[live]
                live, state = live[inside], state[inside]
                t = self.base[state] + data[live, end]
                step = self.check[t] == state
                live, state = live[step], t[step]
                if not len(live):
                    break
                piece = self.value[state]
                is_piece = piece >= 0
                hit, piece = live[is_piece], piece[is_piece]
                s = best[hit, at] + self.score[piece]
                better = s > best[hit, end + 1]
                won = hit[better]
                best[won, end + 1], from_[won, end + 1], by[won, end + 1] = s[better], at, piece[better]
                alone[hit[char_end[hit] == end + 1]] = True
            lone = ~alone[rows]
            if lone.any():
                some, char = rows[lone], char[lone]
                s = np.zeros(len(some))
                for k in range(int(char.max())):
                    more = char > k
                    s[more] += self.byte_score[data[some[more], at + k]]
                s += best[some, at]
                better = s > best[some, at + char]
                won, to = some[better], (at + char)[better]
                best[won, to], from_[won, to], by[won, to] = s[better], at, -1
        total = best[np.arange(n), size]
        # Back from the ends, one piece of each run at a time; runs with bytes in them take the single way.
        steps, at, on = [], size.copy(), np.arange(n)
        bytes_in = np.zeros(n, bool)
        count = np.zeros(n, np.int64)
        while len(on):
            piece = by[on, at[on]]
            bytes_in[on[piece < 0]] = True
            steps.append((on, piece))
            count[on] += 1
            at[on] = from_[on, at[on]]
            on = on[at[on] > 0]
        out = np.zeros((n, len(steps)), np.int32)
        for k, (on, piece) in enumerate(steps):
            out[on, count[on] - 1 - k] = piece
        return [self.viterbi(runs[i]) if odd else (tuple(ids[:k]), s) for i, (odd, ids, k, s) in enumerate(zip(bytes_in.tolist(), out.tolist(), count.tolist(), total.tolist(), strict=True))]

    def _learn(self, before: int) -> None:
        """Segments the runs that were numbered since; those of like length together."""
        new = self.known.names[before:]
        found: list[tuple[tuple[int, ...], float]] = [((), 0.0)] * len(new)
        short: dict[int, list[int]] = {}
        for i, run in enumerate(new):
            if len(run) > SHORT:
                found[i] = self.viterbi(run)
            else:
                short.setdefault((len(run) - 1) // 8, []).append(i)
        for group in short.values():
            for i, got in zip(group, self.viterbi_many([new[i] for i in group]), strict=True):
                found[i] = got
        count = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
        total = self.used + int(count.sum())
        self.ids = _grown(self.ids, total)
        self.first, self.count, self.scores = (_grown(x, before + len(new)) for x in (self.first, self.count, self.scores))
        self.ids[self.used : total] = np.fromiter(chain.from_iterable(f[0] for f in found), np.int32)
        self.count[before : before + len(new)] = count
        self.first[before : before + len(new)] = self.used + np.cumsum(count) - count
        self.scores[before : before + len(new)] = [f[1] for f in found]
        self.used = total
        self.held += sum(map(len, new))

    def runs(self, data: bytes) -> list[bytes]:
        """data (a space, then the text) cut where texts may be cut."""
        if not self.cut:
            return [data]
        c = np.frombuffer(data, np.uint8)
        before = np.concatenate((c[:1], c[:-1]))
        starts = np.flatnonzero((c == 32) & (before != 32) | (c == 10) | (before == 10)).tolist()
        if not starts or starts[0]:
            starts = [0, *starts]
        return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]

    def encode_many(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[float]]:
        """Ids and log score of each text in UTF-8. An empty text has no ids."""
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.forget()
        before = len(self.known)
        number = self.known.__getitem__
        cut = [np.array([number(r) for r in self.runs(b" " + t)] if t else [], np.int64) for t in texts]
        self._learn(before)
        return [_gathered(self.ids, self.first[at], self.count[at]) for at in cut], [float(self.scores[at].sum()) for at in cut]

    def encode(self, text: str) -> tuple[list[int], float]:
        ids, scores = self.encode_many([text.encode("utf-8", "surrogatepass")])
        return ids[0].tolist(), scores[0]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return _gathered(self.letters, self.start[ids], self.length[ids])

    def decode(self, ids: list[int]) -> str:
        return self.spell(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]


def encode(df: DataFrame, text: str = "text", model_file: str = MODEL, ranks: bool = True) -> DataFrame:
    """df with ids (array<int>), log_score (double) and decoded (the text again, from the ids alone).

    A null text counts as empty and has no ids; columns with the new names are replaced, others stay. Texts
    are encoded whole, whatever their length; equal texts get equal ids.
    """
    df = df.drop("ids", "log_score", "decoded")
    codec = Codec(read_pieces(model_file, ranks))
    sent = df.sparkSession.sparkContext.broadcast((astuple(codec.pieces), codec.trie))  # one model file's
    names = df.columns
    added = [StructField("ids", ArrayType(IntegerType())), StructField("log_score", DoubleType()), StructField("decoded", StringType())]
    schema = StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces(*sent.value[0]), sent.value[1])
        for whole_batch in batches:
            for at, n in portions(whole_batch.column(names.index(text))):
                batch = whole_batch.slice(at, n)
                ids, scores = codec.encode_many([v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(names.index(text))])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                new = [lists, pa.array(scores, pa.float64()), pa.array([codec.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "ids", "log_score", "decoded"])

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"), "log_score", "decoded", (F.col("decoded") == whole()).alias("same"))
