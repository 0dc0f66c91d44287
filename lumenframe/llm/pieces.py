"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of vocabulary pieces. Forward Viterbi scores are the exact cost of the
best way to each position, so the backward A-star search that uses them as its heuristic
pops complete segmentations in order of score. No piece of such a vocabulary crosses from
a word into the next word's space mark, so the lattice of a text is a chain of the
lattices of its words: words are solved once and reused, new words of equal length
together in numpy, and A-star runs only over the words whose second-best path is close
enough to matter. Characters that are no piece fall back to their bytes, at a penalty.

Defined results: null texts are empty; an empty text has one segmentation, without pieces;
a text with fewer than n segmentations gives all of them; segmentations of equal score
come in an order that the text alone decides; repeated rows each come back; an empty table gives no rows; further input columns
don't pass through. The space mark itself, written in a text, is decoded as a space, as
the vocabulary defines it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import table
from lumenframe.llm.textblock import mix64, ranges

MARK = "▁"
LINE = "\x02"
N_BEST = 3
#: Words that numpy solves together, by length; longer ones are solved one by one.
LONGEST_TOGETHER = 40
MOST_WORDS = 500_000
#: What a piece made of a byte costs below the least score.
BYTE_PENALTY = 10.0
#: Pieces scored below this are in the vocabulary, but not to be used.
UNUSED = -1e8
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        whole = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        least = min(s for i in whole if (s := sp.get_score(i)) > UNUSED)
        # an unused piece of one character still spells itself, at a cost below all others
        self.id = {self.pieces[i]: i for i in whole if sp.get_score(i) > UNUSED or len(self.pieces[i]) == 1}
        self.score = {p: float(sp.get_score(i)) if sp.get_score(i) > UNUSED else least - 1 for p, i in self.id.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses a space; the lattice doesn't fall into words")
        spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_size = np.array(list(map(len, spelled)), np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.longest = max(map(len, self.id))
        self.cut_lines = not any("\n" in p for p in self.id)
        self.byte_score = min(self.score.values()) - BYTE_PENALTY
        hashes = np.array([int(_hash_one(p)) for p in self.id], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_ids = np.array(list(self.id.values()))[order]
        self.hash_scores = np.array(list(self.score.values()))[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")


def _units(text_codes: np.ndarray) -> np.ndarray:
    return mix64(text_codes.astype(np.uint64) + np.uint64(0x1234567))


_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _hash_one(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for u in _units(np.frombuffer(piece.encode("utf-32-le"), np.uint32)):
        h = h * _RADIX + u
    return mix64(h)[0]


def marked(text: str) -> str:
    """The text as the vocabulary sees it: a mark before it and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def _bytes_of(char: str, v: Vocabulary) -> tuple[int, ...]:
    return tuple(v.byte[b] for b in char.encode())


class Lattice:
    """One string's pieces, its forward scores, and its segmentations, best first."""

    def __init__(self, text: str, v: Vocabulary) -> None:
        n = len(text)
        self.n = n
        self.best = [0.0] + [-np.inf] * n
        self.into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            found = False
            for j in range(i + 1, min(n, i + v.longest) + 1):
                p = text[i:j]
                if p in v.id:
                    found |= j == i + 1
                    self._edge(i, j, v.score[p], (v.id[p],))
            if not found:
                ids = _bytes_of(text[i], v)
                self._edge(i, i + 1, v.byte_score * len(ids), ids)

    def _edge(self, i: int, j: int, score: float, ids: tuple[int, ...]) -> None:
        self.into[j].append((i, score, ids))
        self.best[j] = max(self.best[j], self.best[i] + score)

    def paths(self) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Backward A-star: the forward score of a position is the exact rest of its cost.

        A partial path is a chain of links from its end, so long texts don't copy ids."""
        count = 0
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-self.best[self.n], 0, self.n, 0.0, None)]
        while heap:
            f, _, at, g, chain = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                yield -f, tuple(ids)
                continue
            for i, score, own in self.into[at]:
                count += 1
                heapq.heappush(heap, (-(g + score + self.best[i]), -count, i, g + score, (own, chain)))


class Words:
    """Best ids, best score, and what the second-best path costs more, for each word seen."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.n_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)

    def add(self, words: list[str]) -> None:
        fresh = [w for w in words if w not in self.at]
        start, n = len(self.at), len(fresh)
        if not n:
            return
        self.at.update(zip(fresh, range(start, start + n)))
        self.names += fresh
        by: dict[int, list[str]] = {}
        for w in fresh:
            by.setdefault(len(w), []).append(w)
        n_ids, best, gap = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        place = np.zeros(n, np.int64)
        parts: list[np.ndarray] = []
        used = 0
        for length, group in by.items():
            if not length:
                continue  # no pieces, no cost, no other way
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                rows = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part)) - start
                known = np.zeros(len(part), bool)
                if length <= LONGEST_TOGETHER:
                    known, ids, size, best[rows], gap[rows] = self._together(part, length)
                    parts.append(ids)
                    n_ids[rows], place[rows] = size, used + np.cumsum(size) - size
                    used += len(ids)
                for k in np.flatnonzero(~known):
                    paths = Lattice(part[k], self.v).paths()
                    s, own = next(paths)
                    second = next(paths, None)
                    i = rows[k]
                    n_ids[i], place[i], best[i], gap[i] = len(own), used, s, s - second[0] if second else np.inf
                    parts.append(np.asarray(own, "<u4"))
                    used += len(own)
        if self.used + used > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(used, self.used), "<u4")])
        if used:
            self.ids[self.used : self.used + used] = np.concatenate(parts)
        self.start = np.concatenate([self.start, place + self.used])
        self.used += used
        self.n_ids, self.best, self.gap = np.concatenate([self.n_ids, n_ids]), np.concatenate([self.best, best]), np.concatenate([self.gap, gap])

    def _together(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length: which hold only characters that are pieces; for these all ids, how many each, score and gap."""
        v, m = self.v, len(words)
        units = _units(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)).reshape(m, length)
        best = np.full((length + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, m), np.int64)
        back_id = np.zeros((length + 1, m), np.int64)
        edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        known = np.ones(m, bool)
        last = len(v.hashes) - 1
        for i in range(length):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(length, i + v.longest) + 1):
                h = h * _RADIX + units[:, j - 1]
                key = mix64(h)
                may = np.flatnonzero(v.filter[(key >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(v.hashes, key[may]), last)
                right = v.hashes[at] == key[may]
                may, at = may[right], at[right]
                if j == i + 1:
                    known &= np.bincount(may, minlength=m).astype(bool)
                if len(may):
                    edges[j].append((i, may, v.hash_scores[at], v.hash_ids[at]))
        for j in range(1, length + 1):
            for i, k, s, e in edges[j]:
                value = best[i, k] + s
                better = value > best[j, k]
                k = k[better]
                best[j, k], back[j, k], back_id[j, k] = value[better], i, e[better]
        # the least loss of any other way into a position
        loss = np.full((length + 1, m), np.inf)
        for j in range(1, length + 1):
            for i, k, s, _ in edges[j]:
                other = back[j, k] != i
                k, s = k[other], s[other]
                with np.errstate(invalid="ignore"):
                    loss[j, k] = np.fmin(loss[j, k], best[j, k] - best[i, k] - s)
        gap, pos = np.full(m, np.inf), np.full(m, length)
        rows = np.arange(m)
        steps = []
        while True:
            live = pos > 0
            if not live.any():
                break
            gap = np.where(live, np.minimum(gap, loss[pos, rows]), gap)
            steps.append(np.where(live, back_id[pos, rows], -1))
            pos = np.where(live, back[pos, rows], 0)
        ids = np.stack(steps[::-1], axis=1)
        own = (ids >= 0) & known[:, None]
        return known, ids[own].astype("<u4"), own.sum(axis=1), best[length], gap


class Segmenter:
    """N-best segmentations of texts."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.words = Words(self.v)
        self.ways: dict[str, list[tuple[float, bytes]]] = {}

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text, solved, as numbers.

        Arrow splits texts whose spaces are single and inside, and numbers their distinct
        words; LINE marks words that stand after a line break and so have no space mark."""
        if len(self.words.at) > MOST_WORDS:
            self.words.reset()
        plain = [bool(t) and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t and LINE not in t for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        at = self.words.at
        mine = [i for i, p in enumerate(plain) if p]
        if mine:
            cut = pa.array([texts[i].replace("\n", f" \n {LINE}") if self.v.cut_lines else texts[i] for i in mine], pa.large_string())
            cut = pc.split_pattern(cut, " ")
            bounds = cut.offsets.to_numpy()
            coded = cut.flatten().dictionary_encode()
            words = [w if w == "\n" and self.v.cut_lines else (w[1:] if w[:1] == LINE else MARK + w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
            self.words.add(words)
            units = np.fromiter(map(at.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
            for i, lo, hi in zip(mine, bounds[:-1], bounds[1:]):
                out[i] = units[lo:hi]
        for i, p in enumerate(plain):
            if not p:
                words = _SEGMENT.findall(marked(texts[i]))
                self.words.add(list(dict.fromkeys(words)))
                out[i] = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        return out

    def n_best(self, at: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """(score, ids as 4 bytes each), best first, of a text whose words are solved."""
        w = self.words
        base = float(w.best[at].sum())
        sizes = w.n_ids[at]
        ids = w.ids[ranges(w.start[at], sizes)]
        if n == 1 or not len(at):
            return [(base, ids.tobytes())]
        gaps = w.gap[at]
        # a segmentation among the n best changes only words among the n - 1 least gaps
        near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) >= n else np.arange(len(gaps))
        near = np.sort(near[np.isfinite(gaps[near])])
        stops = np.cumsum(sizes)
        ways = []
        for k in near:
            word = w.names[at[k]]
            got = self.ways.get(word)
            if got is None or len(got) < n and np.isfinite(got[-1][0]):
                got = []
                for s, own in Lattice(word, self.v).paths():
                    got.append((float(w.best[at[k]]) - s, np.asarray(own, "<u4")))
                    if len(got) == n:
                        break
                else:
                    got.append((np.inf, np.zeros(0, "<u4")))  # there are no more
                if len(self.ways) > MOST_WORDS:
                    self.ways.clear()
                self.ways[word] = got
            ways.append([g for g in got[:n] if np.isfinite(g[0])])
        heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(ways))]
        seen = {heap[0][1]}
        taken: list[tuple[float, bytes]] = []
        while heap and len(taken) < n:
            loss, pick = heapq.heappop(heap)
            own, to = [], 0
            for k, c, way in zip(near, pick, ways):
                own += [ids[to : stops[k] - sizes[k]], way[c][1]]
                to = stops[k]
            taken.append((base - loss, np.concatenate([*own, ids[to:]]).tobytes()))
            for i, c in enumerate(pick):
                if c + 1 < len(ways[i]):
                    nxt = (*pick[:i], c + 1, *pick[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(way[x][0] for way, x in zip(ways, nxt)), nxt))
        return taken

    def decoded(self, ids: np.ndarray) -> bytes:
        v = self.v
        return v.spell[ranges(v.spell_start[ids], v.spell_size[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = self.decoded(ids).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


_SEGMENTERS: dict[str, Segmenter] = {}


def _segmenter(path: str) -> Segmenter:
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(path)
    return _SEGMENTERS[path]


def encode(docs: DataFrame, n_best: int = N_BEST, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each document and rank (from 1): score, n_pieces, ids_crc32, and ids or, without them, whether they decode to the text."""
    path = path or model_path()
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "ids" if with_ids else "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                docs_, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
                rows = []
                for doc, text, parts in zip(docs_, texts, seg.learn(texts)):
                    spelled = b"" if with_ids else f" {text}".encode()
                    for rank, (score, ids) in enumerate(seg.n_best(parts, n_best), 1):
                        values = np.frombuffer(ids, "<u4")
                        last = values.astype(np.int64) if with_ids else seg.decoded(values) == spelled or seg.decode(values) == text
                        rows.append((doc, rank, score, len(values), zlib.crc32(ids), last))
                columns = list(zip(*rows)) if rows else [()] * 6
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()) if with_ids else pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, " + ("ids array<long>" if with_ids else "round_trip boolean")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(path)
        for b in batches:
            texts = [None if x is None else seg.decode(np.asarray(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
