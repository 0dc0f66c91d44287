"""Best-fit packing of tokenised documents by linear grouping.

Every decision is taken on the histogram of piece lengths, which has at most `capacity`
rows whatever the corpus holds. The planner
1. sorts the large lengths (over capacity/8) and cuts them into groups of equal
   cardinality, each rounded up to its longest member,
2. solves the configuration program over these few sizes by column generation (a dense
   simplex, priced by a knapsack over the capacity) and keeps whole multiples,
3. puts actual lengths into the slots of their groups,
4. best-fits what is left, longest first, on actual lengths.
Sequences with equal contents are one class with a multiplicity, so the plan stays small,
and a piece finds its sequence and offset from its length and its rank among the pieces of
that length. Ranks come from (length, salt) groups of bounded size.

Defined results: a null text is empty and gives the single closing id; repeated rows are
packed each for itself; an empty table gives no rows; columns of the input other than the
id and text don't pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import table, write_scratch
from lumenframe.llm.textblock import ranges

CAPACITY = 2048
GROUPS = 24
LARGE_PART = 8
#: Rows of a (length, salt) group, on average over the salts, at most.
RANK_GROUP = 4096
#: Salts whose counts are summed together.
RUN = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    A single space between two non-space characters always starts a new pre-token of this
    vocabulary, so texts are cut there. Arrow splits a block of texts and numbers its distinct
    words; new ones are encoded together, and numpy puts the ids of all words in their places.
    Words are encoded by tiktoken from the same file's merges, with the same ids; texts that
    hold the special token go to the tokenizers library itself."""

    MOST_WORDS = 300_000
    #: Characters of a block of texts; longer texts are cut at spaces.
    BLOCK = 1 << 22

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        # byte-level files write each byte as a printable character
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in printable}
        chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.n_bytes[i] = len(piece)
        self.reset()

    #: A space next to any other white space; there a cut could change the pre-tokens.
    _RUN = re.compile(r" (?:\s|(?<=\s ))")

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps words of two blocks or more, so that rare ones don't push out frequent ones."""
        old, stay = self.known, self.uses > 1
        if stay.sum() > self.MOST_WORDS // 2:
            return self.reset()
        start, size, ids = self.start[stay], self.size[stay], self.ids
        words = [w for w, i in old.items() if stay[i]]
        self.reset()
        self.known = dict(zip(words, range(len(words))))
        self._store(ids[ranges(start, size)], size)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used) + 1, "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of words with a space before them: encoded as one text, where every space begins a word."""
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            text = " " + " ".join(fresh)
            ids = self.fast.encode_to_numpy(text)
            starts = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.append(starts[1:], len(text.encode()))) + 1
            self._store(ids, np.diff(stops, prepend=0))

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without white space next to a space, and where each ends.

        The first word of a text has no space before it, and only the last may end with white
        space or be empty: these two are encoded by themselves."""
        if len(self.known) > self.MOST_WORDS:
            self._forget()
        inner = [t[t.find(" ") + 1 : t.rfind(" ") + 1] for t in texts]  # each word with a space after it
        firsts = [t.split(" ", 1)[0] for t in texts]
        lasts = [t[t.rfind(" ") :] if " " in t else "" for t in texts]
        cut = pc.split_pattern(pa.array(inner, pa.string()), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in words if w])
        self.known[""] = -1
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        del self.known[""]
        self.uses[place[place >= 0]] += 1
        edges = [self.fast.encode_to_numpy(w).astype("<u4") for pair in zip(firsts, lasts) for w in pair]
        base = len(self.start)
        units = place[coded.indices.to_numpy()]
        # every text's words end with an empty one, and its two edges go around them
        units[bounds[1:] - 1] = base + 1 + 2 * np.arange(len(texts))
        units = np.insert(units, bounds[:-1], base + 2 * np.arange(len(texts)))
        extra = np.array([len(x) for x in edges], np.int64)
        size, start = np.concatenate([self.size, extra]), np.concatenate([self.start, self.used + np.cumsum(extra) - extra])
        flat = np.concatenate([self.ids[: self.used], *edges])
        sizes = size[units]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return flat[ranges(start[units], sizes)], ends[bounds[1:] + np.arange(1, len(texts) + 1)]

    def _cuts(self, text: str) -> Iterator[str]:
        """text in parts of about BLOCK characters, cut before spaces that are cuts."""
        at = 0
        while at < len(text):
            to = text.find(" ", at + self.BLOCK)
            to = len(text) if to < 0 else to
            yield text[at:to]
            at = to

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        pending: list[str] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            if pending:
                ids, ends = self._block(pending)
                yield from np.split(ids, ends[:-1])
                pending.clear()

        for text in texts:
            plain = not self._RUN.search(text) and not any(s in text for s in self.special)
            if plain and len(text) <= self.BLOCK:
                if size + len(text) > self.BLOCK:
                    yield from flush()
                    size = 0
                pending.append(text)
                size += len(text)
                continue
            yield from flush()
            size = 0
            if plain:
                yield np.concatenate([self._block([part])[0] for part in self._cuts(text)])
            elif any(s in text for s in self.special):
                yield np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                yield self.fast.encode_to_numpy(text).astype("<u4")
        yield from flush()

    def __call__(self, text: str) -> bytes:
        """The ids, each as 4 bytes, little-endian."""
        return next(self.encode([text])).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole capacities, the first maybe shorter."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n_ids, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids of every piece."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_numpy(zero_copy_only=False).tolist()])):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        encoder.reset()  # the worker lives on

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---- the plan, on counts of lengths ----


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in runs of (length, count), cut into groups of equal cardinality."""
    total = sum(counts.values())
    if not total:
        return []
    size = -(-total // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = size
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
            if not room:
                out.append([])
                room = size
    return [g for g in out if g]


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if value[i] > 1e-12]
    if not order:
        return 0.0, np.zeros(len(sizes))
    s, v = sizes[order], value[order]
    for c in range(int(s.min()), capacity + 1):
        fit = s <= c
        got = np.where(fit, best[np.maximum(c - s, 0)] + v, -1.0)
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = got[k], order[k]
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), pattern


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns of the sizes with whole multiplicities, from the configuration program rounded down."""
    s, n = np.asarray(sizes), np.asarray(need, float)
    k = len(s)
    basis = np.diag(np.floor(capacity / s)).astype(float)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        worth, pattern = _knapsack(s, np.maximum(dual, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, n), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    x = np.linalg.solve(basis, n)
    left = n.copy()
    plan = []
    for j in np.argsort(-x):
        pattern = basis[:, j]
        used = pattern > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // pattern[used]).min()))
        if times > 0:
            left -= pattern * times
            plan.append((pattern.astype(int), times))
    return plan


def plan_classes(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(multiplicity, [(length, count)])]: sequences by equal contents. Holds every piece once."""
    left = {int(a): int(b) for a, b in counts.items() if b}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]

    def put(times: int, content: list[tuple[int, int]]) -> None:
        if times:
            room = capacity - sum(a * b for a, b in content)
            (done if room == 0 else open_[room]).append((times, content))

    if capacity in left:
        put(left.pop(capacity), [(capacity, 1)])
    grouped = linear_groups({a: b for a, b in left.items() if a > capacity // LARGE_PART}, groups)
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in grouped:  # equal rounded sizes are one size
        merged.setdefault(g[0][0], []).extend(g)
    runs = [list(g) for g in merged.values()]
    if runs:
        for pattern, times in configurations(list(merged), [sum(c for _, c in g) for g in runs], capacity):
            slots = [g for g, c in enumerate(pattern) for _ in range(c)]
            fills = []
            for g in slots:
                want, fill = times, []
                while want:
                    length, have = runs[g][0]
                    take = min(want, have)
                    fill.append((length, take))
                    left[length] -= take
                    want -= take
                    if take == have:
                        runs[g].pop(0)
                    else:
                        runs[g][0] = (length, have - take)
                fills.append(fill)
            at = [0] * len(fills)
            room = [f[0][1] for f in fills]
            while times:
                step = min(room)
                content: dict[int, int] = {}
                for i, f in enumerate(fills):
                    content[f[at[i]][0]] = content.get(f[at[i]][0], 0) + 1
                put(step, sorted(content.items(), reverse=True))
                times -= step
                for i, f in enumerate(fills):
                    room[i] -= step
                    if not room[i] and times:
                        at[i] += 1
                        room[i] = f[at[i]][1]
    for length in sorted((a for a, b in left.items() if b), reverse=True):
        n = left[length]
        for room in range(length, capacity + 1):
            while n and open_[room]:
                times, content = open_[room].pop()
                each = min(room // length, n)
                took = min(times, n // each)
                put(took, [*content, (length, each)])
                n -= took * each
                if times > took:
                    open_[room].append((times - took, content))
        if n:
            each = capacity // length
            put(n // each, [(length, each)])
            put(1 if n % each else 0, [(length, n % each)])
    return done + [c for level in open_ for c in level]


def segments(classes: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length the ranks from..: sequence of the first of them, offset; sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows = []
    base = 0
    for times, content in classes:
        offset = 0
        for length, count in content:
            for _ in range(count):
                rank = used.get(length, 0)
                rows.append((length, rank, base, offset))
                used[length] = rank + times
                offset += length
        base += times
    rows.sort()
    table = np.asarray(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def assign(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """cut (with doc_id, piece, start, length; written, so that it can be read twice) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = segments(plan_classes(counts, capacity, groups))
    salts = sum(counts.values()) // RANK_GROUP + 32
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    # counts before a salt: of its run of salts by the runs before, and inside its run
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).withColumn("__run", F.floor(F.col("__salt") / RUN))
    inside = Window.partitionBy("length", "__run").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("length").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("length", "__run").agg(F.sum("__n").alias("__n")).select("length", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__runs"))
    offsets = sizes.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(runs, ["length", "__run"]).select("length", "__salt", (F.col("__in") + F.col("__runs")).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(offsets, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__before", "__salt")
    sent = spark.sparkContext.broadcast(found)  # grows with the capacity, not with the corpus
    kept = list(cut.columns)
    names = [*kept, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        first = np.searchsorted(f["length"], np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                mine = length == v
                lo, hi = first[v], first[v + 1]
                at[mine] = lo + np.searchsorted(f["rank"][lo:hi], rank[mine], side="right") - 1
            columns = [b.column(n) for n in kept]
            columns += [pa.array(f["sequence"][at] + rank - f["rank"][at]), pa.array(f["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, groups: int = GROUPS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut, _ = write_scratch(pieces(docs, capacity, path, id_col, text_col, with_ids), "pieces")
    return assign(cut, capacity, groups)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
