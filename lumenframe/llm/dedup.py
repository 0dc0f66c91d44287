"""Near-duplicates by circulant MinHash.

Two permutations of a universe of 2^22 cells make all coordinates of a signature: the
first deals a shingle's hash to a cell, the second gives values, and coordinate k reads
the second one shifted circularly by k. The first ROWS * BANDS coordinates form bands; the
lowest bits of all COORDINATES estimate similarity.

Texts with the same set of shingles are one class, so exact copies cost a row of a partial
aggregate. Classes that share a band are a bucket. No bucket is ever expanded into pairs:
1. each bucket compares its members with one leader, the member with the most company;
   what passes the estimate is verified on full sets, and components are taken;
2. members that are still outside their leader's component are compared, by blocks of
   bounded size, with those who met the same leader and have a set of like size, and
   verified on full sets inside the block. Only links come out, at most one for two
   components. This costs (members * outsiders) / BLOCK rows a leader and class of sizes.
After this every pair that shares a band has been verified, is linked otherwise, or has an
estimate over four standard deviations below the threshold.

Sets are compared by 64-bit hashes of their shingles; equal sets are told by 128 bits from
two independent hashes of the words. Joins on leaders and bands split heavy keys.

Chance of losing a pair at similarity 0.75 in the banding: (1 - 0.75^5)^48 < 3e-6.

Defined results: null texts and texts without words have no shingles and link with
nothing; fewer words than a shingle make one; a row without doc_id is its own document,
kept, with a null component; rows that share a doc_id are one document, and each comes
back; an empty table gives no rows; further input columns don't pass through components().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import COARSE, drop_scratch, join_spread, table, without, write_scratch
from lumenframe.llm.textblock import mix64, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
ROWS, BANDS, COORDINATES = 5, 48, 512
CELL_BITS = 22
SEED = 75
#: Four and a half standard deviations of the estimate from COORDINATES bits.
MARGIN = 0.13
BLOCK = 256

_WINDOWS: list[np.ndarray] = []


def _permutation(seed: int) -> np.ndarray:
    """The cells in an order made by steps that each permute them: adding, multiplying by an odd number, folding high bits down."""
    mask, half = np.uint64((1 << CELL_BITS) - 1), np.uint64(CELL_BITS // 2)
    x = np.arange(1 << CELL_BITS, dtype=np.uint64)
    for odd, plus in np.random.default_rng(seed).integers(0, 1 << CELL_BITS, (6, 2), np.uint64):
        x = (x * (odd | np.uint64(1)) + plus) & mask
        x ^= x >> half
    return x.astype(np.uint32)


def _values() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation; the second, by cell and shift."""
    if not _WINDOWS:
        first, second = _permutation(SEED), _permutation(SEED + 1)
        ring = np.concatenate([second, second[: COORDINATES - 1]])
        _WINDOWS.extend([first, np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)])
    return _WINDOWS[0], _WINDOWS[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a set of shingle hashes that isn't empty."""
    first, windows = _values()
    cells = first[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    out = None
    for lo in range(0, len(cells), 256):
        low = windows[cells[lo : lo + 256]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each row and band; the band is part of it."""
    part = signatures[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return h.view(np.int64)


def sketch_words(signatures: np.ndarray) -> np.ndarray:
    """The lowest bits of all coordinates, 64 to a word."""
    return np.packbits((signatures & 1).astype(np.uint8), axis=1).view(np.int64)


def _sets(texts: list[str | None], table: int = 0) -> list[np.ndarray]:
    hashes, per = word_hashes([(t or "").encode().lower() for t in texts], table)
    ends = np.cumsum(per)
    return [shingle_hashes(hashes[e - n : e], SHINGLE) for e, n in zip(ends, per)]


WORDS = [f"s{i}" for i in range(COORDINATES // 64)]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit key of the set), bands, and the words of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = b.column(1).to_pylist()
                sets = _sets(texts)
                n = np.array([len(s) for s in sets], np.int64)
                sigs = np.zeros((len(sets), COORDINATES), np.uint32)
                keys = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        sigs[i] = signature(s)
                for t in (0, 1):  # by either table of word hashes
                    keys[t] = [mix64(s + np.uint64(1)).sum() for s in (_sets(texts, 1) if t else sets)]
                bands = band_hashes(sigs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                words = sketch_words(sigs)
                arrays = [b.column(0), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), lists, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(WORDS)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "k1", "k2", "bands", *WORDS])

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{w} long" for w in WORDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted set of shingle hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                data = [s.tobytes() for s in _sets(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, for sorted sets without repeats."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def may_link(n1: Column, n2: Column) -> Column:
    return 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)


def estimate(x: str, y: str) -> Column:
    """Similarity estimated from the sketches of x and y (prefixes of column names)."""
    apart = sum((F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in WORDS), F.lit(0))
    return 1 - apart * (2.0 / COORDINATES)


def connected(edges: DataFrame, label: str = "components") -> tuple[DataFrame, list[str]]:
    """(node, component: the least node reachable) for the nodes of edges (a, b), by alternating stars.

    Every round is an aggregate and a join over the edges, written to the shared folder."""
    spark = edges.sparkSession
    now, path = write_scratch(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    paths = [path]
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node may have any number of neighbours
        least, least_path = write_scratch(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), label)
        large = join_spread(both.where("v > u"), least.select("u", "m"), ["u"], least, "n", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now, path = write_scratch(out, label)
        drop_scratch(spark, least_path, *paths)
        paths = [path]
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")), paths
        state = new


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, on full sets; an a may have any number of pairs."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"__{k}")) for k in "ab")
    full = join_spread(pairs.join(right, "b"), left, ["a"], pairs.groupBy("a").agg(F.count("*").alias("n")), "n", ["b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["a", "b"])

    return full.select("a", "b", "__a", "__b").mapInArrow(run, "a long, b long").distinct()


def _block_links(group: pa.Table) -> pa.Table:
    """Links between the outsiders and the members of a block; at most one for two components."""
    outside = group.column("outside").to_numpy()
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    words = np.column_stack([group.column(w).to_numpy() for w in WORDS]).view(np.uint64)
    shingles = group.column("shingles")
    sets: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(shingles[i].as_buffer(), np.uint64)
        return sets[i]

    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    rows, members = np.flatnonzero(outside), np.flatnonzero(~outside)
    found = []
    for i in rows:
        near = 1 - np.bitwise_count(words[members] ^ words[i]).sum(axis=1) * (2.0 / COORDINATES)
        size = 100 * np.minimum(n[members], n[i]) >= PERCENT * np.maximum(n[members], n[i])
        fit = np.flatnonzero((near >= PERCENT / 100 - MARGIN) & size & (comp[members] != comp[i]))
        for j in members[fit[np.argsort(-near[fit], kind="stable")]]:
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y and linked(full(i), full(j)):
                root[x] = y
                found.append((int(node[i]), int(node[j])))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def outsiders(met: DataFrame, per_leader: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Links of members outside their leader's component. met: (leader, node, n_shingles), each leader among its own nodes; labels: (node, component)."""
    named = met.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = labels.select(F.col("node").alias("leader"), F.col("component").alias("__main"))
    marked = join_spread(named, lead, ["leader"], per_leader, "n", ["node"], "left").withColumn("outside", F.col("component") != F.coalesce("__main", "leader"))
    # sets of like size are in one class of sizes or in neighbouring ones
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")
    marked, marked_path = write_scratch(marked.select("leader", "node", "component", "outside", size.alias("size")), "marked")
    out = marked.where("outside").withColumn("size", F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))))
    n_out = out.groupBy("leader", "size").agg(F.count("*").alias("__out"))
    group = ["leader", "size"]
    sizes = marked.groupBy(*group).agg(F.count("*").alias("__n")).join(n_out, group)
    sizes, sizes_path = write_scratch(sizes.select(*group, "__n", "__out", F.ceil(F.col("__n") / BLOCK).alias("__mb"), F.ceil(F.col("__out") / BLOCK).alias("__ob")), "groups")
    few = sizes.select(*group, "__mb", "__ob")
    spread = F.xxhash64("node")
    as_member = join_spread(marked, few, group, sizes, "__n", ["node"])
    as_member = as_member.select(*group, "node", "component", F.lit(False).alias("outside"), F.pmod(spread, F.col("__mb")).alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ob") - 1)).alias("ob"))
    as_outsider = join_spread(out, few, group, sizes, "__out", ["node"])
    as_outsider = as_outsider.select(*group, "node", "component", F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mb") - 1)).alias("mb"), F.pmod(spread, F.col("__ob")).alias("ob"))
    rows = as_member.unionByName(as_outsider)
    full = rows.join(reps.select(F.col("doc_id").alias("node"), "n_shingles", *WORDS), "node").join(sets.withColumnRenamed("doc_id", "node"), "node")
    return full.groupBy("leader", "size", "ob", "mb").applyInArrow(_block_links, "a long, b long").distinct(), [marked_path, sizes_path]


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    every, every_path = write_scratch(signatures(docs), "signatures")
    sketch = F.struct("bands", "n_shingles", *WORDS)
    classes = every.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min_by(sketch, "doc_id").alias("s"), F.min("doc_id").alias("doc_id"))
    reps, reps_path = write_scratch(classes.select("k1", "k2", "doc_id", "s.*"), "classes")
    rows = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared, shared_path = write_scratch(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets, buckets_path = write_scratch(join_spread(rows, shared, ["band"], shared, "n", ["doc_id"]), "buckets")
    company = buckets.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("w"))
    leaders = buckets.join(company, "doc_id").groupBy("band").agg(F.max(F.struct(F.col("w"), (-F.col("doc_id")).alias("i"))).alias("t")).select("band", (-F.col("t.i")).alias("leader"))
    met = join_spread(buckets, leaders, ["band"], shared, "n", ["doc_id"]).select("leader", F.col("doc_id").alias("node"), "n_shingles").distinct()
    met, met_path = write_scratch(met, "met")
    per_leader, per_path = write_scratch(met.groupBy("leader").agg(F.count("*").alias("n")), "leaders")

    known = met.select("node").distinct()
    coarse = known.select(F.pmod(F.xxhash64("node"), F.lit(COARSE)).alias("__c")).distinct()  # COARSE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(coarse), F.pmod(F.xxhash64("doc_id"), F.lit(COARSE)) == F.col("__c"), "left_semi")
    sets, sets_path = write_scratch(shingle_sets(texts).join(known, F.col("doc_id") == F.col("node"), "left_semi"), "sets")

    small = lambda p, k: reps.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{p}n"), *(F.col(w).alias(f"{p}{w}") for w in WORDS))
    near = join_spread(met.where("leader != node").select("leader", "node"), small("x", "leader"), ["leader"], per_leader, "n", ["node"]).join(small("y", "node"), "node")
    near = near.where(may_link(F.col("xn"), F.col("yn")) & (estimate("x", "y") >= PERCENT / 100 - MARGIN))
    near, near_path = write_scratch(near.select(F.col("leader").alias("a"), F.col("node").alias("b")), "near")
    first, first_path = write_scratch(verified(near, sets), "links")
    labels, labels_paths = connected(first)
    apart, apart_paths = outsiders(met, per_leader, labels, reps, sets)
    more, more_path = write_scratch(apart, "links")
    spare = [shared_path, buckets_path, met_path, per_path, sets_path, near_path, *apart_paths]
    # rows that share an id are one document, whatever their sets
    same_id = every.where("n_shingles > 0 and doc_id is not null").join(reps.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    ids = reps.select(F.col("doc_id").alias("a"))
    split = same_id.join(ids, "a", "left_semi")  # an id that also stands for another class
    labels, final_paths = connected(first.union(more).union(split), "final")
    drop_scratch(spark, *spare, *labels_paths, first_path, more_path)
    named = reps.select("k1", "k2", F.col("doc_id").alias("node")).join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("__component"))
    out = every.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("__component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of docs (the least doc_id's), as it is; rows without doc_id stay."""
    found, _ = write_scratch(components(docs.select("doc_id", "text")), "kept")
    gone = found.where(~F.col("kept")).select("doc_id")
    out = without(docs, gone)
    if found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    none = out.where(F.col("doc_id").isNull())
    return none.unionByName(out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs of texts that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""
