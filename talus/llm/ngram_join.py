"""Operator 2: n-gram Jaccard self-join by chosen paths (after Christiani, Pagh and Sivertsen 2018)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ._base import among, components, own, table, written

#: Words to a shingle, least similarity, values of a MinHash embedding, chance that a true pair is found.
WORDS, SIMILARITY, VALUES, RECALL = 5, 0.8, 64, 0.9999
#: Buckets up to LEAF rows are brute-forced; larger ones split, DEPTH times at most, then go in blocks of BLOCK rows.
LEAF, DEPTH, BLOCK = 400, 4, 200
#: Classes, and shingles of all of them, that a block of a connected group holds on average when links are counted.
GROUP_BLOCK, GROUP_SHINGLES = 1_000, 1_000_000
#: A pair is a candidate from this share of equal values of the embeddings on (about five standard errors below SIMILARITY).
CANDIDATE = 0.55
#: In a large bucket, rows that agree with its pivot this far join it as candidates; rows that agree by CORE are done.
#: Distance 1 - J is a metric: a row nearer than LOOSE to the pivot and one farther than CORE are no link of 0.8.
LOOSE, CORE = 0.2, 0.65

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(text):
    """Lower-cased words between runs of white space; none for null or blank."""
    return W.pretokens(F.lower(text), r"[^\x20\x09-\x0D]+")


def _words_of() -> W.Lexicon:
    def make() -> W.Lexicon:
        import xxhash

        return W.Lexicon(lambda ws: [pa.array([xxhash.xxh3_64_intdigest(w) for w in ws], pa.uint64())], most=100_000)

    return W.active(("hashes",), make)


def shingles(lists: pa.ListArray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all rows, and the number of them in each row (ascending within a row).

    A row of fewer than n words has one shingle, all of them; a row without words has none.
    """
    (h,), at = _words_of().rows(lists.flatten())
    w = pc.take(h, at).to_numpy(zero_copy_only=False).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    left = ends[row] - np.arange(len(w)) if len(w) else np.zeros(0, np.int64)  # words from here to the row's end
    key = np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            nxt = np.zeros(len(w), np.uint64)
            nxt[: max(len(w) - i, 0)] = w[i:]
            key = np.where(left > i, mix(key * _M + nxt + np.uint64(i + 1)), key)
    use = (left >= n) | ((left == size[row]) & (size[row] < n)) if len(w) else np.zeros(0, bool)
    key, row = key[use], row[use]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], np.bincount(row[new], minlength=len(size)).astype(np.int64)


def embedding(keys: np.ndarray, counts: np.ndarray, values: int = VALUES) -> np.ndarray:
    """MinHash values (rows with shingles, values) as unsigned 32-bit numbers."""
    full = counts[counts > 0]
    start = np.r_[0, np.cumsum(full)[:-1]].astype(np.int64)
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, 1 << 63, values, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, values, np.uint64)
    out = np.zeros((len(full), values), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(values if len(full) else 0):
            out[:, j] = np.minimum.reduceat((keys * a[j] + b[j]) >> np.uint64(32), start)
    return out


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair of that similarity has met with that chance, in nodes of that depth (Poisson branching)."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)  # 1/similarity children in expectation, each shared with chance `similarity`
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def choices(node: np.ndarray, values: int, similarity: float) -> np.ndarray:
    """(nodes, values): which coordinates each node samples, each with chance 1 / (similarity * values)."""
    with np.errstate(over="ignore"):
        h = mix(node[:, None].astype(np.uint64) + _M * np.arange(1, values + 1, dtype=np.uint64))
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < 1 / (similarity * values)


def stars(ids: np.ndarray, sig: np.ndarray, least: float = CANDIDATE) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs in one bucket whose embeddings agree in `least` of their bytes."""
    n = len(ids)
    out, root = [], np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero((sig[i + 1 :] == sig[i]).mean(1) >= least) + i + 1
        near = near[root[near] != root[i]]
        for j in near:
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
        if (root == root[0]).all():
            break
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key in turn, from batches that come sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        held = pa.concat_tables([held, t]) if held is not None else t
        cols = [held.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = 0
        for to in change:
            yield held.slice(at, to - at)
            at = to
        held = held.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _bytes(column, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def candidates(classes: DataFrame, similarity: float, recall: float, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """classes(c, sig) -> edges (a, b) that connect every pair found along the chosen paths."""
    runs = runs_needed(similarity, recall, depth + 1)  # the root splits too
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Children of each row's node: the node and the sampled coordinate's value name the child."""
        for b in batches:
            sig = _bytes(b.column("sig"), VALUES, "<u4")
            node = b.column("node").to_numpy().view(np.uint64)
            i, j = np.nonzero(choices(node, VALUES, similarity))
            with np.errstate(over="ignore"):
                child = mix(node[i] * _M + mix(sig[i, j].astype(np.uint64) + (np.uint64(1) + j.astype(np.uint64) << np.uint64(32))))
            yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "c": b.column("c").take(pa.array(i))})

    def split_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rooted():
            for b in batches:
                for r in range(runs):
                    yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(b.num_rows, r, np.int64)), "c": b.column("c"), "sig": b.column("sig")})

        yield from split(rooted())

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for t in grouped(batches, ["node", "block"]):
            for x, y in stars(t.column("c").to_numpy(), _bytes(t.column("low"), VALUES, np.uint8)):
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest byte of each value: all that a comparison in a bucket reads, so all that moves to it."""
        for b in batches:
            low = (_bytes(b.column("sig"), VALUES, "<u4") & 0xFF).astype(np.uint8)
            yield b.drop_columns(["sig"]).append_column("low", pa.array([x.tobytes() for x in low], pa.binary()))

    def with_sig(rows: DataFrame, c: str = "c", sig: str = "sig") -> DataFrame:
        """Only embeddings that rows ask for move, each 256 bytes: few classes are in large buckets, fewer are pivots."""
        wanted = among(classes.select(F.col("c").alias("k"), F.col("sig").alias(sig)), rows.select(F.col(c).alias("k")), "k")
        return rows.join(wanted, F.col(c) == F.col("k")).drop("k")

    def with_low(rows: DataFrame) -> DataFrame:
        lows = classes.select(F.col("c").alias("k"), "sig").mapInArrow(W.lean(low_bytes), "k long, low binary")
        return rows.join(lows, F.col("c") == F.col("k")).drop("k")

    def sized(rows: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one, by one shuffle.  No node is hot: a class has 1 / similarity rows in each run."""
        node = Window.partitionBy("node")
        size, pivot = F.count("*").over(node), F.min_by("c", F.xxhash64("c", "node")).over(node)
        return written(rows.select("node", "c", size.alias("size"), pivot.alias("pivot")).where("size > 1"), "nodes")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = _bytes(b.column("sig"), VALUES, "<u4") == _bytes(b.column("psig"), VALUES, "<u4")
                yield b.drop_columns(["psig"]).append_column("s", pa.array(same.mean(1)))

    rows = sized(classes.select("c", "sig").mapInArrow(W.lean(split_roots), "node long, c long"))
    edges = []
    for level in range(depth + 1):
        small = with_low(rows.where(F.col("size") <= leaf).select("node", "c")).withColumn("block", F.lit(0))
        edges.append(written(small.repartition(n, "node").sortWithinPartitions("node", "c").mapInArrow(W.lean(brute), "a long, b long").distinct(), "edges"))
        big = rows.where(F.col("size") > leaf)
        if big.isEmpty():
            break
        # Whoever agrees with the pivot is of its component already; its core is done, as no others can link to it.
        pivots = with_sig(big.select(F.col("pivot").alias("p")).distinct(), "p", "psig")
        seen = with_sig(big.select("node", "c", "pivot")).join(pivots, F.col("pivot") == F.col("p")).select("node", "c", "pivot", "sig", "psig")
        seen = written(seen.mapInArrow(W.lean(agree), "node long, c long, pivot long, sig binary, s double"), "seen")
        edges.append(seen.where((F.col("s") >= LOOSE) & (F.col("c") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct())
        open_nodes = seen.where(F.col("s") < LOOSE).select(F.col("node").alias("at")).distinct()
        todo = seen.where(F.col("s") < CORE).join(open_nodes, F.col("node") == F.col("at"), "left_semi")
        if level < depth:
            rows = sized(todo.select("node", "c", "sig").mapInArrow(W.lean(split), "node long, c long"))
            continue
        # The rest goes in pairs of blocks, so that no bucket is cut short whatever its size.
        blocks = todo.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("node", "at")
        last = todo.select("node", "c", "sig").mapInArrow(W.lean(low_bytes), "node long, c long, low binary")
        mine = last.join(blocks, F.col("node") == F.col("at")).withColumn("i", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        mine = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.least("i", "j").cast("long") * F.lit(1 << 32) + F.greatest("i", "j"))
        edges.append(mine.select("node", "block", "c", "low").repartition(n, "node", "block").sortWithinPartitions("node", "block", "c").mapInArrow(W.lean(brute), "a long, b long").distinct())
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) that connect the same rows as the symmetric boolean matrix does."""
    left, out = link.any(1), []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(link), bool)
        seen[root], new = True, np.array([root])
        while len(new):
            near = link[new].any(0) & ~seen
            seen |= near
            new = np.flatnonzero(near)
        left &= ~seen
        out += [(root, int(x)) for x in np.flatnonzero(seen) if x != root]
    return out


def verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Exact links inside each pair of blocks: rows (c, other, n) - n copies linked to c, or n null and an edge of the links' forest.

    Shared shingles are counted by products of 0/1 matrices, over the shingles that two rows or more of the pair hold.
    """
    top, all_of = round(similarity * 1000), 1000 + round(similarity * 1000)
    out: list[list] = [[], [], []]
    for t in grouped(batches, ["component", "i", "j"]):
        c = t.column("c").to_numpy()
        t = t.filter(pa.array(np.r_[True, c[1:] != c[:-1]]))  # rows that repeat key and text come once from each task
        c, mult, part = (t.column(x).to_numpy() for x in ("c", "mult", "part"))
        sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        i, j = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
        _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        del sets
        row, token = row[held[token] > 1], token[held[token] > 1]  # the others add to no intersection
        token = (np.cumsum(held > 1) - 1)[token]
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        shared = np.zeros((len(c), len(c)), np.float32)
        width = max(256, (1 << 22) // max(len(c), 1))
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, [lo, lo + width])
            dense = np.zeros((len(c), width), np.float32)
            dense[row[a:b], token[a:b] - lo] = 1
            shared += dense @ dense.T
        link = np.zeros(shared.shape, bool)
        for lo in range(0, len(c), 256):  # inter / union >= similarity, in whole numbers
            link[lo : lo + 256] = np.rint(shared[lo : lo + 256]).astype(np.int64) * all_of >= top * (size[lo : lo + 256, None] + size[None, :])
        np.fill_diagonal(link, False)
        if i != j:  # pairs inside one block belong to the task of that block with itself
            link &= part[:, None] != part[None, :]
        n = np.array([mult[x].sum() for x in link], np.int64)
        for x, y in forest(link):
            out[0].append(int(c[x])), out[1].append(int(c[y])), out[2].append(None)
        for x in np.flatnonzero(n):
            out[0].append(int(c[x])), out[1].append(None), out[2].append(int(n[x]))
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["c", "other", "n"])
            out = [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["c", "other", "n"])


def ngram_join(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", key: str = "doc_id", leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """One row per input row: key, n_links, class_id, kept.

    Texts link when the Jaccard similarity of their sets of five-word shingles is `similarity` or more; n_links counts
    the other rows linked to a row, class_id is the smallest key reachable by links, kept marks the row of that key.
    Words are what stands between white space, in lower case; a text of fewer words is one shingle; a text without
    words (null, empty) links with nothing.  Rows of null key link like any other; they name a class (by null) only if
    none of its rows has a key.  Rows that repeat a key keep their own answers.  Other columns are ignored; an empty
    table gives no rows.

    Rows of equal sets are one class from the start.  Paths connect classes that may link; inside each connected group,
    cut into blocks, all links are then counted exactly, so that a large group makes no row for each of its pairs.
    """
    W.small_batches(df.sparkSession)
    rows = own(df, key=key, text=text).withColumn("rid", F.xxhash64("text"))
    kind = dict(rows.dtypes)["key"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import slices

        for b in slices(batches):
            keys, counts = shingles(b.column("words"))
            sig = iter(embedding(keys, counts).astype("<u4"))
            ends = np.r_[0, np.cumsum(counts)]
            import xxhash

            names = [xxhash.xxh3_128_digest(keys[ends[i] : ends[i + 1]].tobytes()) if counts[i] else None for i in range(len(counts))]
            sigs = [next(sig).tobytes() if counts[i] else None for i in range(len(counts))]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "rid": b.column("rid"), "size": pa.array(counts), "name": pa.array(names, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    docs = written(rows.select("key", "rid", word_lists(F.col("text")).alias("words")).mapInArrow(W.lean(sketch), f"key {kind}, rid long, size long, name binary, sig binary"), "docs")
    # A class is read again from one row: of its rows with the smallest key, the one of the least text hash.
    classes = docs.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("of"), F.count("*").alias("mult"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = classes.select("name", F.col("of.key").alias("first"), F.col("of.rid").alias("rid"), "mult", "size", "sig")
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    groups = components(candidates(classes, similarity, recall, leaf, depth))
    groups = written(groups, "groups")

    # The sets of classes that may link, from the text of one row of each.
    member = groups.join(classes.select("c", "first", "rid", "mult", "name", "size"), F.col("node") == F.col("c")).drop("node")
    sizes = member.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("size") / GROUP_SHINGLES)).cast("int").alias("blocks")).withColumnRenamed("component", "of")
    member = member.join(sizes, F.col("component") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    few = written(member.select("first", F.col("rid").alias("first_rid"), "name", "c", "mult", "component", "blocks", "part"), "members")
    wanted = ["c", "name", "mult", "component", "blocks", "part"]
    # Texts that no member is read from stay where they are: the join would move them whole.
    rows = among(rows, few.select(F.col("first").alias("key"), F.col("first_rid").alias("rid")), "key", "rid")
    keyed = rows.join(few.where("first IS NOT NULL"), (F.col("key") == F.col("first")) & (F.col("rid") == F.col("first_rid"))).select(*wanted, "text")
    # Rows without a key are found by their text's hash; copies among them go before their texts are read.
    no_key = rows.where("key IS NULL").groupBy("rid").agg(F.min("text").alias("text"), F.max("text").alias("last"))
    no_key = no_key.select("rid", F.explode(F.array_distinct(F.array("text", "last"))).alias("text"))
    no_key = no_key.join(few.where("first IS NULL"), F.col("rid") == F.col("first_rid")).select(*wanted, "text")
    sources = keyed.unionByName(no_key).select(*wanted, word_lists(F.col("text")).alias("words"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from .bpe import slices

        done: set[int] = set()  # a key and text may repeat
        for b in slices(batches):
            keys, counts = shingles(b.column("words"))
            ends = np.r_[0, np.cumsum(counts)]
            raw = [keys[ends[i] : ends[i + 1]].astype("<u8").tobytes() for i in range(len(counts))]
            right = [xxhash.xxh3_128_digest(x) == y for x, y in zip(raw, b.column("name").to_pylist(), strict=True)]  # a repeated key has other texts too
            for k, c in enumerate(b.column("c").to_pylist()):
                right[k] = right[k] and c not in done
                if right[k]:
                    done.add(c)
            cols = {x: b.column(x) for x in ("c", "mult", "component", "blocks", "part")} | {"shingles": pa.array(raw, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(right))

    found = sources.mapInArrow(W.lean(sets), "c long, mult long, component long, blocks int, part int, shingles binary")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = found.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("part", "x")).withColumn("j", F.greatest("part", "x"))
    tasks = tasks.select("component", "i", "j", "c", "mult", "part", "shingles").repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "c")
    links = written(tasks.mapInArrow(W.lean(lambda it: verify(it, similarity)), "c long, other long, n long"), "links")

    counts = links.where("n IS NOT NULL").groupBy("c").agg(F.sum("n").alias("n")).withColumnRenamed("c", "k")
    joined = components(links.where("other IS NOT NULL"), "c", "other").withColumnRenamed("node", "m")
    labelled = classes.join(counts, F.col("c") == F.col("k"), "left").join(joined, F.col("c") == F.col("m"), "left").withColumn("component", F.coalesce("component", "c"))
    labelled = written(labelled.select("name", "c", "first", "component", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "labelled")
    lowest = labelled.groupBy("component").agg(F.min("first").alias("class_id")).withColumnRenamed("component", "k")
    labelled = labelled.join(lowest, F.col("component") == F.col("k")).select(F.col("name").alias("own_name"), "n_links", "class_id")
    out = docs.select("key", "name").join(labelled, F.col("name") == F.col("own_name"), "left")
    class_id = F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("class_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), class_id.alias("class_id"), F.col("key").eqNullSafe(class_id).alias("kept"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g
    FROM w
),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE k * 1800 >= 800 * (x.n + y.n)
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
    SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_links, class_id, doc_id = class_id AS kept
FROM class LEFT JOIN n USING (doc_id)
"""
