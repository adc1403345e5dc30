"""Operator 9: near-duplicate vectors by inverted lists of product-quantised residuals with exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import components, own, table, written

#: Vectors that the quantisers are fitted on, at most; subspaces; codewords of each; lists at most.
SAMPLE, SUBSPACES, CODEWORDS, LISTS = 20_000, 8, 256, 1024
#: Entries and queries that meet in one task.
ENTRIES, QUERIES = 4_000, 8_000


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[0][:, 0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest of the centres c to each row of x, ascending, and their squared distances."""
    out_i, out_d = [], []
    half = (c * c).sum(1)
    for at in range(0, len(x), 2048):
        b = x[at : at + 2048]
        d = (b * b).sum(1)[:, None] + half - 2 * (b @ c.T)
        i = np.argpartition(d, min(m, len(c)) - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(b), 1))
        v = np.take_along_axis(d, i, 1)
        o = np.argsort(v, axis=1, kind="stable")
        out_i.append(np.take_along_axis(i, o, 1))
        out_d.append(np.take_along_axis(v, o, 1))
    if not out_i:
        return np.zeros((0, m), int), np.zeros((0, m))
    return np.concatenate(out_i), np.concatenate(out_d)


class Index:
    """Coarse centres and residual codebooks, of bounded size, fitted on a bounded sample of unit vectors."""

    def __init__(self, x: np.ndarray, rows: int, threshold: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.threshold, self.dim = threshold, x.shape[1]
        self.reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6  # no partner is farther
        self.centres = k_means(x, max(1, min(LISTS, len(x), math.isqrt(max(rows, 1)))), rng)
        residual = x - self.centres[nearest(x, self.centres, 1)[0][:, 0]]
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [k_means(residual[:, c], min(CODEWORDS, len(x)), rng, 6) for c in self.cuts]

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and (vectors, lists): whether a partner of the vector can be in the list.

        A partner lies within reach of the vector, so its list's cell must come that near: the distance to the plane
        between two centres bounds it from below.  Every list that passes is looked up, however many they are.
        """
        c = self.centres
        half = (c * c).sum(1)
        apart = np.sqrt(np.maximum(half[:, None] + half - 2 * (c @ c.T), 0)) + 1e-6
        home, near = np.zeros(len(x), np.int64), np.zeros((len(x), len(c)), bool)
        for at in range(0, len(x), 2048):
            d = half - 2 * (x[at : at + 2048] @ c.T)
            own_list = d.argmin(1)
            home[at : at + 2048] = own_list
            near[at : at + 2048] = d - d.min(1)[:, None] <= 2 * self.reach * apart[own_list] + 1e-12
        return home, near

    def groups(self, held: dict[int, int], size: int) -> tuple[np.ndarray, list[int]]:
        """The group of each list, and the entries of each group: lists next to each other go together up to `size` entries."""
        left, chain = np.ones(len(self.centres), bool), [0]
        left[0] = False
        while left.any():
            d = ((self.centres - self.centres[chain[-1]]) ** 2).sum(1)
            chain.append(int(np.where(left, d, np.inf).argmin()))
            left[chain[-1]] = False
        of, total = np.zeros(len(chain), np.int64), [0]
        for w in chain:
            if total[-1] and total[-1] + held.get(w, 0) > size:
                total.append(0)
            of[w] = len(total) - 1
            total[-1] += held.get(w, 0)
        return of, total

    def encode(self, x: np.ndarray, own_list: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        residual = x - self.centres[own_list]
        codes = np.stack([nearest(residual[:, c], book, 1)[0][:, 0] for c, book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        kept = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((residual[:, np.concatenate(self.cuts)] - kept) ** 2).sum(1))

    def search(self, entries: dict, x: np.ndarray):
        """Pairs (query, entry) of cosine >= threshold, by blocks: table look-ups first, exact cosines of the rest.

        By the triangle inequality a partner's approximate distance is at most its true one plus its quantisation error.
        The products of a query with the codewords are the same for all lists; 1e-4 is more than single precision loses.
        """
        codes, y = entries["codes"], entries["x"]
        lists, of = np.unique(entries["home"], return_inverse=True)
        kept = self.centres[entries["home"]]
        for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            kept[:, c] += book[codes[:, j]]
        least = ((1 + (kept * kept).sum(1) - (self.reach + entries["err"]) ** 2 - 1e-4) / 2).astype(np.float32)
        for at in range(0, len(x), 256):
            q = x[at : at + 256]
            dot = (self.centres[lists] @ q.T).astype(np.float32)[of]
            for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
                dot += (book @ q[:, c].T).astype(np.float32)[codes[:, j]]
            maybe = dot >= least[:, None]
            if 16 * np.count_nonzero(maybe) > maybe.size:  # one product is cheaper than so many; only ties are left to decide
                cosine = y @ q.T
                good = cosine >= self.threshold + 1e-9
                maybe = abs(cosine - self.threshold) < 1e-9
            else:
                good = np.zeros_like(maybe)
            k, i = np.nonzero(maybe)
            good[k, i] = np.einsum("ij,ij->i", q[i], y[k]) >= self.threshold
            k, i = np.nonzero(good)
            yield at + i, k


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def link(df: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is `threshold` or more; the index leaves out no pair.  Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths.  Rows of equal vectors are one class from the start.  A null key is nobody's
    component; rows that repeat a key keep their own answers.  Other columns are ignored; an empty table gives no rows.
    The quantisers are fitted on `sample` distinct vectors (lowest hashes) at most; every vector is indexed.
    """
    spark = df.sparkSession
    rows = own(df, key=key, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(fit, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = rows.where("usable").groupBy("v").agg(F.min("key").alias("first"), F.count("*").alias("mult"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    parts = [_linked(classes.where(F.col("dim") == r["dim"]), r["dim"], r["n"], threshold, sample) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
    else:
        links = spark.createDataFrame([], "c long, other long, n long")
    links = written(links, "links")
    counts = links.where("n IS NOT NULL").groupBy("c").agg(F.sum("n").alias("n")).withColumnRenamed("c", "k")
    joined = components(links.where("other IS NOT NULL"), "c", "other").withColumnRenamed("node", "m")
    labelled = classes.join(counts, F.col("c") == F.col("k"), "left").join(joined, F.col("c") == F.col("m"), "left").withColumn("component", F.coalesce("component", "c"))
    labelled = written(labelled.select("v", "first", "component", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "labelled")
    lowest = labelled.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "k")
    labelled = labelled.join(lowest, F.col("component") == F.col("k")).select(F.col("v").alias("own_v"), "n_links", "component_id")
    out = rows.withColumn("at", F.when(F.col("usable"), F.col("v"))).join(labelled, F.col("at") == F.col("own_v"), "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _linked(classes: DataFrame, dim: int, n: int, threshold: float, sample: int) -> DataFrame:
    """classes(c, v, mult) of one length -> rows (c, other, n): n copies linked to c, or n null and an edge of a forest of the links."""
    spark = classes.sparkSession
    few = classes.select(F.xxhash64("v").alias("h"), "c", "v").orderBy("h", "c").limit(sample).collect()
    x = np.array([r["v"] for r in few], float).reshape(-1, dim)
    index = Index(x / np.sqrt((x * x).sum(1))[:, None], n, threshold)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            raw = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)
            if not len(raw):
                continue
            unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
            home, near = ix.lists(unit)
            codes, err = ix.encode(unit, home)
            yield pa.RecordBatch.from_pydict(
                {"c": b.column("c"), "mult": b.column("mult"), "home": pa.array(home.astype(np.int32)), "probes": pa.array([r.tobytes() for r in np.packbits(near, axis=1)], pa.binary()), "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "err": pa.array(err), "raw": pa.array([r.tobytes() for r in raw], pa.binary())}
            )

    placed = written(classes.select("c", "mult", "v").mapInArrow(place, "c long, mult long, home int, probes binary, codes binary, err double, raw binary"), "placed")
    # Lists go in groups, long ones in blocks of entries, against blocks of queries: at most LISTS rows come to the driver for each.
    of, total = index.groups({r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}, ENTRIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups with lists that a vector is looked up in."""
        for b in batches:
            if b.num_rows:
                bits = np.frombuffer(b"".join(b.column("probes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                row, which = np.nonzero(np.unpackbits(bits, axis=1, count=len(of)))
                hit = np.zeros((b.num_rows, len(total)), bool)
                hit[row, of[which]] = True
                ends = np.r_[0, np.cumsum(hit.sum(1))].astype(np.int32)
                yield b.drop_columns(["probes"]).append_column("groups", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(hit)[1].astype(np.int32))))

    wanted = placed.select("probes").mapInArrow(deal, "groups array<int>").select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    shape = [(r["g"], -(-total[r["g"]] // ENTRIES), -(-r["n"] // QUERIES)) for r in wanted.collect()]
    shape = F.broadcast(spark.createDataFrame(shape or [(0, 1, 1)], "group int, eb int, qb int"))
    lists = F.broadcast(spark.createDataFrame([(w, int(g)) for w, g in enumerate(of)], "list int, g int"))
    asked = placed.select("c", "raw", "probes").mapInArrow(deal, "c long, raw binary, groups array<int>").select("c", "raw", F.explode("groups").alias("g"))
    entries = placed.join(lists, F.col("home") == F.col("list")).join(shape, F.col("g") == F.col("group")).withColumn("e", F.pmod(F.xxhash64("c"), F.col("eb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    queries = asked.join(shape, F.col("g") == F.col("group")).withColumn("q", F.pmod(F.xxhash64("c"), F.col("qb")).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("eb") - 1)))
    entries = entries.select("g", "e", "q", "c", "mult", "home", "codes", "err", "raw").groupBy("g", "e", "q")
    queries = queries.select(*[F.col(x).alias(f"q_{x}") for x in ("g", "e", "q", "c", "raw")]).groupBy("q_g", "q_e", "q_q")
    schema = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def meet(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return schema.empty_table()
        ec, em, qc = e.column("c").to_numpy(), e.column("mult").to_numpy(), q.column("q_c").to_numpy()
        cols = {"codes": np.frombuffer(b"".join(e.column("codes").to_pylist()), np.uint8).reshape(e.num_rows, -1), "err": e.column("err").to_numpy(), "home": e.column("home").to_numpy(), "x": _unit(e.column("raw").to_pylist(), dim)}
        n = np.zeros(len(qc), np.int64)
        names, node = np.unique(np.r_[qc, ec], return_inverse=True)
        q_node, e_node = node[: len(qc)], node[len(qc) :]
        root = np.arange(len(names))
        edges: list[tuple[int, int]] = []
        for i, k in shared.value.search(cols, _unit(q.column("q_raw").to_pylist(), dim)):
            other = qc[i] != ec[k]
            i, k = i[other], k[other]
            np.add.at(n, i, em[k])
            by_query = np.argsort(i, kind="stable")
            i, k = i[by_query], e_node[k[by_query]]
            for own_i, near in zip(i[np.r_[True, i[1:] != i[:-1]][: len(i)]].tolist(), np.split(k, np.flatnonzero(i[1:] != i[:-1]) + 1), strict=False):
                a = q_node[own_i]
                labels, at = np.unique(root[near], return_index=True)
                new = labels != root[a]
                if new.any():
                    edges += [(int(names[a]), int(b)) for b in names[near[at[new]]]]
                    root[np.isin(root, labels[new])] = root[a]
        some = np.flatnonzero(n)
        c = np.r_[qc[some], np.array([a for a, _ in edges], np.int64)]
        other = [None] * len(some) + [b for _, b in edges]
        return pa.Table.from_arrays([pa.array(c, pa.int64()), pa.array(other, pa.int64()), pa.array(n[some].tolist() + [None] * len(edges), pa.int64())], schema=schema)

    return entries.cogroup(queries).applyInArrow(meet, "c long, other long, n long")


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
    SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
),
class AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM class LEFT JOIN n USING (vec_id)
"""
