"""Operator 5: repeated byte strings by distributed prefix doubling.

Every position gets a name for the string of h bytes that starts there; the name for 2h bytes is made of the pair of
names at the position and h further on.  Names of 1 to 8 bytes are the bytes themselves, longer ones 64-bit hashes of
pairs, so that equal strings have equal names on every executor without a shared rank table (two different strings
share one with a chance of 2^-64).  Spark deals positions out by name and sorts them at two lengths:

1. at BASE bytes, only the minimal name of each window of `length` bytes is dealt out.  A string that repeats has the
   same minimal name at both places, so windows whose minimal name is unique among the texts are done;
2. at `length` bytes, all windows that are left are dealt out by their minimal name, a run of neighbours as the text
   that it covers, and sorted by name; whoever holds a name and is not in the smallest document marks its position.

Positions travel in packed blocks of numbers.  What a task can settle on its own it does not deal out: of a string
that many documents of one task share, a single record goes on, so that frequent strings make no large bucket.

Names only propose.  Before a position is marked, its bytes are compared with those of the first holder of its name, and
a document is known by its key and the hash of its text, not by a hash of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._base import own, salt, salts_of, salts_seen, table, written

LENGTH, BASE = 50, 16
#: Bytes of text that a bucket of documents holds on average, and that are named at once.
BUCKET_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
_LAST = np.iinfo(np.int64).max


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def doubled(data: np.ndarray, length: int, at: np.ndarray | None = None, h: int = 1) -> tuple[np.ndarray, int]:
    """Names of the strings of `length` bytes that start at each position, doubling from names `at` of h bytes."""
    x = data.astype(np.uint64) if at is None else at
    while h < length:
        step = min(h, length - h)  # the last pair may overlap
        a, b = x[: max(len(x) - step, 0)], x[step:]
        x = (a << np.uint64(8 * h)) | b if 2 * h <= 8 and step == h else _pair(a, b)
        h += step
    return x, h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: max(len(x) - step, 0)], x[step:])
        have += step
    return x


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _pack(columns: dict[str, np.ndarray | None], to: np.ndarray, name: str, extra: dict) -> Iterator[pa.RecordBatch]:
    """A row for each value of `to`, with the other columns packed as bytes (none of a column that is None)."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    if not len(to):
        return
    start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    ends = np.r_[start[1:], len(to)]
    out = {name: pa.array(to[start].astype(np.int32))}
    out |= {k: pa.array(np.full(len(start), v, np.int32)) for k, v in extra.items()}
    for k, v in columns.items():
        raw, w = (b"", 0) if v is None else (v[order].tobytes(), v.dtype.itemsize)
        out[k] = pa.array([raw[w * a : w * b] for a, b in zip(start, ends, strict=True)], pa.binary())
    yield pa.RecordBatch.from_pydict(out)


def _runs(doc: np.ndarray, pos: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring positions of one document (and one minimal name): document, start, length, place."""
    if not len(doc):
        return doc, pos.astype(np.int64), pos.astype(np.int64), np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    if low is not None:
        new |= low[1:] != low[:-1]
    head = np.flatnonzero(np.r_[True, new])
    return doc[head], pos[head].astype(np.int64), np.diff(np.r_[head, len(doc)]).astype(np.int64), head


def _not_first(name: np.ndarray, order: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether a smaller document holds the same string of `length` bytes; `at` is where in `data` each string begins.

    Equal strings have equal names.  A string whose name a smaller document holds is compared with that holder's bytes;
    should they differ, the strings of that name are told apart by their bytes.
    """
    by = np.lexsort((order, name))
    n, o = name[by], order[by]
    new = np.r_[True, n[1:] != n[:-1]]
    head = by[new][np.cumsum(new) - 1]
    out = np.zeros(len(name), bool)
    later = o > order[head]
    mine, theirs = by[later], head[later]
    out[mine] = True
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for lo in range(0, len(mine), 1 << 16):
        a, b = mine[lo : lo + (1 << 16)], theirs[lo : lo + (1 << 16)]
        for x in np.unique(name[a[(view[at[a]] != view[at[b]]).any(1)]]):  # two strings of one name
            least: dict[bytes, int] = {}
            same = np.flatnonzero(name == x)
            for i in same:
                k = view[at[i]].tobytes()
                least[k] = min(least.get(k, _LAST), int(order[i]))
            out[same] = [order[i] > least[view[at[i]].tobytes()] for i in same]
    return out


def _local(order: np.ndarray, fp: np.ndarray) -> np.uint64:
    """A seed for which `_mixed` gives different documents of one task different numbers."""
    pairs = len(set(zip(order.tolist(), fp.tolist(), strict=True)))
    seed = np.uint64(0)
    while len(np.unique(_mixed(order, fp, seed))) != pairs:
        seed += np.uint64(1)
    return seed


def _mixed(order: np.ndarray, fp: np.ndarray, seed: np.uint64) -> np.ndarray:
    return _pair(order.view(np.uint64) ^ seed, fp.view(np.uint64)).view(np.int64)


def _db(order: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
    return (order ^ fp) % buckets  # as pmod does


def _unpack(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in t.column(name).to_pylist()), kind)


def repeats(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes from each text every byte covered by a string of `length` bytes that also starts in a row of a smaller key.

    One row per input row: key, the columns of `carry`, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, if with_text, kept (the remaining bytes) and rest (these as text, without characters cut in two).  Strings are judged on the input as UTF-8 bytes and never cross rows.  Null text counts as
    empty; texts shorter than `length` stay whole; a null key counts as larger than any other; rows of one key leave
    each other alone, equal rows get equal answers.  Keys must be whole numbers.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    more = {f"carry{i}": c for i, c in enumerate(carry)}
    rows = own(df, key=key, text=text, **more)
    kinds = dict(rows.dtypes)
    docs = rows.select(F.col("key"), *more, F.coalesce(F.col("key").cast("long"), F.lit(int(_LAST))).alias("ord"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    docs = docs.withColumn("fp", F.xxhash64("data"))
    # Whole copies: the first row of equal texts stands for all of them; the rows of a large group meet it in parts.
    postings = docs.select("ord", F.unhex(F.sha2("data", 256)).alias("sha"), "fp", F.octet_length("data").alias("size"), salt("ord").alias("salt"))
    postings = written(postings, "postings")
    total = postings.agg(F.sum("size")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    firsts = postings.groupBy("sha").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), salts_seen().alias("salts")).where("low < high")
    firsts = firsts.select(F.col("sha").alias("k"), salts_of("salts").alias("k_salt"), "low")
    copies = postings.join(firsts, (F.col("sha") == F.col("k")) & (F.col("salt") == F.col("k_salt"))).where("ord > low").select("ord", "fp").distinct()
    db = F.pmod(F.col("ord").bitwiseXOR(F.col("fp")), F.lit(buckets)).cast("int")

    def packed(c: str):  # little-endian
        hexed = F.lpad(F.hex(c), 16, "0")
        return F.unhex(F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])).alias(c)

    copies = written(copies.select(db.alias("db"), packed("ord"), packed("fp"), F.lit(None).cast("binary").alias("h")), "copies")
    docs = docs.withColumn("db", db)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").to_pylist()
            fp, first = (batch.column(c).to_numpy() for c in ("fp", "ord"))
            sizes = np.array([len(x) for x in data], np.int64)
            hs, docs_at = [], []
            for lo, hi in _cut(sizes, SLICE_BYTES):
                base, _ = doubled(np.frombuffer(b"".join(data[lo:hi]), np.uint8), BASE)
                low = sliding_min(base, length - BASE + 1)
                starts = np.r_[0, np.cumsum(sizes[lo:hi])]
                doc = np.repeat(np.arange(lo, hi), sizes[lo:hi])[: len(low)]
                inside = np.arange(len(low)) + length <= starts[doc - lo + 1]
                new = inside & np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]] if len(low) else inside
                hs.append(low[new])
                docs_at.append(doc[new])
            if not hs:
                continue
            h, at = np.concatenate(hs), np.concatenate(docs_at)
            order = np.lexsort((first[at], fp[at], h))
            h, at = h[order], at[order]
            if not len(h):
                continue
            new_h = np.r_[True, h[1:] != h[:-1]]
            one = np.r_[True, new_h[1:] | (fp[at][1:] != fp[at][:-1])]  # the first document of each text
            h, at, new_h = h[one], at[one], new_h[one]
            group = np.cumsum(new_h) - 1
            shared = np.bincount(group)[group] > 1
            order = np.argsort(at, kind="stable")  # by document: what repeats packs well
            h, at, new_h, shared = h[order], at[order], new_h[order], shared[order]
            ids = lambda m: {"h": h[m], "fp": fp[at][m], "ord": first[at][m]}  # noqa: B023, E731
            deal = lambda x: (x >> np.uint64(40)).astype(np.int64) % buckets
            yield from _pack(ids(~shared), deal(h[~shared]), "bucket", {"kind": 0})
            yield from _pack(ids(shared), _db(first[at][shared], fp[at][shared], buckets), "bucket", {"kind": 1})
            several = h[shared & new_h]
            yield from _pack({"h": several, "fp": None, "ord": None}, deal(several), "bucket", {"kind": 2})

    schema_of_db = pa.schema([("db", pa.int32()), ("ord", pa.binary()), ("fp", pa.binary()), ("h", pa.binary())])

    def by_db(order: np.ndarray, fp: np.ndarray, h: np.ndarray) -> pa.Table:
        out = _pack({"ord": order, "fp": fp, "h": h}, _db(order, fp, buckets), "db", {})
        return pa.Table.from_batches([b.select(schema_of_db.names) for b in out], schema_of_db)

    def of_kind(t: pa.Table, kind: int) -> pa.Table:
        return t.filter(pa.compute.equal(t.column("kind"), kind))

    def settle(t: pa.Table) -> pa.Table:
        known, several, t = of_kind(t, 1), of_kind(t, 2), of_kind(t, 0)
        h, fp, first = _unpack(t, "h", "<u8"), _unpack(t, "fp", "<i8"), _unpack(t, "ord", "<i8")
        order = np.lexsort((fp, h))
        h, fp, first = h[order], fp[order], first[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        differs = np.r_[False, (fp[1:] != fp[:-1]) & ~new[1:]] if len(h) else new
        group = np.cumsum(new) - 1
        many = np.isin(h, _unpack(several, "h", "<u8"))
        if len(h):
            many |= (np.bincount(group, differs) > 0)[group]
        both = lambda mine, name, kind: np.r_[mine[many], _unpack(known, name, kind)]
        return by_db(both(first, "ord", "<i8"), both(fp, "fp", "<i8"), both(h, "h", "<u8"))

    def left_copies(right: pa.Table, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, set]:
        """Documents by their local numbers: of each packed value, the values, and the whole copies."""
        alone = pa.compute.is_null(right.column("h"))
        numbers = lambda t: _mixed(_unpack(t, "ord", "<i8"), _unpack(t, "fp", "<i8"), seed)
        gone = set(numbers(right.filter(alone)).tolist())
        right = right.filter(pa.compute.invert(alone))
        return numbers(right), _unpack(right, "h", "<i8"), gone

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        first, fp, data = left.column("ord").to_numpy(), left.column("fp").to_numpy(), left.column("data").to_pylist()
        rid = _mixed(first, fp, seed := _local(first, fp))
        s_rid, s_h, gone = left_copies(right, seed)
        s_h = s_h.view(np.uint64)
        order = np.lexsort((s_h, s_rid))
        s_rid, s_h = s_rid[order], s_h[order]
        _, once = np.unique(rid, return_index=True)
        lo_at, hi_at = np.searchsorted(s_rid, rid, "left"), np.searchsorted(s_rid, rid, "right")
        use = [i for i in once if hi_at[i] > lo_at[i] and rid[i] not in gone]
        sizes = np.array([len(data[i]) for i in use], np.int64)
        names, whose, where, lows, begins = [], [], [], [], []
        whole = np.frombuffer(b"".join(data[i] for i in use), np.uint8)
        begin = np.cumsum(sizes) - sizes
        for lo, hi in _cut(sizes, SLICE_BYTES):
            base, h = doubled(np.frombuffer(b"".join(data[i] for i in use[lo:hi]), np.uint8), BASE)
            low = sliding_min(base, length - BASE + 1)
            name, _ = doubled(base, length, base, h)
            at = 0
            for k in range(lo, hi):
                i, n = use[k], sizes[k]
                own_h = s_h[lo_at[i] : hi_at[i]]
                mine = low[at : at + n - length + 1]
                hit = np.flatnonzero(own_h[np.minimum(np.searchsorted(own_h, mine), len(own_h) - 1)] == mine)
                names.append(name[at + hit])
                lows.append(mine[hit])
                whose.append(np.full(len(hit), i))
                where.append(hit)
                begins.append(begin[k] + hit)
                at += n
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ord", pa.binary()), ("fp", pa.binary()), ("run", pa.binary()), ("data", pa.binary())])
        if not names or not sum(map(len, names)):
            return schema.empty_table()
        name, low, doc, pos = np.concatenate(names), np.concatenate(lows), np.concatenate(whose), np.concatenate(where)
        repeat = _not_first(name, first[doc], whole, np.concatenate(begins), length)
        out = []
        d, start, size, _ = _runs(doc[repeat], pos[repeat])
        out += _pack({"ord": first[d], "fp": fp[d], "run": start << 32 | size, "data": None}, _db(first[d], fp[d], buckets), "bucket", {"kind": 1})
        # Of what is first here, the text itself goes on, from the run's first byte to its last window's end.
        d, start, size, at = _runs(doc[~repeat], pos[~repeat], low[~repeat])
        to = (low[~repeat][at] >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(to, kind="stable")
        d, start, size, to = d[order], start[order], size[order], to[order]
        if len(d):
            text = [data[i][p : p + n + length - 1] for i, p, n in zip(d.tolist(), start.tolist(), size.tolist(), strict=True)]
            (dealt,) = _pack({"ord": first[d], "fp": fp[d], "run": start << 32 | size}, to, "bucket", {"kind": 0})
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            out.append(dealt.append_column("data", pa.array([b"".join(text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())))
        return pa.Table.from_batches([b.select(schema.names) for b in out], schema)

    def mark(t: pa.Table) -> pa.Table:
        known, t = of_kind(t, 1), of_kind(t, 0)
        first, fp, run = _unpack(t, "ord", "<i8"), _unpack(t, "fp", "<i8"), _unpack(t, "run", "<i8")
        w_first, w_fp, w_run = _unpack(known, "ord", "<i8"), _unpack(known, "fp", "<i8"), _unpack(known, "run", "<i8")
        if len(run):
            start, size = run >> 32, run & 0xFFFFFFFF
            data = _unpack(t, "data", np.uint8)
            names, _ = doubled(data, length)
            i = np.repeat(np.arange(len(run)), size)
            step = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            offset = np.cumsum(size + length - 1) - (size + length - 1)
            repeat = _not_first(names[offset[i] + step], first[i], data, offset[i] + step, length)
            i, pos = i[repeat], start[i[repeat]] + step[repeat]
            order = np.lexsort((pos, fp[i], first[i]))
            i, pos = i[order], pos[order]
            ids = np.cumsum(np.r_[0, (first[i[1:]] != first[i[:-1]]) | (fp[i[1:]] != fp[i[:-1]])]) if len(i) else i
            _, start, size, head = _runs(ids, pos)
            w_first, w_fp, w_run = np.r_[w_first, first[i[head]]], np.r_[w_fp, fp[i[head]]], np.r_[w_run, start << 32 | size]
        return by_db(w_first, w_fp, w_run)

    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "rest"] * with_text

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        first, fp = left.column("ord").to_numpy(), left.column("fp").to_numpy()
        rid = _mixed(first, fp, seed := _local(first, fp))
        m_rid, m_run, gone = left_copies(right, seed)
        order = np.lexsort((m_run, m_rid))
        m_rid, m_run = m_rid[order], m_run[order]
        lo, hi = np.searchsorted(m_rid, rid, "left"), np.searchsorted(m_rid, rid, "right")
        out: list[list] = [[] for _ in names]
        for i, x in enumerate(left.column("data").to_pylist()):
            n = len(x)
            a = m_run[lo[i] : hi[i]] >> 32
            b = np.maximum.accumulate(a + (m_run[lo[i] : hi[i]] & 0xFFFFFFFF) + length - 1)
            if rid[i] in gone and n >= length:
                spans = [(0, n)]
            elif len(a):
                head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                spans = list(zip(a[head].tolist(), b[np.r_[head[1:] - 1, len(b) - 1]].tolist(), strict=True))
            else:
                spans = []
            left_over, at = [], 0
            for a, b in spans:
                left_over.append(x[at:a])
                at = b
            kept = b"".join([*left_over, x[at:]])
            for column, v in zip(out, (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")), strict=False):
                column.append(v)
        kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        made = [pa.array(v, t) for v, t in zip(out, kinds_of, strict=False)][: len(names) - 1]
        return pa.Table.from_arrays([left.column("key"), *(left.column(c) for c in more), *made], names=["key", *more, *names[1:]])

    found = docs.select("fp", "ord", "data").mapInArrow(W.lean(minima), "bucket int, kind int, h binary, fp binary, ord binary")
    survivors = found.groupBy("bucket").applyInArrow(lambda t: W.released(settle(t)), "db int, ord binary, fp binary, h binary")
    by_doc = docs.select("db", "key", *more, "fp", "ord", "data").groupBy("db")
    dealt = by_doc.cogroup(survivors.unionByName(copies).groupBy("db")).applyInArrow(lambda left, right: W.released(windows(left, right)), "bucket int, kind int, ord binary, fp binary, run binary, data binary")
    marked = dealt.groupBy("bucket").applyInArrow(lambda t: W.released(mark(t)), "db int, ord binary, fp binary, h binary")
    out = by_doc.cogroup(marked.unionByName(copies).groupBy("db")).applyInArrow(
        lambda left, right: W.released(remove(left, right)), f"key {kinds['key']}, " + "".join(f"{c} {kinds[c]}, " for c in more) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, rest string" * with_text
    )
    return out.select(F.col("key").alias(key), *[F.col(c).alias(old) for c, old in more.items()], *names[1:])


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), with_text=False)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, unnest(range(0, greatest(n - 49, 0))) AS p, x FROM d),
s AS (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM g),
low AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s),
hit AS (SELECT s.doc_id, s.p FROM s JOIN low USING (s) WHERE low.low < s.doc_id),
step AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM hit),
run AS (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM step),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM span
        UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
num AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.k, x))) AS kept_sha256
FROM d LEFT JOIN num USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
