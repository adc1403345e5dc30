"""Operator 1: byte-level BPE by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from ._base import own, table

#: Words encoded by one recursive query, and the sum of their squared lengths: bounds the rows that its rounds hold.
WORDS_PER_QUERY, SQUARES_PER_QUERY = 20_000, 8_000_000
#: Bytes up to which a word is contracted whole; longer ones go in windows of that size, each half over the next.
LONG = 128

#: k is word * 2^36 + position, positions being gapless; a merge moves the rest of its word one place to the left.
_ENCODE = """
WITH RECURSIVE state(it, k, tok) AS (
    SELECT 0, k, tok FROM start
  UNION ALL
    (WITH now AS MATERIALIZED (SELECT it, k, tok FROM state),
    best AS MATERIALIZED (
        SELECT (a.k >> 36) AS w, min((m.merged << 36) | (a.k & 68719476735)) AS b
        FROM now a JOIN now n ON n.k = a.k + 1 JOIN merges m ON m.pair = ((a.tok << 20) | n.tok)
        GROUP BY (a.k >> 36)
    )
    SELECT it + 1, CASE WHEN (k & 68719476735) > (b & 68719476735) THEN k - 1 ELSE k END, CASE WHEN (k & 68719476735) = (b & 68719476735) THEN (b >> 36) ELSE tok END
    FROM now JOIN best ON (now.k >> 36) = best.w
    WHERE (k & 68719476735) <> (b & 68719476735) + 1)
),
last AS (SELECT (k >> 36) AS w, max(it) AS it FROM state GROUP BY (k >> 36))
SELECT w, string_agg(state.tok::VARCHAR, ' ' ORDER BY k) AS ids, string_agg(v.hex, '' ORDER BY k) AS hex
FROM state JOIN last ON last.w = (state.k >> 36) AND last.it = state.it JOIN vocab v ON v.tok = state.tok
GROUP BY w
"""


class Codec:
    """The merge table of a rank file in an in-memory DuckDB database; encodes lists of words, decodes lists of ids.

    A rank file has lines `base64(token bytes) rank`; a pair's rank is the rank of its joined bytes, a word that is
    itself a token is that token, and of pairs with the least rank the leftmost is contracted first.
    """

    def __init__(self, rank_file: str):
        import duckdb

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "preserve_insertion_order": False})
        self.db.execute("SET temp_directory = ''")
        ranks = self.ranks
        splits = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, m = (pa.array(x, pa.int64()) for x in zip(*splits, strict=True))
        self._load("merges", pa.table({"pair": pc.bit_wise_or(pc.shift_left(l, 20), r), "merged": m}))
        self._load("vocab", pa.table({"tok": pa.array(ranks.values(), pa.int64()), "hex": [t.hex() for t in ranks]}))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.size = {m: len(t) for t, m in ranks.items()}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, words: list[str]) -> list[pa.Array]:
        """Per word: its ids as decimal text, their number, and the bytes that the ids decode to."""
        ids: list = [None] * len(words)
        decoded: list = [None] * len(words)
        rest, held = [], 0
        raw = [w.encode() for w in words]
        for i, b in enumerate(raw):
            if (whole := self.ranks.get(b)) is not None:
                ids[i], decoded[i] = str(whole), b
            else:
                rest.append(i)
                held += min(len(b), LONG) ** 2
                if len(rest) >= WORDS_PER_QUERY or held > SQUARES_PER_QUERY:
                    self._contract(rest, raw, ids, decoded)
                    rest, held = [], 0
        if rest:
            self._contract(rest, raw, ids, decoded)
        if whole_words := [i for i, d in enumerate(decoded) if d is raw[i]]:
            for i, b in zip(whole_words, self.decode([[int(ids[i])] for i in whole_words]), strict=True):
                decoded[i] = b
        joined = pa.array(ids, pa.string())
        return [joined, pc.cast(pc.add(pc.count_substring(joined, " "), 1), pa.int64()), pa.array(decoded, pa.binary())]

    def _contract(self, at: list[int], raw: list[bytes], ids: list, decoded: list) -> None:
        short = [i for i in at if len(raw[i]) <= LONG]
        for i, (got, text) in zip(short, self._query([raw[i] for i in short]), strict=True):
            ids[i], decoded[i] = got, text
        for i in at:
            if len(raw[i]) > LONG:
                ids[i], decoded[i] = self._windows(raw[i]) or self._whole(raw[i])

    def _query(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """Ids and decoded bytes of each word, by the recursive query."""
        n = np.array([len(x) for x in words], np.int64)
        return self._contracted(self.byte[np.frombuffer(b"".join(words), np.uint8)], n) if len(n) else []

    def _contracted(self, tok: np.ndarray, n: np.ndarray) -> list[tuple[str, bytes]]:
        w = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
        self._load("start", pa.table({"k": w << 36 | pos, "tok": tok}))
        out: list = [("", b"")] * len(n)
        for k, got, text in self.db.execute(_ENCODE).fetchall():
            out[k] = got, bytes.fromhex(text)
        return out

    def _windows(self, word: bytes) -> tuple[str, bytes] | None:
        """A long word from its windows, contracted all at once; None where two windows share no token.

        Contracting the least-ranked pair first is the same process on any part of a word that no merge crosses the
        ends of.  So tokens that stand next to each other in one window's answer stay two when they are contracted
        alone, and a row of tokens of which all neighbours do so is the answer for the whole: the first merge across
        one of its borders would be a merge of those two alone.  Hence two windows join at a token that both have.
        """
        starts = range(0, len(word) - LONG // 2, LONG // 2)
        windows = [word[i : i + LONG] for i in starts]
        most = SQUARES_PER_QUERY // LONG**2
        encoded = [x for i in range(0, len(windows), most) for x in self._query(windows[i : i + most])]
        out: list[int] = []
        text: list[bytes] = []
        ends: list[int] = []  # where each token of `out` ends
        for begin, (got, _) in zip(starts, encoded, strict=True):
            new = [int(x) for x in got.split(" ")]
            new_ends = (begin + np.cumsum([self.size[x] for x in new])).tolist()
            if out:
                there = dict(zip(new_ends, range(len(new)), strict=True))
                meet = len(out) - 1
                while meet >= 0 and ends[meet] > begin and not (ends[meet] in there and out[meet] == new[there[ends[meet]]]):
                    meet -= 1
                if meet < 0 or ends[meet] <= begin:
                    return None
                k = there[ends[meet]]
                del out[meet + 1 :], ends[meet + 1 :]
                new, new_ends = new[k + 1 :], new_ends[k + 1 :]
            out += new
            ends += new_ends
        for group in range(0, len(out), WORDS_PER_QUERY):
            text += self.decode([out[group : group + WORDS_PER_QUERY]])
        return " ".join(map(str, out)), b"".join(text)

    def _whole(self, word: bytes) -> tuple[str, bytes]:
        """A long word in one piece, for words whose windows do not meet, such as long repeats of a few characters."""
        tok = self._shortened(self.byte[np.frombuffer(word, np.uint8)])
        return self._contracted(tok, np.array([len(tok)]))[0]

    def _shortened(self, tok: np.ndarray) -> np.ndarray:
        """Contracts all leftmost pairs of the least rank at once, as long as that cannot change the order of merges.

        It stops, and leaves the rest to the recursive query, when a merge would make a pair of a lower rank.
        """
        find = "SELECT m.merged FROM pairs p LEFT JOIN merges m ON m.pair = ((p.l << 20) | p.r) ORDER BY p.i"
        while len(tok) > 4 * LONG:
            self._load("pairs", pa.table({"i": np.arange(len(tok) - 1), "l": tok[:-1], "r": tok[1:]}))
            rank = self.db.execute(find).fetchnumpy()["merged"]
            rank = np.ma.filled(rank.astype(float), np.inf) if np.ma.isMaskedArray(rank) else rank.astype(float)
            if not np.isfinite(best := rank.min()):
                return tok
            hit = rank == best
            start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])  # of each run of overlapping pairs, every second one
            run = np.arange(len(hit)) - np.repeat(start, np.diff(np.r_[start, len(hit)])) if start[0] == 0 else np.r_[np.zeros(start[0], int), np.arange(start[0], len(hit)) - np.repeat(start, np.diff(np.r_[start, len(hit)]))]
            take = hit & (run % 2 == 0)
            new = tok.copy()
            new[:-1][take] = int(best)
            new = np.delete(new, np.flatnonzero(take) + 1)
            near = np.flatnonzero(new == int(best))
            pairs = np.unique(np.concatenate([np.c_[new[near[near > 0] - 1], new[near[near > 0]]], np.c_[new[near[near < len(new) - 1]], new[near[near < len(new) - 1] + 1]]]), axis=0)
            self._load("pairs", pa.table({"i": np.arange(len(pairs)), "l": pairs[:, 0], "r": pairs[:, 1]}))
            made = [x for (x,) in self.db.execute(find).fetchall() if x is not None]
            if made and min(made) <= best:
                return tok
            tok = new
        return tok

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation over token-position rows."""
        n = np.array([len(x) for x in ids], int)
        if not n.sum():
            return [b""] * len(ids)
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(n.sum()))
        self._load("given_ids", pa.table({"w": np.repeat(np.arange(len(ids)), n), "pos": np.arange(len(flat)), "tok": flat}))
        out = [b""] * len(ids)
        for w, text in self.db.execute("SELECT w, string_agg(hex, '' ORDER BY pos) FROM given_ids JOIN vocab USING (tok) GROUP BY w").fetchall():
            out[w] = bytes.fromhex(text)
        return out


def _lexicon(rank_file: str) -> W.Lexicon:
    return W.active(("bpe", rank_file), lambda: W.Lexicon(Codec(rank_file).encode))


def slices(batches: Iterator[pa.RecordBatch], most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` words at most (a longer text stays whole)."""
    for batch in batches:
        ends = batch.column("words").offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Encodes each whole text and decodes it again.

    Returns key, n_tokens, ids (decimal ids joined by one space, if with_ids), decoded (the bytes that they decode to,
    if with_ids), ids_sha256 and decoded_sha256.  A null or empty text has no ids.  Other columns are ignored; a key
    may repeat or be null: there is one row out for each row in.  The model is read from rank_file on each worker.
    """
    source = own(df, key=key, text=text)
    rows = source.select("key", W.pretokens(source["text"], pattern).alias("words"))
    kind = dict(source.dtypes)["key"]
    extra = ", ids string, decoded binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(rank_file)
        for batch in slices(batches):
            lists = batch.column("words")
            (ids, n, raw), at = lexicon.rows(lists.flatten())
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int32)
            each = lambda values: pa.ListArray.from_arrays(pa.array(ends), pc.take(values, at))  # noqa: B023, E731
            total = np.r_[0, np.cumsum(pc.take(n, at).to_numpy(zero_copy_only=False))] if len(at) else np.zeros(1, np.int64)
            joined = pc.binary_join(each(ids), " ")
            decoded = pc.binary_join(each(raw), b"")
            digest = lambda col: pa.array([hashlib.sha256(memoryview(x.as_buffer() or b"")).hexdigest() for x in col], pa.string())
            out = {"key": batch.column("key"), "n_tokens": pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), "ids_sha256": digest(joined), "decoded_sha256": digest(decoded)}
            if with_ids:
                out |= {"ids": joined, "decoded": decoded}
            yield pa.RecordBatch.from_pydict(out)

    W.small_batches(df.sparkSession)
    return rows.mapInArrow(W.lean(run), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("key", key)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False)
