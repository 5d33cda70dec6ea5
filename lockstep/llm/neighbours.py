"""Operator 4, approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations (random signs and a fast Hadamard transform, three times) and belongs to the signed axis it
is nearest to: one bucket in each of ``tables`` tables. A query probes its nearest axes, a fixed share of them, in every table; what it
meets is ranked by the exact inner product, so a score is exact and only membership is approximate.

The share is chosen by the data: a bounded sample of queries (``SAMPLE``) is answered exactly, by comparison with all vectors in blocks, and the smallest
share of ``SHARES`` is taken under which the sample's true neighbours would have been met with the recall aimed at. Clustered vectors need few
axes; random directions need many, as their nearest are hardly nearer than others, with any hashing.

Nearness is the inner product, and hashing is by angle. So vectors are hashed in bands of similar norm (powers of two), with one more
coordinate that gives all of a band one norm, unless they have it; then the larger inner product is the smaller angle. Equal vectors are
one class, known by its 21 smallest ids, so a vector that a third of all rows share costs one entry. Repeated rows (one id, one vector) are counted, and each is a
candidate: an id stands in an answer as often as its row is there, and a query meets the other rows of its id, only not its own.

Entries and queries of a bucket are sorted to one task and streamed: it holds the queries of one bucket and a block of vectors, whatever the bucket's size.
A bucket of over ``PART_ROWS`` entries is split into parts, and its queries are sent to each; one of over ``PART_QUERIES`` queries likewise. So a query is sent
``tables * share * 2 * width`` times, in proportion to the number of queries, until buckets pass that size. A first search in ``scouts``
tables gives each query a score that its answer reaches in any case; the search in all tables returns only what reaches it. Where a query has met
fewer classes than it asks for, all its buckets of one table are searched, which is exact.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null vec_id take no part; a repeated
row is a candidate each time, and as a query is answered once; only vectors of one length are compared; of rows with one vec_id and other vectors each is a row; equal scores are ordered
by vec_id, in every cut; norms may be as large or small as a double (inner products that overflow are infinite); other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.sources.shared import written

PART_ROWS, PART_QUERIES = 1 << 18, 1 << 14
BROADCAST_ROWS = 100_000
SAMPLE, SHARES, AIM = 128, (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2), 0.95
MET = "query long, cid long, least long, score double"


def rows_of_vectors(df: DataFrame) -> DataFrame:
    """``vec_id, vec, cid`` (the class) of the rows that take part, and ``times``: how often a row is there."""
    kind = "float" if dict(df.dtypes)["embedding"] == "array<float>" else "double"  # floats travel as they are, and are counted with as doubles
    vec = F.col("embedding").cast(f"array<{kind}>")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vec, lambda x: x + F.lit(0.0).cast(kind)).alias("vec"))
    return plain.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & usable).withColumn("cid", F.xxhash64("vec")).groupBy("vec_id", "vec", "cid").agg(F.count("*").alias("times"))


@lru_cache(maxsize=64)
def _signs(width: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int, tables: int, seed: int) -> np.ndarray:
    for signs in _signs(x.shape[1], tables, seed)[table]:
        x = hadamard(x * signs)
    return x


def _widened(x: np.ndarray, last: np.ndarray | None) -> np.ndarray:
    """Rows with one more coordinate, or none, and zeros up to a power of two."""
    own = x if last is None else np.column_stack([x, last])
    width = 1 << max(1, own.shape[1] - 1).bit_length()
    return np.pad(own, ((0, 0), (0, width - own.shape[1])))


def bucket_name(band: int, table: int, axis: np.ndarray) -> np.ndarray:
    return ((band + 2048) << 40) + (table << 32) + axis


def _norms(x: np.ndarray) -> np.ndarray:
    """The norm of each row, without overflow on the way."""
    most = np.abs(x).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def bands_of(vectors: DataFrame) -> dict[int, dict[int, tuple[float, bool]]]:
    """By length and band: the largest norm, and whether norms are unlike. At most some two thousand bands a length exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _stacked(batch, "vec"):
                norm = _norms(x)
                band = _bands(norm)
                for b in np.unique(band):
                    at = norm[band == b]
                    yield pa.RecordBatch.from_pydict({"d": pa.array([x.shape[1]], pa.int32()), "band": pa.array([int(b)], pa.int32()), "top": [float(at.max())], "low": [float(at.min())]})

    found = vectors.select("vec").mapInArrow(run, "d int, band int, top double, low double").groupBy("d", "band").agg(F.max("top").alias("top"), F.min("low").alias("low")).collect()
    out: dict[int, dict[int, tuple[float, bool]]] = {}
    for r in found:
        out.setdefault(r["d"], {})[r["band"]] = (r["top"], r["low"] < 0.99 * r["top"])
    return out


def _bands(norm: np.ndarray) -> np.ndarray:
    """The power of two of each norm; one whose norm is beyond a double is in the last band."""
    return np.round(np.log2(np.clip(norm, 5e-324, np.finfo(float).max))).astype(np.int64)


def _stacked(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows' numbers and their vectors, by vector length."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)].astype(np.float64)


def _entries(x: np.ndarray, own: dict, tables: int, seed: int, used: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows' numbers and their bucket, table by table and band by band."""
    norm = _norms(x)
    band = _bands(norm)
    for b, (top, unlike) in own.items():
        at = np.flatnonzero(band == b)
        if not len(at):
            continue
        y = x[at] / min(top, np.finfo(float).max)
        wide = _widened(y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1))) if unlike else None)
        for t in range(used):
            z = turned(wide, t, tables, seed)
            axis = np.abs(z).argmax(1)
            yield at, bucket_name(b, t, 2 * axis + (z[np.arange(len(z)), axis] < 0))


def _probes(x: np.ndarray, own: dict, tables: int, seed: int, used: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows' numbers, repeated, and the buckets they probe."""
    q = _unit(x)
    for b, (_, unlike) in own.items():
        wide = _widened(q, np.zeros(len(q)) if unlike else None)
        most = max(1, round(share * 2 * wide.shape[1]))
        for t in range(used):
            z = turned(wide, t, tables, seed)
            axes = np.argpartition(-np.stack([z, -z], 2).reshape(len(z), -1), most - 1, axis=1)[:, :most]
            yield np.repeat(np.arange(len(x)), most), bucket_name(b, t, axes.ravel())


def index_entries(classes: DataFrame, bands: dict, tables: int, used: int, seed: int) -> DataFrame:
    """``bucket, d, cid, least, vec``: each class once in each of the first ``used`` tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _stacked(batch, "vec"):
                for at, bucket in _entries(x, bands.get(x.shape[1], {}), tables, seed, used):
                    taken = batch.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(at), x.shape[1], np.int32)), *taken.columns], names=["bucket", "d", "cid", "least", "vec"])

    return classes.select("cid", "least", "vec").mapInArrow(run, f"bucket long, d int, cid long, least long, vec {dict(classes.dtypes)['vec']}")


def probe_entries(queries: DataFrame, bands: dict, tables: int, used: int, share: float, seed: int) -> DataFrame:
    """``bucket, d, cid, bound, vec``: each query once for every bucket it probes in the first ``used`` tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _stacked(batch, "vec"):
                for at, bucket in _probes(x, bands.get(x.shape[1], {}), tables, seed, used, share):
                    taken = batch.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(at), x.shape[1], np.int32)), *taken.columns], names=["bucket", "d", "cid", "bound", "vec"])

    return queries.select("cid", "bound", "vec").mapInArrow(run, f"bucket long, d int, cid long, bound double, vec {dict(queries.dtypes)['vec']}")


class _Asking:
    """The queries of one part of a bucket, and the best ``most`` classes that each has met there."""

    def __init__(self, names: np.ndarray, bounds: np.ndarray, x: np.ndarray, most: int):
        self.names, self.floor, self.x, self.most = names, bounds.copy(), x, most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def meet(self, x: np.ndarray, cids: np.ndarray, least: np.ndarray) -> None:
        for a in range(0, len(self.x), 512):
            q = self.x[a : a + 512]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = q @ x.T
                floor = self.floor[a : a + 512, None]
                row, col = np.nonzero(~(rough < floor - 1e-9 * (1 + np.abs(floor))))
            for c in range(0, len(row), 1 << 17):
                i, j = row[c : c + (1 << 17)], col[c : c + (1 << 17)]
                # row by row in one order of summing, so that a class has one score wherever it is met
                score = scores(q[i], x[j])
                good = score >= self.floor[a + i]
                self.held.append((a + i[good], score[good], least[j[good]], cids[j[good]]))
                self.n += int(good.sum())
                if self.n > 2 * self.most * len(self.x) + (1 << 17):
                    self.cut()

    def cut(self) -> None:
        row, score, least, cid = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((least, -score, row))
        row, score, least, cid = row[order], score[order], least[order], cid[order]
        start = np.searchsorted(row, np.arange(len(self.x)))
        keep = np.arange(len(row)) - start[row] < self.most
        self.held = [(row[keep], score[keep], least[keep], cid[keep])]
        self.n = int(keep.sum())
        last = np.flatnonzero(np.arange(len(row)) - start[row] == self.most - 1)
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])

    def result(self) -> pa.RecordBatch:
        if self.held:
            self.cut()
            row, score, least, cid = self.held[0]
        else:
            row, score, least, cid = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.names[row]), pa.array(cid), pa.array(least), pa.array(score)], names=["query", "cid", "least", "score"])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order; -inf where infinities cancel."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (q * x).sum(1)
    return np.where(np.isnan(s), -np.inf, s)


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by part, queries before entries."""
    part, waiting, asking = None, [], None

    def opened() -> _Asking | None:
        if not waiting:
            return None
        names, bounds, vecs = (np.concatenate(c) for c in zip(*waiting, strict=True))
        return _Asking(names, bounds, vecs, most)

    for batch in batches:
        parts, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        borders = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *borders], [*borders, len(parts)]):
            if a == b:
                continue
            if parts[a] != part:
                if asking:
                    yield asking.result()
                part, waiting, asking = parts[a], [], None
            piece = batch.slice(a, b - a)
            ((_, x),) = _stacked(piece, "vec")  # a part is of one length
            if asks[a]:
                waiting.append((piece.column("cid").to_numpy(), piece.column("bound").to_numpy(), x))
                continue
            asking = asking or opened()
            if asking:
                for k in range(0, len(x), 4096):
                    asking.meet(x[k : k + 4096], piece.column("cid").to_numpy()[k : k + 4096], piece.column("least").to_numpy()[k : k + 4096])
    if asking:
        yield asking.result()


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is found to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _search(classes: DataFrame, asking: DataFrame, bands: dict, tables: int, used: int, share: float, most: int, seed: int, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """``query, cid, least, score``: what the queries (``cid, vec, bound``) meet in the first ``used`` tables and what reaches their bound."""
    entries, probes = index_entries(classes, bands, tables, used, seed), probe_entries(asking, bands, tables, used, share, seed)
    # one row for each bucket: tables times axes times bands
    own, ask = (df.groupBy("bucket", "d").agg(F.ceil(F.count("*") / size).cast("int").alias(name)) for df, size, name in ((entries, part_rows, "own"), (probes, part_queries, "ask")))
    split = written(own.join(ask, ["bucket", "d"]).filter("own > 1 or ask > 1"), "split")
    parts = _small(split)
    salt = lambda n: F.pmod(F.xxhash64("cid"), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    key = F.xxhash64("bucket", "d", F.col("own_salt").cast("int"), F.col("ask_salt").cast("int"))
    held = entries.join(parts, ["bucket", "d"], "left").withColumn("own_salt", salt(F.col("own"))).withColumn("ask_salt", every(F.col("ask")))
    asked = probes.join(parts, ["bucket", "d"], "left").withColumn("ask_salt", salt(F.col("ask"))).withColumn("own_salt", every(F.col("own")))
    both = held.select(key.alias("part"), F.lit(False).alias("asks"), "cid", "least", F.lit(None).cast("double").alias("bound"), "vec").unionByName(
        asked.select(key.alias("part"), F.lit(True).alias("asks"), "cid", F.lit(None).cast("long").alias("least"), "bound", "vec")
    )
    return both.repartition("part").sortWithinPartitions("part", F.desc("asks")).mapInArrow(lambda batches: _met(batches, most), MET)


def _exact(classes: DataFrame, sample: dict[int, np.ndarray], most: int) -> DataFrame:
    """``query, cid, least, score, vec``: the best classes of a few vectors (by class), from a comparison with all, block by block."""
    names = np.array(list(sample), np.int64)
    kind = dict(classes.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _stacked(batch, "vec"):
                for name in names.tolist():
                    q = sample[name]
                    if len(q) != x.shape[1]:
                        continue
                    s = scores(np.broadcast_to(q, x.shape), x)
                    best = np.argsort(-s, kind="stable")[:most]
                    taken = batch.take(pa.array(rows[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), name)), *taken.select(["cid", "least"]).columns, pa.array(s[best]), taken.column("vec")], names=["query", "cid", "least", "score", "vec"])

    best = classes.select("cid", "least", "vec").mapInArrow(run, MET + f", vec {kind}")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    return best.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= most).drop("r")


def chosen_share(classes: DataFrame, asking: DataFrame, bands: dict, tables: int, top: int, seed: int, aim: float = AIM) -> tuple[float, float]:
    """The smallest share of ``SHARES`` under which a sample of the queries would meet their true neighbours, and the recall that it would have. Where none
    reaches ``aim``, the share is 1: the search is exact then."""
    picked = asking.select("cid", "vec").distinct().orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    sample = {r["cid"]: np.array(r["vec"], np.float64) for r in picked}
    true = [r for r in _exact(classes, sample, top + 1).collect() if r["cid"] != r["query"]]  # at most SAMPLE * (top + 1)
    if not true:
        return SHARES[0], 1.0
    least = np.ones(len(true))  # the share that would meet each true neighbour
    sizes = np.array([len(r["vec"]) for r in true])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x, q = (np.array([v(true[i]) for i in rows], np.float64) for v in (lambda r: r["vec"], lambda r: sample[r["query"]]))
        for at, bucket in _entries(x, bands[d], tables, seed, tables):
            band, table = (int(bucket[0]) >> 40) - 2048, int(bucket[0]) >> 32 & 255
            wide = _widened(_unit(q[at]), np.zeros(len(at)) if bands[d][band][1] else None)
            z = turned(wide, table, tables, seed)
            near = np.stack([z, -z], 2).reshape(len(z), -1)
            place = (near > near[np.arange(len(z)), bucket & 0xFFFFFFFF][:, None]).sum(1) + 1
            least[rows[at]] = np.minimum(least[rows[at]], place / near.shape[1])
    for share in SHARES:
        recall = float(np.mean(least <= share))
        if recall >= aim:
            return share, recall
    return 1.0, 1.0


def nearest(df: DataFrame, every: int = 20, top: int = 20, tables: int = 8, scouts: int = 2, share: float | None = None, seed: int = 4) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vec_id, embedding`` whose id ``every`` divides. ``share``: None chooses it by the data."""
    rows = written(rows_of_vectors(df), "vectors")
    by_class = Window.partitionBy("cid", "vec").orderBy("vec_id")
    each = rows.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.least("times", F.lit(top + 1)).cast("int"))))  # more copies fit no answer
    classes = each.withColumn("k", F.row_number().over(by_class)).filter(F.col("k") <= top + 1).groupBy("cid", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = written(classes.withColumn("least", F.get("members", F.lit(0))), "classes")
    asking = rows.filter(F.col("vec_id") % every == 0)
    bands, most = bands_of(classes), top + 1
    if share is None:
        share, _ = chosen_share(classes, asking, bands, tables, top, seed)
    if share >= 1:  # each query meets all entries of one table
        tables = scouts = 1
    free = asking.select("cid", "vec").distinct().withColumn("bound", F.lit(float("-inf")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    scouted = _search(classes, free, bands, tables, scouts, share, most, seed).distinct()
    last = scouted.withColumn("r", F.row_number().over(best)).filter(F.col("r") == most)
    bounded = free.drop("bound").join(last.select(F.col("query").alias("cid"), F.col("score").alias("bound")), "cid", "left").fillna({"bound": float("-inf")})
    met = _search(classes, written(bounded, "bounds"), bands, tables, tables, share, most, seed).distinct()
    ranked = written(met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r"), "met")
    sizes = written(classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("there")), "sizes")
    counts = ranked.groupBy(F.col("query").alias("cid")).agg(F.count("*").alias("n"))
    short = free.withColumn("d", F.size("vec")).join(_small(sizes), "d").join(counts, "cid", "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(most), "there"))
    short = written(short.select("cid", "vec", "bound"), "short")
    if not short.isEmpty():
        again = _search(classes, short, bands, tables, 1, 1.0, most, seed).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r")
        ranked = ranked.join(short.select(F.col("cid").alias("query")), "query", "left_anti").unionByName(again)
    members = ranked.join(classes.select("cid", "members"), "cid").select("query", "cid", "score", F.explode("members").alias("vec_id"))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = members.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= top + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "cid", "score"))).alias("near"))
    answered = asking.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).join(lists, "query")
    own = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["cid"] == F.col("query"))), True) - 1  # one row, not its copies
    others = F.slice(F.filter("near", lambda x, i: i != F.col("own")), 1, top)
    return answered.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
