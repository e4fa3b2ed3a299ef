"""The most similar vectors of every vector, by shifted space-filling curves.

Vectors are scaled to length one and projected on several random orthonormal bases; in each projection, shifted by a
random offset, they are ordered along a Hilbert curve. Each ordering is range-partitioned, a window slides over it,
and the windows' best candidates of all orderings are merged and ranked again by the exact cosine. Windows that reach
over a partition's edge are completed by a second, small step over the edges' rows. Where a window is crowded with
near copies, the best may lie beyond it on every curve: such rows are compared with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.util import forget, materialise

CURVES, DIMS, BITS, WINDOW = 8, 24, 2, 48
QUERY_BLOCK_MB = 64
RANGE_BYTES = 32_000_000  # of a range of the curves
CROWD, CROWD_MARGIN = 16, 0.15  # so many rows of a window this little below `least`: the window may be too small
_PAIR, _CROWDED = -2, -3  # marks of rows that are pairs, and of rows in a crowd, among rows of partitions' edges
_GOOD = "vec is not null and size(vec) > 0 and forall(vec, v -> v is not null and not isnan(v) and abs(v) < 1e30) and exists(vec, v -> v != 0)"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of small integers (rows x dims, dims * bits <= 62)."""
    x = [cells[:, d].astype(np.uint32).copy() for d in range(cells.shape[1])]
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(m):
            high = (x[i] & np.uint32(q)) > 0
            t = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[m - 1] & np.uint32(q)) > 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    key = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | (((x[i] ^ t) >> np.uint32(b)) & 1).astype(np.int64)
    return key


def _projections(width: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    dims = min(dims, width)
    return [(np.linalg.qr(rng.standard_normal((width, dims)))[0].astype(np.float32), rng.random(dims).astype(np.float32)) for _ in range(curves)]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(vectors: pd.Series | np.ndarray) -> list[bytes]:
    """Vectors of one length as bytes without loss: in half precision where that holds every component, else in single."""
    x = np.stack(list(vectors)).astype(np.float32) if len(vectors) else np.zeros((0, 1), np.float32)
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    small = (half.astype(np.float32) == x).all(1)
    width = 2 * x.shape[1]
    packed, full = half.tobytes(), x.tobytes()
    return [packed[k * width : (k + 1) * width] if s else full[2 * k * width : 2 * (k + 1) * width] for k, s in enumerate(small.tolist())]


def decode(codes: pd.Series, width: int) -> np.ndarray:
    """The vectors of `encode`, as rows."""
    raw = list(codes)
    if not raw:
        return np.zeros((0, width), np.float32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    small = size == 2 * width
    out = np.empty((len(raw), width), np.float32)
    for pick, kind in ((small, np.float16), (~small, np.float32)):
        where = np.flatnonzero(pick)
        if len(where):
            some = raw if len(where) == len(raw) else [raw[k] for k in where]
            out[where] = np.frombuffer(b"".join(some), kind).reshape(len(where), width)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def exact_cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, to nine digits."""
    out = np.empty(len(a))
    for s in range(0, len(a), 8192):
        p, q = x[a[s : s + 8192]].astype(np.float64), x[b[s : s + 8192]].astype(np.float64)
        out[s : s + 8192] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
    return np.round(out, 9)


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec) of the rows whose vector is neither null nor empty nor zero and holds no null, NaN or infinity;
    of repeated keys one row counts, the one with the smallest vector."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec")).where(F.col("key").isNotNull()).where(_GOOD)
    return rows.groupBy("key").agg(F.min("vec").alias("vec"))


def _window_pairs(v: np.ndarray, window: int, keep: int, least: float | None, first_new: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, candidate, cosine): of each row from `first_new` on and those before it within the window, the `keep`
    best of either side's rows; `least` drops pairs below it."""
    n = len(v)
    rows, cands, sims = [], [], []
    block = 512
    for s in range(first_new, n, block):
        e = min(n, s + block)
        lo = max(0, s - window)
        sim = v[s:e] @ v[lo:e].T
        back = np.arange(s, e)[:, None] - np.arange(lo, e)[None, :]
        sim[(back <= 0) | (back > window)] = -2
        if least is not None:
            i, j = np.nonzero(sim >= least)
            rows.append(i + s), cands.append(j + lo), sims.append(sim[i, j])
            continue
        for mat, swap in ((sim, False), (sim.T, True)):
            k = min(keep, mat.shape[1])
            top = np.argpartition(-mat, k - 1, axis=1)[:, :k]
            val = np.take_along_axis(mat, top, 1)
            i, j = np.nonzero(val > -2)
            a, b = i, top[i, j]
            rows.append((b if swap else a) + s), cands.append((a if swap else b) + lo), sims.append(val[i, j])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cands), np.concatenate(sims)


def _crowded(v: np.ndarray, window: int, floor: float, first_new: int = 0) -> np.ndarray:
    """Rows that have at least `CROWD` others of at least `floor` within the window, as far as seen from `first_new` on."""
    near = np.zeros(len(v), np.int64)
    for s in range(first_new, len(v), 512):
        e, lo = min(len(v), s + 512), max(0, s - window)
        back = np.arange(s, e)[:, None] - np.arange(lo, e)[None, :]
        close = (v[s:e] @ v[lo:e].T >= floor) & (back > 0) & (back <= window)
        near[s:e] += close.sum(1)
        near[lo:e] += close.sum(0)
    return np.flatnonzero(near >= CROWD)


def _against_all(rows: DataFrame, asked: DataFrame, width: int, k: int, floor: float, key_type: str) -> list[DataFrame]:
    """Pairs (key_1, key_2, cosine) of `asked` with all `rows` (both key, code): those that can be among the `k` best of
    either side and reach `floor`. The asked go in blocks of `QUERY_BLOCK_MB`, each one pass over the rows."""
    per_block = max(1, int(QUERY_BLOCK_MB * 1_000_000) // (8 * width))
    blocks = -(-asked.count() // per_block)
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toPandas()  # a block, bounded above
        if mine.empty:
            continue
        names, raw = mine["key"].to_numpy(object), decode(mine["code"], width)

        def scan(batches: Iterator[pd.DataFrame], names=names, raw=raw) -> Iterator[pd.DataFrame]:
            q, place = unit_rows(raw), pd.Index(names)
            best = np.full((len(q), k), -2, np.float32)
            for batch in batches:
                for s in range(0, len(batch), 1024):
                    cut = batch.iloc[s : s + 1024]
                    x, keys = decode(cut["code"], width), cut["key"].to_numpy(object)
                    at, unit = place.get_indexer(pd.Index(keys)), unit_rows(x).T
                    for lo in range(0, len(q), 4096):
                        hi = min(lo + 4096, len(q))
                        y = q[lo:hi] @ unit
                        own = np.flatnonzero((at >= lo) & (at < hi))
                        y[at[own] - lo, own] = -3
                        n = min(k, y.shape[1])
                        best[lo:hi] = np.partition(np.concatenate((best[lo:hi], np.partition(y, -n, axis=1)[:, -n:]), axis=1), -k, axis=1)[:, -k:]
                        # With room for the error of single precision; the row itself is at -3.
                        wanted = y >= np.maximum(best[lo:hi].min(1), floor)[:, None] - 2e-5
                        lone = np.flatnonzero((at < 0) & (y.max(0) >= floor))
                        if len(lone):
                            n = min(k, hi - lo)
                            sub = y[:, lone]
                            wanted[:, lone] |= sub >= np.maximum(np.partition(sub, -n, axis=0)[-n], floor)[None, :] - 2e-5
                        i, j = np.nonzero(wanted & (y > -2.5))
                        if len(i):
                            both = np.concatenate((raw[lo:hi], x))
                            yield pd.DataFrame({"key_1": names[lo + i], "key_2": keys[j], "cosine": exact_cosines(both, i, j + hi - lo)})

        out.append(rows.mapInPandas(scan, f"key_1 {key_type}, key_2 {key_type}, cosine double"))
    return out


def _others(names: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs without those of a row and itself, which meet where one curve ends and the next begins."""
    same = np.flatnonzero(s > 0.999)
    keep = np.ones(len(a), bool)
    keep[same] = names[a[same]] != names[b[same]]
    return a[keep], b[keep], s[keep]


def _best_per_row(a: np.ndarray, b: np.ndarray, s: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the `keep` highest pairs of each row, either end counting as the row; a pair counts once."""
    first = np.unique(np.minimum(a, b) * np.int64(max(a.max(initial=0), b.max(initial=0)) + 1) + np.maximum(a, b), return_index=True)[1]
    a, b, s = a[first], b[first], s[first]
    ends, other, val, pos = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s)), np.tile(first, 2)
    order = np.lexsort((other, -val, ends))
    ends = ends[order]
    start = np.concatenate(([True], ends[1:] != ends[:-1])) if len(ends) else np.zeros(0, bool)
    rank = np.arange(len(ends)) - np.maximum.accumulate(np.where(start, np.arange(len(ends)), 0)) if len(ends) else np.zeros(0, np.int64)
    return np.unique(pos[order][rank < keep])


def similar_vectors(
    df: DataFrame, key: str, vector: str, *, k: int = 5, least: float | None = None, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: int = WINDOW, seed: int = 11,
) -> DataFrame:
    """(key_a, key_b, cosine, rank): the `k` most similar other vectors of each vector, best first.

    Null, empty, zero and non-finite vectors take no part; repeated keys count once; all vectors must be of one
    length. Equal cosines rank by the smaller key. Vectors equal to the last bit are stored once with their `k + 1`
    smallest keys, which is all that any ranking can need of them; the other members of such a group get those keys
    as their neighbours. With `least`, only neighbours of at least that cosine come out (among the k best). Rows that
    have `CROWD` rows of at least `least` (0.95 where it is not given) less `CROWD_MARGIN` in a window are compared
    with all rows, so pairs with one of them are exact, at the cost of (such rows) x (all rows). Between the others
    the search is approximate: see the README for measured recall.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec")).where(F.col("key").isNotNull()).where(_GOOD)
    key_type = rows.schema["key"].dataType.simpleString()
    head = rows.select("vec").first()
    if head is None:
        return df.sparkSession.createDataFrame([], f"key_a {key_type}, key_b {key_type}, cosine double, rank int")
    width = len(head.vec)
    bases = _projections(width, curves, dims, seed)
    spread = width**-0.5

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "code": encode(batch["vec"])})

    once = rows.mapInPandas(coded, f"key {key_type}, code binary").groupBy("key").agg(F.min("code").alias("code"))
    base = materialise(once)
    # Exact copies: the smallest keys of each vector, found in two steps so that no group is held by one task.
    marks = base.select("key", F.sha2("code", 256).alias("copy"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    part = marks.withColumn("r", F.row_number().over(W.partitionBy("copy", "salt").orderBy("key")))
    low = part.where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(W.partitionBy("copy").orderBy("key")))
    # Groups of more than k + 1 copies: their first k keys, and the members that need not be searched.
    large = part.groupBy("copy", "salt").agg(F.count("*").alias("n")).groupBy("copy").agg(F.sum("n").alias("n")).where(F.col("n") > k + 1).select("copy")
    firsts = materialise(low.join(large, "copy", "left_semi").where(F.col("r") <= k + 1).select("key", "copy", "r"))
    extra = materialise(marks.join(large, "copy", "left_semi").join(firsts.select("key"), "key", "left_anti").select("key", "copy"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 4096):
                cut = batch.iloc[s : s + 4096]
                x = unit_rows(decode(cut["code"], width))
                keys = np.empty((len(cut), curves), np.int64)
                for c, (q, shift) in enumerate(bases):
                    y = (x @ q) / (6 * spread) + 0.5 + (shift - 0.5) / (1 << bits)
                    keys[:, c] = hilbert_key(np.clip(y * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)
                yield pd.DataFrame({"key": cut["key"], "code": cut["code"], "keys": list(keys)})

    searched = base.join(extra.select("key"), "key", "left_anti")
    placed = materialise(searched.mapInPandas(keyed, f"key {key_type}, code binary, keys array<bigint>"))
    forget(base)
    ordered = placed.select("key", "code", F.posexplode("keys").alias("curve", "at"))
    # As many ranges as the rows of all curves need, so that no task grows with the input.
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-placed.count() * curves * (2 * width + 64) // RANGE_BYTES))
    ordered = ordered.repartitionByRange(ranges, "curve", "at", "key").sortWithinPartitions("curve", "at", "key").select("key", "code")
    keep = k + 3
    floor_ = None if least is None else least - 1e-4  # single precision against double
    crowd_floor = (0.95 if least is None else least) - CROWD_MARGIN

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        names, x = np.zeros(0, object), np.zeros((0, width), np.float32)
        head_rows: list[pd.DataFrame] = []
        n_head = 0
        for batch in batches:
            if n_head < window:
                take = min(window - n_head, len(batch))
                head_rows.append(pd.DataFrame({"key_1": batch["key"].iloc[:take].to_numpy(), "code": batch["code"].iloc[:take].to_numpy(), "pos": np.arange(n_head, n_head + take)}))
                n_head += take
            old = len(names)
            names = np.concatenate((names, batch["key"].to_numpy(object)))
            x = np.concatenate((x, decode(batch["code"], width)))
            unit = unit_rows(x)
            a, b, s = _others(names, *_window_pairs(unit, window, keep, floor_, old))
            sel = _best_per_row(a, b, s, keep)
            a, b = a[sel], b[sel]
            yield pd.DataFrame({"key_1": names[a], "key_2": names[b], "cosine": exact_cosines(x, a, b), "edge": _PAIR, "pos": 0, "code": None})
            crowd = np.unique(names[_crowded(unit, window, crowd_floor, old)])
            if len(crowd):
                yield pd.DataFrame({"key_1": crowd, "key_2": None, "cosine": 0.0, "edge": _CROWDED, "pos": 0, "code": None})
            names, x = names[-window:], x[-window:]
        if len(names):
            tail = pd.DataFrame({"key_1": names, "code": encode(pd.Series(list(x))), "pos": np.arange(-len(names), 0)})
            for part_, edge in ((pd.concat(head_rows), number - 1), (tail, number)):
                yield part_.assign(key_2=None, cosine=0.0, edge=edge)[["key_1", "key_2", "cosine", "edge", "pos", "code"]]

    slid = materialise(ordered.mapInPandas(slide, f"key_1 {key_type}, key_2 {key_type}, cosine double, edge int, pos int, code binary"))

    def join_edges(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("pos", kind="stable")
        x = decode(rows_["code"], width)
        n_old = int((rows_["pos"] < 0).sum())
        names = rows_["key_1"].to_numpy(object)
        a, b, s = _others(names, *_window_pairs(unit_rows(x), window, keep, floor_, n_old))
        cross = b < n_old
        a, b, s = a[cross], b[cross], s[cross]
        sel = _best_per_row(a, b, s, keep)
        return pd.DataFrame({"key_1": names[a[sel]], "key_2": names[b[sel]], "cosine": exact_cosines(x, a[sel], b[sel])})

    # An edge has at most two windows' rows.
    edges = slid.where("edge >= 0").groupBy("edge").applyInPandas(join_edges, f"key_1 {key_type}, key_2 {key_type}, cosine double")
    found = slid.where(F.col("edge") == _PAIR).select("key_1", "key_2", "cosine").unionByName(edges)
    crowded = slid.where(F.col("edge") == _CROWDED).select(F.col("key_1").alias("key")).distinct()
    crowded = materialise(placed.select("key", "code").join(crowded, "key", "left_semi"))
    for pairs in _against_all(placed.select("key", "code"), crowded, width, k, -2.0 if floor_ is None else floor_, key_type):
        found = found.unionByName(pairs)
    # The windows' cosines are exact already: what is left is to merge the curves and rank.
    ways = F.array(F.struct(F.col("key_1").alias("key_a"), F.col("key_2").alias("key_b")), F.struct(F.col("key_2").alias("key_a"), F.col("key_1").alias("key_b")))
    both = found.select("cosine", F.explode(ways).alias("w")).select("w.key_a", "w.key_b", "cosine").groupBy("key_a", "key_b").agg(F.max("cosine").alias("cosine"))
    if least is not None:
        both = both.where(F.col("cosine") >= least)
    # The other members of a group of copies: their k nearest are the group's k smallest keys.
    copies = extra.join(firsts.where(F.col("r") <= k).select("copy", F.col("key").alias("other")), "copy")
    both = both.unionByName(copies.select(F.col("key").alias("key_a"), F.col("other").alias("key_b"), F.lit(1.0).alias("cosine")))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("key_a").orderBy(F.desc("cosine"), "key_b")))
    return ranked.where(F.col("rank") <= k)


def nearest_of_queries(df: DataFrame, queries: DataFrame, key: str, vector: str, *, k: int = 5) -> DataFrame:
    """(key_a, key_b, cosine, rank): the exact k most similar other vectors of each row of `queries`, against all rows
    of `df`, the queries in blocks of `QUERY_BLOCK_MB`; each block is one pass over the rows with partial top k.

    Null, empty, zero and non-finite vectors take no part; equal cosines rank by the smaller key.
    """
    rows = usable_vectors(df, key, vector)
    asked = materialise(usable_vectors(queries, key, vector))
    key_type = rows.schema["key"].dataType.simpleString()
    out_type = f"key_a {key_type}, key_b {key_type}, cosine double"
    head = asked.first()
    if head is None:
        return df.sparkSession.createDataFrame([], f"{out_type}, rank int")
    rows = materialise(rows)
    per_block = max(1, int(QUERY_BLOCK_MB * 1_000_000) // (8 * len(head.vec)))
    blocks = -(-asked.count() // per_block)
    best: DataFrame | None = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toPandas()  # a block, bounded above
        if mine.empty:
            continue
        names = mine["key"].to_numpy(object)
        q = _unit(mine["vec"])

        def scan(batches: Iterator[pd.DataFrame], names=names, q=q) -> Iterator[pd.DataFrame]:
            """The best k of each query among a task's rows. Single precision finds what may be among them, with room
            for its error; those are measured in double precision."""
            q32 = q.astype(np.float32)
            best = pd.DataFrame({"q": np.zeros(0, np.int64), "key": np.zeros(0, object), "c": np.zeros(0)})
            least = np.full(len(names), -np.inf)
            for batch in batches:
                for s in range(0, len(batch), 1024):
                    x = _unit(batch["vec"].iloc[s : s + 1024])
                    keys = batch["key"].iloc[s : s + 1024].to_numpy(object)
                    y = q32 @ x.astype(np.float32).T
                    if len(keys) > k:  # a row that k others of its block beat is none of the best
                        low = np.partition(y, -k, axis=1)[:, -k] if np.isinf(least).any() else np.full(len(names), -np.inf)
                    else:
                        low = np.full(len(names), -np.inf)
                    # The query itself may be among the k of its block, so one place more is kept where it is.
                    own = np.isin(names, keys)
                    low = np.where(own, -np.inf, low)
                    i, j = np.nonzero(y >= np.maximum(least, low)[:, None] - 1e-5)
                    other = names[i] != keys[j]
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    c = np.concatenate([np.round((q[i[t : t + 8192]] * x[j[t : t + 8192]]).sum(1), 9) for t in range(0, len(i), 8192)])
                    new = pd.DataFrame({"q": i, "key": keys[j], "c": c})
                    touched = np.unique(i)
                    held = best["q"].isin(touched)
                    merged = pd.concat((best[held], new)).sort_values(["q", "c", "key"], ascending=[True, False, True]).groupby("q").head(k)
                    full = merged.groupby("q")["c"].agg(["size", "min"])
                    full = full[full["size"] >= k]
                    least[full.index.to_numpy()] = full["min"].to_numpy()
                    best = pd.concat((best[~held], merged))
            if len(best):
                yield pd.DataFrame({"key_a": names[best["q"].to_numpy()], "key_b": best["key"].to_numpy(object), "cosine": best["c"].to_numpy()})

        part = rows.mapInPandas(scan, out_type)
        best = part if best is None else best.unionByName(part)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("key_a").orderBy(F.desc("cosine"), "key_b")))
    return ranked.where(F.col("rank") <= k)
