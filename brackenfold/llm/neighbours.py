"""The k most similar vectors of every vector, by cells and score-aware 4-bit codes.

Vectors are unit vectors, so the inner product is the cosine similarity. Each
cell scans its members' 4-bit codes for all queries sent to it and reranks
exactly whatever the codes don't rule out. Codebooks and codes minimise the anisotropic loss, in which the
part of the residual that is parallel to the vector, the one that changes high
inner products, weighs more than the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackenfold.operators.skew import lookup_join
from brackenfold.tables import checkpoint

#: Rows that cells and codebooks are fitted on, at most. Everything else covers all rows.
SAMPLE_ROWS = 120_000
#: Rows a cell should hold, cells of a level at most, and members, and likewise queries, of a cell that one task scans at most.
CELL_ROWS, MAX_CELLS, BLOCK_ROWS = 2_500, 4_096, 20_000
#: Cells that a task of the search scans one after the other, on average.
TASK_CELLS = 4
#: Rows of a cell of the upper level that its cells of the lower level are fitted on, about.
SUB_ROWS = 20_000
#: A query is sent to the cells whose centre is less similar by a margin at most than the best one, and to so many at most:
#: PROBES and MARGIN, or what more it takes with these cells for TARGET of the k nearest (see ``reach``).
PROBES, MARGIN, TARGET = 6, 0.25, 0.95
#: Where only neighbours of a least score are asked for, so many of them: they are near, so that few cells hold them.
CLOSE_TARGET, TURNS = 0.99, 4
#: Rows of the sample whose neighbours in the sample tell that.
ASK_ROWS = 1_000
#: Rows of the sample that codebooks are fitted on.
CODE_ROWS = 10_000
#: Values of a code (four bits), dimensions it stands for. Two dimensions a code hide every eighth neighbour from the scan.
CODES, SUB = 16, 1
#: Inner products from here on count in the score-aware loss.
THRESHOLD = 0.2
#: Candidates reranked exactly at first: so many groups of so many neighbouring rows, then so many rows. They give the
#: k-th score to beat; every other row whose code leaves it a chance to is then scored exactly too, however many there are.
GROUPS, WIDTH, RERANK = 56, 8, 56
#: Rounding of single-precision scores, and pairs scored exactly at a time.
SLACK, PAIRS = 2e-5, 100_000


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny numbers leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, math.ceil(len(x) / 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), centres)
    return centres.astype(np.float32)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(p @ centres.T).argmax(axis=1) for p in np.array_split(x, math.ceil(len(x) / 8192))])


def reach(sample: np.ndarray, near: np.ndarray, centres: np.ndarray, k: int, probes: int = PROBES, target: float = TARGET, min_score: float | None = None) -> tuple[int, float]:
    """(probes, margin) that send a query to the cells of ``target`` of its k nearest, with the fewest cells a query.

    Told by the neighbours of rows of the sample in the sample. In the whole
    table they are nearer, so that the share is rather higher there. With
    ``min_score`` only neighbours of that score count, and besides those in the
    sample, which may have none, vectors turned away from its rows in random
    directions to just that score, the farthest that are asked for.
    """
    ask = np.linspace(0, len(sample) - 1, min(ASK_ROWS, len(sample))).astype(int)
    k = min(k, len(sample) - 1)
    probes = min(probes, len(centres))
    if k < 1 or len(centres) == 1:
        return probes, MARGIN
    cells, close = [], []
    for part in np.array_split(ask, math.ceil(len(ask) / 32)):
        s = sample[part] @ sample.T
        s[np.arange(len(part)), part] = -3
        top = np.argpartition(s, -k, axis=1)[:, -k:]
        cells.append(near[top])
        close.append(np.take_along_axis(s, top, axis=1) >= (-3 if min_score is None else min_score))
    home, counts = np.concatenate(cells), np.concatenate(close)
    if min_score is not None and 0 < min_score < 1:
        rng = np.random.default_rng(5)
        for _ in range(TURNS):
            x = sample[ask]
            away = rng.normal(size=x.shape).astype(np.float32)
            away -= (away * x).sum(axis=1, keepdims=True) * x
            away /= np.linalg.norm(away, axis=1, keepdims=True)
            turned = ((min_score * x + math.sqrt(1 - min_score**2) * away) @ centres.T).argmax(axis=1)
            home, counts = np.column_stack([home, turned]), np.column_stack([counts, np.ones(len(ask), bool)])
        probes, target = 1, max(target, CLOSE_TARGET)
    to = sample[ask] @ centres.T
    rank = np.argsort(np.argsort(-to, axis=1, kind="stable"), axis=1)
    lag = to.max(axis=1, keepdims=True) - to
    of, gap = np.take_along_axis(rank, home, axis=1), np.take_along_axis(lag, home, axis=1)
    best = (math.inf, len(centres), 2.0)
    p = probes
    while True:
        for m in (0.1, 0.15, 0.2, MARGIN, 0.3, 0.35, 0.4, 0.5, 0.7, 2.0):
            if ((of < p) & (gap <= m))[counts].mean() >= target:
                best = min(best, (float(((rank < p) & (lag <= m)).sum(axis=1).mean()), p, m))
        if p >= len(centres):
            return best[1:]
        p = min(len(centres), math.ceil(p * 1.2))


class Codec:
    """Product codes of residuals, four bits for each pair of dimensions, under the anisotropic loss."""

    def __init__(self, dims: int, threshold: float = THRESHOLD):
        self.dims, self.parts = dims, math.ceil(dims / SUB)
        # parallel against orthogonal error, for unit vectors and inner products over the threshold
        self.extra = max(0.0, (dims - 1) * threshold**2 / (1 - threshold**2) - 1)
        self.books = np.zeros((self.parts, CODES, SUB), np.float32)

    def _split(self, x: np.ndarray) -> np.ndarray:
        if self.dims % SUB:
            x = np.pad(x, ((0, 0), (0, SUB - self.dims % SUB)))
        return x.reshape(len(x), self.parts, SUB)

    def encode(self, x: np.ndarray, residual: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows, parts): nearest centres, then coordinate descent on |e|^2 + extra (x.e)^2."""
        xs, rs = self._split(x), self._split(residual)
        n, rows = len(x), np.arange(len(x))
        codes = np.empty((n, self.parts), np.uint8)
        along = np.empty((n, self.parts), np.float32)  # x.e of each part
        for s in range(self.parts):
            e2 = ((rs[:, s, None, :] - self.books[s]) ** 2).sum(-1)
            codes[:, s] = e2.argmin(axis=1)
            along[:, s] = (xs[:, s] * (rs[:, s] - self.books[s][codes[:, s]])).sum(-1)
        total = along.sum(axis=1)
        for _ in range(rounds):
            for s in range(self.parts):
                rest = total - along[:, s]
                e = rs[:, s, None, :] - self.books[s]
                parallel = (xs[:, s, None, :] * e).sum(-1)
                codes[:, s] = ((e**2).sum(-1) + self.extra * (parallel + rest[:, None]) ** 2).argmin(axis=1)
                along[:, s] = parallel[rows, codes[:, s]]
                total = rest + along[:, s]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)[:, : self.dims]

    def fit(self, x: np.ndarray, residual: np.ndarray, rounds: int = 3, seed: int = 7) -> Codec:
        xs, rs = self._split(x).astype(np.float64), self._split(residual).astype(np.float64)
        rng = np.random.default_rng(seed)
        for s in range(self.parts):
            book = rs[rng.choice(len(rs), CODES, replace=len(rs) < CODES), s] + rng.normal(0, 1e-4, (CODES, SUB))
            for _ in range(8):
                near = ((rs[:, s, None, :] - book) ** 2).sum(-1).argmin(axis=1)
                for c in range(CODES):
                    if (near == c).any():
                        book[c] = rs[near == c, s].mean(axis=0)
            self.books[s] = book
        for _ in range(rounds):
            codes = self.encode(x, residual, 1)
            error = rs - self._split(self.decode(codes))
            along = (xs * error).sum(-1)
            total = along.sum(axis=1)
            for s in range(self.parts):
                rest = total - along[:, s]
                for c in range(CODES):
                    i = codes[:, s] == c
                    if i.sum() <= SUB:
                        continue
                    # minimum of sum |r - c|^2 + extra (x.(r - c) + rest)^2: a linear system of SUB equations
                    a = i.sum() * np.eye(SUB) + self.extra * xs[i, s].T @ xs[i, s]
                    b = rs[i, s].sum(axis=0) + self.extra * (xs[i, s] * ((xs[i, s] * rs[i, s]).sum(-1) + rest[i])[:, None]).sum(axis=0)
                    self.books[s, c] = np.linalg.solve(a, b)
                along[:, s] = (xs[:, s] * (rs[:, s] - self.books[s][codes[:, s]])).sum(-1)
                total = rest + along[:, s]
        return self


def scan(queries: np.ndarray, exact: np.ndarray, members: np.ndarray, coded: np.ndarray, own: np.ndarray, k: int, least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best members of each query, exactly; -1 where there are fewer.

    ``coded`` holds the vectors that the codes stand for, so that one matrix
    product sums the table entries of all codes. ``own`` is the position of the
    query among the members, or -1. Members below ``least`` may be left out.

    With e the error of a member's code, along and across the member, a score s
    has a coded score of s (1 - along) - sqrt(1 - s^2) across at least. That grows
    with s from 0 on, so a member coded below it can't reach s.
    """
    n = len(members)
    error = members - coded
    along = (members * error).sum(axis=1)
    across = np.sqrt(np.maximum((error**2).sum(axis=1) - along**2, 0))
    lowest = np.stack([1 - along, -across]).astype(np.float32)
    unsure = along >= 1
    width = WIDTH if n > 2 * WIDTH * GROUPS and k <= GROUPS else 1
    padded = math.ceil(n / width) * width
    out_at, out_score = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2.0)
    step = max(1, 4_000_000 // max(1, padded))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        rows = np.arange(len(q))
        approx = np.full((len(q), padded), -9, np.float32)
        np.matmul(q, coded.T, out=approx[:, :n]) if padded == n else approx.__setitem__((slice(None), slice(0, n)), q @ coded.T)
        mine = own[lo : lo + step]
        has = mine >= 0
        approx[rows[has], mine[has]] = -9
        if width > 1:
            best = approx.reshape(len(q), -1, width).max(axis=2)
            groups = np.argpartition(-best, min(GROUPS, best.shape[1]) - 1, axis=1)[:, :GROUPS]
            at = (groups[:, :, None] * width + np.arange(width)).reshape(len(q), -1)
        else:
            at = np.broadcast_to(np.arange(padded), (len(q), padded))
        found = np.take_along_axis(approx, at, axis=1)
        if found.shape[1] > max(RERANK, k):
            pick = np.argpartition(-found, max(RERANK, k) - 1, axis=1)[:, : max(RERANK, k)]
            at, found = np.take_along_axis(at, pick, axis=1), np.take_along_axis(found, pick, axis=1)
        scored = at
        real = found > -8
        score = np.einsum("qd,qcd->qc", exact[lo : lo + step], members[np.where(real, at, 0)])
        score = np.where(real, np.round(score, 9), -2)  # sums in another order differ in the last digits: ties stay ties
        order = np.lexsort((at, -score), axis=1)[:, :k]
        score, at = np.take_along_axis(score, order, axis=1), np.take_along_axis(at, order, axis=1)
        beat = np.maximum(score[:, k - 1] if score.shape[1] == k else np.full(len(q), -2.0), least) - 1e-9
        if found.shape[1] < n:
            score, at = _rest(exact[lo : lo + step], members, approx, scored, lowest, unsure, beat, score, at)
        m = score.shape[1]
        out_score[lo : lo + step, :m] = score
        out_at[lo : lo + step, :m] = np.where(score > -2, at, -1)
    return out_at, out_score


def _rest(exact: np.ndarray, members: np.ndarray, approx: np.ndarray, scored: np.ndarray, lowest: np.ndarray, unsure: np.ndarray, beat: np.ndarray, score: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, positions) of the best as given, and of all members not yet ``scored`` that may reach ``beat``."""
    n, k = len(members), score.shape[1]
    np.put_along_axis(approx, scored, -9, axis=1)
    open_ = np.empty((len(exact), n), bool)
    sure = beat >= 0
    bound = np.stack([beat, np.sqrt(np.maximum(1 - beat**2, 0))], axis=1).astype(np.float32)
    np.greater_equal(approx[:, :n], bound @ lowest - np.float32(SLACK), out=open_)
    if not sure.all() or unsure.any():
        open_ |= (~sure[:, None] | unsure) & (approx[:, :n] > -8)
    row, col = np.nonzero(open_)
    new = np.empty(len(row))
    for lo in range(0, len(row), PAIRS):
        r, c = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
        new[lo : lo + PAIRS] = np.round(np.einsum("pd,pd->p", exact[r], members[c]), 9)
    better = new >= beat[row]
    row, col, new = row[better], col[better], new[better]
    if not len(row):
        return score, at
    # only the queries that got more are sorted again
    some = np.unique(row)
    r = np.concatenate([np.repeat(some, k), row])
    c, s = np.concatenate([at[some].ravel(), col]), np.concatenate([score[some].ravel(), new])
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    first = (starts[:, None] + np.arange(k)).ravel()  # each has k at least
    score[some], at[some] = s[first].reshape(-1, k), c[first].reshape(-1, k)
    return score, at


def usable(df: DataFrame, item: str, vector: str, dims: int) -> DataFrame:
    """(item, vector as array<float>): ids with a vector of ``dims`` finite numbers, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(item).isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0)).select(F.col(item).alias("item"), F.transform(v, lambda x: x.cast("float")).alias("vector"))


def nearest(df: DataFrame, item: str = "lsn", vector: str = "vector_data", dims: int = 64, k: int = 10, min_score: float | None = None, probes: int = PROBES) -> DataFrame:
    """(item, neighbour, rank, score): the k most similar other items of each item, by cosine similarity.

    An item is a distinct id with a usable vector (see ``usable``); rows without
    one give nothing, an empty table gives none. Repeated rows count once. If an
    id comes with several different vectors, each takes part. Ties go to the
    smaller id. With ``min_score`` only neighbours of at least that score are
    kept, of the same k. Items with equal vectors are searched as one and share
    the result, so that thousands of copies cost no more than one.

    Approximate: a neighbour is missed if its cell isn't among those the item is
    sent to (``probes`` at least, see ``reach``); within these cells none is. Tests
    hold recall to 0.9.
    """
    base = usable(df, item, vector, dims)
    item_type = base.schema["item"].dataType.simpleString()
    # copies become one vector, named by its smallest item
    groups = checkpoint(base.groupBy("vector").agg(F.min("item").alias("v"), F.max("item").alias("last"), F.count("*").alias("n")))
    # written once: it is read twice below, and the search would run for each
    pairs = checkpoint(_search(groups.select("v", "vector"), item_type, dims, k, min_score, probes))
    many = groups.where("v < last").select(F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"), "v", "n")
    members = lookup_join(base.select(F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"), "item"), many, ["h1", "h2"], "n").select("v", "item").distinct()
    # of a group of copies only its k + 1 smallest items can be anyone's neighbours
    few = (
        members.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("item")))
        .where(F.col("r") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("item")).alias("copies"))
    )
    to = pairs.join(few.withColumnRenamed("v", "w"), "w", "left").select("v", F.explode(F.coalesce("copies", F.array("w"))).alias("neighbour"), "score")
    own = few.select("v", F.explode("copies").alias("neighbour"), F.lit(1.0).alias("score"))
    by_rank = Window.partitionBy("v").orderBy(F.col("score").desc(), "neighbour")
    best = to.unionByName(own).withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list(F.struct("r", "neighbour", "score")).alias("best"))
    sizes = members.groupBy("v").agg(F.count("*").alias("n"))
    shared = lookup_join(members, best.join(sizes, "v"), ["v"], "n")
    alone = best.join(few.select("v"), "v", "left_anti").select("v", F.col("v").alias("item"), "best")
    result = shared.select("v", "item", "best").unionByName(alone)
    mine = F.slice(F.filter(F.array_sort("best"), lambda x: x["neighbour"] != F.col("item")), 1, k)
    return result.select("item", F.posexplode(mine).alias("p", "x")).select(F.col("item"), F.col("x.neighbour").alias("neighbour"), (F.col("p") + 1).alias("rank"), F.col("x.score").alias("score"))


def _search(vectors: DataFrame, item_type: str, dims: int, k: int, min_score: float | None, probes: int) -> DataFrame:
    """(v, w, score): the k best other vectors of each distinct vector."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], f"v {item_type}, w {item_type}, score double")
    n = vectors.count()
    if n < 2:
        return empty
    part = min(1.0, 1.1 * SAMPLE_ROWS / n)
    rows = vectors.where((F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < part * 1_000_003)).select("vector").limit(SAMPLE_ROWS).toArrow()["vector"].combine_chunks()
    sample = unit(rows.flatten().to_numpy(zero_copy_only=False), dims).astype(np.float32) if len(rows) else None
    if sample is None:
        sample = unit(np.array(vectors.first()["vector"], np.float32), dims).astype(np.float32)
    cells = max(1, n // CELL_ROWS)
    deep = cells > MAX_CELLS
    # with two levels each keeps so much that both together keep TARGET
    target = TARGET**0.5 if deep else TARGET
    centres = kmeans(sample, max(1, min(MAX_CELLS, math.ceil(cells**0.5) if deep else cells, len(sample) // 20)))
    near = nearest_centre(sample, centres)
    fit = sample[:CODE_ROWS]
    codec = Codec(dims).fit(fit, fit - centres[near[:CODE_ROWS]])
    model = spark.sparkContext.broadcast((centres, codec.books))
    probes, margin = reach(sample, near, centres, k, probes, target, min_score)
    flat = f"v {item_type}, vector array<float>, cell int, sub int, member boolean"
    sent = vectors.mapInArrow(lambda bs: _assign(bs, model.value[0], probes, margin, dims), flat)
    if deep:
        sent = checkpoint(_lower(vectors, sent, model, probes, margin, dims, k, target, min_score, flat))
    # cells are bounded in number; one with more members or queries than a task should scan is scanned in blocks
    tally = sent if deep else vectors.mapInArrow(lambda bs: _tally(_assign(bs, model.value[0], probes, margin, dims)), "cell int, sub int, m bigint, q bigint")
    if deep:
        tally = tally.select("cell", "sub", F.col("member").cast("bigint").alias("m"), F.lit(1).cast("bigint").alias("q"))
    large = tally.groupBy("cell", "sub").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).where((F.col("m") > BLOCK_ROWS) | (F.col("q") > BLOCK_ROWS))
    # a row for each BLOCK_ROWS queries at most
    cut = large.select("cell", "sub", F.ceil(F.greatest("m", F.lit(1)) / BLOCK_ROWS).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK_ROWS).cast("int").alias("qb"))
    marked = sent.join(F.broadcast(cut), ["cell", "sub"], "left").select(*sent.columns, F.coalesce("mb", F.lit(1)).alias("mb"), F.coalesce("qb", F.lit(1)).alias("qb"))
    whole = (F.col("mb") == 1) & (F.col("qb") == 1)
    columns = ["v", "vector", "cell", "sub"]
    mine = lambda blocks: F.pmod(F.xxhash64("v"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    # members of block i meet queries of block j
    alone = marked.where(whole).select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), "member", F.lit(True).alias("query"))
    as_member = marked.where(~whole & F.col("member")).select(*columns, mine("mb").alias("i"), every("qb").alias("j"), F.lit(True).alias("member"), F.lit(False).alias("query"))
    as_query = marked.where(~whole).select(*columns, every("mb").alias("i"), mine("qb").alias("j"), F.lit(False).alias("member"), F.lit(True).alias("query"))
    # a few cells a task, so that a task's share doesn't grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells / TASK_CELLS))
    sent = alone.unionByName(as_member).unionByName(as_query).repartition(parts, "cell", "sub", "i", "j")

    def search(t: pa.Table) -> pa.Table:
        c, books = model.value
        coder = Codec(dims)
        coder.books = books
        ids = t.column("v").combine_chunks()
        v = ids.to_numpy(zero_copy_only=False)
        x = unit(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dims)
        member, query = (np.flatnonzero(t.column(name).to_numpy()) for name in ("member", "query"))
        member = member[np.argsort(v[member], kind="stable")]  # ties go to the smaller id
        if not len(member) or not len(query):
            return pa.table({"v": ids[:0], "w": ids[:0], "score": pa.array([], pa.float64())})
        m = x[member]
        centre = c[t.column("cell")[0].as_py()]
        m32 = m.astype(np.float32)
        coded = centre + coder.decode(coder.encode(m32, m32 - centre))
        at = np.searchsorted(v[member], v[query])
        own = np.where((at < len(member)) & (v[member][np.minimum(at, len(member) - 1)] == v[query]), at, -1)
        q = x[query]
        places, scores = scan(q.astype(np.float32), q, m, coded, own, k, -2.0 if min_score is None else min_score)
        keep = (places >= 0) & (scores >= (-2 if min_score is None else min_score))
        qi, ki = np.nonzero(keep)
        return pa.table({"v": pa.array(v[query[qi]]).cast(ids.type), "w": pa.array(v[member[places[qi, ki]]]).cast(ids.type), "score": np.clip(scores[qi, ki], -1, 1)})

    hits = sent.groupBy("cell", "sub", "i", "j").applyInArrow(search, f"v {item_type}, w {item_type}, score double")
    by_rank = Window.partitionBy("v").orderBy(F.col("score").desc(), "w")
    return hits.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k).drop("r")


def _near(x: np.ndarray, centres: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, whether it is the row's nearest): the centres each row is sent to."""
    score = x @ centres.T
    top = np.argsort(-score, axis=1, kind="stable")[:, :probes]
    best = np.take_along_axis(score, top, axis=1)
    row, rank = np.nonzero(best >= best[:, :1] - margin)
    return row, top[row, rank], rank == 0


def _rows(batch, row: np.ndarray, cell: np.ndarray, sub: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    part = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([part.column("v"), part.column("vector"), pa.array(cell.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(member)], ["v", "vector", "cell", "sub", "member"])


def _assign(batches, centres: np.ndarray, probes: int, margin: float, dims: int):
    for b in batches:
        x = unit(b.column("vector").flatten().to_numpy(zero_copy_only=False), dims).astype(np.float32)
        for lo in range(0, len(x), 4096):
            row, cell, member = _near(x[lo : lo + 4096], centres, probes, margin)
            yield _rows(b, row + lo, cell, np.zeros(len(row)), member)


def _tally(batches):
    """Members and queries by cell."""
    for b in batches:
        cell, at = np.unique(b.column("cell").to_numpy(), return_inverse=True)
        m = np.bincount(at, b.column("member").to_numpy(zero_copy_only=False), len(cell)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.zeros(len(cell)), pa.int32()), pa.array(m), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64))], ["cell", "sub", "m", "q"])


def _lower(vectors: DataFrame, sent: DataFrame, model, probes: int, margin: float, dims: int, k: int, target: float, min_score: float | None, flat: str) -> DataFrame:
    """``sent`` with ``sub``: the rows sent to a cell go on to its cells of the lower level.

    These are fitted cell by cell on about SUB_ROWS of its members and join the
    rows in groups of about BLOCK_ROWS, so that nothing of the lower level comes
    to the driver or is broadcast.
    """
    tallies = vectors.mapInArrow(lambda bs: _tally(_assign(bs, model.value[0], probes, margin, dims)), "cell int, sub int, m bigint, q bigint")
    # a row per cell of the upper level
    sizes = {r["cell"]: (r["m"], r["q"]) for r in tallies.groupBy("cell").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).collect()}
    rows = vectors.sparkSession.createDataFrame([(c, m, math.ceil(q / BLOCK_ROWS)) for c, (m, q) in sizes.items()], "cell int, m bigint, salts int")
    known = F.broadcast(rows)  # MAX_CELLS rows at most
    draw = F.pmod(F.xxhash64("v", F.lit("sub")), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(SUB_ROWS)) / F.col("m")) * (1 << 30)
    sample = sent.where("member").join(known, "cell").where(draw).select("cell", "m", "vector")

    def fit(t: pa.Table) -> pa.Table:
        x = unit(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dims).astype(np.float32)
        c = kmeans(x, max(1, min(t.column("m")[0].as_py() // CELL_ROWS, len(x) // 20)))
        p, m = reach(x, nearest_centre(x, c), c, k, PROBES, target, min_score)
        return pa.table({"cell": t.column("cell").slice(0, 1), "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float32())), "probes": pa.array([p], pa.int32()), "margin": pa.array([m], pa.float64())})

    lower = checkpoint(sample.groupBy("cell").applyInArrow(fit, "cell int, centres array<float>, probes int, margin double"))
    salted = sent.join(known.select("cell", "salts"), "cell").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")).drop("salts")
    copies = lower.join(known.select("cell", "salts"), "cell").select("cell", "centres", "probes", "margin", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["v", "vector", "cell", "sub", "member"])
        b = left.combine_chunks().to_batches()[0]
        home = b.column("member").to_numpy(zero_copy_only=False)
        cell = b.column("cell").to_numpy()
        if not right.num_rows:
            return pa.Table.from_batches([_rows(b, np.arange(len(cell)), cell, np.zeros(len(cell)), home)])
        c = right.column("centres").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        x = unit(b.column("vector").flatten().to_numpy(zero_copy_only=False), dims).astype(np.float32)
        row, sub, first = _near(x, c, right.column("probes")[0].as_py(), right.column("margin")[0].as_py())
        return pa.Table.from_batches([_rows(b, row, cell[row], sub, first & home[row])])

    return salted.groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInArrow(go_on, flat)


def close_pairs(neighbours: DataFrame, a: str, b: str, min_score: float) -> DataFrame:
    """(a, b), a < b: pairs of which one is a neighbour of the other with at least that score."""
    return neighbours.where((F.col("score") >= min_score) & (F.col("item") != F.col("neighbour"))).select(F.least("item", "neighbour").alias(a), F.greatest("item", "neighbour").alias(b)).distinct()
