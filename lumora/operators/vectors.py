"""Vector joins bounded by pivots, and identities carried over from one clustering to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import settle

#: Rows of a pivot that meet in one block; a pivot with more of them is dealt out over several blocks.
BLOCK = 8192
#: Rows that leave a task at once, and rows that the number of pivots is tried on.
OUT, TRIED = 1 << 15, 1024
#: Seconds to write and shuffle a row, and to compare a pair, roughly.
ROW, PAIR = 4e-6, 8e-9


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _lengths(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _spread(m: np.ndarray, many: int) -> np.ndarray:
    """`many` of the rows, each the farthest from those before it."""
    taken, far = [0], np.full(len(m), np.inf)
    while len(taken) < min(many, len(m)):
        far = np.minimum(far, _lengths(m, m[taken[-1:]])[:, 0])
        taken.append(int(far.argmax()))
    return m[taken]


def _fewest(sample: np.ndarray, pivots: np.ndarray, radius: float, n: int) -> int:
    """How many of the pivots cost least for n rows like the sample: rows that visit are written and shuffled, pairs in blocks are compared.

    Where the triangle bound leaves nothing out, every row visits every pivot; more of them than there are blocks would only copy rows.
    """
    far, apart, best = _lengths(sample, pivots), _lengths(pivots, pivots), (np.inf, 1)
    k = len(pivots)
    while k:
        home = far[:, :k].argmin(1)
        near = far[np.arange(len(far)), home]
        goes = far[:, :k] ** 2 - (near * near)[:, None] <= 2 * radius * apart[home, :k] + 1e-6
        visits = float(goes.sum()) / max(1, len(far))
        blocks = max(1.0, n * visits / k / BLOCK)  # that a resident is copied to
        cost = n * (ROW * (visits / 2 + blocks) + PAIR * visits * n / k)
        best = min(best, (cost, k))
        k //= 2
    return best[1]


def _placed(vectors: DataFrame, least_dot: float, most_pivots: int) -> tuple[DataFrame, float]:
    """Every vector at its nearest pivot, and as a visitor at each pivot of no lower number that a partner of its may live at; and the radius of the search.

    Of a pair at two pivots the vector at the lower one visits the other, so it meets once.
    """
    head = vectors.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    many = min(most_pivots, max(1, int(np.ceil((head[0] or 0) ** 0.5))))
    # a.b >= c means |a - b|^2 = |a|^2 + |b|^2 - 2 a.b <= 2 (largest |v|^2 - c); the slack covers rounding
    radius = float(np.sqrt(max(0.0, 2 * ((head[1] or 0.0) - least_dot)))) + 1e-6
    drawn = vectors.orderBy(F.xxhash64("asset_id", F.lit(7)), "asset_id").limit(4 * many).select("vec").collect()
    sample = np.array([r["vec"] for r in drawn], float) if drawn else np.zeros((0, 0))
    pivots = _spread(sample, many) if drawn else sample
    if drawn:
        pivots = pivots[: _fewest(sample[:TRIED], pivots, radius, head[0])]
    held = vectors.sparkSession.sparkContext.broadcast((pivots, _lengths(pivots, pivots)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, OUT // (1 + len(held.value[0])))  # a row may visit every pivot
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                far = _lengths(_stacked(b.column(1)), held.value[0])
                home = far.argmin(1)
                near = far[np.arange(len(far)), home]
                # who lives at another pivot is beyond the plane halfway to it: that plane must be within the radius
                goes = far * far - (near * near)[:, None] <= 2 * radius * held.value[1][home] + 1e-6
                row, at = np.nonzero(goes & (np.arange(far.shape[1]) >= home[:, None]))
                ids, vec = b.column(0), b.column(1)
                both = np.concatenate([np.arange(len(far)), row])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(both)), vec.take(pa.array(both)), pa.array(np.concatenate([home, at]).astype(np.int32)),
                        pa.array(np.concatenate([near, far[row, at]])), pa.array(np.arange(len(both)) < len(far)), pa.array(np.concatenate([np.ones(len(far), bool), at == home[row]])),
                    ],
                    ["id", "vec", "pivot", "far", "home", "same"],
                )

    kind = vectors.schema["vec"].dataType.simpleString()
    return settle(vectors.select("asset_id", "vec").mapInArrow(deal, f"id long, vec {kind}, pivot int, far double, home boolean, same boolean")), radius


def _blocks(vectors: DataFrame, least_dot: float, most_pivots: int) -> tuple[DataFrame, float]:
    placed, radius = _placed(vectors, least_dot, most_pivots)
    homes = placed.where("home").groupBy("pivot").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    seen = placed.where("not home").join(F.broadcast(homes), "pivot").where((F.col("far") >= F.col("lo") - radius) & (F.col("far") <= F.col("hi") + radius))
    guests = F.broadcast(seen.groupBy("pivot").agg(F.count("*").alias("m")))  # a row a pivot, as homes
    part = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
    row = ["id", "vec", "pivot", "far", "home", "same"]
    own = placed.where("home").join(F.broadcast(homes), "pivot").join(guests, "pivot")
    own = own.select(*row, F.pmod(F.xxhash64("id"), part("n")).cast("int").alias("i"), every("m").alias("j"))
    come = seen.join(guests, "pivot").select(*row, every("n").alias("i"), F.pmod(F.xxhash64("id"), part("m")).cast("int").alias("j"))
    return own.unionByName(come), radius


def _windows(table: pa.Table, radius: float, step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Visitors a few at a time with the residents whose distance to the pivot differs by no more than the radius: (ids, vectors) of both, and which visitors live there too."""
    far, home = table.column("far").to_numpy(), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    ids, vec, same = table.column("id").to_numpy(), _stacked(table.column("vec")), table.column("same").to_numpy(zero_copy_only=False).astype(bool)
    stay, come = np.flatnonzero(home), np.flatnonzero(~home)
    stay, come = stay[np.argsort(far[stay], kind="stable")], come[np.argsort(far[come], kind="stable")]
    near, there, at = far[stay], vec[stay], ids[stay]
    for k in range(0, len(come), step):
        some = come[k : k + step]
        a, b = np.searchsorted(near, far[some[0]] - radius), np.searchsorted(near, far[some[-1]] + radius, "right")
        if b > a:
            yield ids[some], vec[some], at[a:b], there[a:b], same[some]


def near_vectors(vectors: DataFrame, least_cosine: float, most_pivots: int = 4096) -> DataFrame:
    """Pairs (a, b, score), a < b, of unit vectors(asset_id, vec) with at least that dot product, exact.

    Pivots, far apart, split the space: a vector lives at its nearest pivot and visits those where the triangle bound allows a
    partner. There are as many as the root of the row count where the bound leaves visits out, fewer where it can't (a sample tells). In a block only residents at a like distance from the pivot are compared. What remains is compared by matrix products; those within rounding of
    the threshold are summed in order again. Blocks hold at most BLOCK residents and visitors, however many rows live at a pivot. Vectors of other
    lengths than one are searched exactly too, with a wider radius. Null vectors have no pairs.
    """
    blocks, radius = _blocks(vectors.where("vec is not null and asset_id is not null"), least_cosine, most_pivots)

    def meet(table: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for come, va, stay, vb, same in _windows(table, radius):
            i, j = np.nonzero(va @ vb.T >= least_cosine - 1e-9)
            once = np.where(same[i], come[i] < stay[j], come[i] != stay[j])  # those of one pivot see each other twice
            i, j = i[once], j[once]
            score = np.zeros(len(i))
            for c in range(va.shape[1]):  # in the order of a plain sum
                score += va[i, c] * vb[j, c]
            good = score >= least_cosine
            one, two = come[i[good]], stay[j[good]]
            found.append((np.minimum(one, two), np.maximum(one, two), score[good]))
        return pa.table({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(("a", "b", "score"))})

    return blocks.groupBy("pivot", "i", "j").applyInArrow(meet, "a long, b long, score double")


def comparisons(vectors: DataFrame, least_cosine: float, most_pivots: int = 4096) -> int:
    """How many pairs of a visitor and a resident near_vectors compares."""
    blocks, radius = _blocks(vectors, least_cosine, most_pivots)

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"n": [sum(len(a) * len(b) for a, _, b, *_ in _windows(table, radius))]})

    return blocks.groupBy("pivot", "i", "j").applyInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def assigned(benefit: np.ndarray) -> list[int]:
    """The column of each row in a one-to-one assignment of largest total, for a square matrix.

    Rows enter one after another; each follows a cheapest augmenting path under prices that keep all reduced costs
    from being negative.
    """
    n = len(benefit)
    cost = benefit.max(initial=0) - benefit.astype(np.int64)
    row_price, col_price, owner = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    for row in range(n):
        dist, came, done = cost[row] - row_price[row] - col_price, np.full(n, row), np.zeros(n, bool)
        while True:
            open_ = np.where(done, np.iinfo(np.int64).max, dist)
            col = int(open_.argmin())
            reach = int(dist[col])
            done[col] = True
            if owner[col] < 0:
                break
            by = int(owner[col])
            other = reach + cost[by] - row_price[by] - col_price
            better = ~done & (other < dist)
            dist, came = np.where(better, other, dist), np.where(better, by, came)
        passed = np.flatnonzero(done)
        row_price[row] += reach
        for c in passed:
            if owner[c] >= 0:
                row_price[owner[c]] += reach - dist[c]
            col_price[c] += min(0, int(dist[c]) - reach)
        while True:
            by = int(came[col])
            before = int(np.flatnonzero(owner == by)[0]) if by != row else -1
            owner[col] = by
            if by == row:
                break
            col = before
    out = [0] * n
    for c, r in enumerate(owner):
        out[int(r)] = c
    return out


def _carried(new: list[tuple[int, np.ndarray]], old: list[tuple[int, np.ndarray]], least: float) -> list[tuple[int, int, float | None]]:
    size = max(len(new), len(old))
    sim = np.full((size, size), -1.0)
    if new and old:
        sim[: len(new), : len(old)] = np.array([v for _, v in new], float) @ np.array([v for _, v in old], float).T
    got, fresh, out = assigned(((sim + 1) * 1e6).astype(np.int64)), max((k for k, _ in old), default=-1) + 1, []
    for i, (label, _) in enumerate(new):
        j = got[i]
        if j < len(old) and sim[i, j] >= least:
            out.append((label, old[j][0], float(sim[i, j])))
        else:
            out.append((label, fresh, None))
            fresh += 1
    return out


def reassigned(new: DataFrame, old: DataFrame, group: str, least: float) -> DataFrame:
    """(group, label, identity, score): labels of new(group, label, vec) as identities of old(group, identity, vec), group by group.

    Within a group they are matched one to one by the largest total of whole benefits int((dot + 1) * 1e6); pairs below `least` and labels without a partner get
    identities past the group's largest, in the order of labels. A group is one library's named clusters, a bounded list; groups are solved side by side.
    """
    kind = new.schema[group].dataType.simpleString()

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = lambda t, name: sorted(zip(t.column(name).to_pylist(), _stacked(t.column("vec"))), key=lambda r: r[0])
        out = _carried(rows(left, "label"), rows(right, "identity"), least)
        return pa.table({group: pa.array([key[0].as_py()] * len(out), left.schema.field(group).type), "label": pa.array([r[0] for r in out], pa.int64()), "identity": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    a = new.select(group, F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    b = old.select(group, F.col("identity").cast("long").alias("identity"), F.col("vec").cast("array<double>").alias("vec"))
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInArrow(solve, f"{group} {kind}, label long, identity long, score double")
