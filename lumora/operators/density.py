"""Density clusters on a grid, whole and incremental: crowded cells are cores at once, cells are linked by their boxes, points meet only at the rim."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.components import components
from lumora.session import settle

#: A box with more points than this meets others in parts; two boxes meet point by point if their counts multiply to no more than SMALL.
PART, SMALL, DEEPEST = 4096, 1024, 12


@dataclass(frozen=True)
class Grid:
    """Cells whose points are all within eps of each other; `least` neighbours, itself included, make a core."""

    eps: float
    least: int
    dims: tuple[str, ...] = ("x", "y", "z")

    @property
    def side(self) -> float:
        return self.eps / len(self.dims) ** 0.5 * (1 - 1e-9)

    def key(self, depth: int = 0) -> Column:
        """The point's cell, or its part of side / 2 ** depth."""
        return F.struct(*(F.floor(F.col(c) / (self.side / (1 << depth))).cast("long").alias(f"c{k}") for k, c in enumerate(self.dims)))

    def box(self) -> list[Column]:
        sides = [f(c).alias(f"{c}_{n}") for c in self.dims for f, n in ((F.min, "lo"), (F.max, "hi"))]
        return [F.count("*").alias("n"), *sides]

    def offsets(self) -> list[tuple[int, ...]]:
        reach = range(-int(len(self.dims) ** 0.5 + 1), int(len(self.dims) ** 0.5 + 1) + 1)
        return [o for o in product(reach, repeat=len(self.dims)) if sum(max(abs(x) - 1, 0) ** 2 for x in o) * self.side**2 <= self.eps**2]

    def around(self, cells: DataFrame, others: DataFrame) -> DataFrame:
        """(a, b): every cell of `cells` with each cell of `others` that a point within eps may be in, itself included."""
        shifts = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in self.offsets())))
        moved = cells.select(F.col("cell").alias("a"), shifts.alias("o"))
        moved = moved.select("a", F.struct(*((F.col(f"a.c{k}") + F.get("o", F.lit(k))).alias(f"c{k}") for k in range(len(self.dims)))).alias("b"))
        return moved.join(others.select(F.col("cell").alias("b")), "b")

    def _squares(self, parts: list[Column]) -> Column:
        total = parts[0] * parts[0]
        for p in parts[1:]:
            total = total + p * p
        return total

    def apart(self, other: str = "2") -> Column:
        return self._squares([F.col(c) - F.col(f"{c}{other}") for c in self.dims])

    def to_box(self) -> tuple[Column, Column]:
        """Squares of the least and largest distance of a point to a box."""
        low = [F.greatest(F.col(f"{c}_lo") - F.col(c), F.col(c) - F.col(f"{c}_hi"), F.lit(0.0)) for c in self.dims]
        high = [F.greatest(F.abs(F.col(c) - F.col(f"{c}_lo")), F.abs(F.col(f"{c}_hi") - F.col(c))) for c in self.dims]
        return self._squares(low), self._squares(high)

    def between(self) -> tuple[Column, Column]:
        """Squares of the least and largest distance of the points of two boxes, the second with names that end in 2."""
        low = [F.greatest(F.col(f"{c}_lo") - F.col(f"{c}_hi2"), F.col(f"{c}_lo2") - F.col(f"{c}_hi"), F.lit(0.0)) for c in self.dims]
        high = [F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo2"), F.col(f"{c}_hi2") - F.col(f"{c}_lo")) for c in self.dims]
        return self._squares(low), self._squares(high)

    @property
    def limit(self) -> float:
        return self.eps * self.eps


def _reached(grid: Grid, ps: DataFrame, pts: DataFrame, load: list[str], put: Column, sure: Column) -> DataFrame:
    """(id, v): for each of ps, `put` over what lies within eps: whole boxes of pts by themselves (`sure`), points only of boxes that the rim cuts.

    ps are points of cells with few of them. Boxes are parts of cells; `load` are columns that all points of a cell share. A rim box with many points
    is dealt out in parts, so one place with most of the points is no one task's.
    """
    boxes = settle(pts.groupBy("cell", grid.key(2).alias("sub"), *load).agg(*grid.box()).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    near = grid.around(ps.select("cell").distinct(), boxes.select("cell").distinct())
    low, high = grid.to_box()
    seen = ps.select("id", *grid.dims, F.col("cell").alias("a")).join(near, "a").join(boxes.withColumnRenamed("cell", "b"), "b").withColumns({"low": low, "high": high}).where(F.col("low") <= grid.limit)
    whole = seen.where(F.col("high") <= grid.limit).groupBy("id").agg(sure.alias("v"))
    rim = seen.where(F.col("high") > grid.limit).select("id", *grid.dims, "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pts.withColumn("sub", grid.key(2)).join(boxes.select("sub", "parts"), "sub").select("sub", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), *load, *(F.col(c).alias(f"{c}2") for c in grid.dims))
    met = rim.join(dealt, ["sub", "part"]).where(grid.apart() <= grid.limit).withColumn("n", F.lit(1).cast("long"))
    return whole.unionByName(met.groupBy("id").agg(sure.alias("v"))).groupBy("id").agg(put.alias("v"))


def _counted(grid: Grid, ps: DataFrame, pts: DataFrame) -> DataFrame:
    return _reached(grid, ps, pts, [], F.sum("v"), F.sum("n"))


def _bordered(grid: Grid, ps: DataFrame, cores: DataFrame) -> DataFrame:
    """(id, cluster): the smallest cluster with a core within eps of each of ps; cores have their cell's cluster."""
    return _reached(grid, ps, cores, ["cluster"], F.min("v"), F.min("cluster")).withColumnRenamed("v", "cluster")


def _linked(grid: Grid, pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """Those of the cell pairs (a, b) with two cores within eps of each other.

    Boxes of the cores decide: linked if their farthest points are within eps, not if their nearest sides aren't. Else small boxes meet point by point, and
    larger ones are halved in each dimension, until all pairs are decided. So two crowded cells cost some boxes, not the product of their points.
    """
    second = lambda df, key: df.select(key, F.col("n").alias("n2"), *(F.col(f"{c}_{s}").alias(f"{c}_{s}2") for c in grid.dims for s in ("lo", "hi")))
    low, high = grid.between()
    boxes = settle(cores.groupBy(grid.key().alias("ka")).agg(*grid.box()))
    now = pairs.select("a", "b", F.col("a").alias("ka"), F.col("b").alias("kb"))
    done = None
    for depth in range(DEEPEST + 1):
        both = now.join(boxes, "ka").join(second(boxes.withColumnRenamed("ka", "kb"), "kb"), "kb").withColumns({"low": low, "high": high})
        both = settle(both.where(F.col("low") <= grid.limit).select("a", "b", "ka", "kb", (F.col("n") * F.col("n2")).alias("work"), (F.col("high") <= grid.limit).alias("sure")))
        left = both.where(~F.col("sure")) if depth == DEEPEST else both.where(~F.col("sure") & (F.col("work") <= SMALL))
        mine = cores.select(grid.key(depth).alias("ka"), *grid.dims)
        other = cores.select(grid.key(depth).alias("kb"), *(F.col(c).alias(f"{c}2") for c in grid.dims))
        met = left.select("a", "b", "ka", "kb").join(mine, "ka").join(other, "kb").where(grid.apart() <= grid.limit)
        found = both.where("sure").select("a", "b").unionByName(met.select("a", "b")).distinct()
        done = settle(found if done is None else done.unionByName(found).distinct())
        large = both.where(~F.col("sure") & (F.col("work") > SMALL)).join(done, ["a", "b"], "left_anti").select("a", "b", "ka", "kb")
        if depth == DEEPEST or large.isEmpty():
            return done
        kids = settle(cores.groupBy(grid.key(depth).alias("up"), grid.key(depth + 1).alias("ka")).agg(*grid.box()))
        deeper = large.join(kids.select(F.col("up").alias("ka"), F.col("ka").alias("da")), "ka").join(kids.select(F.col("up").alias("kb"), F.col("ka").alias("db")), "kb")
        now, boxes = deeper.select("a", "b", F.col("da").alias("ka"), F.col("db").alias("kb")), kids.drop("up")
    raise AssertionError


def density_grid(points: DataFrame, grid: Grid) -> DataFrame:
    """points(id, dims...) with `core` and `cluster`: DBSCAN, exact, without a list of neighbour pairs; a written table that `grown` can go on from.

    Points of a cell with `least` points are cores without a look at any other; only points of emptier cells are counted, by boxes where these lie
    within eps. Cells with cores are linked by boxes (`_linked`); clusters are components of cells and take their smallest core's id.
    Other points join the neighbouring cluster of smallest id, the rest have cluster null. Points at one place cost one box. Null coordinates are noise.
    """
    known = F.lit(True)
    for c in grid.dims:
        known = known & F.col(c).isNotNull()
    pts = settle(points.where(known).select("id", *(F.col(c).cast("double").alias(c) for c in grid.dims)).withColumn("cell", grid.key()))
    sizes = settle(pts.groupBy("cell").agg(F.count("*").alias("n")))
    thin = pts.join(sizes.where(F.col("n") < grid.least).select("cell"), "cell", "left_semi")
    counts = _counted(grid, thin, pts).where(F.col("v") >= grid.least).select("id")
    cores = pts.join(sizes.where(F.col("n") >= grid.least).select("cell"), "cell", "left_semi").unionByName(thin.join(counts, "id", "left_semi").select(*pts.columns))
    cores = settle(cores)
    cells = settle(cores.groupBy("cell").agg(F.min("id").alias("least_id")))
    # a cell goes by its smallest core, so the smallest name of a component is its cluster's
    links = _linked(grid, grid.around(cells, cells).where("a < b"), cores)
    one, two = cells.select(F.col("cell").alias("a"), F.col("least_id").alias("la")), cells.select(F.col("cell").alias("b"), F.col("least_id").alias("lb"))
    roots = components(links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    named = cells.join(roots, cells["least_id"] == roots["node"], "left").select("cell", F.coalesce("root", "least_id").alias("cluster"))
    inside = settle(cores.join(named, "cell").select("id", *grid.dims, "cell", "cluster"))
    rest = thin.join(inside.select("id"), "id", "left_anti")
    border = _bordered(grid, rest, inside)
    out = inside.select("id", *grid.dims, F.lit(True).alias("core"), "cluster").unionByName(rest.join(border, "id", "left").select("id", *grid.dims, F.lit(False).alias("core"), "cluster"))
    lost = points.where(~known).select("id", *(F.col(c).cast("double").alias(c) for c in grid.dims), F.lit(False).alias("core"), F.lit(None).cast(out.schema["cluster"].dataType).alias("cluster"))
    return settle(out.unionByName(lost))


def grown(state: DataFrame, fresh: DataFrame, grid: Grid) -> DataFrame:
    """The result of density_grid over the points of state and fresh together, from state and the surroundings of fresh alone.

    Cores stay cores. Only points in cells around fresh points are counted again, only cells with new cores are linked, labels change only in clusters that a
    link joins, and only fresh points and points around those or around new cores look for a cluster. New ids must not be in state.
    """
    dims = list(grid.dims)
    known = F.lit(True)
    for c in dims:
        known = known & F.col(c).isNotNull()
    every = state.select("id", *dims, "core", "cluster").unionByName(fresh.select("id", *(F.col(c).cast("double").alias(c) for c in dims), F.lit(False).alias("core"), F.lit(None).cast(state.schema["cluster"].dataType).alias("cluster")))
    lost = every.where(~known)
    every = settle(every.where(known).withColumn("cell", grid.key()))
    cells = settle(every.groupBy("cell").agg(F.count("*").alias("n")))
    came = fresh.where(known).select(grid.key().alias("cell")).distinct()
    touched = settle(grid.around(came, cells).select(F.col("b").alias("cell")).distinct())
    context = grid.around(touched, cells).select(F.col("b").alias("cell")).distinct()
    asked = settle(every.where(~F.col("core")).join(touched, "cell", "left_semi").join(cells, "cell"))
    counted = _counted(grid, asked.where(F.col("n") < grid.least), every.join(context, "cell", "left_semi")).where(F.col("v") >= grid.least).select("id")
    full = asked.where(F.col("n") >= grid.least).select("id")
    risen = settle(full.unionByName(counted))
    new = every.where(~F.col("core")).join(risen, "id", "left_semi").withColumn("cluster", F.col("id"))
    cores = settle(every.where("core").unionByName(new))
    labels = settle(cores.groupBy("cell").agg(F.min("cluster").alias("label")))
    new_cells = new.select("cell").distinct()
    around = grid.around(new_cells, labels.select("cell"))
    pairs = around.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    close = cores.join(around.select(F.col("b").alias("cell")).distinct(), "cell", "left_semi")
    links = _linked(grid, pairs, close)
    one, two = labels.select(F.col("cell").alias("a"), F.col("label").alias("la")), labels.select(F.col("cell").alias("b"), F.col("label").alias("lb"))
    edges = links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    own = cores.join(new_cells, "cell", "left_semi").join(labels, "cell").select(F.col("cluster").alias("a"), F.col("label").alias("b")).distinct()
    roots = components(edges.unionByName(own)).where("node <> root").select(F.col("node").alias("cluster"), "root")
    settled = cores.join(roots, "cluster", "left").withColumn("moved", F.col("root").isNotNull())
    settled = settle(settled.withColumn("cluster", F.coalesce("root", "cluster")).select("id", *dims, "cell", "cluster", "moved"))
    # clusters that took others in kept their name, so only cells of renamed clusters and of new cores can change a border point
    changed = settled.where("moved").select("cell").unionByName(new_cells).distinct()
    open_cells = settle(grid.around(changed, cells).select(F.col("b").alias("cell")).unionByName(came).distinct())
    rest = every.where(~F.col("core")).join(risen, "id", "left_anti")
    again = rest.join(open_cells, "cell", "left_semi")
    reach = settled.join(grid.around(open_cells, cells).select(F.col("b").alias("cell")).distinct(), "cell", "left_semi")
    border = _bordered(grid, again, reach)
    out = settled.select("id", *dims, F.lit(True).alias("core"), "cluster")
    out = out.unionByName(rest.join(open_cells, "cell", "left_anti").select("id", *dims, "core", "cluster"))
    out = out.unionByName(again.drop("cluster").join(border, "id", "left").select("id", *dims, "core", "cluster"))
    return settle(out.unionByName(lost))
