"""Merkle manifest of a dataset: levels stored as parent-linked node rows, climbed by a recursive query that folds each leaf."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.session import discard, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tables of at most this many rows are broadcast in joins; larger ones meet by a shuffle.
FEW = 10_000


def written(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the written fields, one after another."""
    return F.sha2(F.concat(*map(written, fields)), 256)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with a gapless `place` from 0 in the order given, as a written table: ranges are sorted apart and offset by the counts before them.

    Equal rows are told apart by where they were read, so that no range holds more than its share of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("__read", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(parts, *order, "__read").sortWithinPartitions(*order, "__read")
    kept = settle(dealt.drop("__read").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return kept.withColumn("__part", part).join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + local).alias("place"))


def _depth(n: str) -> str:
    """SQL: levels above the leaves of a tree of n leaves."""
    return f"IF({n} > 1, length(bin({n} - 1)), 0)"


def _climbed(rows: DataFrame, tier: int, stride: int) -> DataFrame:
    """rows(tree, n, pos, hash, load) by blocks of 2 ** stride: (tree, n, block, top, nodes), a written table.

    nodes are the block's rows with their link: `sides` has a letter for each level up to the block's top (L or R: where the sibling stands,
    `-`: none), `sibs` those siblings' digests, 32 bytes each. A block holds at most 2 ** stride rows.
    """
    all_levels = "array(" + ", ".join(map(str, range(stride))) + ")"
    levels = f"slice({all_levels}, 1, CAST(least({stride}, greatest(0, {_depth('n')} - {stride * tier})) AS INT))"
    by = rows.groupBy("tree", "n", F.expr(f"shiftright(pos, {stride})").alias("block"))
    got = by.agg(F.array_sort(F.collect_list(F.struct(F.expr(f"CAST(pos & {(1 << stride) - 1} AS INT)").alias("i"), "hash", "load"))).alias("items"))
    pair = "sha2(concat(element_at(up, -1)[2 * j], coalesce(get(element_at(up, -1), 2 * j + 1), '')), 256)"
    grown = f"aggregate({levels}, array(transform(items, x -> x.hash)), (up, k) -> array_append(up, transform(sequence(0, (size(element_at(up, -1)) - 1) div 2), j -> {pair})))"
    got = got.withColumn("levels", F.expr(grown))
    at = "get(levels[k], shiftright(x.i, k) ^ 1)"
    sides = f"array_join(transform({levels}, k -> CASE WHEN {at} IS NULL THEN '-' WHEN shiftright(x.i, k) & 1 = 1 THEN 'L' ELSE 'R' END), '')"
    sibs = f"unhex(array_join(transform({levels}, k -> coalesce({at}, '')), ''))"
    node = f"transform(items, x -> struct((block << {stride}) + x.i AS pos, x.load AS load, {sides} AS sides, {sibs} AS sibs))"
    return settle(got.select("tree", "n", "block", F.expr("element_at(levels, -1)[0]").alias("top"), F.expr(node).alias("nodes")))


def _tiers(rows: DataFrame, stride: int, deepest: int) -> list[DataFrame]:
    """The written blocks of each tier of `stride` levels, from the leaves to the tops of all trees."""
    out = [_climbed(rows, 0, stride)]
    while len(out) * stride < deepest:
        tops = out[-1].select("tree", "n", F.col("block").alias("pos"), F.col("top").alias("hash"), F.lit(None).cast("int").alias("load"))
        out.append(_climbed(tops.where(F.expr(f"{_depth('n')} > {len(out) * stride}")), len(out), stride))
    return out


def _links(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", "n", "block", F.explode("nodes").alias("x")).select("tree", "n", "block", "x.*")


def _hops(n: str, stride: int) -> str:
    return f"CAST(greatest(1, ceil({_depth(n)} / {stride})) AS INT)"


@contextmanager
def _any_rows(spark: SparkSession) -> Iterator[None]:
    """Recursive queries may return any number of rows in here; rounds stay few, as each climbs several levels."""
    name = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


FOLD = """aggregate(slice(array({levels}), 1, length({sides})), named_struct('h', {start}, 'at', 0), (a, k) -> named_struct(
 'h', sha2(CASE substr({sides}, k, 1) WHEN 'L' THEN concat(lower(hex(substr({sibs}, 32 * a.at + 1, 32))), a.h)
 WHEN 'R' THEN concat(a.h, lower(hex(substr({sibs}, 32 * a.at + 1, 32)))) ELSE a.h END, 256),
 'at', a.at + IF(substr({sides}, k, 1) = '-', 0, 1)), a -> a.h)"""

CLIMB = """WITH RECURSIVE climb (id, tree, block, leaf, hops, hop, folded, proof) AS (
SELECT load.id, tree, block, load.leaf, hops, 1, {first}, sibs FROM {leaves}
UNION ALL
SELECT c.id, c.tree, c.block, c.leaf, c.hops, c.hop + 1, {next}, concat(c.proof, u.sibs)
FROM climb c JOIN {upper} u ON u.tree = c.tree AND u.block = c.block AND u.hop = c.hop)
SELECT id, tree, lower(hex(leaf)) AS leaf, folded, sha2(lower(hex(proof)), 256) AS proof FROM climb WHERE hop = hops"""


def manifest(df: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", stride: int = 8) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: its place in the dataset's Merkle tree, climbed leaf by leaf.

    A leaf is the hash of the row's written fields. Within each value of tree_col leaves ascend by id (nulls first, ties by leaf); while more than one
    node remains, every two become the hash of their hex digests, a last one alone is hashed alone. Subroots, null first, then by bytes, give the root
    in the same way. `claimed` is the leaf hash to be folded (null: the true one); verified says that it led to the root.

    Leaves are numbered by sorted ranges and grouped into blocks of 2 ** stride, which build `stride` levels at a time; each node row stores its
    siblings up to the next stored level and is linked to the node there. Above the first blocks, link rows are written once for each bottom block, so
    in the recursive query, which climbs a stored link a round, no key has more than 2 ** stride rows, at the root as at the bottom. Rounds:
    levels / stride. Rows of several trees or very large trees spread over all tasks alike.

    Null ids, texts and fields are written as `-`; a null id sorts first. Repeated rows are leaves of their own, next to one another. Empty tables give
    no rows. Only the named columns are read, so other columns cannot clash.
    """
    spark = df.sparkSession
    own = {c: F.col(f"`{c}`") for c in fields}
    leaf = row_hash([own[c] for c in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = df.select(F.col(f"`{id_col}`").alias("id"), tree.alias("tree"), F.unhex(leaf).alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows = numbered(rows.withColumn("claimed", F.unhex("claimed")), ["tree", "id", "leaf"])
    trees = settle(rows.groupBy("tree").agg(F.min("place").alias("start"), F.count("*").alias("n")))
    n_trees, largest = trees.agg(F.count("*"), F.max("n")).first()
    placed = rows.join(_small(trees), "tree").select(
        "tree", "n", (F.col("place") - F.col("start")).alias("pos"), F.lower(F.hex("leaf")).alias("hash"), F.struct("id", "leaf", F.coalesce("claimed", "leaf").alias("claimed")).alias("load")
    )
    tiers = _tiers(placed, stride, max(0, ((largest or 1) - 1).bit_length()))

    tops = None
    for k, blocks in enumerate(tiers):
        ended = blocks.where(F.expr(f"{_hops('n', stride)} = {k + 1}")).select("tree", "n", F.col("top").alias("subroot"))
        tops = ended if tops is None else tops.unionByName(ended)
    ordered = numbered(tops.select("tree", "subroot"), ["tree"])
    forest = ordered.select(F.lit("").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("place").alias("pos"), F.col("subroot").alias("hash"), F.col("tree").alias("load"))
    crown = _tiers(forest, stride, max(0, (n_trees - 1).bit_length()))
    row = crown[-1].select("top").first()
    root = F.lit(row[0] if row else None).cast("string")

    bottoms = tiers[0].select("tree", "n", "block")
    upper = []
    for k, blocks in enumerate(tiers[1:], 1):
        link = _links(blocks).select("tree", F.col("pos").alias("up"), "sides", "sibs")
        met = bottoms.withColumn("up", F.expr(f"shiftright(block, {stride * (k - 1)})")).join(_small(link), ["tree", "up"])
        upper.append(met.select("tree", "block", F.lit(k).alias("hop"), "sides", "sibs"))
    names = _links(crown[0]).select(F.col("load").alias("tree"), F.col("pos").alias("rank"), "sides", "sibs")
    for k, blocks in enumerate(crown):
        link = names if not k else names.select("tree", F.expr(f"shiftright(rank, {stride * k})").alias("pos")).join(_small(_links(blocks).select("pos", "sides", "sibs")), "pos")
        met = bottoms.join(_small(link.select("tree", "sides", "sibs")), "tree")
        upper.append(met.select("tree", "block", F.expr(f"{_hops('n', stride)} + {k}").alias("hop"), "sides", "sibs"))
    above = upper[0]
    for more in upper[1:]:
        above = above.unionByName(more)
    above = settle(above)

    leaves = _links(tiers[0]).withColumn("hops", F.expr(f"{_hops('n', stride)} + {len(crown)}"))
    levels = ", ".join(str(k + 1) for k in range(stride))
    text = CLIMB.replace("{first}", FOLD.format(levels=levels, sides="sides", sibs="sibs", start="lower(hex(load.claimed))"))
    text = text.replace("{next}", FOLD.format(levels=levels, sides="u.sides", sibs="u.sibs", start="c.folded"))
    with _any_rows(spark):
        climbed = settle(spark.sql(text, leaves=leaves, upper=above))
    out = climbed.join(_small(tops.select("tree", "subroot")), "tree")
    out = settle(out.select("id", "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified")))
    discard(climbed, above, trees, *tiers, *crown)
    return out


def tampered(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_chars", every: int = 7, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf hash of a row whose size is one larger, for ids whose CRC-32 of the decimal id `every` divides; null for others."""
    more = {c: F.col(f"`{c}`") for c in fields}
    more[size_col] = (F.col(f"`{size_col}`").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return F.when(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % every == 0, row_hash([more[c] for c in fields]))
