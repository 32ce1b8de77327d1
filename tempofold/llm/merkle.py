"""Merkle manifest of a dataset: a binary tree of digests per group, a tree of the groups' roots, and a proof per row.

Ranks come from a range sort, so a group of any size is spread over tasks. The bits of a rank are cut
into digits and blocks: the rows of a block meet in one partition, where its digit columns are grouped
away one after the other, each grouping nesting the child structs of the one before and adding the
levels between. A block's digests are the leaves of the next round, 512 times fewer. Proofs are emitted
from the nested structs by transform and inline, without joins inside a block; a block learns the
path above it by one equi-join on its number, so that no row ever holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a digit, digits of a block: 8 children a struct, 512 leaves a block.
BITS, DIGITS = 3, 3
#: Rows of one range of the sort; a small table still has a range for every core.
RANGE_ROWS = 500_000
PATH = "array<struct<left:boolean,digest:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon, value: no two lists of fields read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**instead: Column) -> Column:
    """Digest of a row's fields; keyword arguments stand in for columns."""
    return digest(*(field(instead.get(c, F.col(c))) for c in FIELDS))


def _over(nodes: Column, level: int, height: Column) -> Column:
    """The level over ``nodes`` of a full or last run; one above the tree's height leaves its only node as it is."""
    pair = lambda i: digest(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit("")))
    return F.when(height >= level, F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), pair)).otherwise(nodes)


def _beside(place: Column, levels: Column) -> Column:
    """Siblings on the way up from ``place`` through the levels of one digit; a null digest where a run has one node."""
    step = lambda j: F.struct((F.shiftright(place, j).bitwiseAND(1) == 1).alias("left"), F.get(levels[j], F.shiftright(place, j).bitwiseXOR(1)).alias("digest"))
    return F.array(*(step(j) for j in range(BITS)))


def _blocks(nodes: DataFrame, below: int) -> DataFrame:
    """key, height, block, node, kids, levels from key, height, rank, node, load: one row per block, its digits nested."""
    digits = [f"digit_{k}" for k in range(DIGITS)]
    rows = nodes.select("key", "height", "node", "load", F.shiftright("rank", BITS * DIGITS).alias("block"),
                        *(F.shiftright("rank", BITS * k).bitwiseAND((1 << BITS) - 1).cast("int").alias(d) for k, d in enumerate(digits))).repartition("key", "block")
    inner = ["load"]
    for k, d in enumerate(digits):
        # The rows of a block share a partition already, so none of these groupings shuffles.
        rows = rows.groupBy("key", "height", "block", *digits[k + 1 :]).agg(F.sort_array(F.collect_list(F.struct(F.col(d).alias("place"), "node", *inner))).alias("kids"))
        rows = rows.withColumn("level_0", F.transform("kids", lambda x: x["node"]))
        for j in range(1, BITS + 1):
            rows = rows.withColumn(f"level_{j}", _over(F.col(f"level_{j - 1}"), below + BITS * k + j, F.col("height")))
        rows = rows.withColumn("levels", F.array(*(f"level_{j}" for j in range(BITS)))).withColumn("node", F.get(f"level_{BITS}", F.lit(0))).drop(*(f"level_{j}" for j in range(BITS + 1)))
        inner = ["kids", "levels"]
    return rows


def _leaves(kids: Column, levels: Column, above: Column, depth: int) -> Column:
    """Array of (load, path) of all that is nested in ``kids``."""
    path = lambda x: F.concat(_beside(x["place"], levels), above)
    if depth == 0:
        return F.transform(kids, lambda x: F.struct(x["load"].alias("load"), path(x).alias("path")))
    return F.flatten(F.transform(kids, lambda x: _leaves(x["kids"], x["levels"], path(x), depth - 1)))


def ranked(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with the rank of each row within its ``key`` (from 0) and the height of the key's tree."""
    ranges = max(nodes.count() // RANGE_ROWS, nodes.sparkSession.sparkContext.defaultParallelism)
    by = [F.col("key").asc_nulls_first(), *order]
    placed = common.written(nodes.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # One row per range and key that it holds: as many as there are ranges and keys together.
    tally = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tally = common.written(tally.select("key", "part", "first", F.expr("sum(n) over (partition by key order by part) - n").alias("before"), F.expr("sum(n) over (partition by key)").alias("total")), "merkle-ranges")
    t = tally.select(F.col("key").alias("t_key"), F.col("part").alias("t_part"), "first", "before", F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0).alias("height"))
    joined = placed.join(t, F.col("key").eqNullSafe(F.col("t_key")) & (F.col("part") == F.col("t_part")))
    return joined.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("t_key", "t_part", "part", "at", "first", "before")


class Trees:
    """The trees of all keys: ``nodes`` has key, node and the columns to carry; ``order`` sorts a key's leaves."""

    def __init__(self, nodes: DataFrame, order: list[Column], carried: list[str]):
        rows = ranked(nodes, order).select("key", "height", "rank", "node", F.struct("node", *carried).alias("load"))
        tallest = rows.agg(F.max("height")).first()[0] or 0
        self.rounds = []
        while True:
            done = BITS * DIGITS * len(self.rounds)
            self.rounds.append(common.written(_blocks(rows, done), "merkle-blocks"))
            if done + BITS * DIGITS >= tallest:
                break
            rows = self.rounds[-1].select("key", "height", F.col("block").alias("rank"), "node", F.struct("block").alias("load"))

    def roots(self) -> DataFrame:
        """key, node: one row per tree."""
        return self.rounds[-1].select("key", "node")

    def proofs(self, above: DataFrame) -> DataFrame:
        """load, path (from the leaf up) and the columns of ``above``, which has one row per key (and its name in ``a_key``)."""
        rows, more = above.withColumn("a_block", F.lit(0).cast("long")).withColumn("a_path", F.array().cast(PATH)), [c for c in above.columns if c != "a_key"]
        for k, blocks in reversed(list(enumerate(self.rounds))):
            met = blocks.join(rows, F.col("key").eqNullSafe(F.col("a_key")) & (F.col("block") == F.col("a_block")))
            out = met.select("key", "height", *more, F.inline(_leaves(F.col("kids"), F.col("levels"), F.col("a_path"), DIGITS - 1)))
            if k == 0:
                return out.select("load", F.slice("path", F.lit(1), F.col("height")).alias("path"), *more)
            rows = out.select(F.col("key").alias("a_key"), F.col("load.block").alias("a_block"), F.col("path").alias("a_path"), *more)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, p: digest(F.when(p["left"], p["digest"]).otherwise(F.lit("")), h, F.when(p["left"], F.lit("")).otherwise(F.coalesce(p["digest"], F.lit("")))))


def summary(path: Column) -> Column:
    """Digest of a path's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: p["digest"]), "").cast("binary"), 256)


def prove(docs: DataFrame, key: str = "lang", id_col: str = "doc_id", **carried: Column) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, and ``carried`` columns, computed from the document.

    Leaves are digests of FIELDS. Per ``key`` (null is a key), leaves ascend by id, null ids first, equal
    ids by their digest; two consecutive nodes become one until one remains, a last single node is
    hashed alone. Roots of the keys, ordered by key, null first, go on in the same way. ``path`` lists
    siblings from the leaf to the root: left (whether it stands left of the node), digest (null where
    there is none). Repeated rows are leaves each. No rows in, none out. Other columns are not read.
    """
    if set(carried) & {"key", "node", "salt", "leaf", "path", "root", "subroot", "doc_id"}:
        raise ValueError("a carried column has the name of a result")
    # The salt only spreads rows that are equal in all fields, whose proofs are interchangeable.
    leaves = docs.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id"), leaf().alias("node"), F.monotonically_increasing_id().alias("salt"), *(c.alias(k) for k, c in carried.items()))
    trees = Trees(common.written(leaves, "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("salt")], ["doc_id", *carried])
    top = Trees(trees.roots().select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), [F.col("name").asc_nulls_first()], ["name"])
    root = top.roots().select(F.col("key").alias("a_key"), F.col("node").alias("root"))
    above = top.proofs(root).select(F.col("load.name").alias("a_key"), F.col("load.node").alias("subroot"), "root", F.col("path").alias("upper"))
    rows = trees.proofs(common.written(above, "merkle-roots"))
    return rows.select("load.doc_id", F.col("load.node").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), *(f"load.{c}" for c in carried))


def manifest(proofs: DataFrame) -> DataFrame:
    """root, subroot, rows: what is published beside the data, from the rows of ``prove``."""
    return proofs.groupBy("root", "subroot").agg(F.count(F.lit(1)).alias("rows"))


def tampered() -> Column:
    """Rows that the registered query changes: 7 divides the crc32 of the decimal id (null ids stay)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that a tampered copy of it folds to."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = prove(common.table(spark, sf_dir, "documents"), bent=F.when(tampered() & F.col("n_chars").isNotNull(), leaf(n_chars=more)))
    folded = rows.withColumn("folded_root", fold(F.coalesce("bent", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", summary(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: crc32 bit by bit over the characters of the decimal id.
_CRC_SQL = """xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"""

_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r, *
  FROM (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
          CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS bent FROM documents)),
nodes(lang, lev, i, n, h) AS (
  SELECT lang, 0::BIGINT, i, n, leaf FROM leaves
  UNION ALL
  SELECT lang, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lev, i // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lev, i, n, h) AS (
  SELECT 0::BIGINT, i, n, subroot FROM subs
  UNION ALL
  SELECT lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lev, i // 2, n),
heights AS (SELECT lang, max(lev) AS top FROM nodes GROUP BY lang),
steps AS (
  SELECT l.r, a.lev, (l.i >> a.lev::INT) & 1 AS odd, b.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, lev FROM nodes WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lev = a.lev AND b.i = xor(l.i >> a.lev::INT, 1)
  UNION ALL
  SELECT l.r, t.top + a.lev, (s.i >> a.lev::INT) & 1, b.h
  FROM leaves l JOIN heights t ON t.lang IS NOT DISTINCT FROM l.lang JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
  JOIN (SELECT DISTINCT lev FROM tops WHERE n > 1) a ON true
  LEFT JOIN tops b ON b.lev = a.lev AND b.i = xor(s.i >> a.lev::INT, 1)),
proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY lev), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (r) GROUP BY r),
folds(r, lev, h) AS (
  SELECT r, 0::BIGINT, bent FROM leaves
  UNION ALL
  SELECT f.r, f.lev + 1, sha256(CASE WHEN s.odd = 1 THEN s.sibling || f.h ELSE f.h || coalesce(s.sibling, '') END) FROM folds f JOIN steps s ON s.r = f.r AND s.lev = f.lev),
folded AS (SELECT r, arg_max(h, lev) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h AS root FROM tops WHERE n = 1) ON true JOIN proofs USING (r) JOIN folded USING (r)
"""

QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": _SQL}
