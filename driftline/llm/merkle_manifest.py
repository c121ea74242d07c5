"""A Merkle manifest of a table of documents, with a proof for each row and a test of tampered rows.

Leaves are hashed where the texts are read, as one expression; from there on only ids and digests move. Rows are numbered
in their language by sorted ranges, so that a language of a third of all rows is many ranges. 8^DEPTH consecutive
leaves are a bucket, aligned so that it is a whole subtree. An executor loads a bucket from Arrow into DuckDB, which
builds its levels by ordered string_agg and sha256. Bucket roots are the leaves of the next storey, which is built in the same
way, until one node is left in each language; the languages' roots make the last tree. Then each storey, from the top, joins
its buckets to the proofs found above, and DuckDB adds the siblings of its own levels. Each storey holds 8^DEPTH times fewer
nodes than the one below; a task holds one bucket.

Proofs are kept as steps (what stands left and right of the node in its run), so that folding a tampered leaf needs no other
row. A node alone in its run has an empty step.

Defined results: any null column of a row is hashed as "-"; a missing source, lang, n_chars or text column counts as null.
Rows of equal (lang, doc_id), repeated rows among them, follow by their leaf; a null doc_id comes first. Tampering that
changes nothing (no A-Z, null text) leaves the row verified; a row without an id is not tampered with. A row alone in
the table is its own root and has the proof of no siblings. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import stored, table
from driftline.operators.archive import numbered

FAN, DEPTH = 8, 4
#: Trees whose sizes may be broadcast.
BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value with the number of its bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language, so written that null comes first), doc_id, hash and changed (the tampered row's hash)."""
    have = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None) for c in ("doc_id", "source", "lang", "n_chars", "text")}

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[field(have[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)

    doc_id, own = have["doc_id"].cast("long"), leaf(have["text"])
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf(F.translate(have["text"], UPPER, LOWER))).otherwise(own)
    tree = F.coalesce(F.concat(F.lit("1"), have["lang"].cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), doc_id.alias("doc_id"), own.alias("hash"), changed.alias("changed"))


def in_trees(rows: DataFrame, order: list[str], depth: int) -> DataFrame:
    """rows with n (of their tree), bucket, place (in the bucket) and levels (that are left to its root, depth at most)."""
    rows = numbered(rows, ["tree", *order], "number")
    sizes = stored(rows.groupBy("tree").agg(F.min("number").alias("first"), F.count("*").alias("n")), "sizes")
    own = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes, "tree")
    return placed(own.withColumn("number", F.col("number") - F.col("first")).drop("first"), depth)


def placed(nodes: DataFrame, depth: int) -> DataFrame:
    """Buckets and places of nodes that carry their number (from 0) and their tree's n."""
    levels = reduce(lambda so_far, k: so_far + (F.col("n") > FAN**k).cast("int"), range(depth), F.lit(0))
    seat = [F.floor(F.col("number") / FAN**depth).alias("bucket"), (F.col("number") % FAN**depth).alias("place"), levels.alias("levels")]
    return nodes.select(*nodes.columns, *seat)


class Block:
    """The levels of one bucket in DuckDB. level_k holds node (its number) and hash."""

    def __init__(self, rows: pa.Table):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.register("rows", rows)
        self.depth = rows.column("levels")[0].as_py()
        self.db.execute("CREATE TABLE level_0 AS SELECT place AS node, hash FROM rows")
        for k in range(self.depth):
            self.db.execute(f"CREATE TABLE level_{k + 1} AS SELECT node // {FAN} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM level_{k} GROUP BY 1")

    def root(self) -> str:
        return self.db.execute(f"SELECT hash FROM level_{self.depth}").fetchone()[0]

    def with_steps(self) -> str:
        """SQL of the rows with steps, from their own level up to the bucket's root."""
        for k in range(self.depth):
            run = f"OVER (PARTITION BY node // {FAN} ORDER BY node ROWS BETWEEN"
            before, after = f"{run} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"{run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            self.db.execute(f"CREATE TABLE step_{k} AS SELECT node, {{'before': coalesce(string_agg(hash, '') {before}, ''), 'after': coalesce(string_agg(hash, '') {after}, '')}} AS step FROM level_{k}")
        joins = " ".join(f"JOIN step_{k} ON step_{k}.node = rows.place // {FAN**k}" for k in range(self.depth))
        steps = ", ".join(f"step_{k}.step" for k in range(self.depth))
        return f"SELECT rows.*, [{steps}] AS own FROM rows {joins}"

    def __enter__(self) -> Block:
        return self

    def __exit__(self, *error) -> None:
        self.db.close()


def bucket_roots(rows: DataFrame, depth: int) -> DataFrame:
    """tree, number (of the bucket, from 0), n (the tree's buckets), hash."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        with Block(rows) as block:
            return pa.table({"tree": [key[0].as_py()], "number": [key[1].as_py()], "n": [-(-rows.column("n")[0].as_py() // FAN**depth)], "hash": [block.root()]})

    slim = rows.select("tree", "bucket", "place", "levels", "n", "hash")
    return slim.groupBy("tree", "bucket").applyInArrow(run, "tree string, number long, n long, hash string")


def storeys(rows: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The storeys above the leaves, and the roots (tree, hash) of their trees."""
    above = []
    roots = stored(bucket_roots(rows, depth), "roots")
    while roots.filter("n > 1").limit(1).count():
        above.append(placed(roots, depth))
        roots = stored(bucket_roots(above[-1], depth), "roots")
    return above, roots.select("tree", "hash")


def down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """tree, number, steps of each node of a storey; outer: tree, number, steps of the nodes above, which are its buckets."""

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        with Block(rows) as block:
            block.db.register("above", above)
            return arrow(block.db.sql(f"SELECT tree, number, list_concat(own, (SELECT steps FROM above)) AS steps FROM ({block.with_steps()})"))

    above = outer.select("tree", F.col("number").alias("bucket"), "steps")
    return nodes.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInArrow(run, f"tree string, number long, steps {STEPS}")


def arrow(found: duckdb.DuckDBPyRelation) -> pa.Table:
    return found.to_arrow_table()


def proofs(rows: DataFrame, outer: DataFrame, root: str) -> DataFrame:
    """The result rows; rows: the seated leaves, outer: tree, number, steps and subroot of their buckets."""

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        with Block(rows) as block:
            block.db.register("above", above)
            steps = block.depth + len(above.column("steps")[0])
            block.db.execute(f"CREATE TABLE told AS SELECT doc_id, hash, changed, list_concat(own, (SELECT steps FROM above)) AS steps FROM ({block.with_steps()})")
            # one sha256 for each level, the leaf innermost
            folded = reduce(lambda h, k: f"sha256(steps[{k}].before || {h} || steps[{k}].after)", range(1, steps + 1), "changed")
            siblings = " || ".join(f"steps[{k}].before || steps[{k}].after" for k in range(1, steps + 1)) or "''"
            return arrow(
                block.db.sql(
                    f"SELECT doc_id, hash AS leaf, (SELECT subroot FROM above) AS subroot, '{root}' AS root, sha256({siblings}) AS proof_sha256, "
                    f"{folded} AS folded_root, {folded} = '{root}' AS verified FROM told"
                )
            )

    above = outer.select("tree", F.col("number").alias("bucket"), "steps", "subroot")
    own = rows.select("tree", "bucket", "place", "levels", "doc_id", "hash", "changed")
    return own.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInArrow(run, SCHEMA)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The columns of SCHEMA for each row of docs; a bucket holds 8^depth rows."""
    rows = in_trees(stored(leaves(docs), "leaves"), ["doc_id", "hash"], depth)
    above, subroots = storeys(rows, depth)
    # the last tree has the languages' roots as leaves
    named = numbered(subroots.withColumnRenamed("tree", "name"), ["name"], "number").withColumn("number", F.col("number") - 1)
    n = named.count()
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    top = placed(named.select(F.lit("").alias("tree"), "hash", "number", F.lit(n).cast("long").alias("n")), depth)
    over, root = storeys(top, depth)
    steps = downwards([*over[::-1], top], root.select("tree", F.lit(0).cast("long").alias("number"), F.array().cast(STEPS).alias("steps")))
    trees = steps.select("number", "steps").join(named.select("number", F.col("name").alias("tree"), F.col("hash").alias("subroot")), "number")
    trees = stored(trees.select("tree", "steps", "subroot"), "trees")
    steps = downwards(above[::-1], trees.select("tree", F.lit(0).cast("long").alias("number"), "steps"))
    subs = trees.select("tree", "subroot")
    outer = stored(steps.join(F.broadcast(subs) if n <= BROADCAST else subs, "tree"), "steps")
    return proofs(rows, outer, root.first()["hash"])


def downwards(above: list[DataFrame], steps: DataFrame) -> DataFrame:
    """tree, number, steps of the last of the storeys, which go down from the one below steps."""
    for nodes in above:
        steps = down(nodes, steps)
    return steps


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: Levels that the oracle unrolls: 8^LEVELS rows a language, and as many languages.
LEVELS = 8


def oracle_tree(name: str, source: str, levels: int = LEVELS) -> list[str]:
    """CTEs name_0 to name_levels (tree, node, hash), each a level higher; a node alone in its tree stays as it is."""
    out = [f"{name}_0 AS ({source})"]
    for k in range(levels):
        below = f"(SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_{k})"
        out.append(
            f"{name}_{k + 1} AS (SELECT tree, CASE WHEN n = 1 THEN node ELSE node // {FAN} END AS node, "
            f"CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY node)) END AS hash FROM {below} GROUP BY tree, CASE WHEN n = 1 THEN node ELSE node // {FAN} END)"
        )
        run = f"OVER (PARTITION BY tree, node // {FAN} ORDER BY node ROWS BETWEEN"
        sides = f"coalesce(string_agg(hash, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(hash, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"
        out.append(f"{name}_step_{k} AS (SELECT tree, node, n > 1 AS climbs, {sides} FROM {below})")
    return out


def oracle() -> str:
    def item(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(item(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    # crc32 by the reversed polynomial, bit by bit, over the digits of the id
    bits = "list_reduce(list_prepend(xor(acc, ascii(digit)), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda acc, digit: {bits.replace('ascii(digit)', 'digit')}), 4294967295)"
    tampered = f"CASE WHEN {crc} % 3 = 0 THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} ELSE {leaf('text')} END"
    parts = [f"told AS (SELECT coalesce('1' || lang, '0') AS tree, doc_id, {leaf('text')} AS hash, {tampered} AS changed FROM documents)"]
    parts.append("seats AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS node FROM told)")
    parts += oracle_tree("own", "SELECT tree, node, hash FROM seats")
    parts.append(f"subs AS (SELECT tree AS name, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS seat FROM own_{LEVELS})")
    parts += oracle_tree("top", "SELECT '' AS tree, seat AS node, subroot AS hash FROM subs")
    folded, siblings = "changed", []
    joins = ""
    for name, key, node in (("own", "seats.tree", "seats.node"), ("top", "''", "subs.seat")):
        for k in range(LEVELS):
            s = f"{name}_step_{k}"
            # a node that has become its tree's root keeps the number 0 up to the top
            joins += f" JOIN {s} ON {s}.tree = {key} AND {s}.node = {node} // {FAN**k}"
            siblings.append(f"CASE WHEN {s}.climbs THEN {s}.before || {s}.after ELSE '' END")
            joins += f" CROSS JOIN LATERAL (SELECT CASE WHEN {s}.climbs THEN sha256({s}.before || {folded} || {s}.after) ELSE {folded} END AS f) AS {name}_fold_{k}"
            folded = f"{name}_fold_{k}.f"
        if name == "own":
            joins += " JOIN subs ON subs.name = seats.tree"
    parts.append(f"final AS (SELECT doc_id, seats.hash AS leaf, subroot, (SELECT hash FROM top_{LEVELS}) AS root, sha256({' || '.join(siblings)}) AS proof_sha256, {folded} AS folded_root FROM seats{joins})")
    return f"WITH {', '.join(parts)} SELECT *, folded_root = root AS verified FROM final"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": oracle()}
