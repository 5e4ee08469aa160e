"""Merkle manifest of a documents table: a leaf for each row, a tree for each language, a tree over languages.

Nested-struct rollup. The rank of a leaf is written as binary digits: the high ones name a bounded block, each
of the low ones is a column. One shuffle brings a block together; then the digit columns are grouped away one
after the other, each step nesting two child structs in their parent, until a block is one struct that holds
its whole subtree. Blocks of blocks follow in the same way, with only the hashes. At the end a transform walks
down the nested structs with the siblings that it passes, and an explode emits every row's proof: within a
block no proof needs a join. Only the path above a block, one row for BLOCK leaves, is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .ranks import ranked

#: Levels that are nested in one block: 1,024 leaves.
BITS = 10
PATH = "array<struct<side:int,h:string>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Text of a leaf's field: '-' for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return _hash(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))


def _levels(n: Column) -> Column:
    """ceil(log2(n)), from the binary digits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def roll(items: DataFrame, base: int, payload: list[str] = []) -> DataFrame:
    """A row for each block of 2 ** BITS items: group, block, levels and node, the block's nested struct.

    Items have group, rank, levels (those of the group's whole tree), h and the payload columns. `base` is the
    level that items stand on. Nodes above a group's last level are passed on unhashed.
    """
    digits = [f"digit{j}" for j in range(BITS)]
    rows = items.select(
        "group", F.shiftright("rank", BITS).alias("block"), "levels", *[F.shiftright("rank", j).bitwiseAND(F.lit(1)).alias(d) for j, d in enumerate(digits)],
        F.struct("h", *payload).alias("node"),
    ).repartition("group", "block")
    for j, digit in enumerate(digits):
        child = lambda which: F.first(F.when(F.col(digit) == which, F.col("node")), ignorenulls=True)  # noqa: E731, B023
        rows = rows.groupBy("group", "block", "levels", *digits[j + 1 :]).agg(child(0).alias("left"), child(1).alias("right"))
        parent = _hash(F.col("left.h"), F.coalesce("right.h", F.lit("")))
        h = F.when(F.col("levels") > base + j, parent).otherwise(F.col("left.h"))
        kids = F.array_compact(F.array("left", "right"))
        rows = rows.select("group", "block", "levels", *digits[j + 1 :], F.struct(h.alias("h"), kids.alias("kids")).alias("node"))
    return rows


def unroll(blocks: DataFrame, base: int, payload: list[str] = []) -> DataFrame:
    """The items of `blocks` again: group, rank, h, payload and path, the siblings from the item up to the end
    of `above`, the block's own path. Side 1 is a sibling on the right, -1 on the left, 0 a run of one."""

    def walk(node: Column, level: int, passed: list[Column], place: Column) -> Column:
        if level == 0:
            path = F.array_compact(F.array(*reversed(passed)))
            return F.array(F.struct(place.alias("place"), node["h"].alias("h"), *[node[p].alias(p) for p in payload], path.alias("path")))

        def down(kid: Column, i: Column) -> Column:
            other = F.get(node["kids"], 1 - i)["h"]
            side = F.when(other.isNull(), 0).when(i == 0, 1).otherwise(-1)
            step = F.when(F.col("levels") > base + level - 1, F.struct(side.alias("side"), other.alias("h")))
            return walk(kid, level - 1, [*passed, step], 2 * place + i)

        return F.flatten(F.transform(node["kids"], down))

    rest = [c for c in blocks.columns if c not in ("node", "block", "levels", "above")]
    rows = blocks.select(*rest, "block", "above", F.explode(walk(F.col("node"), BITS, [], F.lit(0))).alias("item"))
    return rows.select(
        *rest, (F.shiftleft("block", BITS) + F.col("item.place")).alias("rank"), "item.h", *[f"item.{p}" for p in payload],
        F.concat("item.path", "above").alias("path"),
    )


def tree(items: DataFrame, most: int, payload: list[str] = []) -> list[DataFrame]:
    """Saved tables of blocks, from those of the items up to one block for each group; `most` levels at most."""
    rounds = []
    for base in range(0, max(most, 1), BITS):
        rounds.append(save(roll(items, base, payload if not base else []), "blocks"))
        items = rounds[-1].select("group", F.col("block").alias("rank"), "levels", F.col("node.h").alias("h"))
    return rounds


def proofs(rounds: list[DataFrame], above: DataFrame, payload: list[str] = []) -> DataFrame:
    """Items of the lowest round with their paths. `above` has group and path, the path above the group's root, and columns to keep."""
    for k in reversed(range(len(rounds))):
        on = ["group"] if k == len(rounds) - 1 else ["group", "block"]
        upper = above.withColumnRenamed("path", "above") if on == ["group"] else above.drop("h").withColumnsRenamed({"path": "above", "rank": "block"})
        above = unroll(rounds[k].join(upper, on), k * BITS, payload if not k else [])
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: _hash(
        F.when(s["side"] < 0, F.concat(s["h"], h)).when(s["side"] > 0, F.concat(h, s["h"])).otherwise(h)
    ))


def _with_levels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("levels", _levels(F.col("n")))


def manifest(docs: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, leaf, path, subroot and root for every row of `docs`; path is an array of (side, h).

    Leaves of a language (null is one) ascend by doc_id, nulls first, then by leaf; equal rows are leaves each.
    Nulls are hashed as '-', empty texts as '0:'. Other columns aren't part of a leaf. An empty table has no rows.
    With a column `now` (a leaf hash of what is to be checked, or null) in `docs`, it is kept beside the leaf.
    """
    now = F.col("now") if "now" in docs.columns else F.lit(None).cast("string").alias("now")
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null first, then bytewise
    leaves = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("group"), leaf(F.col("n_chars")).alias("h"), now), "leaves")
    items = _with_levels(ranked(leaves, "group", ["doc_id", "h"]))
    most = items.agg(F.max("levels")).first()[0] or 0
    rounds = tree(items, most, ["doc_id", "now"])
    roots = save(rounds[-1].select(F.lit("").alias("all"), F.col("group").alias("lang"), F.col("node.h").alias("h")), "subroots")
    over = _with_levels(ranked(roots, "all", ["lang"])).withColumnRenamed("all", "group")
    langs = tree(over, over.agg(F.max("levels")).first()[0] or 0, ["lang"])
    root = langs[-1].select("group", F.array().cast(PATH).alias("path"), F.col("node.h").alias("root"))
    above = save(proofs(langs, root, ["lang"]).select(F.col("lang").alias("group"), "path", F.col("h").alias("subroot"), "root"), "above")
    found = proofs(rounds, above, ["doc_id", "now"])
    discard(leaves, roots)
    lang = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias("lang")
    return found.select("doc_id", lang, F.col("h").alias("leaf"), "now", "path", "subroot", "root")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of `docs`.

    Rows whose doc_id's CRC-32 (of its decimal digits) is divisible by 7 are checked with n_chars + 1, the
    others as they are; so are rows with null doc_id, and null n_chars stay null. See manifest() for the order of leaves,
    ties, repeated rows and empty tables.
    """
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    rows = rows.withColumn("now", F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1)))
    siblings = F.array_join(F.filter(F.transform("path", lambda s: s["h"]), lambda h: h.isNotNull()), "")
    fold = folded(F.coalesce("now", "leaf"), F.col("path"))
    out = manifest(rows).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
