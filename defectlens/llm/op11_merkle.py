"""Merkle dataset manifest: rank digits grouped away, child structs nested, proofs by one transform.

Every row is a leaf, the digest of its fields.  The leaves of a group (``by``)
are numbered by key; the binary digits of that rank are columns.  A block
holds ``2 ** BLOCK_BITS`` consecutive ranks: its rows are brought together
once, sorted, and the digit columns are grouped away one after the other, last
digit first.  Each step puts the two child structs below their parent's
digest, so it needs neither an exchange nor a sort.  A block ends as one
nested struct of at most ``2 ** BLOCK_BITS`` leaves; block digests are the
leaves of the next tier, up to the group's root, and the roots of the groups
make the tree of the whole set.  A block's own way up is attached to its one
row; transforms over the nested struct and one explode then give every leaf
its proof, with no join of leaves.

A run of one node is digested too while its level has more nodes; a group of
one leaf is its own root.  Ties: equal keys are ordered by leaf digest, equal
leaves are interchangeable.  Null fields are ``-``; a null group or key comes
first.  Repeated rows are leaves of their own.  An empty table gives no rows.
Further input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import staged
from defectlens.operators.numbering import positions

#: Rank digits of a block: at most 256 leaves in one nested row.
BLOCK_BITS = 8

#: Fields of a document's leaf, in this order (contract).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One step of a proof: the sibling's digest on its side, both null for a run of one.
STEP = "struct<left:string,right:string>"


def field_text(value: Column) -> Column:
    """A field as it is digested: its UTF-8 byte count, ``:`` and value, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(
        F.concat(F.coalesce(s["left"], F.lit("")), h, F.coalesce(s["right"], F.lit(""))), 256))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the digits of n - 1, none for one leaf."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _blocks(nodes: DataFrame, by: list[str], level: int, payload: list[str], bits: int) -> DataFrame:
    """Nodes (by, height, rank, h, payload) to one row a block: by, height, block and the nested ``node``.

    ``level`` is the number of levels below these nodes.
    """
    bit = [f"_d{j}" for j in range(bits)]
    keys = [*by, "height", "block"]
    rows = nodes.select(*by, "height", F.shiftright("rank", bits).alias("block"),
                        *[F.shiftright("rank", j).bitwiseAND(F.lit(1)).cast("int").alias(b) for j, b in enumerate(bit)],
                        F.struct("h", *payload).alias("node"))
    digits = bit[::-1]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *digits)
    for j in range(bits):
        digits = digits[:-1]
        rows = rows.groupBy(*keys, *digits).agg(
            F.first(F.when(F.col(bit[j]) == 0, F.col("node")), ignorenulls=True).alias("_l"),
            F.first(F.when(F.col(bit[j]) == 1, F.col("node")), ignorenulls=True).alias("_r"))
        both = F.sha2(F.concat(F.col("_l.h"), F.coalesce(F.col("_r.h"), F.lit(""))), 256)
        h = F.when(F.col("height") > level + j, both).otherwise(F.col("_l.h"))  # a finished root is handed on
        rows = rows.select(*keys, *digits, F.struct(h.alias("h"), F.array_compact(F.array("_l", "_r")).alias("kids")).alias("node"))
    return rows


def _leaves(node: Column, path: Column, level: int, bits: int) -> Column:
    """The leaf structs below a block's nested node, each with its way up: array of (node, path)."""
    found = F.array(F.struct(node.alias("node"), path.alias("path")))
    for j in reversed(range(bits)):
        found = F.flatten(F.transform(found, _children(level + j)))
    return found


def _children(level: int):
    """Function of a (node, path) to its children's; siblings differ at ``level``."""
    def children(parent: Column) -> Column:
        kids = parent["node"]["kids"]

        def child(kid: Column, i: Column) -> Column:
            left, right = (F.try_element_at(kids, F.lit(k))["h"] for k in (1, 2))
            step = F.struct(F.when(i == 1, left).alias("left"), F.when(i == 0, right).alias("right"))
            up = F.when(F.col("height") > level, F.concat(F.array(step), parent["path"])).otherwise(parent["path"])
            return F.struct(kid.alias("node"), up.alias("path"))

        return F.transform(kids, child)

    return children


def _same(by: list[str]) -> Column:
    """The groups of a block and of its row in the tier above (columns ``_by0``...) are equal, null with null."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return same


def _climb(nodes: DataFrame, by: list[str], payload: list[str], level: int, bits: int) -> DataFrame:
    """Nodes to one row a block, with the block's way up ``_up`` to its group's root ``top``."""
    blocks = staged(_blocks(nodes, by, level, payload, bits), f"merkle-{level}")
    last = blocks.agg(F.max("block")).first()[0]
    if not last:  # every group is one block
        return blocks.select("*", F.array().cast(f"array<{STEP}>").alias("_up"), F.col("node.h").alias("top"))
    above = _climb(blocks.select(*by, "height", F.col("block").alias("rank"), F.col("node.h").alias("h"), F.col("block").alias("of")),
                   by, ["of"], level + bits, _bits(last))
    ways = _emit(above, level + bits, _bits(last), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "top")
    ways = ways.select(*[f"_by{i}" for i in range(len(by))], F.col("_p.node.of").alias("_of"), F.col("_p.path").alias("_up"), "top")
    return blocks.join(ways, _same(by) & (F.col("block") == F.col("_of"))).select(*blocks.columns, "_up", "top")  # one row a block


def _emit(blocks: DataFrame, level: int, bits: int, *kept) -> DataFrame:
    """Block rows to one row a node: ``_p`` (node, path) and the kept columns."""
    return blocks.select(*kept, F.explode(_leaves(F.col("node"), F.col("_up"), level, bits)).alias("_p"))


def _bits(last: int) -> int:
    """Digits of a block whose ranks end at ``last``, at most ``BLOCK_BITS``."""
    return max(1, min(BLOCK_BITS, int(last).bit_length()))


def _numbered(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    n = positions(rows, order, by, "rank", "_rows")
    return n.withColumn("height", _height(F.col("_rows"))).drop("_rows")


def merkle_proofs(leaves: DataFrame, by: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Leaves (``h``, ``by``, payload) to rows of by, h, payload, ``path``, ``subroot`` and ``root``.

    ``path`` holds one step a level, from the leaf to the root over all groups,
    so ``fold(h, path)`` is the root.  ``leaves`` is scanned twice.
    """
    blocks = _climb(_numbered(leaves, [*order, "h"], [by]), [by], list(payload), 0, BLOCK_BITS)
    roots = staged(blocks.groupBy(by).agg(F.first("top").alias("h")).withColumn("of", F.col(by)), "merkle-subroots")
    bits = _bits(roots.count())
    whole = _emit(_climb(_numbered(roots, [by], []), [], ["of"], 0, bits), 0, bits, F.col("top").alias("root"))
    whole = whole.select(F.col("_p.node.of").alias("_by0"), F.col("_p.path").alias("_above"), "root")
    blocks = blocks.join(whole, _same([by])).withColumn("_up", F.concat("_up", "_above"))  # one row a group
    out = _emit(blocks, 0, BLOCK_BITS, by, F.col("top").alias("subroot"), "root")
    return out.select(by, "_p.node.h", *[f"_p.node.{c}" for c in payload], "_p.path", "subroot", "root")


def merkle_report(docs: DataFrame) -> DataFrame:
    """Contract columns: leaf, roots, proof digest and the check of tampered rows.

    Where 7 divides crc32(doc_id), one more character is claimed in n_chars; a
    null n_chars or doc_id stays untampered.
    """
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    claimed = [one_more if f == "n_chars" else F.col(f) for f in FIELDS]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf_digest(claimed))
    leaves = staged(docs.select(F.col("lang").cast("string").alias("lang"), "doc_id",
                                leaf_digest([F.col(f) for f in FIELDS]).alias("h"), tampered.alias("tampered"),
                                F.rand(11).alias("salt")), "merkle-leaves")
    rows = merkle_proofs(leaves, "lang", ["doc_id", "h", "salt"], ["doc_id", "tampered"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit("")))), "")
    folded = fold(F.coalesce("tampered", "h"), F.col("path"))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(e: str) -> str:
    return f"coalesce(octet_length(encode(CAST({e} AS VARCHAR))) || ':' || CAST({e} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def crc32_sql(e: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    octet = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    octets = f"list_transform(string_split({e}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {octet}), 4294967295)"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS k, doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS lvl, i, leaf AS h, n FROM ranked
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2, n
), subroots AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, g AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, i // 2, n
), whole AS (SELECT h AS root, lvl AS height FROM tops WHERE n = 1),
steps AS (
  SELECT r.k, v.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < v.i THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM ranked r JOIN nodes v ON v.lang IS NOT DISTINCT FROM r.lang AND v.n > 1 AND v.i = r.i >> v.lvl
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM v.lang AND s.lvl = v.lvl AND s.i = xor(v.i, 1)
  UNION ALL
  SELECT r.k, 1000 + v.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < v.i THEN 'L' || s.h ELSE 'R' || s.h END
  FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang JOIN tops v ON v.n > 1 AND v.i = b.g >> v.lvl
  LEFT JOIN tops s ON s.lvl = v.lvl AND s.i = xor(v.i, 1)
), paths AS (SELECT k, list(step ORDER BY lvl) AS path FROM steps GROUP BY k),
folded AS (
  SELECT r.doc_id, r.leaf, b.subroot, w.root, coalesce(p.path, CAST([] AS VARCHAR[])) AS path, coalesce(r.tampered, r.leaf) AS start
  FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang LEFT JOIN paths p USING (k), whole w
), checked AS (
  SELECT *, list_reduce(list_prepend(start, path), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root,
         sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256
  FROM folded
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM checked"""
