"""Merkle manifest: a tree over the rows of each source, and one over the sources.

Every row is a leaf. The leaves of a source stand in the order of their ids;
runs of three become their hash, level by level, until one node is left, the
subroot. The subroots, in the order of their sources, likewise give the root.

Places come from a range-partitioned sort and counts of its parts, so that a
source of any size is many tasks. Proofs are made by pointer jumping: a node
begins with its siblings and its parent, and in every round it is joined with
the node that it points at, takes over that one's pointer and appends its
siblings, so that the distance doubles. A node that many point at is copied
for every thousand of them before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that one copy of an ancestor is joined with, at most about.
CROWD = 1000
_SEGMENT = "array<struct<l:binary,r:binary>>"
_KEY = ("sid", "level", "pos")


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_hash(columns: dict[str, Column] | None = None) -> Column:
    """The leaf of a row, in hex; `columns` replaces some of its fields."""
    return F.sha2(F.concat(*[field((columns or {}).get(c, F.col(c))) for c in FIELDS]), 256)


def tampered_text() -> Column:
    """The text without its line ends where 2 divides the id's CRC-32, else the text."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _placed(docs: DataFrame, changed: Column, scratch: Scratch) -> DataFrame:
    """(sid, pos, n, hash, doc): the rank of the source, the place in it and its size.

    The sorted rows are written with the number of their part; how many rows
    of a source stand in earlier parts follows from the counts by part.
    """
    doc = F.struct(F.col("doc_id"), F.unhex(leaf_hash({"text": changed})).alias("changed"))
    rows = docs.select("source", "doc_id", F.unhex(leaf_hash()).alias("hash"), doc.alias("doc"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "source", "doc_id", "hash").sortWithinPartitions("source", "doc_id", "hash")
    ordered = scratch.keep(ordered.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    pieces = scratch.keep(ordered.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("seq").alias("first")))
    by_source = Window.partitionBy("source").orderBy("part")
    whole = Window.partitionBy("source")
    pieces = pieces.select(
        "part", "source", "first", F.sum("rows").over(whole).alias("n"), (F.row_number().over(by_source) == 1).alias("new"),
        (F.sum("rows").over(by_source) - F.col("rows")).alias("before"),
    )
    new = pieces.filter("new")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = new.groupBy("part").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    in_part = Window.partitionBy("part").orderBy("source")
    ranked = new.withColumn("k", F.row_number().over(in_part) - 1).join(base, "part").select(F.col("source").alias("s"), (F.col("base") + F.col("k")).alias("sid"))
    pieces = scratch.keep(pieces.join(ranked, F.col("source").eqNullSafe(F.col("s"))).select("part", F.col("source").alias("s"), "first", "before", "n", "sid"))
    met = ordered.alias("o").join(pieces.alias("p"), (F.col("o.part") == F.col("p.part")) & F.col("o.source").eqNullSafe(F.col("p.s")))
    return met.select("sid", F.lit(0).alias("level"), (F.col("o.seq") - F.col("p.first") + F.col("p.before")).alias("pos"), "n", "hash", "doc")


def _levels(now: DataFrame, at: int, folder: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Writes the runs of every level under `folder`; the last nodes, one for each tree, and the number of levels."""
    spark, roots = now.sparkSession, []
    top = now.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(now.filter("n = 1"))
        if top <= 1:
            return _all(roots), at
        runs = now.filter("n > 1").groupBy("sid", "level", F.expr(f"pos div {ARITY}").alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "doc"))).alias("run"))
        text = F.array_join(F.transform("run", lambda x: _hex(x["hash"])), "")
        runs = runs.withColumn("made", F.unhex(F.sha2(text, 256)))
        path = f"{folder}/at={at}"
        scratch.write(runs, path)
        kept = spark.read.schema(runs.schema).parquet(path)
        up = F.expr(f"(n + {ARITY - 1}) div {ARITY}")
        doc = now.schema["doc"].dataType
        now = kept.select("sid", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), up.alias("n"), F.col("made").alias("hash"), F.lit(None).cast(doc).alias("doc"))
        top, at = -(-top // ARITY), at + 1


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _nodes(runs: DataFrame, sources: int) -> DataFrame:
    """Every node but the root: its key, its siblings as a segment, its parent's key (null at the root), its subroot if near."""
    last = F.expr(f"(n + {ARITY - 1}) div {ARITY}") == 1
    own, top = F.col("sid") >= 0, F.struct(F.lit(-1).cast("long").alias("sid"), F.lit(0).alias("level"), F.col("sid").alias("pos"))
    plain = F.struct(F.col("sid"), (F.col("level") + 1).alias("level"), F.col("up").alias("pos"))
    above = F.when(last & (~own | F.lit(sources == 1)), F.lit(None)).when(last, top).otherwise(plain)
    hashes = F.transform("run", lambda x: x["hash"])
    rows = runs.select("sid", "level", "n", above.alias("above"), F.when(last & own, F.col("made")).alias("sub"), hashes.alias("all"), F.posexplode("run").alias("i", "x"))
    some = lambda first, n: F.aggregate(F.slice("all", first, n), F.lit(b""), lambda a, h: F.concat(a, h))
    one = F.struct(some(F.lit(1), F.col("i")).alias("l"), some(F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0))).alias("r"))
    sub = F.when(own, F.col("sub")).when(F.col("level") == 0, F.col("x.hash"))
    return rows.select("sid", "level", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"), F.col("x.doc").alias("doc"), "above", sub.alias("sub"), F.array(one).cast(_SEGMENT).alias("segment"))


def _jump(nodes: DataFrame, distance: int, last: bool, crowd: int, total: int) -> DataFrame:
    """One round: who points at a node takes over its pointer and appends its segment."""
    copies = -(-min(ARITY**distance, total) // crowd)
    far = nodes.filter((F.col("level") > 0) | (F.col("sid") < 0))
    salts = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0)
    far = far.select(F.struct(*_KEY).alias("at"), F.col("above").alias("above2"), F.col("segment").alias("segment2"), F.col("sub").alias("sub2"), salts.alias("salt"))
    if last:  # only leaves are asked for
        nodes = nodes.filter("doc is not null")
    going = nodes.filter("above is not null").withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(copies)).cast("int"))
    joined = going.join(far, (going["above"] == far["at"]) & (going["salt"] == far["salt"]))
    kept = joined.select(*_KEY, "hash", "doc", F.col("above2").alias("above"), F.coalesce("sub", "sub2").alias("sub"), F.concat("segment", "segment2").alias("segment"))
    return kept.unionByName(nodes.filter("above is null"))


def merkle_proofs(docs: DataFrame, changed: Column | None = None, *, crowd: int = CROWD) -> DataFrame:
    """(doc_id, leaf, subroot, root, segment, changed): the tree, and every leaf's way to the root.

    `docs` has the columns of documents; others are left out, whatever their
    names. `changed` is a text that the leaf is made of again (`changed`, in
    hex). `segment` has a struct for each level from the leaf up: the hashes
    left of it in its run and those right of it, as bytes. A null doc_id comes
    first in its source, rows of one id stand in the order of their leaves, and
    repeated rows are leaves of their own. Null sources come first. Texts are
    hashed whole, of any length, once, and are not shuffled. An empty table has no rows and no root;
    of a single row leaf, subroot and root are equal and the segment is empty.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*FIELDS)
    leaves = scratch.keep(_placed(docs, F.col("text") if changed is None else changed, scratch))
    folder = scratch.path()
    subroots, depth = _levels(leaves, 0, folder, scratch)
    counted = subroots.agg(F.count("*"), F.max("sid")).first()
    sources = counted[0]
    above = subroots.select(F.lit(-1).cast("long").alias("sid"), F.lit(0).alias("level"), F.col("sid").alias("pos"), F.lit(sources).cast("long").alias("n"), "hash", "doc")
    above = scratch.keep(above)
    tops, depth = _levels(above, depth, folder, scratch)
    top = tops.first()  # the root alone
    shape = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("sid", "long"), ("level", "int"), ("pos", "long"))])
    if top is None or depth == 0:  # no row, or one
        nodes = tops.select(*_KEY, "hash", "doc", shape.alias("above"), F.col("hash").alias("sub"), F.array().cast(_SEGMENT).alias("segment"))
    else:
        runs = docs.sparkSession.read.schema(_runs_schema(leaves)).parquet(folder)
        nodes = scratch.keep(_nodes(runs, sources))
        total, distance = leaves.count(), 1
        while distance < depth:
            before, nodes = nodes, scratch.keep(_jump(nodes, distance, 2 * distance >= depth, crowd, total))
            scratch.drop(before)
            distance *= 2
        nodes = nodes.filter("doc is not null")
    root = F.lit(bytes(top["hash"]).hex() if top else None).cast("string")
    return nodes.select(F.col("doc.doc_id").alias("doc_id"), _hex(F.col("hash")).alias("leaf"), _hex(F.col("sub")).alias("subroot"), root.alias("root"), "segment", _hex(F.col("doc.changed")).alias("changed"))


def _runs_schema(leaves: DataFrame) -> str:
    doc = leaves.schema["doc"].dataType.simpleString()
    return f"sid long, level int, up long, n long, run array<struct<pos:long,hash:binary,doc:{doc}>>, made binary"


def proof_hash(segment: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(segment, lambda s: _hex(F.concat(s["l"], s["r"]))), ""), 256)


def fold(leaf: Column, segment: Column) -> Column:
    """The root that a leaf (hex) gives with its siblings."""
    return F.aggregate(segment, leaf, lambda at, s: F.sha2(F.concat(_hex(s["l"]), at, _hex(s["r"])), 256))


def verify_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; edge cases as in merkle_proofs."""
    made = merkle_proofs(docs, changed)
    rows = made.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("segment")).alias("proof_sha256"), fold(F.col("changed"), F.col("segment")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
