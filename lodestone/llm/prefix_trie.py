"""Prefix trie of conversations by van Emde Boas recursion: depths are cut in halves, and halves in halves.

A problem of size L is a forest of turns below one named prefix. It is cut at half its depth: the prefix that ends there, the cut
prefix, is named by its problem's name and the digest of the L/2 turns between, so its name stands for the whole sequence; the turns
above make the upper trie, those below a forest for each cut prefix, and both are problems of size L/2, of all branches at
once. The prefix of depth d is thus a cut prefix of size 2^j, the lowest bit of d, in the problem of the prefix of depth d - 2^j.

Totals are grafted upward the same way. A round for each size takes all cut prefixes of that size: the total of the lower forest of
each comes from its children and from the cut prefixes of smaller sizes in it (up), and is then added to the upper trie, whose
parts are told by the cut prefixes at distances 1, 2, 4, ... above (down). So 2 log2(depth) aggregations over ever fewer rows
give every subtree's totals, and no row holds more than a logarithm of names.

Turns are numbered within range partitions, so one conversation may hold any share of the rows. Names inside 2^8 turns are made
in one task, from the name above them; longer conversations chain the digests of such pieces, 24 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import number_batches
from lodestone.sources.scratch import broadcast_if_small, keep, release

#: Turns of the pieces in which names are made, as a power of two.
PIECE = 8
ROOT = bytes(16)
#: Ids in one piece of the text whose hash is taken.
IDS = 1 << 16

_EMPTY = hashlib.sha256(b"").hexdigest()


# ---- turns


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes) of the turns with a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The role's length keeps ("ab", "c") from ("a", "bc").
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): turns in order, numbered from 0."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            starts = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1]
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
            if conv[0] == last:
                at[: starts[1] if len(starts) > 1 else len(conv)] += n
            last, n = conv[-1], int(at[-1]) + 1
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int64))], names=["conv_id", "digest", "bytes", "pid", "at"])

    slim = keep(turns, "turns")  # else the sampling of the ranges hashes every text once more
    ordered = slim.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest").withColumn("pid", F.spark_partition_id())
    with number_batches(turns.sparkSession):
        rows = keep(ordered.select("conv_id", "digest", "bytes", "pid").mapInArrow(counted, "conv_id long, digest binary, bytes long, pid int, at long"), "numbered-turns")
    release(slim)
    # Only a conversation across partitions goes on counting: there are no more of its later parts than partitions.
    parts = rows.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    later = keep(parts.withColumn("before", earlier).filter(F.col("before") > 0).select("conv_id", "pid", "before"), "later-parts")
    return rows.join(broadcast_if_small(later), ["conv_id", "pid"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def rebuilt_turns(conversations: DataFrame, group: int = 5, most_shared: int = 8) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length), (conv_id, length, pos, digest, bytes)): every conversation with the first turns of its group's.

    Conversation c begins with the first h = crc32(c) % (``most_shared`` + 1) turns of conversation c - c % ``group``, and goes on with
    its own after its first h.
    """
    turns = keep(_numbered(_turns(conversations)), "turns-in-order")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most_shared + 1)).alias("h")
    base = F.col("conv_id") - F.col("conv_id") % group
    known = keep(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    of_base = known.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    plan = known.select("conv_id", "n", h, base.alias("base")).join(of_base, "base", "left").withColumn("shared", shared)
    plan = keep(plan.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n", "n_base"), "conversation-plans")
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most_shared)).withColumnRenamed("conv_id", "base")
    first = plan.join(heads, "base").filter(F.col("pos") < F.col("shared")).select("conv_id", "length", "pos", "digest", "bytes")
    own = turns.join(plan, "conv_id").filter(F.col("pos") >= F.col("h")).select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "bytes")
    return plan.select("conv_id", "length"), first.unionByName(own)


# ---- names


def _hash(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(a + b).digest()[:16]


def _low(d: int) -> int:
    return d & -d


def _levels(digests: list[bytes]) -> list[list[bytes]]:
    """Digests of all whole blocks of 1, 2, 4, ... turns."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash(below[k], below[k + 1]) for k in range(0, len(below) - 1, 2)])
    return levels


def _names(root: bytes, digests: list[bytes]) -> list[bytes]:
    """Names of the prefixes of 0 to len(digests) turns below ``root``: a block digest from the name at the cut above it."""
    levels, names = _levels(digests), [root]
    for d in range(1, len(digests) + 1):
        size = _low(d)
        names.append(_hash(names[d - size], levels[size.bit_length() - 1][d // size - 1]))
    return names


def _above(names: list[bytes], d: int) -> list[bytes]:
    """Names at distances 1, 2, 4, ... up to the lowest bit of ``d``: the last is the problem's."""
    return [names[d - (1 << i)] for i in range(_low(d).bit_length())]


def _piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [_levels([t["digest"] for t in turns])[-1][0] for turns in batch.column("turns").to_pylist()]
        yield pa.record_batch([batch.column("conv_id"), batch.column("piece"), pa.array(tops, pa.binary())], names=["conv_id", "piece", "digest"])


def _piece_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, start, end, high): the names around each piece, and those above its end at the distances of whole pieces."""
    for batch in batches:
        rows = []
        for conv, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            names = _names(ROOT, [p["digest"] for p in pieces])
            rows += [(conv, k, names[k], names[k + 1] if k < len(pieces) else None, _above(names, k + 1) if k < len(pieces) else None) for k in range(len(names))]
        for at in range(0, len(rows), 20000):
            conv, piece, start, end, high = zip(*rows[at : at + 20000], strict=True)
            yield pa.record_batch([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(start, pa.binary()), pa.array(end, pa.binary()), pa.array(high, pa.list_(pa.binary()))], names=["conv_id", "piece", "start", "end", "high"])


_PLACE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("name", pa.binary()), ("above", pa.list_(pa.binary())), ("bytes", pa.int64()), ("ends", pa.bool_())])


def _piece_places(bits: int):
    """A row for each turn of pieces of 2^bits turns: the prefix that ends with it."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, piece, length, turns, start, end, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, first = _names(start or ROOT, [t["digest"] for t in turns]), piece << bits
                for d, turn in enumerate(turns, 1):
                    above = _above(names, d)
                    if d == 1 << bits:
                        names[d], above = end, above[:-1] + high
                    rows.append((conv, first + d, names[d], above, turn["bytes"], first + d == length))
                if len(rows) >= 20000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACE, strict=True)], schema=_PLACE)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACE, strict=True)], schema=_PLACE)

    return places


def named_places(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, above, bytes, ends) for each turn of (conv_id, length, pos, digest, bytes)."""
    piece = F.shiftright("pos", PIECE).alias("piece")
    turn = F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes")))
    pieces = keep(turns.groupBy("conv_id", piece).agg(F.max("length").alias("length"), turn.alias("turns")), "pieces")
    whole = pieces.filter(F.size("turns") == 1 << PIECE).select("conv_id", "piece", "turns").mapInArrow(_piece_digests, "conv_id long, piece long, digest binary")
    chains = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "digest"))).alias("pieces"))
    around = chains.mapInArrow(_piece_names, "conv_id long, piece long, start binary, end binary, high array<binary>")
    met = pieces.join(around, ["conv_id", "piece"], "left").select("conv_id", "piece", "length", "turns", "start", "end", "high")
    return met.mapInArrow(_piece_places(PIECE), "conv_id long, depth long, name binary, above array<binary>, bytes long, ends boolean")


# ---- totals


def _level(depth: Column, top: int) -> Column:
    """The lowest bit of a depth, as an exponent; the root is cut last."""
    return F.when(depth == 0, top).otherwise(F.log2(depth.bitwiseAND(-depth)).cast("int"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.max("depth").alias("depth"), F.max("above").alias("above"), F.sum("value").alias("value"), F.sum("leaves").alias("leaves"))


def grafted(nodes: DataFrame) -> DataFrame:
    """(name, value, leaves) below each inner node of (name, depth, above, parent, value, n_children, child_value): its own not counted."""
    spark = nodes.sparkSession
    top = int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    inner = nodes.filter(F.col("n_children") > 0).select("name", "depth", "above", F.col("child_value").alias("value"), F.lit(0).cast("long").alias("leaves"))
    childless = nodes.filter((F.col("n_children") == 0) & (F.col("depth") > 0)).groupBy(F.col("parent").alias("name")).agg(F.max(F.col("depth") - 1).alias("depth"), F.count("*").alias("leaves"))
    nothing = F.lit(None).cast("array<binary>").alias("above")
    start = inner.unionByName(childless.select("name", "depth", nothing, F.lit(0).cast("long").alias("value"), "leaves"))
    start = keep(start.withColumn("level", _level(F.col("depth"), top)), "trie-start")
    columns = ["name", "depth", "above", "value", "leaves"]

    # Up: the total of the lower forest of each cut prefix.
    lower: list[DataFrame] = []
    for level in range(top + 1):
        rows = start.filter(F.col("level") == level).select(*columns)
        for smaller, done in enumerate(lower):
            at = F.col("depth") - (1 << smaller)
            rows = rows.unionByName(done.filter(_level(at, top) == level).select(F.element_at("above", -1).alias("name"), at.alias("depth"), nothing, "value", "leaves"))
        lower.append(keep(_sums(rows), f"trie-up-{level}"))

    # Down: into the upper trie above it.
    whole: dict[int, DataFrame] = {}
    for level in range(top, -1, -1):
        rows = lower[level].select(*columns)
        for larger in range(level + 1, top):
            rows = rows.unionByName(whole[larger].select(F.col("above")[level].alias("name"), (F.col("depth") - (1 << level)).alias("depth"), nothing, "value", "leaves"))
        whole[level] = keep(_sums(rows), f"trie-down-{level}") if level < top - 1 else rows
    found = None
    for rows in whole.values():
        part = rows.select("name", "value", "leaves")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "name binary, value long, leaves long")


# ---- members


def _id_pieces(most: int):
    """(name, first, ids): sorted ids in decimal, comma-joined, at most ``most`` in a row."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, rows = None, [], []

        def batch_of() -> pa.RecordBatch:
            a, b, c = zip(*rows, strict=True)
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["name", "first", "ids"])

        for batch in batches:
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != name or len(held) >= most:
                    if held:
                        rows.append((name, held[0], ",".join(map(str, held)).encode()))
                        if len(rows) >= 10000 or len(held) >= most:
                            yield batch_of()
                            rows = []
                    name, held = n, []
                held.append(i)
        if held:
            rows.append((name, held[0], ",".join(map(str, held)).encode()))
        if rows:
            yield batch_of()

    return pieces


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, sha): the hash of a name's pieces in order, which are never put together."""
    name, state, rows = None, None, []

    def batch_of() -> pa.RecordBatch:
        a, b = zip(*rows, strict=True)
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.string())], names=["name", "sha"])

    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != name:
                if state is not None:
                    rows.append((name, state.hexdigest()))
                    if len(rows) >= 10000:
                        yield batch_of()
                        rows = []
                name, state = n, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if state is not None:
        rows.append((name, state.hexdigest()))
    if rows:
        yield batch_of()


def _ends(members: DataFrame) -> DataFrame:
    """(name, sha) of (name, conv_id): the hash of the ids of conversations that end at a name, ascending and comma-joined.

    Ids are sorted and joined in range partitions, so a name that ends very many conversations is spread; its hash then reads
    pieces of 2^16 ids.
    """
    members = keep(members, "trie-ends")
    pieces = members.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_id_pieces(IDS), "name binary, first long, ids binary")
    return pieces.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(_id_hashes, "name binary, sha string")


def trie(plans: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of all prefixes of (conv_id, length) and (conv_id, length, pos, digest, bytes); see ``conversation_trie``."""
    places = keep(named_places(turns), "trie-places")
    ends = places.filter("ends").select("name", "conv_id").unionByName(plans.filter(F.col("length") == 0).select(F.lit(ROOT).alias("name"), "conv_id"))

    found = places.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("above").alias("above"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    valued = found.select("name", "conv_id", "depth", "above", F.element_at("above", 1).alias("parent"), "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    nothing = F.lit(None)
    root = plans.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter(F.col("n_convs") > 0)
    root = root.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), nothing.cast("array<binary>").alias("above"), nothing.cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("value"))
    each = keep(valued.unionByName(root), "trie-nodes")

    children = each.filter(F.col("depth") > 0).groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"), F.sum("value").alias("child_value"))
    nodes = keep(each.join(children, "name", "left").fillna(0, ["n_children", "child_value"]), "trie-inner")
    release(each)

    parents = nodes.filter(F.col("n_children") > 0).select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(grafted(nodes).select("name", F.col("value").alias("below"), "leaves"), "name", "left").join(_ends(ends), "name", "left").join(parents, "parent", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        (F.col("value") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, group: int = 5, most_shared: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct prefix.

    Args:
        conversations: has ``conv_id`` (an integer), ``turn``, ``role`` and ``text``; other columns are ignored.
        group, most_shared: how conversations are rebuilt; see ``rebuilt_turns``.

    conv_id is the smallest of the n_convs conversations that begin with the prefix, parent_conv_id that of the prefix one turn
    shorter (null at the root). saved_tokens are the bytes of the turns in the subtree that all but one of their conversations
    could share; ends_sha256 is of the ids of the conversations that end at the prefix.

    Rows without conv_id belong to no conversation. Turns come by turn, null first, rows of one turn by the hash of role and text;
    repeated rows are turns of their own. A null role or text is empty; texts count whole, of any length, and so do conversations.
    No conversations give no rows.
    """
    return trie(*rebuilt_turns(conversations, group, most_shared))
