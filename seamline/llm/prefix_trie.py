"""A trie of conversations that share their first turns, and totals of its subtrees by leaf peeling."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import removed, shared_folder, table, written

#: Conversations of one hundred share up to SHARED - 1 first turns with the one they are counted from.
HUNDRED, SHARED = 100, 6
#: Ids of ended conversations that are one block of a digest.
BLOCK = 1024
ROOT = hashlib.sha256(b"").digest()[:16]
STEPS = "conv_id long, depth long, key binary, parent binary, chars long, ends boolean"


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns of every conversation, the first ones taken from another.

    A conversation c draws h below SHARED; its first h turns become those of
    c - c % HUNDRED (below c, also for ids below 0), as far as there are so many, and its own follow after its
    first h. pos orders a conversation's turns and may have gaps; a conversation
    without any turn left has one row with a null digest. Turns that tie go by
    role and text. Only a turn's digest and length are carried on.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text")).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(HUNDRED))
    drawn = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    own = written(rows.select("conv_id", place.alias("pos"), digest.alias("digest"), F.length("text").cast("long").alias("chars"), drawn))
    firsts = own.filter((F.col("conv_id") == first) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    convs = own.filter("pos = 1").select("conv_id", "h", first.alias("base"))
    borrowed = convs.join(firsts, "base").filter("pos <= h").select("conv_id", "pos", "digest", "chars")
    kept = own.filter("pos > h").select("conv_id", "pos", "digest", "chars")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return none.unionByName(borrowed).unionByName(kept)


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a partition's turns by conversation and place: the node that each turn leads to, named by the digest of all turns up to it. Only the last turn is kept in memory."""
    at: tuple | None = None  # conv_id, depth, key, parent, chars
    out: list[tuple] = []
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in STEPS.split(", ")])

    for batch in batches:
        for conv, digest, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "digest", "chars"))):
            if at and at[0] == conv:
                out.append((*at, False))
                at = conv, at[1] + 1, hashlib.sha256(at[2] + digest).digest()[:16], at[2], chars
            else:  # the row without a digest comes first
                if at:
                    out.append((*at, True))
                at = conv, 0, ROOT, None, 0
        yield flush()
    if at:
        out.append((*at, True))
    yield flush()


def ended(steps: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end: the digest of their ids in order, joined by commas.

    Ids are dealt by ranges of node and id, so many of one node are joined to
    blocks by many tasks; then only the blocks of a node meet, in order, in the
    digest, which can't be made in parts. Neither step holds a node's ids at once.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for k, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
                if k != key or len(ids) == BLOCK:
                    close()
                key = k
                ids.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if k != key:
                    if running:
                        out.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 2, (pa.binary(), pa.string()))], ["key", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [running.hexdigest()]})

    ids = steps.filter("ends").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ids.mapInArrow(blocks, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def peeled(chains: DataFrame) -> DataFrame:
    """(head, leaves, saved): totals of the subtree of every chain's top, by leaf peeling.

    ``chains`` (head, up, waits, own) is a tree: up is the head of the chain
    above (null at the root), waits the number of chains right below and own
    what the chain adds itself. Chains that wait for none are complete; each
    round they send their totals to the chain above, which counts down, until
    only the root has finished. Messages to one chain are summed in the map
    tasks first. A round writes what was completed and what waits; there are as
    many rounds as chains on the longest way down.
    """
    spark, folder = chains.sparkSession, f"{shared_folder(chains.sparkSession)}/peeling-{uuid.uuid4().hex}"
    state = written(chains.select("head", "up", "waits", "own", F.when(F.col("waits") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved")), f"{folder}/0")
    done, k = [state.filter("waits = 0")], 0
    while not state.filter("waits > 0").isEmpty():
        k += 1
        sent = done[-1].filter("up is not null").groupBy(F.col("up").alias("head")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        got = state.filter("waits > 0").join(sent, "head", "left")
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        state = written(got.select("head", "up", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), "own", more("leaves", "_leaves"), more("saved", "_saved")), f"{folder}/{k}")
        done.append(state.filter("waits = 0"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    out = written(whole.select("head", "leaves", "saved"))
    removed(spark, folder)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations (see ``rebuilt``) of ``turns`` (conv_id, turn, role, text).

    Returns key and parent (128 bits that stand for the turns up to the node),
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points that need not be stored again, summed
    over the subtree) and ends_sha256.

    Nodes with the same members are a chain: the same smallest member and as
    many members. Peeling goes over chains, so a tail that one conversation
    has alone is one step. Null roles and texts count as empty, null turns come
    first, repeated rows are turns of their own, and turns without a conv_id
    are of no conversation. A conversation's turns go through one task one by
    one, however long it is; other columns are ignored; no rows give no nodes.
    """
    # written first: over a union whose parts are dealt by conv_id already, adaptive planning may leave this exchange out and lay the parts end to end
    spread = written(rebuilt(turns)).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    steps = written(spread.mapInArrow(paths, STEPS))
    nodes = written(steps.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars")))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("_above_n"))
    whole = nodes.join(children, "key", "left").join(above, "parent", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "_above_n", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_own")
    )
    whole = written(whole)
    head = F.struct("conv_id", "n_convs").alias("head")
    up = F.when(F.col("top_parent").isNotNull(), F.struct(F.col("top_parent.conv_id").alias("conv_id"), F.col("top_parent.n_convs").alias("n_convs"))).alias("up")
    above = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"), F.col("_above_n").alias("n_convs")))
    chains = whole.groupBy(head).agg(F.sum("_own").alias("own"), F.min_by(above, "depth").alias("top_parent"), F.max_by("n_children", "depth").alias("waits")).select("head", up, "waits", "own")
    totals = peeled(chains)
    below = F.sum("_own").over(Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    named = whole.withColumn("_before", F.coalesce(below, F.lit(0))).join(totals.select("head.*", "leaves", "saved"), ["conv_id", "n_convs"])
    return named.join(ended(steps), "key", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("key", "parent")


SQL = f"""
with recursive bits(n, k, v) as (select range, 0, range from range(256) union all select n, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc_table as (select n, v from bits where k = 8),
own as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
convs as (select distinct conv_id, cast(conv_id as varchar) as d from own),
crc(conv_id, d, i, v) as (select conv_id, d, 0, 4294967295 from convs union all select c.conv_id, c.d, c.i + 1, xor(t.v, c.v >> 8) from crc c join crc_table t on t.n = xor(c.v, ascii(c.d[c.i + 1])) & 255 where c.i < length(c.d)),
drawn as (select conv_id, xor(v, 4294967295) % {SHARED} as h from crc where i = length(d)),
turns as (select d.conv_id, b.pos, b.role, b.text from drawn d join own b on b.conv_id = d.conv_id - (d.conv_id % {HUNDRED} + {HUNDRED}) % {HUNDRED} where b.pos <= h
  union all select conv_id, pos, role, text from own join drawn using (conv_id) where pos > h),
steps as (select conv_id, row_number() over w as depth, length(text) as chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, ';') over w) as key from turns
  window w as (partition by conv_id order by pos rows between unbounded preceding and current row)
  union all select conv_id, 0, 0, 'root' from convs),
nodes as (select key, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(chars) as chars from steps group by key),
parents as (select distinct s.key, p.key as parent from steps s join steps p on p.conv_id = s.conv_id and p.depth = s.depth - 1),
children as (select parent as key, count(*) as n from parents group by parent),
ends as (select key, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ids from (select conv_id, key from steps qualify depth = max(depth) over (partition by conv_id)) group by key),
below as (select distinct a.key, b.key as low from steps a join steps b on a.conv_id = b.conv_id and b.depth >= a.depth),
totals as (select b.key, count(*) filter (where c.n is null) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved from below b join nodes n on n.key = b.low left join children c on c.key = b.low group by b.key)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, n_leaves, cast(saved as bigint) as saved_tokens, coalesce(ids, sha256('')) as ends_sha256
from nodes n join totals using (key) left join parents using (key) left join nodes p on p.key = parent left join children c on c.key = n.key left join ends e on e.key = n.key"""
