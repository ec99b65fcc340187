"""A trie of conversations' prefixes, in balanced parentheses for each shard, with what sharing prefixes saves.

1. Sequences. Turns are digests of 128 bits. Conversations are cut into stretches of LEVEL_TURNS turns, so that no row
   grows with a conversation; a stretch hangs on the node that the ones before it end at. Equal stretches are one sequence.
2. Shards. Sequences are sorted, and a shard is a run of them with at most SHARD_TURNS turns. Going from one sequence to
   the next closes the nodes they don't share and opens the new ones: the shard's trie in balanced parentheses, in preorder.
3. Subtrees. The excess of opened over closed parentheses has a tree of minima over its blocks; findclose climbs it to the
   first place where a node's parenthesis closes. A rank of the pairs '()' counts the leaves between, and cumulative arrays
   over the preorder give members and savings.
4. Spines. Only nodes on the paths to a shard's first and last sequences can go on in other shards. They are merged by
   node, and what hangs below them is summed along the paths, each node counting on one path alone.
5. Levels of stretches are worked off from the deepest on; a level's roots give their totals to the nodes they hang on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ngram_join import _mix
from .shared import discard, giving_back, numbered, read, save, sized

#: Turns of a stretch; turns of a shard, at most but for one sequence more; parentheses in a block of the excess.
LEVEL_TURNS, SHARD_TURNS, BLOCK = 512, 400_000, 64
#: Bytes of member ids that are joined before they are hashed.
ID_BYTES = 1 << 20
U = np.uint64
NO_ID = np.iinfo(np.int64).max


class Parentheses:
    """A forest as balanced parentheses (1 opens, 0 closes), with a tree of minima over blocks of the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.minima = [padded.reshape(-1, BLOCK).min(1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.append(low, np.iinfo(np.int32).max) if len(low) % 2 else low
            self.minima.append(low.reshape(-1, 2).min(1))
        self.opened = np.cumsum(bits, dtype=np.int64)  # rank of '('
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.cumsum(pair)  # rank of '()', at its '('

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from `at` on, within its block, whose excess is not above the target; -1 if there is none."""
        found, left = np.full(len(at), -1), np.arange(len(at))
        for step in range(BLOCK):
            place = at[left] + step
            inside = (place < len(self.bits)) & (place // BLOCK == at[left] // BLOCK)
            left, place = left[inside], place[inside]
            if not len(left):
                break
            hit = self.excess[place] <= target[left]
            found[left[hit]] = place[hit]
            left = left[~hit]
        return found

    def _block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block from `block` on with a minimum not above the target, which must be there."""
        found, left = np.full(len(block), -1), np.arange(len(block))
        node = block.copy()
        for level, minima in enumerate(self.minima):
            for _ in range(2):  # the node, and its right sibling if it is a left one
                here = left[node[left] < len(minima)]
                hit = here[minima[node[here]] <= target[here]]
                if len(hit):
                    down = node[hit]
                    for lower in self.minima[level - 1 :: -1] if level else ():
                        down = down * 2
                        down += lower[down] > target[hit]
                    found[hit] = down
                    left = left[~np.isin(left, hit)]
                node[left] += (node[left] % 2 == 0) if _ == 0 else 0
            node[left] = node[left] // 2 + 1
            if not len(left):
                break
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at these places are closed."""
        target = self.excess[opens] - 1
        found = self._scan(np.minimum(opens + 1, len(self.bits) - 1), target)
        ahead = opens // BLOCK != (opens + 1) // BLOCK
        found[ahead] = -1  # the scan began in the next block, which the tree looks at
        left = np.flatnonzero(found < 0)
        block = self._block(opens[left] // BLOCK + 1, target[left])
        found[left] = self._scan(block * BLOCK, target[left])
        return found


def _step(ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """128-bit ids (two words each) of the children of nodes by turns with these digests."""
    x = _mix(ids + U(0x9E3779B97F4A7C15)) ^ digests
    return _mix(np.stack([x[:, 0] + x[:, 1] * U(0xD1342543DE82EF95), x[:, 1] ^ (x[:, 0] * U(0xAF251AF3B0F025B5))], 1))


def chained(top: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """[0 .. n]: ids of the nodes from top on, down along the digests of turns."""
    out = np.empty((len(digests) + 1, 2), np.uint64)
    out[0] = top
    for i in range(len(digests)):
        out[i + 1] = _step(out[i : i + 1], digests[i : i + 1])[0]
    return out


def _words(digests: pa.Array) -> np.ndarray:
    """[i, 2]: binary values of 16 bytes each as words."""
    if not len(digests):
        return np.zeros((0, 2), np.uint64)
    whole = digests.cast(pa.binary(16))
    return np.frombuffer(whole.buffers()[1], ">u8").reshape(-1, 2)[whole.offset : whole.offset + len(whole)].astype(np.uint64)


def _bytes(ids: np.ndarray) -> list[bytes]:
    data = ids.astype(">u8").tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


ITEMS = "array<struct<pos:bigint,digest:binary,bytes:bigint>>"
STRETCHES = f"conv_id long, last boolean, top binary, items {ITEMS}, end binary"


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches with the id of the node they end at. Each step of the chains is taken for all stretches that have it."""
    for b in batches:
        items = b.column(b.schema.get_field_index("items"))
        sizes = np.diff(items.offsets.to_numpy())
        digests = _words(items.flatten().field("digest"))
        ids = _words(b.column(b.schema.get_field_index("top")))
        ends = np.cumsum(sizes)
        for i in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes > i)
            ids[some] = _step(ids[some], digests[ends[some] - sizes[some] + i])
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in ("conv_id", "last", "top", "items")), pa.array(_bytes(ids), pa.binary())], ["conv_id", "last", "top", "items", "end"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (end, conv_id) come sorted; out come (end, at, ids): decimal ids, comma-joined, in stretches of ID_BYTES."""
    end, at, ids, size = None, None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([at], pa.int64()), pa.array([",".join(ids)])], ["end", "at", "ids"])

    for b in batches:
        for e, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (e != end or size > ID_BYTES):
                yield out()
                ids, size = [], 0
            if not ids:
                end, at = e, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (end, at, ids) come sorted; out come (end, ends_sha256). A node's ids stream through the hash."""
    end, h = None, None
    for b in batches:
        done = []
        for e, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if e == end:
                h.update(b",")
            else:
                if h:
                    done.append((end, h.hexdigest()))
                end, h = e, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["end", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([h.hexdigest()])], ["end", "ends_sha256"])


NODES = "path long, node binary, parent binary, is_top boolean, conv_id long, depth long, parent_conv_id long, bytes long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shard_trie(rows: pa.Table, level_depth: int, path: int) -> pa.RecordBatch:
    """The nodes of sorted, distinct sequences. Rows of nodes inside the shard are final, but for the parent's conv_id of
    those below a spine or a top, which have the parent's id instead. Rows with a path are of the spines: what the
    shard adds to the node, without what the spines' own nodes add."""
    column = lambda x: rows.column(x).combine_chunks()
    items = column("items")
    sizes = np.diff(items.offsets.to_numpy()) + 1  # with the top
    tops, flat = _words(column("top")), items.flatten()
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(total) - starts[owner]
    word, weight = np.empty((total, 2), np.uint64), np.zeros(total, np.int64)
    word[starts], word[depth > 0], weight[depth > 0] = tops, _words(flat.field("digest")), flat.field("bytes").to_numpy()
    # how many elements each sequence shares with the one before
    before = np.where(owner > 0, starts[owner - 1] + depth, 0)
    differs = (owner == 0) | (depth >= sizes[owner - 1]) | (word[np.minimum(before, total - 1)] != word).any(1)
    shared = np.minimum.reduceat(np.where(differs, depth, sizes[owner]), starts)
    new = depth >= shared[owner]
    depth, weight, owner = depth[new], weight[new], owner[new]
    n = len(depth)
    closes, opens = np.append(0, sizes[:-1] - shared[1:]), sizes - shared
    runs = np.concatenate([[1], np.stack([closes, opens], 1).ravel(), [sizes[-1], 1]])
    bits = np.repeat(np.concatenate([[1], np.tile([0, 1], len(sizes)), [0, 0]]).astype(np.uint8), runs)  # under one root of all
    tree = Parentheses(bits)
    p = np.flatnonzero(bits)[1:]
    q = tree.find_close(p)
    first, after = tree.opened[p] - 2, tree.opened[q] - 1  # the subtree's stretch of the preorder

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[after] - sums[first]

    last = np.append(np.flatnonzero(np.diff(owner)), n - 1)  # the node that each sequence ends at
    at_end = lambda x, empty=0: _at(column(x), last, n, empty)
    n_convs = below(at_end("n"))
    least = np.append(at_end("first", NO_ID), NO_ID)
    conv_id = np.minimum.reduceat(least, np.stack([first, after], 1).ravel())[::2]
    by_depth = np.lexsort((np.arange(n), depth))
    key = depth[by_depth] * (n + 1) + by_depth
    parent = np.where(depth > 0, by_depth[np.searchsorted(key, (depth - 1) * (n + 1) + np.arange(n)) - 1], -1)
    hung, hung_leaves, hung_saved = at_end("hung_children"), at_end("hung_leaves"), at_end("hung_saved")
    children = np.bincount(parent[parent >= 0], minlength=n)
    # the spines
    left = np.arange(int(sizes[0]))
    right = np.array([by_depth[np.searchsorted(depth[by_depth], d, side="right") - 1] for d in range(int(sizes[-1]))])
    spine = np.zeros(n, bool)
    spine[left] = spine[right] = True
    alone = children == 0
    leaves = tree.pairs[q] - tree.pairs[p - 1] + below(np.where(hung > 0, hung_leaves - 1, -(spine & alone).astype(np.int64)))
    saved = below(np.where(spine, 0, (n_convs - 1) * weight) + hung_saved)
    # ids where they are needed
    ids: dict[int, bytes] = {}
    for nodes, i in ((left, 0), (right, len(sizes) - 1)):
        ids |= dict(zip(nodes.tolist(), _bytes(chained(tops[i], word[starts[i] + 1 : starts[i] + sizes[i]])), strict=True))
    ids |= {int(v): x for v, x in zip(np.flatnonzero(depth == 0).tolist(), _bytes(tops[owner[depth == 0]]), strict=True)}
    needs = (parent >= 0) & (spine | spine[parent] | (depth == 1))
    parent_id = [ids[v] if z else None for v, z in zip(parent.tolist(), needs.tolist(), strict=True)]
    ends = np.full(n, None, object)
    ends[last] = column("ends_sha256").to_numpy(zero_copy_only=False)
    inside = np.flatnonzero(~spine)
    again = right[np.isin(right, left)]  # on both paths: only the first has the shares
    order = np.concatenate([inside, left, right])
    paths = np.concatenate([np.full(len(inside), -1), np.full(len(left), path * 2), np.full(len(right), path * 2 + 1)])
    mute = np.concatenate([np.zeros(len(inside) + len(left), bool), np.isin(right, again)])
    zero = lambda x: pa.array(np.where(mute, 0, x[order]).astype(np.int64))
    inner_children = children.copy()
    np.subtract.at(inner_children, parent[spine & (parent >= 0)], 1)  # spine children are counted when merged
    columns = [
        pa.array(paths, mask=paths < 0), pa.array([ids.get(v) for v in order.tolist()], pa.binary()), pa.array([parent_id[v] for v in order.tolist()], pa.binary()), pa.array(depth[order] == 0),
        pa.array(conv_id[order], mask=mute), pa.array(depth[order] + level_depth), pa.array(np.where(parent >= 0, conv_id[parent], 0)[order], mask=needs[order] | (parent[order] < 0)),
        pa.array(weight[order]), zero(n_convs), zero(inner_children + hung), zero(leaves), zero(saved), pa.array(np.where(mute, None, ends[order]), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in NODES.split(", ")])


def _at(values: pa.Array, places: np.ndarray, n: int, empty: int) -> np.ndarray:
    out = np.full(n, empty, np.int64)
    out[places] = values.to_numpy()
    return out


def _tries(batches: Iterator[pa.RecordBatch], level_depth: int, shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted sequences in shards of shard_turns turns."""
    held, size, number = [], 0, 0
    for b in batches:
        sizes = np.diff(b.column(b.schema.get_field_index("items")).offsets.to_numpy()) + 1
        at = 0
        while at < b.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), shard_turns - size) + 1
            part = b.slice(at, int(room))
            held.append(part)
            size += int(sizes[at : at + part.num_rows].sum())
            at += part.num_rows
            if size >= shard_turns:
                yield shard_trie(pa.Table.from_batches(held), level_depth, (TaskContext.get().partitionId() << 24) + number)
                held, size, number = [], 0, number + 1
    if held:
        yield shard_trie(pa.Table.from_batches(held), level_depth, (TaskContext.get().partitionId() << 24) + number)


FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def merged(nodes: DataFrame) -> DataFrame:
    """(node, parent, is_top, FIELDS without parent_conv_id) of the spines of all shards."""
    spines = nodes.where("path IS NOT NULL")
    sums = [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(x).alias(x) for x in ("parent", "is_top", "depth", "bytes", "ends_sha256")]
    each = spines.groupBy("node").agg(*same, *sums, F.min("conv_id").alias("conv_id"), F.min("path").alias("owner"))
    each = save(each, "spines")
    kids = each.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    each = each.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = each.select("node", "owner", F.expr("IF(n_children = 0, 1L, 0L)").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    along = spines.select("path", "depth", "node").join(own, "node")
    down = Window.partitionBy("path").orderBy(F.desc("depth"))
    along = along.select("node", *(F.sum(F.when(F.col("owner") == F.col("path"), F.col(x)).otherwise(0)).over(down).alias(x) for x in ("leaf", "own")))
    totals = along.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    return each.join(totals, "node").select(
        "node", "parent", "is_top", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), "ends_sha256",
    )


def member_hashes(members: DataFrame) -> DataFrame:
    """(end, ends_sha256): sha256 of each node's comma-joined members, ascending. Ids are joined in parallel, in stretches,
    and a node's stretches pass one hash, as the hash demands."""
    ids = members.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(giving_back(_joined_ids), "end binary, at long, ids string")
    return ids.repartition("end").sortWithinPartitions("end", "at").mapInArrow(giving_back(_hashed_ids), "end binary, ends_sha256 string")


def trie(stretches: list[DataFrame], level_turns: int = LEVEL_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(FIELDS) of every node of stretches (STRETCHES), a saved table for each level, the first one first."""
    sequences = [save(s.groupBy("end").agg(F.first("top").alias("top"), F.first("items").alias("items"), F.count("*").alias("n"), F.min("conv_id").alias("first")), "sequences") for s in stretches]
    out, hung = [], None
    for level in range(len(stretches) - 1, -1, -1):
        rows = sequences[level].join(member_hashes(stretches[level].where("last")), "end", "left")
        if hung is None:
            rows = rows.withColumns({x: F.lit(0).cast("long") for x in ("hung_children", "hung_leaves", "hung_saved")})
        else:
            rows = rows.join(hung, "end", "left").na.fill(0, ["hung_children", "hung_leaves", "hung_saved"])
        rows = rows.repartitionByRange("top", "items").sortWithinPartitions("top", "items")
        depth = level * level_turns
        nodes = save(rows.mapInArrow(giving_back(lambda it, d=depth: _tries(it, d, shard_turns)), NODES), "nodes")
        spines = save(merged(nodes), "merged")
        parents = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("_of"))
        if level:  # a top stands for the node that it hangs on
            on = sequences[level - 1].select(F.col("end").alias("parent"), F.col("first").alias("_of"))
            parents = parents.join(spines.where("is_top").select(F.col("node").alias("parent")), "parent", "left_anti").unionByName(on)
        parents = sized(parents)
        inner = nodes.where("path IS NULL").select("node", "parent", "is_top", *FIELDS)
        known = inner.where("parent IS NULL")
        asking = inner.where("parent IS NOT NULL").drop("parent_conv_id").unionByName(spines.where("parent IS NOT NULL"))
        asking = asking.join(parents, "parent", "left").withColumnRenamed("_of", "parent_conv_id")
        root = spines.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
        found = known.unionByName(asking.select(known.columns)).unionByName(root.select(known.columns))
        out.append(found.where("NOT is_top").select(*FIELDS) if level else found.select(*FIELDS))
        if level:
            hung = save(found.where("is_top").select(F.col("node").alias("end"), F.col("n_children").alias("hung_children"), F.col("n_leaves").alias("hung_leaves"), F.col("saved_tokens").alias("hung_saved")), "hung")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.na.fill(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])


def rebuilt(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, digest, bytes, total) of the rebuilt conversations' turns, in no order, and a row with a null pos for
    each that has none; total is how many turns a conversation has."""
    name, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(F.md5(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name, said))).alias("digest"), F.octet_length(said).cast("long").alias("bytes")
    )
    by = ("conv_id", "turn", "digest")
    turns = save(numbered(turns.repartitionByRange(*by).sortWithinPartitions(*by), ["conv_id"], "turns", "i").drop("turn"), "turns")
    own = save(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "lengths")
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    of = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("given")), "base", "left")
    of = of.withColumn("p", F.least("h", F.coalesce("given", F.lit(0)))).withColumn("total", F.col("p") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    of = save(of.select("conv_id", "base", "h", "p", "total"), "heads")
    tail = turns.join(sized(of), "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("p")).alias("pos"), "digest", "bytes", "total")
    head = turns.where("conv_id % 5 = 0 AND i < 8").select(F.col("conv_id").alias("base"), "i", "digest", "bytes").join(sized(of), "base").where("i < p")
    none = of.where("total = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "total")
    return tail.unionByName(head.select("conv_id", F.col("i").alias("pos"), "digest", "bytes", "total")).unionByName(none)


def stretches_of(turns: DataFrame, level_turns: int = LEVEL_TURNS) -> list[DataFrame]:
    """The conversations in stretches of level_turns turns, a saved table (STRETCHES) for each level."""
    level = F.coalesce(F.expr(f"pos DIV {level_turns}"), F.lit(0)).alias("level")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "bytes"))  # nulls are not collected
    cut = save(turns.groupBy("conv_id", level).agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("total").alias("total")), "stretches")
    deepest, out = cut.agg(F.max("level")).first()[0], []
    for i in range(-1 if deepest is None else deepest + 1):
        rows = cut.where(F.col("level") == i).withColumn("last", F.col("total") <= (i + 1) * level_turns)
        rows = rows.join(out[-1].where("NOT last").select("conv_id", F.col("end").alias("top")), "conv_id") if i else rows.withColumn("top", F.lit(bytes(16)))
        out.append(save(rows.select("conv_id", "last", "top", "items").mapInArrow(giving_back(_with_end), STRETCHES), "level"))
    discard(cut)
    return out


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", level_turns: int = LEVEL_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(FIELDS) of every node of the trie of rebuilt conversations.

    A conversation c is rebuilt from the first h = crc32(c) % 9 turns of conversation c - c % 5 and its own turns after its
    first h. A node is a distinct sequence of first turns (role, text), the root the empty one; its members are the
    conversations that begin with it, conv_id the smallest. saved_tokens sums, over a node's subtree with itself, the
    UTF-8 bytes of each node's last text for every member but one.

    Turns are in order of `turn`, nulls first, ties by digest; repeated rows are turns of their own. A null role or text is
    empty; rows with a null conversation belong to none and are left out. A table without conversations has no node, not
    even a root. Other columns are not looked at. Turns are told apart by 128 bits of (role, text).
    """
    stretches = stretches_of(rebuilt(df, conv, turn, role, text), level_turns)
    if not stretches:
        return df.sparkSession.createDataFrame([], ", ".join(f"{x} {'string' if x == 'ends_sha256' else 'long'}" for x in FIELDS))
    return trie(stretches, level_turns, shard_turns)


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: crc32 of a number in decimal, as plain SQL has none.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
#: The same rows by prefixes written out. A turn's bytes count for each member but the smallest of its node, so savings
#: are sums over members of what follows on their paths.
ORACLE = r"""
WITH t AS (SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS i FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, crc.h FROM t JOIN (SELECT conv_id, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)) crc USING (conv_id)),
hd AS (SELECT c.conv_id, o.i AS pos, g, bytes FROM c JOIN o ON o.conv_id = c.base AND o.i < c.h),
p AS (SELECT c.conv_id, c.h, count(hd.pos) AS p FROM c LEFT JOIN hd USING (conv_id) GROUP BY ALL),
r AS (SELECT * FROM hd UNION ALL SELECT conv_id, i - h + p AS pos, g, bytes FROM o JOIN p USING (conv_id) WHERE i >= h),
s AS MATERIALIZED (SELECT p.conv_id, list(g ORDER BY pos) FILTER (g IS NOT NULL) AS gs, list(bytes ORDER BY pos) FILTER (g IS NOT NULL) AS bs FROM p LEFT JOIN r USING (conv_id) GROUP BY 1),
n AS MATERIALIZED (SELECT conv_id, d, coalesce(array_to_string(gs[1:d], ''), '') AS k, CASE WHEN d > 0 THEN coalesce(array_to_string(gs[1:d - 1], ''), '') END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes, d = coalesce(len(gs), 0) AS ends
  FROM (SELECT *, unnest(range(0, coalesce(len(gs), 0) + 1)) AS d FROM s)),
v AS MATERIALIZED (SELECT k, d, up, min(conv_id) AS first, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS sha FROM n GROUP BY k, d, up),
kids AS (SELECT up AS k, count(*) AS kids FROM v WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.conv_id, n.d, n.k, sum(CASE WHEN v.first = n.conv_id THEN 0 ELSE n.bytes END) OVER w AS saved, sum(CASE WHEN n.ends AND v.first = n.conv_id AND kids.k IS NULL THEN 1 ELSE 0 END) OVER w AS leaves
  FROM n JOIN v ON v.k = n.k LEFT JOIN kids ON kids.k = n.k WINDOW w AS (PARTITION BY n.conv_id ORDER BY n.d DESC)),
z AS (SELECT k, sum(saved) AS saved, sum(leaves) AS leaves FROM m GROUP BY k)
SELECT v.first AS conv_id, v.d::BIGINT AS depth, u.first AS parent_conv_id, v.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.sha AS ends_sha256
FROM v JOIN z ON z.k = v.k LEFT JOIN kids ON kids.k = v.k LEFT JOIN v u ON u.k = v.up""".replace("{crc}", _CRC)
