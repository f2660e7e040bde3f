"""Exact dedup with owners kept in Patricia tries.

Texts are equal when their UTF-8 bytes are. Nothing but a walk through a compressed radix trie decides
that: a digest only says where a text goes.

1. Each task inserts its own documents into a trie and hands on one row per different text, with the ids
   that share it. Copies are thereby combined before the shuffle, so a text that a third of all rows
   repeat is one row per task afterwards, not a hot group.
2. The rows are dealt by length and content hash, to a number of parts that follows the bytes. Each part
   inserts full byte strings into its trie; a terminal node holds the owner (the row that stays), the
   number of documents and the rows of step 1 that end there.
3. A trie that outgrows its budget gives up its heaviest subtrees: the strings in them, and all that
   reach them later, go on as rows of a table in the shared folder, dealt again to as many parts as they
   need. A string's path through the trie is fixed, so equal strings take the same turn, and the first
   string of a trie is never given up, so every round settles some.
4. Owners return to the documents through the rows of step 1.

Defined results: null counts as empty, and empty texts are equal to each other; the row with the largest
id stays (a null id is smaller than any other; of rows with the same id and text one stays); very
long texts pass through a trie as they are, one at a time beyond the budget; an empty table gives no rows;
other columns are ignored (``owners_only`` returns them as they were, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm.tables import written

TRIE_BYTES = 128 << 20  # a trie's budget in a task: labels, nodes and what terminal nodes hold
LOCAL_BYTES = 32 << 20  # the same for the tries that combine copies before the shuffle
PART_BYTES = 64 << 20  # text bytes of an average part
NODE_BYTES = 200  # a node with its dictionary entry, about


class Node:
    """An edge label with what lies below it. ``held`` is what a terminal node stores; a node given up is
    ``spilled`` and has nothing below."""

    __slots__ = ("label", "children", "held", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.held, self.spilled = label, None, None, False


def shared_bytes(text: bytes, at: int, label: bytes) -> int:
    """How many of the label's bytes the text has from ``at`` on: doubling steps, then bisection."""
    if text.startswith(label, at):
        return len(label)
    lo, most, step = 0, min(len(label), len(text) - at), 16
    while lo + step <= most and text[at + lo : at + lo + step] == label[lo : lo + step]:
        lo, step = lo + step, step * 2
    hi = min(lo + step, most + 1)  # the first difference is at lo or later, and before hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if text[at + lo : at + mid] == label[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """A compressed radix trie over full byte strings; ``size`` follows its memory."""

    def __init__(self):
        self.root, self.size, self.first = Node(b""), 0, None

    def reach(self, text: bytes) -> Node:
        """The node where the text ends, made if need be, or the node given up that its path meets."""
        if self.first is None:
            self.first = text
        node, at = self.root, 0
        while not node.spilled and at < len(text):
            first = text[at]
            child = node.children.get(first) if node.children else None
            if child is None:
                child = Node(text[at:])
                if node.children is None:
                    node.children = {}
                node.children[first] = child
                self.size += NODE_BYTES + len(child.label)
                return child
            k = shared_bytes(text, at, child.label)
            if k < len(child.label):  # the label parts here
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children = {child.label[0]: child}
                node.children[first] = upper
                self.size += NODE_BYTES
                child = upper
            node, at = child, at + k
        return node

    def walk(self, node: Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(string, terminal node) of every string at or below ``node``, whose own string is ``path``."""
        todo = [(node or self.root, path)]
        while todo:
            at, text = todo.pop()
            if at.held is not None:
                yield text, at
            for child in (at.children or {}).values():
                todo.append((child, text + child.label))

    def weights(self) -> dict[int, int]:
        """Bytes at and below each node (by identity), without recursion."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend((node.children or {}).values())
        out: dict[int, int] = {}
        for node in reversed(order):
            own = NODE_BYTES + len(node.label) + (8 * len(node.held["uids"]) if node.held else 0)
            out[id(node)] = own + sum(out[id(c)] for c in (node.children or {}).values())
        return out

    def give_up(self, goal: int) -> Iterator[tuple[bytes, dict, int]]:
        """Give up the heaviest subtrees until ``goal`` bytes or nothing beside the first string's path is
        left: (string, what its node held)."""
        weight, beside = self.weights(), []
        node, at = self.root, 0
        while node is not None:  # the path of the first string stays, so every trie settles something
            below = None
            for child in (node.children or {}).values():
                if self.first.startswith(child.label, at):
                    below = child
                elif not child.spilled:
                    beside.append((weight[id(child)], self.first[:at] + child.label, child))
            node, at = below, at + (len(below.label) if below else 0)
        for heavy, path, node in sorted(beside, key=lambda x: -x[0]):
            if self.size <= goal:
                return
            yield from ((text, end.held) for text, end in self.walk(node, path))
            node.children, node.held, node.spilled = None, None, True
            self.size -= heavy - NODE_BYTES - len(node.label)


def _local_classes(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """(uid, n_bytes, hash, sha, text, ids): one row per different text of a task's trie."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, made = PatriciaTrie(), TaskContext.get().partitionId() << 33

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal made
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for raw, node in trie.walk():
                for col, v in zip(cols, (made, len(raw), node.held["hash"], hashlib.sha256(raw).hexdigest(), raw, node.held["ids"])):
                    col.append(v)
                made, size = made + 1, size + len(raw)
                if size > 8 << 20:
                    yield batch(cols, id_type)
                    cols, size = [[], [], [], [], [], []], 0
            yield batch(cols, id_type)

        def batch(cols: list[list], id_type: pa.DataType) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(id_type))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["uid", "n_bytes", "hash", "sha", "text", "ids"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for key, h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                node = trie.reach(raw.as_py())
                if node.held is None:
                    node.held = {"hash": h, "ids": []}
                node.held["ids"].append(key)
                trie.size += 16
                if trie.size > budget:
                    yield from flush(id_type)
                    trie = PatriciaTrie()
        if id_type is not None:
            yield from flush(id_type)

    return rows.mapInArrow(run, f"uid bigint, n_bytes bigint, hash bigint, sha string, text binary, ids array<{kind}>")


def _better(a: tuple, b: tuple) -> tuple:
    """The owner of two (id, uid): the larger id, no id last; the same id: the smaller uid."""
    if a[0] is None or b[0] is None or a[0] == b[0]:
        if (a[0] is None) == (b[0] is None):
            return min(a, b, key=lambda x: x[1])
        return b if a[0] is None else a
    return max(a, b, key=lambda x: x[0])


def _insert_round(rows: DataFrame, id_kind: str, parts: int, budget: int) -> DataFrame:
    """Each part's trie over its rows: terminal nodes (``text`` is null), and the rows of subtrees given up."""
    names = ["keep_id", "keep_uid", "n", "uids", "n_bytes", "hash", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = PatriciaTrie(), None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(cols, names)], names=names)

        def row(held: dict, text: bytes | None) -> tuple:
            return (*held["owner"], held["n"], held["uids"], held["n_bytes"], held["hash"], text)

        def grouped(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for x in found:
                out.append(x)
                size += len(x[-1] or b"") + 8 * len(x[3]) + 64
                if size > 8 << 20:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

        for b in batches:
            schema = b.schema
            passed = []
            fixed = zip(*(b.column(n).to_pylist() for n in names[:-1]))
            for (keep_id, keep_uid, n, uids, n_bytes, h), raw in zip(fixed, b.column("text")):
                raw = raw.as_py()
                node = trie.reach(raw)
                held = {"owner": (keep_id, keep_uid), "n": n, "uids": uids, "n_bytes": n_bytes, "hash": h}
                if node.spilled:
                    passed.append(row(held, raw))
                    continue
                if node.held is None:
                    node.held = held
                else:
                    node.held["owner"] = _better(node.held["owner"], held["owner"])
                    node.held["n"] += n
                    node.held["uids"] += uids
                trie.size += 8 * len(uids)
                if trie.size > budget + len(trie.first):
                    yield from grouped(row(x, text) for text, x in trie.give_up(budget // 2 + len(trie.first)))
            yield from grouped(iter(passed))
        if schema is not None:
            yield from grouped(row(node.held, None) for _, node in trie.walk())

    kinds = f"keep_id {id_kind}, keep_uid bigint, n bigint, uids array<bigint>, n_bytes bigint, hash bigint, text binary"
    return rows.select(*names).repartition(parts, "n_bytes", "hash").mapInArrow(run, kinds)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES,
                 local_bytes: int = LOCAL_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of every row."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    local = written(_local_classes(docs, id_col, text_col, local_bytes), "trie-local")
    rows = local.select(F.array_max("ids").alias("keep_id"), F.col("uid").alias("keep_uid"), F.size("ids").cast("bigint").alias("n"), F.array("uid").alias("uids"),
                        "n_bytes", "hash", "text")
    ends = None
    while size := rows.agg(F.sum(F.col("n_bytes") + 64).cast("bigint")).first()[0]:
        parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
        found = written(_insert_round(rows, kind, parts, trie_bytes), "trie-round")
        done = found.where("text is null").select("keep_id", "keep_uid", F.col("n").alias("group_size"), F.explode("uids").alias("uid"))
        ends = done if ends is None else ends.unionByName(done)
        rows = found.where("text is not null")
    members = local.select("uid", "sha", F.coalesce(F.array_position("ids", F.array_max("ids")) - 1, F.lit(0)).alias("first"), F.posexplode("ids").alias("pos", "id"))
    if ends is None:
        return members.select("id", F.col("id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    kept = (F.col("uid") == F.col("keep_uid")) & (F.col("pos") == F.col("first"))
    return members.join(ends, "uid").select("id", "keep_id", "group_size", kept.alias("kept"), "sha")


def owners_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("stay_id"), F.col("sha").alias("stay_sha"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("own_id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("own_sha"))
    met = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_sha") == F.col("stay_sha")), "left_semi")
    order = Window.partitionBy("own_id", "own_sha").orderBy(F.to_json("doc"))  # rows that repeat an id and its text
    return met.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc.*")


DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
