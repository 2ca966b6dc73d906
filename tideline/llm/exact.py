"""Exact duplicates owned by compressed radix tries.

A text's key in a trie is the hash of its length and content, its length, and all of its bytes: no key begins another, the first bytes deal texts
evenly over subtrees, and two texts share a terminal node only if every byte agrees. A terminal node stores its owner, the row that stays, and how many rows met there.

Tries work twice. Each scan task has one for its own rows; when it holds more bytes than it may, its largest subtrees are given up: their terminals go
to the shuffle as partial owners, and later copies start new ones. Partial owners are then dealt by length and hash, sorted by them, and met in tries again,
of which all subtrees but the current one are closed and given up. So a group of copies sends one text a task however many copies it has, and a text that more than `fan` tasks hold
meets in as many tasks as that takes first. Rows find their owner through the terminal they met in their own task, never through the text, so no group is gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import cut, pieces, table, utf8

HEAD = 16  # bytes of hash and length before the text
NODE = 400  # bytes that a terminal takes besides its text


class Node:
    """A node under an edge of many bytes; a terminal has an owner, the rank and number of the row that stays, the count of rows, and the partial owners that met here."""

    __slots__ = ("below", "count", "label", "owner", "refs")

    def __init__(self, label: bytes):
        self.label, self.below, self.owner, self.count, self.refs = label, None, None, 0, None


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by doubling and halving slices."""
    low, high, step = 0, min(len(a), len(b) - at), 8
    while low + step <= high and a[low : low + step] == b[at + low : at + low + step]:
        low, step = low + step, 2 * step
    high = min(high, low + step - 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[at + low : at + mid] else (low, mid - 1)
    return low


class Trie:
    """A compressed radix trie of keys of which none begins another."""

    def __init__(self):
        self.root, self.held, self.under = Node(b""), 0, [0] * 256
        self.root.below = {}

    def add(self, key: bytes, owner: tuple, count: int, ref: int) -> Node:
        """The terminal of the key, whose owner is the greatest that came."""
        node, at = self.root, 0
        while True:
            child = node.below.get(key[at])
            if child is None:
                leaf = node.below[key[at]] = Node(key[at:])
                leaf.owner, leaf.count, leaf.refs = owner, count, [ref]
                self.held += len(leaf.label) + NODE
                self.under[key[0]] += len(leaf.label) + NODE
                return leaf
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                if at == len(key):
                    if owner > node.owner:
                        node.owner = owner
                    node.count += count
                    node.refs.append(ref)
                    return node
            else:
                n = shared_length(child.label, key, at)
                fork = node.below[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                fork.below = {child.label[0]: child}
                node, at = fork, at + n

    def terminals(self, first: int):
        """(key, terminal) of the subtree under a first byte."""
        if first not in self.root.below:
            return
        todo = [(b"", self.root.below[first])]
        while todo:
            above, node = todo.pop()
            key = above + node.label
            if node.below is None:
                yield key, node
            else:
                todo += [(key, child) for child in node.below.values()]

    def give_up(self, down_to: int = 0):
        """Spills the largest subtrees until at most `down_to` bytes are held. -> (key, terminal)"""
        for first in sorted(range(256), key=self.under.__getitem__, reverse=True):
            if self.held <= down_to:
                return
            yield from self.terminals(first)
            self.root.below.pop(first, None)
            self.held -= self.under[first]
            self.under[first] = 0


def key_of(text: bytes) -> tuple[bytes, int]:
    """(key, hash of length and content as a signed number)"""
    h = xxhash.xxh64_intdigest(text, len(text) & 0xFFFFFFFF)
    return h.to_bytes(8, "big") + len(text).to_bytes(8, "big") + text, h - (h >> 63 << 64)


PARTS = {"h": pa.int64(), "size": pa.int64(), "t": pa.binary(), "rank": pa.int64(), "owner": pa.int64(), "count": pa.int64()}
SCAN = {"row": pa.int64(), "doc_id": pa.int64(), "ref": pa.int64()} | PARTS
MET = {"ref": pa.int64(), "to": pa.int64()} | PARTS | {"sha": pa.binary()}
KINDS = {pa.int64(): "long", pa.binary(): "binary"}
ddl = lambda fields: ", ".join(f"{k} {KINDS[v]}" for k, v in fields.items())


def _batch(fields: dict, **columns):
    n = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], v) if k in columns else pa.nulls(n, v) for k, v in fields.items()], list(fields))


def _partial(found, fields: dict, most: int = 8 << 20):
    """Batches of partial owners, of about `most` bytes of texts each."""
    rows, held = [], 0
    for key, leaf in found:
        h = int.from_bytes(key[:8], "big", signed=True)
        has, rank, row = leaf.owner
        rows.append((leaf.refs[0], h, len(key) - HEAD, key[HEAD:], rank if has else None, ~row, leaf.count))
        held += len(key)
        if held > most:
            yield _batch(fields, **dict(zip(("ref", *PARTS), zip(*rows))))
            rows, held = [], 0
    if rows:
        yield _batch(fields, **dict(zip(("ref", *PARTS), zip(*rows))))


def _scan(held: int):
    """Rows with the partial owner each met in its task's trie, and the partial owners."""

    def run(batches):
        trie = Trie()
        for whole in batches:
            for b in pieces(whole, "t"):
                row, ids, rank = (b.column(c).to_pylist() for c in ("row", "doc_id", "rank"))
                refs = []
                for r, k, t in zip(row, rank, b.column("t").to_pylist()):
                    leaf = trie.add(key_of(t)[0], (k is not None, k or 0, ~r), 1, r)
                    del leaf.refs[1:]
                    refs.append(leaf.refs[0])
                yield _batch(SCAN, row=row, doc_id=ids, ref=refs)
                if trie.held > held:
                    yield from _partial(trie.give_up(held // 2), SCAN)
        yield from _partial(trie.give_up(), SCAN)

    return run


def _meet(last: bool):
    """Partial owners, sorted by hash and length, as (ref, to: one of those that have the same text), with the text's owner: with that row's rank and number and the digest if this is the last meeting, else as a partial owner again."""

    def closed(found):
        rows = []
        for key, leaf in found:
            has, rank, row = leaf.owner
            to = leaf.refs[0]
            sha = hashlib.sha256(memoryview(key)[HEAD:]).digest()
            rows += [(ref, to, rank if has else None, ~row, leaf.count, sha) for ref in leaf.refs]
            if len(rows) >= 10_000:
                yield _batch(MET, **dict(zip(("ref", "to", "rank", "owner", "count", "sha"), zip(*rows))))
                rows = []
        if rows:
            yield _batch(MET, **dict(zip(("ref", "to", "rank", "owner", "count", "sha"), zip(*rows))))

    def again(found):
        for key, leaf in found:
            yield _batch(MET, ref=leaf.refs, to=[leaf.refs[0]] * len(leaf.refs))
            yield from _partial([(key, leaf)], MET)

    finish = closed if last else again

    def run(batches):
        trie, now = Trie(), None
        for whole in batches:
            for b in pieces(whole, "t"):
                for h, *x in zip(*(b.column(c).to_pylist() for c in ("h", "ref", "t", "rank", "owner", "count"))):
                    if h != now and trie.held > 8 << 20:  # all subtrees of former hashes are closed
                        yield from finish(trie.give_up())
                    now = h
                    ref, t, rank, owner, count = x
                    trie.add(h.to_bytes(8, "big", signed=True) + len(t).to_bytes(8, "big") + t, (rank is not None, rank or 0, ~owner), count, ref)
        yield from finish(trie.give_up())

    return run


def owners(docs: DataFrame, keep: str = "largest", held: int = 64 << 20, fan: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: equal texts are one group, of which the row with the largest (or smallest) id stays.

    Texts are equal if all their bytes are; a null text is empty and equal to other empty ones. A null id loses to any other. Of rows that repeat id and text one is kept, so each group has just one kept row. group_size counts
    rows. An empty table gives an empty result; other columns are ignored, whatever their names. A scan task's trie holds about `held` bytes, a later one 8 MB and one text; texts that more than `fan` partial owners have are met in steps of about `fan`.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    i = F.col(id_col).cast("long")
    rank = i if keep == "largest" else F.bitwise_not(i)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), i.alias("doc_id"), rank.alias("rank"), utf8(text_col).alias("t"))
    scanned = cut(rows.mapInArrow(_scan(held), ddl(SCAN)), "scanned")
    parts, moved = scanned.where("t is not null").select("ref", *PARTS), None
    while True:
        hot = cut(parts.groupBy("h", "size").agg(F.count("*").alias("held_by")).where(F.col("held_by") > fan), "hot")
        if hot.isEmpty():
            break
        some = parts.join(hot, ["h", "size"]).withColumn("salt", F.pmod(F.xxhash64("ref"), F.ceil(F.col("held_by") / fan)))
        met = cut(some.repartition("h", "size", "salt").sortWithinPartitions("h", "size", "salt").mapInArrow(_meet(False), ddl(MET)), "met")
        step = met.where("t is null and ref <> to").select("ref", "to")
        moved = step if moved is None else cut(moved.join(step.toDF("to", "next"), "to", "left").select("ref", F.coalesce("next", "to").alias("to")).unionByName(step), "moved")
        parts = parts.join(hot, ["h", "size"], "left_anti").unionByName(met.where("t is not null").select("ref", *PARTS))
    last = cut(parts.repartition("h", "size").sortWithinPartitions("h", "size").mapInArrow(_meet(True), ddl(MET)).select("ref", "rank", "owner", "count", "sha"), "owners")
    if moved is not None:
        last = last.unionByName(moved.join(last.withColumnRenamed("ref", "to"), "to").select("ref", "rank", "owner", "count", "sha"))
    out = scanned.where("t is null").select("row", "doc_id", "ref").join(last, "ref")
    kept_id = F.col("rank") if keep == "largest" else F.bitwise_not("rank")
    return out.select("doc_id", kept_id.alias("keep_id"), F.col("count").alias("group_size"), (F.col("row") == F.col("owner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were. Where rows repeat both id and text, some one of them stays."""
    kept = owners(docs, keep, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("kept"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.sha2(utf8(text_col), 256).alias("digest"))
    out = rows.join(kept, rows["id"].eqNullSafe(kept["kept"]) & (rows["digest"] == kept["sha"]))
    return out.dropDuplicates(["kept", "sha"]).select("doc.*")


def op11_exact_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of all documents' texts: of equal ones the largest doc_id stays."""
    return owners(table(spark, sf_dir, "documents"))


ORACLE_OP11 = """
with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as n from documents group by 1)
select d.doc_id, g.keep_id, g.n as group_size, d.doc_id = g.keep_id as kept, sha256(g.t) as text_sha256 from documents d join g on coalesce(d.text, '') = g.t
"""
