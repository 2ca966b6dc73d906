"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into dictionary phrases (LZ78: the longest phrase known, and one byte more, is the next phrase). Texts
that compress well together share phrases, so the Jaccard likeness of phrase sets is a cheap stand-in for compression
distance. A fingerprint holds a minimum hash for each of BINS classes of phrases, 16 bits each, 0000 for a class without a phrase.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, table, utf8, width
from tideline.llm.tokens import PIECE, mix, span_hashes

BINS = 128


class Parse:
    """An LZ78 parse that can be forked: phrases end at `ends`; the unfinished rest is a phrase known already."""

    __slots__ = ("ends", "node", "size", "trie", "at")

    def __init__(self):
        self.ends, self.node, self.size, self.trie, self.at = [], 0, 256, {}, 0

    def fork(self) -> Parse:
        new = Parse()
        new.ends, new.node, new.size, new.trie, new.at = self.ends.copy(), self.node, self.size, self.trie.copy(), self.at
        return new

    def feed(self, data: bytes) -> Parse:
        trie, node, size, put = self.trie, self.node, self.size, self.ends.append
        get = trie.get
        for j, c in enumerate(data, self.at + 1):
            key = node + c
            if child := get(key):
                node = child
            else:
                trie[key] = size
                size += 256
                node = 0
                put(j)
        self.node, self.size, self.at = node, size, self.at + len(data)
        return self


def signatures(texts: list[bytes], ends: list[list[int]]) -> np.ndarray:
    """(texts, BINS) array of 16-bit minimum hashes, 0 for an empty class, given the ends of each text's phrases."""
    low = np.full((len(texts), BINS), np.iinfo(np.uint64).max, dtype=np.uint64)

    def add(buf, starts, stops, which):
        h = span_hashes(buf, starts, stops)
        np.minimum.at(low, (which, (h & np.uint64(BINS - 1)).astype(np.int64)), h >> np.uint64(7))

    k = 0
    while k < len(texts):
        group, held = [k], len(texts[k])
        while group[-1] + 1 < len(texts) and held + len(texts[group[-1] + 1]) <= PIECE:
            group.append(group[-1] + 1)
            held += len(texts[group[-1]])
        k = group[-1] + 1
        e = [np.array(ends[g], dtype=np.int64) for g in group]
        s = [np.concatenate([[0], x[:-1]]) if len(x) else x for x in e]
        if held <= 2 * PIECE:
            base = np.concatenate([[0], np.cumsum([len(texts[g]) for g in group])])[:-1]
            if any(map(len, e)):
                add(np.frombuffer(b"".join(texts[g] for g in group), dtype=np.uint8), np.concatenate([x + b for x, b in zip(s, base)]).astype(np.int64), np.concatenate([x + b for x, b in zip(e, base)]).astype(np.int64), np.repeat(group, [len(x) for x in e]))
            continue
        buf, x = np.frombuffer(texts[group[0]], dtype=np.uint8), 0
        while x < len(e[0]):  # one very long text: some of its phrases at a time
            y = max(x + 1, int(np.searchsorted(e[0], s[0][x] + 2 * PIECE, "right")))
            add(buf[s[0][x] : e[0][y - 1]], s[0][x:y] - s[0][x], e[0][x:y] - s[0][x], np.full(y - x, group[0]))
            x = y
    empty = low == np.iinfo(np.uint64).max
    return np.where(empty, 0, mix(low) % np.uint64(65535) + np.uint64(1)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the phrase sets behind two arrays of signatures, row by row; two empty sets are alike."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(some == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(some, 1))


def _ring(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, extra, doc_id, t): rows cut by id into buckets; each bucket is followed by a copy of the first row of the next
    one (extra), the last by that of the first. Order: descending id, nulls last; equal ids by text."""
    spark = docs.sparkSession
    n = 4 * width(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bucket = (F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id")))) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(bucket).cast("int")
    heads = sorted((r["b"], r["m"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("m")).collect())  # a row a bucket
    rows = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    before = F.broadcast(spark.createDataFrame(rows, "head long, target int"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).withColumn("own", bucket)
    placed = own.join(before, own["doc_id"].eqNullSafe(before["head"]), "left")
    both = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("extra")))))
    return placed.select(F.explode(both).alias("p"), "doc_id", "t").select("p.bucket", "p.extra", "doc_id", "t")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next row's
    text; next is by descending id, nulls last, equal ids by text; after the last row comes the first. A table of one row is its own
    next. Null and empty texts have a fingerprint of zeros; two of these are alike (1). Repeated rows are all returned. An empty table
    gives an empty result. Other columns are ignored. Rows are dealt by ranges of ids; a task streams through its ranges and
    holds a row and its successor.
    """
    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        before = None  # (bucket, id, text, str, forked parse of the part that stays, parse)
        done: list = []
        held = 0

        def flush():
            sig = signatures([x for d in done for x in (d[2], d[4], d[6])], [x for d in done for x in (d[3], d[5], d[7])])
            own, edited, after = sig[0::3], sig[1::3], sig[2::3]
            arrays = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[4]).hexdigest() for d in done], pa.string())]
            arrays += [pa.array([r.tobytes().hex() for r in x], pa.string()) for x in (own, edited)]
            arrays += [pa.array(likeness(own, x), pa.float64()) for x in (edited, after)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for k, t in zip(zip(*(c.to_pylist() for c in b.columns[:3])), b.column(3)):
                bucket, extra, doc_id = k
                t = t.as_py()
                s = t.decode("utf-8", "surrogateescape")
                stays = s[: len(s) - len(s) // 2].encode("utf-8", "surrogateescape")
                half = Parse().feed(stays)
                whole = half.fork().feed(t[len(stays) :])
                if before and before[0] == bucket:
                    _, i, t0, s0, kept, half0, whole0 = before
                    more = s[: len(s0) // 2].encode("utf-8", "surrogateescape")
                    done.append((i, len(s0), t0, whole0.ends, kept + more, half0.feed(more).ends, t, whole.ends))
                    held += len(t0) + len(kept) + len(more) + len(t)
                whole.trie = None
                before = None if extra else (bucket, doc_id, t, s, stays, half, whole)
                if held > PIECE:
                    yield flush()
                    done, held = [], 0
        if done:
            yield flush()

    small_batches(docs.sparkSession)
    ring = _ring(docs, id_col, text_col)
    n = width(docs.sparkSession)
    return ring.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "t").mapInArrow(run, shape)


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv fingerprints of all documents and their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
