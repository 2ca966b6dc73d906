"""Product-quantizer codes of vectors by Lloyd's rounds with heaps of bounds.

A vector's parts each have an entry of their position's codebook. In the first scan every part is compared with all entries, and its slack is kept: how
much farther the second nearest entry is than the nearest. When entries move, a part's slack shrinks at most by what its own entry moved plus the most that any other did. So each entry
has a cumulative drift, a part's key is its slack plus the drift at the time it was found, and as long as the key is above the entry's drift
now, the part can't have changed its entry. A task puts the keys of its parts into one heap for each position and entry, pops those that the drift has reached, and compares these alone with all entries again.
All other keys stay as they are. Keys are rounded down and drifts up, so that a tie is always compared exactly.

The rows of a scan carry their integers, entries and keys; they are written between rounds, along with each task's sums of the parts that came to an entry or left it.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.shared import cut, table

LIMIT = 1 << 26  # components are held within this, so that sums of squares are exact in 64 bits
ROWS = 8192  # vectors whose heaps are built together
SHRINK = 1e-9


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(n, k) exact squared distances of integer rows to integer entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every number below is whole in a double
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    out = np.empty((len(x), len(book)), dtype=np.int64)
    for k, c in enumerate(book):
        d = x - c
        out[:, k] = (d * d).sum(axis=1)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of each row: the nearest entry, the lowest of equal ones, and a lower bound of how much farther the next is."""
    d = squared(x, book)
    entry = d.argmin(axis=1)
    if len(book) == 1:
        return entry, np.full(len(x), np.inf)
    own = d[np.arange(len(x)), entry].astype(np.float64)
    d = d.astype(np.float64)
    d[np.arange(len(x)), entry] = np.inf
    u, v = np.sqrt(own), np.sqrt(d.min(axis=1))
    return entry, v - u - SHRINK * (v + u)


def rounded_down(x: np.ndarray) -> np.ndarray:
    """Single floats that are less than the numbers."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(parts, entries): how far each entry moved plus how far the farthest of the others did, rounded up."""
    d = after.astype(np.float64) - before.astype(np.float64)
    moved = np.sqrt((d * d).sum(axis=2)) * (1 + SHRINK)
    first = moved.argmax(axis=1)
    rows = np.arange(len(moved))
    most = moved[rows, first]
    rest = moved.copy()
    rest[rows, first] = 0
    other = np.repeat(most[:, None], moved.shape[1], axis=1)
    other[rows, first] = rest.max(axis=1)
    return (moved + other) * (1 + SHRINK)


def violated(entry: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Indices of the parts of one position whose key isn't above their entry's drift: popped from a heap for each entry."""
    order = np.argsort(entry, kind="stable")
    ends = np.searchsorted(entry[order], np.arange(len(drift) + 1))
    out: list[int] = []
    for e in range(len(drift)):
        mine = order[ends[e] : ends[e + 1]]
        if not len(mine) or drift[e] <= 0:
            continue
        heap = list(zip(key[mine].tolist(), mine.tolist()))
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[e]:
            out.append(heapq.heappop(heap)[1])
    return np.array(sorted(out), dtype=np.int64)


def _whole(batch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _fixed(batch, column: str, kind, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=kind).reshape(-1, parts)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _scan(books: np.ndarray, drift: np.ndarray | None, label: pa.DataType):
    """Rows with their entries and keys, and at the task's end what it adds to the sums of entries. drift: None for the first scan, which compares all; else the cumulative drift."""
    parts, k, d = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, k, d), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _whole(b, parts * d).reshape(-1, parts, d)
                if drift is None:
                    code, key = np.zeros((len(x), parts), dtype=np.uint16), np.zeros((len(x), parts), dtype=np.float32)
                else:
                    code, key = _fixed(b, "code", np.uint16, parts).copy(), _fixed(b, "key", np.float32, parts).copy()
                for p in range(parts):
                    again = np.arange(len(x)) if drift is None else violated(code[:, p], key[:, p], drift[p])
                    if not len(again):
                        continue
                    own, (entry, slack) = code[again, p].astype(np.int64), nearest(x[again, p], books[p])
                    code[again, p] = entry
                    key[again, p] = rounded_down(slack if drift is None else slack + drift[p][entry])
                    moved = np.arange(len(again)) if drift is None else np.flatnonzero(own != entry)
                    np.add.at(sums[p], entry[moved], x[again[moved], p])
                    counts[p] += np.bincount(entry[moved], minlength=k)
                    if drift is not None:
                        np.subtract.at(sums[p], own[moved], x[again[moved], p])
                        counts[p] -= np.bincount(own[moved], minlength=k)
                n = len(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q").cast(kinds[2]), _bytes(code), _bytes(key), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        p, e = np.nonzero(counts.astype(bool) | sums.any(axis=2))
        if len(p):
            empty = [pa.nulls(len(p), t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names)

    names = ["vec_id", "label", "q", "code", "key", "part", "entry", "n", "s"]
    kinds = [pa.int64(), label, pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return run


def _last(books: np.ndarray, drift: np.ndarray):
    """(vec_id, label, code, error) after the last move of the entries."""
    parts, _, d = books.shape

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _whole(b, parts * d).reshape(-1, parts, d)
                code, key = _fixed(b, "code", np.uint16, parts).astype(np.int64), _fixed(b, "key", np.float32, parts)
                error = np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    again = violated(code[:, p], key[:, p], drift[p])
                    if len(again):
                        code[again, p] = nearest(x[again, p], books[p])[0]
                    off = x[:, p] - books[p][code[:, p]]
                    error += (off * off).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(["".join(f"{v:02x}" for v in r) for r in code.tolist()], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q): rows whose vector isn't null or empty and has no null or non-finite component, each component as floor(scale * x), held within 2^26 either way."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), q.alias("q"))


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) for every vector that is kept, codebooks (parts, entries, components)).

    Codebooks start as the parts of the `entries` smallest ids (ties by the vector itself, null ids last; all vectors where there are fewer). Each round gives every part the nearest entry, of equal ones the lowest, then moves each entry to the componentwise
    floor of its parts' mean; entries without a part stay. At last parts are assigned again. code: two hex digits a part; error: the squared distances summed over parts.

    Rows without a usable vector are dropped, see whole_vectors(), and so are vectors of another length than that of the smallest id, which has to be a multiple of `parts`. Repeated rows count as often as they occur. An empty table gives an empty result and empty codebooks.
    Other columns are ignored. What passes through the driver is the codebooks and their sums: parts * entries rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[label_col].dataType
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    rows = whole_vectors(vectors, scale, id_col, vector_col, label_col)
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(*order).select("q").limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {kind.simpleString()}, code string, error long"), np.zeros((parts, 0, 0), dtype=np.int64)
    dims = len(first[0]["q"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("q") == dims)
    start = np.array([r["q"] for r in rows.orderBy(*order).select("q").limit(entries).collect()], dtype=np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    sums, counts, drift = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64), None
    schema = f"vec_id long, label {kind.simpleString()}, q array<int>, code binary, key binary, part int, entry int, n long, s array<long>"
    for r in range(rounds):
        state = cut(rows.mapInArrow(_scan(books, drift, to_arrow_type(kind)), schema), f"round{r}")
        added = state.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[x]).alias(f"s{x}") for x in range(dims // parts)])
        for row in added.collect():  # parts * entries rows at most
            counts[row[0], row[1]] += row[2]
            sums[row[0], row[1]] += np.array(row[3:], dtype=np.int64)
        moved = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        drift = drifts(books, moved) + (0 if drift is None else drift)
        books, rows = moved, state.where("part is null").select("vec_id", "label", "q", "code", "key")
    return rows.mapInArrow(_last(books, drift), f"vec_id long, label {kind.simpleString()}, code string, error long"), books


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds."""
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    coded = cut(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


DISTANCE = " + ".join(f"(a.x[{i}] - b.c[{i}]) * (a.x[{i}] - b.c[{i}])" for i in range(1, 5))
ASSIGNED = f"select a.vec_id, a.label, a.p, any_value(a.x) as x, min(({DISTANCE}) * 64 + b.e) as m from parts a join {{book}} b on a.p = b.p group by a.vec_id, a.label, a.p"
MOVED = """select b.p, b.e, coalesce(n.c, b.c) as c from {book} b left join (
    select p, m % 64 as e, [cast(floor(sum(x[1]) / count(*)) as bigint), cast(floor(sum(x[2]) / count(*)) as bigint), cast(floor(sum(x[3]) / count(*)) as bigint), cast(floor(sum(x[4]) / count(*)) as bigint)] as c from {assigned} group by 1, 2
  ) n on n.p = b.p and n.e = b.e"""
#: For vectors of 64 components, distinct ids, and squared distances below 2 ** 57.
ORACLE_OP13 = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select vec_id, label, p, q[4 * p + 1:4 * p + 4] as x from kept, range(16) t(p)
), first as (
  select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64
), book0 as (
  select p, e, x as c from parts join first using (vec_id)
), assigned0 as ({ASSIGNED.format(book='book0')}
), book1 as ({MOVED.format(book='book0', assigned='assigned0')}
), assigned1 as ({ASSIGNED.format(book='book1')}
), book2 as ({MOVED.format(book='book1', assigned='assigned1')}
), coded as ({ASSIGNED.format(book='book2')}
), digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as d from book2
), v as (
  select vec_id, label, string_agg(format('{{:02x}}', m % 64), '' order by p) as code, cast(sum(m // 64) as bigint) as error from coded group by vec_id, label
), by_label as (
  select label, sum(error) as label_error from v group by label
)
select v.vec_id, v.code, v.error, cast(l.label_error as bigint) as label_error, digest.d as codebooks_sha256 from v join by_label l on v.label is not distinct from l.label, digest
"""
