"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in few bits are found by walking pairs of trie nodes together: a pair of nodes carries the
number of bits in which its two paths differ, and is dropped when that number exceeds what is allowed at its depth.
Two tries share the work. The first is keyed by the fingerprint and allows half the budget within its upper 32 bits;
the second is keyed by the halves swapped and allows what is left within the lower 32. Any two fingerprints within
the budget meet in exactly one of them, and both walks stay narrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.graph import components, local_components
from tideline.llm.shared import cut, digests, pieces, small_batches, table, utf8, width
from tideline.llm.tokens import joined, mix
from tideline.llm.tokens import words as split

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
BLOCK = 1 << 16
SOLID = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
BATCH = 1 << 20
SLACK = 3  # standard deviations of the bits that differ between pairs of just the similarity asked for: beyond them the bits decide, within them the shingles
WALK, LEAF = 1 << 15, 16  # node pairs that are walked at once; pairs of fingerprints below which a node pair is compared outright
PAIRS = 1 << 18  # pairs that are compared at once
SMALL = 1 << 14  # links of near-duplicate groups that one task brings together
BLOCKS, PIECES = (0, 2, 4, 6), (1, 3)  # bytes of a segment by which wide fingerprints are dealt out; where the two 16-bit pieces that are searched begin, in bytes from there, round the segment


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as a signed number; 0 where the text has no word."""
    w = text.translate(LOWER).split()  # bytes.split() parts at \x20 and \x09-\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    a, b = starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist()
    for k in range(0, len(a), BLOCK):
        h = np.fromiter([digest(joined[x:y], SEED) for x, y in zip(a[k : k + BLOCK], b[k : k + BLOCK])], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(a), bitorder="little").view(np.int64)[0])


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The set of 64-bit hashes of each text's shingles of `words` whitespace-separated words, A-Z lower-cased; a text of fewer words has one shingle, one of none has none."""
    out: list = []
    while len(out) < len(texts):
        group, held = [], 0
        while len(out) + len(group) < len(texts) and (not group or held < BATCH):
            group.append(texts[len(out) + len(group)])
            held += len(group[-1])
        buf, off = joined(group)
        s, _, h = split(buf, SOLID)
        per = np.searchsorted(s, off)
        for k in range(len(group)):
            w = h[per[k] : per[k + 1]]
            n = min(words, len(w))
            g = np.zeros(len(w) - n + 1 if n else 0, dtype=np.uint64)
            for x in range(n):
                g = g * np.uint64(0x9E3779B97F4A7C15) + w[x : x + len(g)]
            out.append(np.unique(mix(g)))
    return out


def wide_fingerprint(h: np.ndarray, segments: int) -> np.ndarray:
    """`segments` SimHashes of a set of shingle hashes, from independent hashes of the same shingles."""
    total = np.zeros((segments, 64), dtype=np.int64)
    for k in range(0, len(h), BLOCK):
        for s in range(segments):
            v = mix(h[k : k + BLOCK] + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            total[s] += np.unpackbits(v.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row. Null texts count as empty; rows and ids may repeat."""

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray | None, upper: int, budget: int, lower_from: int, head: int = 32, exact: int = 0):
    """Index pairs of the sorted uint64 arrays a and b (b None: a with itself, i < j) that differ in at most
    `upper` of the `head` upper bits but none of the first `exact`, at most `budget` bits in all, and at least `lower_from` of the other ones; in blocks."""
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    one = lambda *v: [np.array([x], dtype=np.int64) for x in v]
    stack = [(0, *one(0, len(a), 0, len(b), 0))]
    deep = head if budget >= upper + 64 - head else 64  # below, nothing is left to prune by
    while stack:
        d, al, ah, bl, bh, e = stack.pop()
        na, nb = ah - al, bh - bl
        leaf = (na * nb <= LEAF) if d < deep else np.ones(len(al), dtype=bool)
        if leaf.any():
            n, la, lb, mb = (na * nb)[leaf], al[leaf], bl[leaf], nb[leaf]
            ends = np.cumsum(n)
            for at in range(0, int(ends[-1]), PAIRS):
                t = np.arange(at, min(at + PAIRS, int(ends[-1])))
                which = np.repeat(np.arange(len(n)), n) if len(t) == ends[-1] else np.searchsorted(ends, t, "right")
                off = t - (ends - n)[which]
                i, j = la[which] + off // mb[which], lb[which] + off % mb[which]
                if own:
                    keep = i < j
                    i, j = i[keep], j[keep]
                x = a[i] ^ b[j]
                hi, lo = np.bitwise_count(x >> np.uint64(64 - head)).astype(np.int64), np.bitwise_count(x & np.uint64((1 << (64 - head)) - 1)).astype(np.int64)
                keep = (hi <= upper) & (hi + lo <= budget) & (lo >= lower_from)
                if exact:
                    keep &= x >> np.uint64(64 - exact) == 0
                if keep.any():
                    yield i[keep], j[keep]
            rest = ~leaf
            al, ah, bl, bh, e = al[rest], ah[rest], bl[rest], bh[rest], e[rest]
        if not len(al):
            continue
        bit = np.uint64(1 << (63 - d))
        above = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - d)) - 1))
        am = np.clip(np.searchsorted(a, (a[al] & above) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & above) | bit), bl, bh)
        most = 0 if d < exact else upper if d < head else budget
        parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1)]
        cross = (am, ah, bl, bm, e + 1)
        if own:  # the mirror image of a node with itself is the pair met already
            keep = al != bl
            cross = tuple(x[keep] for x in cross)
        out = [np.concatenate(x) for x in zip(*parts, cross)]
        keep = (out[4] <= most) & (out[1] > out[0]) & (out[3] > out[2])
        out = [x[keep] for x in out]
        for k in range(0, len(out[0]), WALK):
            stack.append((d + 1, *[x[k : k + WALK].copy() for x in out]))


def _forest(a: np.ndarray, b: np.ndarray | None, upper: int, budget: int, lower_from: int):
    """Links that join the same fingerprints as all of trie_pairs() do: every member to the least of its group."""
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    label = np.arange(len(both), dtype=np.int64)
    for i, j in trie_pairs(a, b, upper, budget, lower_from):
        label = local_components(len(both), *_joined(label, i, j + shift))
    lost = np.flatnonzero(label != np.arange(len(both)))
    return both[lost], both[label[lost]]


def _joined(label, i, j):
    n = np.arange(len(label), dtype=np.int64)
    own = label != n
    return np.concatenate([n[own], i]), np.concatenate([label[own], j])


def _routes(counts: dict[int, int], depth: int, most: int, errors: int) -> tuple[list, int]:
    """Cuts the trie, given the counts of its nodes at `depth`, into nodes of `most` fingerprints at most, and pairs these
    within the error budget (0: only parts of one node meet). -> rows (prefix, part, parts, [(task, side)]), number of tasks."""
    size = [np.zeros(1 << k, dtype=np.int64) for k in range(depth + 1)]
    for p, n in counts.items():
        size[depth][p] = n
    for k in range(depth, 0, -1):
        size[k - 1] = size[k].reshape(-1, 2).sum(axis=1)
    nodes, todo = [], [(0, 0)]  # (prefix, its depth, part, parts)
    while todo:
        p, k = todo.pop()
        if size[k][p] and (size[k][p] <= most or k == depth):
            parts = -(-int(size[k][p]) // most)
            nodes += [(p, k, x, parts) for x in range(parts)]
        elif size[k][p]:
            todo += [(2 * p, k + 1), (2 * p + 1, k + 1)]
    prefix, deep = (np.array([n[x] for n in nodes], dtype=np.int64) for x in (0, 1))
    goes, task = [[] for _ in nodes], 0
    for u in range(len(nodes)):
        k = np.minimum(deep[u], deep[u:])
        near = np.bitwise_count((prefix[u] >> (deep[u] - k)) ^ (prefix[u:] >> (deep[u:] - k))) <= errors
        for v in (np.flatnonzero(near) + u).tolist():
            goes[u].append((task, 0))
            if v != u:
                goes[v].append((task, 1))
            task += 1
    rows = []
    for (p, k, part, parts), g in zip(nodes, goes):
        for x in range(p << (depth - k), (p + 1) << (depth - k)):
            rows.append((x, part, parts, g))
    return rows, task


def _task(swapped: bool, upper: int, budget: int, lower_from: int):
    """The grouped function that walks the tries of the one or two nodes of a task."""

    def run(t):
        k, side = t.column("k").to_numpy().view(np.uint64), t.column("side").to_numpy()
        a, b = np.sort(k[side == 0]), np.sort(k[side == 1])
        x, y = _forest(a, b if (side == 1).any() else None, upper, budget, lower_from)
        if swapped:
            x, y = ((z << np.uint64(32)) | (z >> np.uint64(32)) for z in (x, y))
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})

    return run


def near_links(fps: DataFrame, budget: int = 4, per_task: int = 200_000, nodes: int = 32) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that join all those within `budget` differing bits.

    Each task holds the fingerprints of two trie nodes at most. The trie is cut by a histogram of its prefixes; a
    node holds about 1/nodes of all or per_task, whichever is less, and one that outgrows this by a crowded prefix is dealt out
    in parts that all meet. A task gives a spanning forest of its links, so a group of copies costs links in proportion to its members.
    """
    spark = fps.sparkSession
    total = fps.count()
    schema = "a long, b long"
    if total < 2:
        return spark.createDataFrame([], schema)
    most = max(64, min(per_task, -(-2 * total // nodes)), total // 4096)
    depth = min(14, max(5, (total // most).bit_length()) + 4)
    out = None
    lower = budget // 2
    for swapped, upper, lower_from in ((False, lower, 0), (True, budget - lower - 1, lower + 1)):
        if upper < 0:
            continue
        key = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)) if swapped else F.col("fp")
        keyed = fps.select(key.alias("k"), F.shiftrightunsigned(key, 64 - depth).alias("prefix"))
        counts = {r[0]: r[1] for r in keyed.groupBy("prefix").count().collect()}  # at most 2 ** depth rows
        rows, _ = _routes(counts, depth, most, upper)
        routes = F.broadcast(spark.createDataFrame(rows, "prefix long, part int, parts int, goes array<struct<task:int,side:int>>"))  # at most 2 ** depth prefixes
        dealt = keyed.join(routes, "prefix").where("pmod(xxhash64(k), parts) = part").select("k", F.explode("goes").alias("g"))

        links = dealt.select("k", "g.task", "g.side").groupBy("task").applyInArrow(_task(swapped, upper, budget, lower_from), schema)
        out = links if out is None else out.unionByName(links)
    return out


def classes(docs: DataFrame, budget: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): every row with its SimHash and the smallest doc_id that links of at most
    `budget` differing bits reach from it.

    Null and empty texts, and texts without words, have fingerprint 0 and link like any other. Repeated rows stay and
    share a component. A null doc_id is kept; its component is the smallest non-null id reached, null if there is none.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words), "simhash")
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(near_links(first.select("fp"), budget))
    member = cut(first.join(found.toDF("fp", "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "member")
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(member.join(least, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def bits_for(similarity: float) -> float:
    """Expected share of bits in which SimHashes differ, for shingle sets of equal size of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, i, j): those of the links (i, j), likeliest first, that join what label, the least member of each one's group, holds apart, without a circle; and the labels after them."""
    kept_i, kept_j, rank = [], [], np.arange(len(i))
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b, rank = i[open_], j[open_], a[open_], b[open_], rank[open_]
        if not len(i):
            return label, np.concatenate([*kept_i, i]), np.concatenate([*kept_j, j])
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((rank, high))
        pick = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept_i.append(i[pick])
        kept_j.append(j[pick])
        up = np.arange(len(label))
        up[high[pick]] = low[pick]
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]


def _first_walk(x: np.ndarray, upper: int) -> np.ndarray:
    """The first of the walks that shows a pair, given the bits x (pairs, segments) in which it differs: by segment, block and piece; the block is equal and the piece differs in at most `upper` bits."""
    errors = np.bitwise_count(np.ascontiguousarray(x, dtype=">u8").view(np.uint8).reshape(*x.shape, 8))  # of each byte, the highest first
    shown = [(errors[:, :, q] == 0) & (errors[:, :, (q + p) % 8] + errors[:, :, (q + p + 1) % 8] <= upper) for q in BLOCKS for p in PIECES]
    return np.argmax(np.stack(shown, axis=2).reshape(len(x), x.shape[1] * len(shown)), axis=1)


def _wide_task(segments: int, starts: list[int], upper: int, sure: int, most: int):
    """The grouped function for a block of wide fingerprints: links of rows that have it equal, differ in at most `upper` bits of one of its pieces, and in at most `most` bits in all. A pair counts in the first
    walk that shows it only; starts: the first task of each block.

    Of those within `sure` bits, and of the others, which shingles have to decide, only as many are given (`now`) as would keep groups together if all held; rows that have others besides are given as links to themselves."""

    def run(t):
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        sig = np.stack([t.column(f"f{s}").to_numpy() for s in range(segments)], axis=1).view(np.uint64)
        view = int(np.searchsorted(starts, t.column("task")[0].as_py(), "right")) - 1
        segment, q = view // len(BLOCKS), BLOCKS[view % len(BLOCKS)]
        put = np.argsort(side, kind="stable")
        side, sig, ids = side[put], sig[put], ids[put]
        cut_at = int(np.searchsorted(side, 1))
        turned = lambda x, bits: x << np.uint64(bits) | x >> np.uint64(64 - bits) if bits % 64 else x
        block = turned(sig[:, segment], 8 * q) >> np.uint64(56) << np.uint64(56)
        n, label, more = len(sig), np.arange(len(sig)), np.zeros(len(sig), dtype=bool)
        none = np.zeros(0, dtype=np.int64)
        certain, forest, waiting, held = [(none, none)], (none, none), [(none, none)], 0
        bits = lambda i, j: np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)

        def spanned(forest, waiting):
            """The likeliest links that keep together what these do, of groups that `label` holds apart; the rows of others are marked."""
            i, j = (np.concatenate(z) for z in zip(forest, *waiting))
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            put = np.argsort(bits(i, j), kind="stable")
            _, u, v = _spanning(label, i[put], j[put])
            over = ~np.isin(i * n + j, u * n + v)
            more[i[over]] = more[j[over]] = True
            return u, v

        for walk, p in enumerate(PIECES):
            k = block | turned(sig[:, segment], 8 * (q + p) % 64) >> np.uint64(8)
            left, right = np.argsort(k[:cut_at]), cut_at + np.argsort(k[cut_at:])
            for i, j in trie_pairs(k[left], k[right] if len(right) else None, upper, 64, 0, 24, 8):
                i, j = left[i], (right if len(right) else left)[j]
                apart = label[i] != label[j]  # what certain links hold together needs no others
                i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
                x = sig[i] ^ sig[j]
                d = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(d <= most)
                near = near[_first_walk(x[near], upper) == len(PIECES) * view + walk]
                i, j, d = i[near], j[near], d[near]
                label, x, y = _spanning(label, i[d <= sure], j[d <= sure])
                certain.append((x, y))
                open_ = (d > sure) & (label[i] != label[j])
                waiting.append((i[open_], j[open_]))
                held += int(open_.sum())
                if held > max(BLOCK, len(forest[0])):
                    forest, waiting, held = spanned(forest, waiting), [(none, none)], 0
        x, y = (np.concatenate(z) for z in zip(*certain, spanned(forest, waiting)))
        own = np.flatnonzero(more)
        p, q = ids[np.concatenate([x, own])], ids[np.concatenate([y, own])]
        return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "now": np.arange(len(p)) < len(x)})

    return run


def _most_bits(similarity: float, segments: int) -> int:
    """Differing bits beyond which SimHashes of that many segments tell that a pair is below the similarity."""
    share, bits = bits_for(similarity), 64 * segments
    return int(share * bits + SLACK * (share * (1 - share) * bits) ** 0.5)


def _dealt(wide: DataFrame, segments: int, total: int, per_task: int) -> tuple[DataFrame, list[int]]:
    """(id, f0, f1, .., task, side) and the first task of each block: every row once for each block of each segment, whatever the number of rows, in a task with the rows of equal (or neighbouring) blocks.

    A task holds about `per_task` rows, or as many more as the least that 256 values of a block allow, but 400,000 at most; only a value that has more is dealt out in parts that all meet.
    """
    names = [f"f{s}" for s in range(segments)]
    size = max(per_task, min(4 * per_task, total // 128))
    blocks = [F.shiftrightunsigned(f, 56 - 8 * q).bitwiseAND(255) for f in names for q in BLOCKS]
    keyed = wide.select("id", *names, F.posexplode(F.array(*blocks)).alias("view", "prefix"))
    counts: dict[int, dict[int, int]] = {}
    for view, prefix, n in keyed.groupBy("view", "prefix").count().collect():  # at most 256 rows a block
        counts.setdefault(view, {})[prefix] = n
    rows, tasks, starts = [], 0, []
    for view in range(len(blocks)):
        starts.append(tasks)
        got, more = _routes(counts.get(view, {}), 8, size, 0)
        rows += [(view, p, part, parts, [(tasks + t, side) for t, side in goes]) for p, part, parts, goes in got]
        tasks += more
    routes = F.broadcast(wide.sparkSession.createDataFrame(rows, "view int, prefix long, part int, parts int, goes array<struct<task:int,side:int>>"))
    # The table is small and what a task of it sends is many times that: in more tasks, none has to spill that and merge it again.
    spread = wide.repartition(width(wide.sparkSession)).select("id", *names, F.posexplode(F.array(*blocks)).alias("view", "prefix"))
    dealt = spread.join(routes, ["view", "prefix"]).where("pmod(xxhash64(id), parts) = part").select("id", *names, F.explode("goes").alias("g"))
    return dealt.select("id", *names, "g.task", "g.side"), starts


def similar_links(wide: DataFrame, segments: int, similarity: float = 0.8, budget: int = 8, per_task: int = 100_000) -> DataFrame:
    """Links (a, b, now) between rows (id, f0, f1, ..) of wide fingerprints that may have `similarity` or more: those marked `now` would make the same groups as all, if all held; rows with further links are given once
    more, linked to themselves and not marked. Rows of null id aren't expected; fewer than two rows have no links.

    Two rows are compared if any segment has one of its four blocks of 8 bits equal and one of two 16-bit pieces beside it in at most budget // 4 bits different, and then judged by all segments. Rows meet by equal
    blocks, so that each is sent `segments` * 4 times whatever their number (nodes of a trie within an error budget meet in more pairs the more of them there are); a task walks two tries of its rows.
    """
    total = wide.count()
    if total < 2:
        return wide.sparkSession.createDataFrame([], "a long, b long, now boolean")
    share, bits = bits_for(similarity), 64 * segments
    slack = SLACK * (share * (1 - share) * bits) ** 0.5
    dealt, starts = _dealt(wide, segments, total, per_task)
    run = _wide_task(segments, starts, budget // 4, int(share * bits - slack), _most_bits(similarity, segments))
    return dealt.groupBy("task").applyInArrow(run, "a long, b long, now boolean")


def _similar(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts (id, t) have shingle sets of a Jaccard similarity of `similarity` or more. Links of an id without a text are dropped; no links give none."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "ta", 4 << 20):
                keep = []
                for x, y in zip(*(shingles(b.column(c).to_pylist(), words) for c in ("ta", "tb"))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = width(links.sparkSession)
    both = links.repartition(n, "a").join(texts.toDF("a", "ta").hint("merge"), "a").repartition(n, "b").join(texts.toDF("b", "tb").hint("merge"), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "similar")


def prefix_pairs(texts: DataFrame, groups: DataFrame, words: int = 5, similarity: float = 0.8, segments: int = 0) -> DataFrame:
    """Pairs (a, b) of texts (id, t) of different groups (id, c[, f0, f1, ..]) that can have a Jaccard similarity of `similarity` or more: all such pairs are among them, but for those whose `segments` SimHashes, if
    there are any, are farther apart than such pairs' are but once in about seven hundred.

    In any order common to all texts, two sets of that similarity have a member in common that is among the first n - 2t / (1 + t) * n + 1 of the smaller one and among the first n - t * n + 1 of the other (t: the
    similarity). The order is by how many texts have a shingle, rare ones first: texts around one template that are below the similarity to one another have enough shingles of their own to fill the
    smaller one's first places, so the template brings none together, however many they are. A shingle of one text alone counts as a place and is not sent on. The work follows the shingles, not the
    pairs of a family. Where the first common member comes late in both, too few are left to be in common, and the pair is passed over. Texts of no word have no pairs.
    """

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "t", 4 << 20):
                sets = shingles(b.column("t").to_pylist(), words)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                s = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(s)], ["id", "n", "s"])

    rows = cut(texts.join(groups.select("id").hint("merge"), "id").select("id", "t").mapInArrow(run, "id long, n long, s long"), "shingles")
    often = rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    by = Window.partitionBy("id")
    shared = rows.join(often.hint("merge"), "s").withColumn("place", F.row_number().over(by.orderBy("f", "s")) + F.col("n") - F.count("*").over(by))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    heads = shared.where(F.col("place") <= first(similarity)).select("id", "s", "n", "place", (F.col("place") <= first(2 * similarity / (1 + similarity))).alias("early"))
    names = [f"f{k}" for k in range(segments)]
    heads = cut(heads.join(groups.select("id", "c", *names).hint("merge"), "id"), "heads")
    x, y = (heads.select(F.col("s"), *[F.col(c).alias(f"{c}{z}") for c in ("id", "n", "place", "c", "early", *names)]) for z in "xy")
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") < F.col("idy")))
    left = 1 + F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey"))
    fits = smaller & (F.col("cx") != F.col("cy")) & (F.col("nx") >= similarity * F.col("ny") - 1e-9) & (left >= similarity / (1 + similarity) * (F.col("nx") + F.col("ny")) - 1e-9)
    if names:
        fits = fits & (sum((F.bit_count(F.col(f"{n}x").bitwiseXOR(F.col(f"{n}y"))) for n in names), F.lit(0)) <= _most_bits(similarity, segments))
    near = x.where("earlyx").hint("merge").join(y, "s").where(fits).toDF(*[c if c not in ("idx", "idy") else c[-1] for c in [*x.columns, *y.columns[1:]]])
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, segments: int = 8, budget: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group, that of the smallest id; of rows that repeat both id and text, one. Rows of one id or of null id but of different texts are judged apart.

    Documents are near duplicates if the sets of their shingles of `words` words have a Jaccard similarity of `similarity` or more; a group is what these links reach. Candidates are found by SimHashes of `segments`
    * 64 bits: pairs that have one of four bytes of some segment equal and at most budget // 4 bits of a 16-bit piece beside it different, and by all bits are within three standard deviations of the similarity asked for; the
    shingles of as many as could join groups are then compared. Texts with further candidates meet again by their rarest shingles, see prefix_pairs(), which misses none. (At 0.8, a pair is missed by the bits once in about 800.)
    Null and empty texts are one group, and so are texts without a word. Rows of null id stay only if their group has no
    other; one of them then stands for it. An empty table stays empty. All columns are kept, whatever their names.
    """
    small_batches(docs.sparkSession)
    names = [f"f{s}" for s in range(segments)]

    def run(batches):
        for b in batches:
            got = np.array([wide_fingerprint(h, segments) for h in shingles(b.column(3).to_pylist(), words)], dtype=np.int64).reshape(-1, segments)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(got[:, s]) for s in range(segments)]], [*key, *names])

    key, own = ["doc_id", "h1", "h2"], digests(utf8(text_col))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), own[0].alias("h1"), own[1].alias("h2"), utf8(text_col).alias("t"))
    rows = cut(plain.mapInArrow(run, ", ".join(f"{n} long" for n in [*key, *names])), "wide")
    each = rows.groupBy(*key).count()
    repeats = not each.where("count > 1").isEmpty()
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), *[F.first(f).alias(f) for f in names])
    first = cut(first.select(F.monotonically_increasing_id().alias("id"), F.struct("least.none", "least.doc_id", "h1", "h2").alias("first"), *names), "distinct")
    links = cut(similar_links(first.select("id", *names), segments, similarity, budget), "links")
    need = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    need = cut(need.join(first.hint("merge"), "id").select("id", F.col("first.doc_id").alias("d"), F.col("first.h1").alias("g1"), F.col("first.h2").alias("g2")), "need")
    # Texts are joined by shuffling at every size, so that the work follows the input.
    texts = plain.join(need.hint("merge"), plain["doc_id"].eqNullSafe(need["d"]) & (plain["h1"] == need["g1"]) & (plain["h2"] == need["g2"])).select("id", "t")
    texts = cut(texts.dropDuplicates(["id"]) if repeats else texts, "texts")
    good = _similar(links.where("now").select("a", "b").distinct(), texts, words, similarity)
    found = components(good, SMALL)
    # What these links didn't bring together may be by others: rows that have more meet by their rare shingles, knowing their groups.
    more = links.where("not now").select(F.col("a").alias("id")).distinct()
    groups = more.join(first.select("id", *names).hint("merge"), "id").join(found.toDF("id", "c").hint("merge"), "id", "left")
    groups = cut(groups.select("id", F.coalesce("c", "id").alias("c"), *names), "groups")
    if not groups.isEmpty():
        rest = cut(prefix_pairs(texts, groups, words, similarity, segments), "rest")
        found = components(good.unionByName(_similar(rest, texts, words, similarity)), SMALL)
    member = first.select("id", "first").join(found.toDF("id", "component").hint("merge"), "id", "left").select("first", F.coalesce("component", "id").alias("component"))
    kept = member.groupBy("component").agg(F.min("first").alias("kept")).select("kept.*").toDF("none", "kept", "k1", "k2")
    gone = each.join(kept, each["doc_id"].eqNullSafe(kept["kept"]) & (each["h1"] == kept["k1"]) & (each["h2"] == kept["k2"]), "left_anti")
    gone = cut(gone.select(F.col("doc_id").alias("gone"), F.col("h1").alias("g1"), F.col("h2").alias("g2")), "gone")
    some = kept.select(F.col("kept").alias("some")).distinct()
    # Ids of which no row stays go by the id alone, which is short; digests are needed only where other rows of the id stay.
    whole = cut(gone.join(some, gone["gone"].eqNullSafe(some["some"]), "left_anti").select(F.col("gone").alias("whole")).distinct(), "whole")
    part = cut(gone.join(some, gone["gone"].eqNullSafe(some["some"]), "left_semi"), "part")
    out = docs.join(whole.hint("merge"), docs[id_col].cast("long").eqNullSafe(whole["whole"]), "left_anti")
    if not part.isEmpty():
        out = out.join(part, out[id_col].cast("long").eqNullSafe(part["gone"]) & (own[0] == part["g1"]) & (own[1] == part["g2"]), "left_anti")
    if not repeats:
        return out
    marks = ["_digest_1", "_digest_2"]
    return out.withColumns(dict(zip(marks, own))).dropDuplicates([id_col, *marks]).drop(*marks)


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 4-word shingles, links at 4 or fewer differing bits."""
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
