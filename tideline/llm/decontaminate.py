"""Benchmark decontamination by an FM-index of every training shard.

A shard is a few megabytes of documents as they stream through a task. Its words become numbers: those that occur in the
test set keep one each, all others are separators, since no test phrase contains them; stretches shorter than the
shortest test phrase are dropped for the same reason. The suffix array of what is left gives a Burrows-Wheeler
transform, kept as a wavelet matrix; test phrases are searched backwards in it, all at once, and their
occurrences located through sampled suffix positions. No shuffle takes place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import cut, digests, small_batches, table, utf8
from tideline.llm.tokens import joined, words

SHARD = 6 << 20
SAMPLE = 8


class FMIndex:
    """Of a sequence of numbers from 0 to sigma - 1, in which 0 separates stretches; it must end with 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        sa = suffix_array(seq)
        before = np.where(sa > 0, seq[sa - 1], 0)
        counts = np.bincount(seq, minlength=sigma + 1)
        self.c = np.concatenate([[0], np.cumsum(counts)])[: sigma + 1]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, cur = [], [], before
        for b in range(self.bits - 1, -1, -1):
            one = (cur >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            cur = np.concatenate([cur[one == 0], cur[one == 1]])
        self.first = np.zeros(1 << self.bits, dtype=np.int64)  # where a symbol's run begins on the last level
        symbol, at = np.unique(cur, return_index=True)
        self.first[symbol] = at
        self.before = before.astype(np.int32)
        self.marked = (sa % sample == 0) | (before == 0)
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.positions = sa[self.marked]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i places of the transform."""
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1
            r = self.ones[level][i]
            i = np.where(one == 1, self.zeros[level] + r, i - r)
        return i - self.first[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of `patterns` (all of one length) that occur: (row, low, high) of suffix ranges, none empty."""
        row = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.before), dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[row, k]
            lo, hi = self.c[s] + self.rank(s, lo), self.c[s] + self.rank(s, hi)
            keep = hi > lo
            row, lo, hi = row[keep], lo[keep], hi[keep]
        return row, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes with these ranks."""
        out, steps, open_ = np.zeros(len(i), dtype=np.int64), 0, np.arange(len(i))
        while len(open_):
            there = self.marked[i]
            out[open_[there]] = self.positions[self.mark_rank[i[there]]] + steps
            open_, i = open_[~there], i[~there]
            s = self.before[i].astype(np.int64)
            i = self.c[s] + self.rank(s, i)
            steps += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; separators (0) are told apart by position, so no comparison passes one."""
    n = len(seq)
    zero = seq == 0
    order = np.argsort(np.where(zero, np.cumsum(zero), seq + np.count_nonzero(zero)), kind="stable")
    key = np.where(zero, np.cumsum(zero), seq + np.count_nonzero(zero))[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        single = head & np.append(head[1:], True) if n else head
        open_ = np.flatnonzero(~single)  # places in `order` whose groups aren't resolved; each group is a run of them
        if not len(open_):
            return order
        who = order[open_]
        follow = rank[np.minimum(who + step, n - 1)]  # a group with more than one member never reaches past the last separator
        put = np.lexsort((follow, rank[who]))
        who, follow = who[put], follow[put]
        old = rank[who]
        order[open_] = who
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])])
        head[open_] = new
        rank[who] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2


class Phrases:
    """The windows of a block of test items: `window` consecutive words, or all of an item with fewer."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        buf, off = joined([t for _, t in items])
        s, _, h = words(buf)
        per = np.searchsorted(s, off)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number + 1
        found: dict[int, dict[bytes, set]] = {}
        for k, (name, _) in enumerate(items):
            w = number[per[k] : per[k + 1]].astype(np.int32)
            n = min(window, len(w))
            for x in range(len(w) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(w[x : x + n].tobytes(), set()).add(name)
        self.by_length = [(n, np.array([np.frombuffer(p, dtype=np.int32) for p in d], dtype=np.int64).reshape(-1, n), [sorted(x for x in v if x is not None) for v in d.values()]) for n, d in sorted(found.items())]
        self.shortest = self.by_length[0][0] if self.by_length else 0


def _shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, dict, dict]:
    """Words of each text; merged spans of words by text; item names by text."""
    buf, off = joined(texts)
    s, _, h = words(buf)
    per = np.searchsorted(s, off)
    n_words, spans, names = np.diff(per), {}, {}
    if not phrases.by_length or not len(h):
        return n_words, spans, names
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    number = np.where(phrases.vocabulary[at] == h, at + 1, 0)
    known = number > 0
    if not known.any():
        return n_words, spans, names
    doc = np.repeat(np.arange(len(texts)), n_words)
    head = known & (np.concatenate([[True], ~known[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    run = np.cumsum(head) - 1
    length = np.bincount(run[known], minlength=int(head.sum()))
    place = np.flatnonzero(known & (length[np.maximum(run, 0)] >= phrases.shortest))
    if not len(place):
        return n_words, spans, names
    cut = np.flatnonzero(np.concatenate([[True], run[place][1:] != run[place][:-1]]))
    seq = np.append(np.insert(number[place], cut, 0), 0)
    back = np.append(np.insert(place, cut, -1), -1)
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    hits = []
    for n, patterns, of in phrases.by_length:
        row, lo, hi = index.search(patterns)
        if not len(row):
            continue
        size = hi - lo
        each = np.repeat(np.arange(len(row)), size)
        word = back[index.locate(np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(each)))]
        hits.append(np.stack([word, word + n]))
        pair = np.unique(np.stack([doc[word], row[each]]), axis=1)
        for d, r in pair.T.tolist():
            names.setdefault(d, set()).update(of[r])
    if hits:
        a, b = np.concatenate(hits, axis=1)
        put = np.lexsort((b, a))
        a, b, d = a[put], b[put], doc[a[put]]
        # ends grow along a document if the running maximum is taken; words of a later document have larger numbers anyway
        reach = np.maximum.accumulate(b)
        new = np.concatenate([[True], (a[1:] > reach[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        for x, y in zip(first.tolist(), last.tolist()):
            spans.setdefault(int(d[x]), []).append((int(a[x] - per[d[x]]), int(reach[y] - per[d[x]])))
    return n_words, spans, names


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Test items in blocks of about `most` bytes, fetched one at a time."""
    block, held = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), utf8(text_col)).toLocalIterator():
        block.append((name, bytes(text)))
        held += len(text)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of `docs`: spans are the merged, half-open ranges of words inside occurrences
    of test windows, items the sorted ids (as strings) of the items these come from.

    Test items travel to the tasks in blocks of `block_bytes`; a larger test set takes more passes over the same rows, without a shuffle.
    Null and empty texts have no words and no hits; an item without words has no window; equal windows of several items count
    for all of them; a null item id marks spans but isn't named. Repeated rows are all returned. An empty test set hits nothing. Other columns are ignored.
    """
    return _marked(docs, items, window, id_col, text_col, item_id, item_text, block_bytes).drop("t")


def _marked(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """contamination() with the text as column t."""
    shape = "doc_id long, t binary, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    sc = docs.sparkSession.sparkContext

    def against(phrases):
        def run(batches):
            for b in batches:
                texts, done, held, at = b.column(1).to_pylist(), 0, 0, 0
                olds = (b.column(3).to_pylist(), b.column(4).to_pylist())
                n, spans, names = [], [], []
                for k, t in enumerate(texts):
                    held += len(t) + 1
                    if held >= SHARD or k + 1 == len(texts):
                        count, s, i = _shard(texts[at : k + 1], phrases.value)
                        n.append(count)
                        for x in range(at, k + 1):
                            spans.append([{"first": p, "last": q} for p, q in _merged(s.get(x - at, []) + [(o["first"], o["last"]) for o in olds[0][x]])])
                            names.append(sorted(i.get(x - at, set()) | set(olds[1][x])))
                        at, held = k + 1, 0
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(spans, spans_type), pa.array(names, pa.list_(pa.string()))], ["doc_id", "t", "n_words", "spans", "items"])

        return run

    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    any_block = False
    for block in _blocks(items, item_id, item_text, block_bytes):
        out = out.mapInArrow(against(sc.broadcast(Phrases(block, window))), shape)
        any_block = True
    if not any_block:
        out = out.mapInArrow(against(sc.broadcast(Phrases([], window))), shape)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the rows that contain a test window, whatever other rows of the same or of null id hold. Rows keep all their columns."""
    # Written, so that its size is known: few rows are broadcast, many are joined by shuffling.
    t1, t2 = digests(F.col("t"))
    hit = cut(_marked(docs, items, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit"), t1.alias("g1"), t2.alias("g2")).distinct(), "hits")
    own = digests(utf8("text"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit"]) & (own[0] == hit["g1"]) & (own[1] == hit["g2"]), "left_anti")


def op6_decontamination_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items, at windows of 10 words."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_OP6 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
n as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
win as (select distinct item, n, array_to_string(list_slice(w, k + 1, k + n), ' ') as g from (select *, unnest(range(len(w) - n + 1)) as k from n)),
sizes as (select distinct n from win),
grams as (select doc_id, n, k, array_to_string(list_slice(w, k + 1, k + n), ' ') as g from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as k from d cross join sizes where len(w) >= n)),
hits as (select g.doc_id, g.k, g.n, win.item from grams g join win using (n, g)),
spots as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(k, k + n)) as spot from hits) group by 1),
items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as names from hits where item is not null group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (doc_id) left join items using (doc_id)
"""
