"""The operators against brute force on the small tables."""

import base64
import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from oracle import same
from tideline.llm import decontaminate, langid, lzprint, mixing, passages, registry, sharding, simhash, warc

LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) > 0


def test_lz_fingerprints(spark, sf, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_lz_fingerprint"](spark, sf).collect()}
    order = sorted(docs, reverse=True)

    def phrases(b):
        out, i = set(), 0
        for j in range(1, len(b) + 1):
            if b[i:j] not in out:
                out.add(b[i:j])
                i = j
        return out

    off = []
    for k, i in enumerate(order):
        x, y, n = docs[i], docs[order[(k + 1) % len(order)]], len(docs[i])
        edited = x[: n - n // 2] + y[: n // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        if k % 20 == 0:
            a, b, c = phrases(x.encode()), phrases(edited.encode()), phrases(y.encode())
            off += [r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)]
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.03
    by_text = collections.defaultdict(set)
    for i, t in docs.items():
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_language_held_out_accuracy(spark, sf):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    rows = registry.QUERIES["op3_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert 0.25 < len(held) / len(rows) < 0.42
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_simhash_classes(spark, sf, docs):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", LOW(t))
        sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    want = {i: fp(t) for i, t in docs.items()}
    ids = sorted(want)
    f = np.array([want[i] for i in ids], dtype=np.uint64)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= 4) + k + 1:
            a, b = find(i), find(ids[j])
            up[max(a, b)] = min(a, b)
    for r in registry.QUERIES["op4_simhash_trie"](spark, sf).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", find(r["doc_id"]))


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 6])
def test_trie_join_finds_all_links(spark, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base for k in (1, 3, 5)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    links = simhash.near_links(spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long"), budget, per_task=40).collect()
    at = {int(x.view(np.int64)): k for k, x in enumerate(fps)}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget, 1))
    want = simhash.local_components(len(fps), i, j)
    got = simhash.local_components(len(fps), np.array([at[r["a"]] for r in links], dtype=np.int64), np.array([at[r["b"]] for r in links], dtype=np.int64))
    assert (want == got).all()


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(500)])
    rows, near = [], set()
    for k in range(60):
        w = rng.choice(vocabulary, 300)
        rows.append((k, " ".join(w)))
        if k % 3 == 0:
            w[rng.choice(300, 3, replace=False)] = "changed"  # at most 15 of 296 shingles: a similarity of 0.9 or more
            near.add(100 + k)
            rows.append((100 + k, " ".join(w)))
        if k % 3 == 1:
            rows.append((200 + k, " ".join([*w[:150], *rng.choice(vocabulary, 150)])))  # half in common: 0.33
    kept = {r[0] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert {i for i, _ in rows} - kept <= near and len(near - kept) >= 19


def _shingle_set(t):
    w = LOW(t).encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _near_kept(texts):
    """The least ids of the groups that links of a Jaccard similarity of 0.8 make, by all pairs with a shingle in common."""
    sets, holders, up = {i: _shingle_set(t) for i, t in texts.items()}, collections.defaultdict(list), {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        common = collections.Counter(j for g in sets[i] or [None] for j in holders[g])
        for j, n in common.items():
            if not sets[i] or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i] or [None]:
            holders[g].append(i)
    return {i for i in texts if find(i) == i}


def test_near_duplicates_of_all_documents(spark, sf, docs):
    kept = {r[0] for r in simhash.deduplicated(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect()}
    assert kept == _near_kept(docs)


def test_near_duplicates_around_the_threshold(spark):
    """Documents of 0.7 to 0.95, a large group of near copies of one text, and equal lines: few of the near ones may be missed, none else may go."""
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 30_000, n)]
    texts, near = {}, 0
    for k in range(120):
        w = draw(300)
        texts[k] = " ".join(w)
        for at in rng.choice(296, 2 + k % 14, replace=False):
            w[at] = "changed"
        texts[1000 + k] = " ".join(w)
    base = draw(200)
    for k in range(150):
        w = list(base)
        w[int(rng.integers(200))] = f"n{k}"
        texts[2000 + k] = " ".join(w)
    texts[3000], texts[3001] = "one line " * 400 + " ".join(draw(150)), "one line " * 400 + " ".join(draw(150))
    want = _near_kept(texts)
    kept = {r[0] for r in simhash.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id").collect()}
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_warc_round_trip(spark, sf):
    pages = dict(duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in registry.QUERIES["op5_warc_chain"](spark, sf).collect():
        b, f = pages[r["page_id"]].encode(), first[pages[r["page_id"]]]
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == r["page_id"] else "revisit", None if f == r["page_id"] else f)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_warc_rejects_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    df = spark.createDataFrame([(1, "u", inner * 3), (2, "v", "WARC/1.1\r\n"), (3, "w", "plain"), (4, "x", inner * 3)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r["intact"] for r in got.values())
    assert (got[4]["record_type"], got[4]["refers_to"]) == ("revisit", 1)
    off = np.array([0, 10, 20, 30, 40])
    assert warc.reachable(off, np.array([20, 40, 40, -1, 99])).tolist() == [True, False, True, False, True]


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        q = rng.integers(0, 4, rng.integers(1, 80))
        q[-1] = 0
        f = decontaminate.FMIndex(q, 4, 3)
        for n in (1, 2, 4):
            patterns = rng.integers(1, 4, (6, n))
            row, lo, hi = f.search(patterns)
            got = {int(r): sorted(f.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, lo, hi)}
            want = {k: [i for i in range(len(q) - n + 1) if (q[i : i + n] == p).all()] for k, p in enumerate(patterns)}
            assert got == {k: v for k, v in want.items() if v}


def test_contamination(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall():
        w = word.findall(LOW(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for r in registry.QUERIES["op6_decontamination_fm"](spark, sf).collect():
        w, hit, items = word.findall(LOW(docs[r["doc_id"]])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), digest, bool(hit))


def test_mixture_is_never_a_block_off(spark, sf):
    p = mixing.mixed_order(spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", langid.F.col("lang")), {"en": 1.0, "de": 2.0, "fr": 3.0}, block_rows=8).toPandas()
    assert sorted(p.position) == list(range(len(p)))
    names = sorted(p.source.unique())
    w = np.array([p[p.source == s].weight.iloc[0] for s in names])
    n = np.array([p[p.source == s].block.max() + 1 for s in names], dtype=float)
    v = np.unique(np.concatenate([[0], n / w]))
    t = np.array([np.minimum(w * x, n).sum() for x in v])
    have, worst = np.zeros(len(names)), 0.0
    for k, s in enumerate(p.groupby("slot").source.first()):
        have[names.index(s)] += 1
        worst = max(worst, np.abs(have - np.minimum(w * np.interp(k + 1, t, v), n)).max())
    assert worst < 1


def test_passages(spark, sf, docs):
    """Every word of an exact stretch of 50 words that two texts share lies in a passage, and passages are what they say."""
    rows = registry.QUERIES["op9_collinear_passages"](spark, sf).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    w = {i: word.findall(LOW(docs[i])) for i in first.values()}
    holders, have = collections.defaultdict(set), collections.defaultdict(set)
    for i in w:
        for k in range(len(w[i]) - 49):
            holders[tuple(w[i][k : k + 50])].add(i)
    copies = {i: first[docs[i]] for i in docs if i != first[docs[i]]}
    for r in rows:
        if r["doc_id"] in copies:
            n = len(w[copies[r["doc_id"]]])
            assert (r["first"], r["last"], r["other_id"], r["equal"]) == (0, n, copies[r["doc_id"]], n)
            continue
        a, b = w[r["doc_id"]][r["first"] : r["last"]], w[r["other_id"]][r["other_first"] : r["other_last"]]
        assert min(len(a), len(b)) >= 50 and r["equal"] >= 0.8 * max(len(a), len(b))
        assert r["equal"] <= sum((collections.Counter(a) & collections.Counter(b)).values())
        have[r["doc_id"]] |= set(range(r["first"], r["last"]))
        have[r["other_id"]] |= set(range(r["other_first"], r["other_last"]))
    assert {r["doc_id"] for r in rows} >= {i for i, k in copies.items() if len(w[k]) >= 50}
    for i in w:
        for k in range(len(w[i]) - 49):
            if len(holders[tuple(w[i][k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= have[i]


def _passage_pairs(spark, texts):
    rows = passages.repeated(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    return {(r["doc_id"], r["other_id"]): r for r in rows}


def test_passages_whose_parts_occur_elsewhere(spark):
    rng = np.random.default_rng(21)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    whole = draw(240)
    texts = [draw(60) + whole[k : k + 35] + draw(60) for k in range(0, 240, 35)] + [draw(80) + whole + draw(50), draw(30) + whole + draw(90)]
    two = draw(40), draw(40)  # with the words around it none of these is a passage
    texts += [draw(50) + two[0] + draw(50), draw(50) + two[1] + draw(50), draw(70) + two[0] + two[1], two[0] + two[1] + draw(70)]
    got = _passage_pairs(spark, texts)
    assert set(got) == {(8, 7), (12, 11)}
    assert (got[8, 7]["first"], got[8, 7]["last"], got[8, 7]["equal"]) == (30, 270, 240) and got[12, 11]["equal"] == 80


@pytest.mark.parametrize("n", [50, 60, 120])
def test_recall_of_fuzzy_passages(spark, n):
    rng = np.random.default_rng(n)
    draw = lambda m: [f"w{k}" for k in rng.integers(0, 50_000, m)]
    texts, cases = [], collections.defaultdict(set)
    for share in (0.8, 0.85, 0.9, 0.95, "every 5th", "every 8th", "in and out"):
        for _ in range(50):
            p = draw(n)
            q = list(p)
            if share == "in and out":
                for k in sorted(rng.choice(n, n // 10, replace=False).tolist(), reverse=True):
                    q[k : k + 1] = [] if k % 2 else ["new", q[k]]
            else:
                at = rng.choice(n, round(n * (1 - share)), replace=False) if isinstance(share, float) else range(int(rng.integers(5)), n, int(share[6]))
                for k in at:
                    q[k] = f"x{rng.integers(1 << 40)}"
            cases[share].add((len(texts) + 1, len(texts)))
            texts += [draw(80) + p + draw(80), draw(80) + q + draw(80)]
    got = _passage_pairs(spark, texts)
    assert set(got) <= set().union(*cases.values())
    assert all(len(c & set(got)) >= 0.9 * len(c) for c in cases.values()), {s: len(c & set(got)) for s, c in cases.items()}


def test_chains_are_best(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        pts = sorted({(int(x), int(y)) for x, y in rng.integers(0, 30, (8, 2))})
        x, y = [p[0] for p in pts], [p[1] for p in pts]

        def score(c):
            return passages.SPAN * len(c) - passages.GAP * ((x[c[-1]] - x[c[0]]) + (y[c[-1]] - y[c[0]]))

        best = max(score([k for k in range(len(pts)) if m >> k & 1]) for m in range(1, 1 << len(pts)) if all(x[a] < x[b] and y[a] < y[b] for a, b in zip([k for k in range(len(pts)) if m >> k & 1], [k for k in range(len(pts)) if m >> k & 1][1:])))
        assert score(passages.chains(x, y)[0]) == pytest.approx(best)


def test_shards_match_the_mixture(spark, sf):
    p = sharding.assigned(spark.read.parquet(f"{sf}/documents.parquet"), 5).toPandas()
    size = p.groupby("shard").size()
    assert size.max() - size.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    each = p.groupby(["shard", "source"]).size().unstack().fillna(0)
    assert (each.max() - each.min()).max() <= 2


def test_lz_long_texts_by_pieces(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 101, 5000, dtype=np.uint8))
    ends = lzprint.Parse().feed(text).ends
    whole = lzprint.signatures([text], [ends])
    monkeypatch.setattr(lzprint, "PIECE", 300)
    assert (lzprint.signatures([text], [ends]) == whole).all()
    assert (lzprint.signatures([text, b"", text], [ends, [], ends])[[0, 2]] == whole).all()


def test_chains_are_cut_where_texts_differ(spark):
    rng = np.random.default_rng(11)
    word = lambda n, tag: [f"{tag}{k}" for k in rng.permutation(n)]
    one, two = word(100, "p"), word(100, "q")
    texts = [word(30, "r") + one + word(80, "s") + two + word(30, "t"), word(30, "u") + one + word(80, "v") + two + word(30, "x")]
    rows = passages.repeated(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r["first"], r["last"], r["equal"]) for r in rows) == [(30, 130, 100), (210, 310, 100)]


def test_common_subsequences_of_any_length():
    rng = np.random.default_rng(12)
    for n, m, size in ((40, 60, 5), (300, 300, 50), (500, 20, 9)):
        a, b = rng.integers(0, size, n), rng.integers(0, size, m)
        last = np.zeros(m + 1, dtype=int)
        for v in a:
            row = np.zeros(m + 1, dtype=int)
            for q in range(m):
                row[q + 1] = last[q] + 1 if v == b[q] else max(last[q + 1], row[q])
            last = row
        assert passages._common(a, b) == last[m]
