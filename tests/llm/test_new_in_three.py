"""Exact duplicates by tries, fill-in-the-middle and vector codes: brute force, round trips and odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import exact, infill, lloyd, mixing, sharding

sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
ROWS = [(1, "a"), (2, None), (3, ""), (None, "a"), (4, "a"), (4, "a"), (5, "ä" * 40_000), (6, "ä" * 40_000), (7, "ä" * 39_999 + "b"), (None, "only"), (None, "only"), (-8, "n"), (-9, "n")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("x") for c in ("row", "t", "h", "h0", "size", "ref", "rank", "owner", "count", "kept", "keep_id", "doc", "sha", "id", "digest", "n", "form", "output", "lang")}
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5).withColumns(clash)


def test_trie_holds_keys_and_gives_up_subtrees():
    draw = random.Random(1)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(0, 30))) for _ in range(3000)]
    trie, want = exact.Trie(), collections.Counter(texts)
    for k, t in enumerate(texts):
        trie.add(exact.key_of(t)[0], (True, k, 0), 1, k)
    some = [(key[16:], leaf.count, leaf.owner[1]) for key, leaf in trie.give_up(trie.held // 2)]
    assert some and trie.root.below
    rest = [(key[16:], leaf.count, leaf.owner[1]) for key, leaf in trie.give_up()]
    assert trie.held == 0 and not trie.root.below
    assert {t: n for t, n, _ in some + rest} == want
    last = {t: k for k, t in enumerate(texts)}
    assert all(last[t] == k for t, _, k in some + rest)


def test_trie_tells_texts_of_one_hash_apart():
    trie, texts = exact.Trie(), [b"same hash, " + bytes([c]) * 50 for c in range(97, 123)] + [b"x" * 60 + bytes([c]) for c in range(97, 123)]
    for k, t in enumerate([*texts, *texts]):
        trie.add(b"\0" * 8 + len(t).to_bytes(8, "big") + t, (True, k, 0), 1, k)
    got = {key[16:]: (leaf.count, leaf.refs) for key, leaf in trie.give_up()}
    assert got == {t: (2, [k, k + len(texts)]) for k, t in enumerate(texts)}


def brute(rows, sign=1):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = lambda g: max((sign * i for i in g if i is not None), default=None)
    keep = {t: best(g) for t, g in groups.items()}
    return sorted(((i, None if keep[t or ""] is None else sign * keep[t or ""], len(groups[t or ""]), sha(t)) for i, t in rows), key=str), len(groups)


@pytest.mark.parametrize("keep, sign", [("largest", 1), ("smallest", -1)])
@pytest.mark.parametrize("held, fan", [(64 << 20, 512), (300, 2)])
def test_owners(odd, keep, sign, held, fan):
    got = exact.owners(odd, keep, held, fan).collect()
    want, groups = brute(ROWS, sign)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == groups == len({r["text_sha256"] for r in got if r["kept"]})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_owners_of_a_hot_text(spark):
    rows = [(k, f"text {0 if k % 3 else k}") for k in range(4000)]
    got = exact.owners(spark.createDataFrame(rows, "doc_id long, text string").repartition(40), held=500, fan=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)[0]


def test_owners_of_nothing_and_deduplicated(spark, odd):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.owners(none).count() == 0 and exact.deduplicated(none).count() == 0
    out = exact.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(4, "a"), (3, ""), (6, "ä" * 40_000), (7, "ä" * 39_999 + "b"), (None, "only"), (-8, "n")], key=str)


TEXTS = ["", "a", "ab cd", "é", "日本 語x", "ab1\r\n\tcd--", "x" * 5000 + "é" * 5000 + "y z" * 999, " ", "a<P>b", "<S", "<M>", "a<b>c", "ÀbC🎉dE"]


@pytest.mark.parametrize("text", TEXTS)
def test_units_are_those_of_the_pattern(text):
    b, unit = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    starts, lead = infill.masks(b)
    assert starts.bit_count() == len(unit) and lead.bit_count() == len(text)
    for k in {*range(min(len(unit), 20) + 1), len(unit) // 2, len(unit)}:
        assert infill.select(starts, len(b), k) == len("".join(unit[:k]).encode())
    for h in ((0, 0, 0, 99), (len(unit), 0, 0, 0), (1, 2, 89, 19), (7, 3, 90, 0), (10**9 + 7, 998_244_353, 5, 50)):
        n, form, one, two, out = infill.infilled_text(b, h)
        assert infill.restored_text(out, form) == b and n == len(unit)
        assert (form == "plain") == (not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] >= 90)
        if form != "plain":
            lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            parts = "".join(unit[:lo]), "".join(unit[lo:hi]), "".join(unit[hi:])
            assert (one, two) == (len(parts[0]), len(parts[1]))
            assert out.decode() == ("<P>{0}<S>{2}<M>{1}" if form == "psm" else "<S>{2}<P>{0}<M>{1}").format(*parts)


def test_infilled_rows(spark, odd):
    texts = spark.createDataFrame([*enumerate(TEXTS), (None, "no id, a text of words"), (99, None), (3, TEXTS[3])], "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = infill.restored(infill.infilled(texts, rate=100, spm=50, keep=("text", "lang"))).collect()
    assert len(got) == len(TEXTS) + 3 and all((r["row"]["text"] or "") == r["restored"] and r["row"]["lang"] == "x" for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.infilled(odd).count() == len(ROWS) and infill.infilled(odd.where("doc_id = 77")).count() == 0


def lloyd_brute(rows, parts, entries, rounds):
    q = {i: np.array([max(-(1 << 26), min(1 << 26, int(np.floor(256 * float(x))))) for x in v], dtype=object) for i, v in rows}
    ids, d = sorted(q), len(next(iter(q.values()))) // parts
    books = [[list(q[i][p * d : p * d + d]) for i in ids[:entries]] for p in range(parts)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        code = {i: [min(range(len(books[p])), key=lambda e: (dist(q[i][p * d : p * d + d], books[p][e]), e)) for p in range(parts)] for i in ids}
        if r == rounds:
            return {i: ("".join(f"{e:02x}" for e in code[i]), sum(dist(q[i][p * d : p * d + d], books[p][code[i][p]]) for p in range(parts))) for i in ids}, books
        for p in range(parts):
            for e in range(len(books[p])):
                own = [q[i][p * d : p * d + d] for i in ids if code[i][p] == e]
                if own:
                    books[p][e] = [sum(x[k] for x in own) // len(own) for k in range(d)]


@pytest.mark.parametrize("scale, rounds", [(0.1, 2), (0.02, 5), (3e4, 3)])
def test_lloyd_equals_brute_force(spark, monkeypatch, scale, rounds):
    draw = np.random.default_rng(int(rounds))
    rows = [(int(i), [float(x) for x in draw.normal(0, scale, 8)]) for i in draw.permutation(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)]
    frame = spark.createDataFrame([(*r, k % 3 or None) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(7)
    coded, books = lloyd.compressed(frame, 4, 16, rounds)
    want, want_books = lloyd_brute(rows, 4, 16, rounds)
    assert books.tolist() == want_books
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == want


def test_lloyd_pops_only_what_drift_has_reached():
    draw = np.random.default_rng(0)
    x, book = draw.integers(-100, 100, (2000, 4)), draw.integers(-100, 100, (16, 4))
    entry, slack = lloyd.nearest(x, book)
    moved = book + draw.integers(-2, 3, book.shape)
    drift = lloyd.drifts(book[None], moved[None])[0]
    again = lloyd.violated(entry, lloyd.rounded_down(slack), drift)
    now = lloyd.nearest(x, moved)[0]
    assert 0 < len(again) < 1000 and set(np.flatnonzero(now != entry)) <= set(again.tolist())


def test_lloyd_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label string"
    v = [float(k) for k in range(16)]
    rows = [(1, v, "a"), (2, None, "a"), (3, [], "a"), (4, [float("nan"), *v[1:]], None), (5, [None, *v[1:]], "b"), (6, [float("inf"), *v[1:]], "b"), (None, [1e30, *v[1:]], None), (1, v, "a"), (7, v[:8], "a"), (8, [-x for x in v], None)]
    frame = spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("q", "code", "key", "part", "n", "s", "of", "error")})
    coded, books = lloyd.compressed(frame)
    got = sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()), key=str)
    assert [g[:2] for g in got] == [(1, "a"), (1, "a"), (8, None), (None, None)] and books.shape == (16, 4, 1)
    assert {g[3] for g in got} == {0} and books[0].ravel().tolist() == [0, 0, 0, 1 << 26]
    assert lloyd.compressed(frame.where("vec_id = 77"))[0].count() == 0
    with pytest.raises(ValueError):
        lloyd.compressed(frame, parts=5)


def test_prefix_pairs_miss_no_similar_pair(spark):
    from tideline.llm import simhash

    draw = np.random.default_rng(3)
    template, texts = [f"t{k}" for k in range(200)], {}
    for k in range(60):  # one template, each text with words of its own: about 0.7 to one another
        w = list(template)
        for at in draw.choice(200, 6, replace=False):
            w[at] = f"own{k}_{at}"
        texts[k] = " ".join(w)
    for k in range(60, 90):  # near copies of some of them
        w = texts[k - 60].split()
        w[int(draw.integers(200))] = f"new{k}"
        texts[k] = " ".join(w)
    texts |= {90: "", 91: "a b", 92: "a b", 93: None}
    frame = spark.createDataFrame(list(texts.items()), "id long, t string").select("id", F.coalesce("t", F.lit("")).cast("binary").alias("t"))
    got = {tuple(r) for r in simhash.prefix_pairs(frame, frame.select("id", F.col("id").alias("c"))).collect()}
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in texts.items()}
    near = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near and near <= got and len(got) < 300  # of 1,770 pairs around the template
    assert simhash.prefix_pairs(frame, frame.select("id", F.lit(1).cast("long").alias("c"))).count() == 0


def test_pipeline_with_clashing_columns(spark, sf, odd):
    import corpus_pipeline
    from tideline.llm.shared import cut

    names = ["mixture_place", "Mixture_Place_", "position", "shard", "slot", "id", "a", "b", "gone", "whole", "f0", "h1", "first", "component"]
    rows = [(i, t, "en", "a" if k % 3 else "b", 1) for k, (i, t) in enumerate(ROWS)] + [(100 + k, f"the text of number {k} and no other", "en", None, 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(7) for n in names if n.lower() != "mixture_place_"}).withColumn("Mixture_Place_", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = stage(spark, docs, sf)
        if name != "shards":
            assert [c for c in docs.columns if c in columns] == columns
            docs = cut(docs, name)
        assert 0 < docs.count() <= before
    n = docs.count()
    assert docs.select("shard", "slot").distinct().count() == n and docs.where("mixture_place = 7 and position = 7").count() == n
    alone = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("mixture_place", F.lit(3))
    out = corpus_pipeline.shards(spark, alone, sf)
    assert out.select("shard", "slot").distinct().count() == len(rows) and "mixture_place" in out.columns


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
LESSER = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
APACHE1 = "Copyright (c) 2000 The Apache Software Foundation. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def license_cases():
    from tideline.llm import licenses as L

    said = {
        GPL: "GPL-2.0", LESSER: "LGPL-2.1", "Distributed under the GNU General Public License, version 1": "GPL-1.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0", "Licensed under CC BY 3.0.": "CC-BY-3.0",
        "// Licensed under the GPLv2": None, "License: GPL v3": "GPL-3.0", "Apache License 1.1": "Apache-1.1", "Licensed under the Apache License, Version 1.1": "Apache-1.1", "All rights reserved.": "All-Rights-Reserved", "This file is under the Mozilla Public License, version 1.1": "MPL-1.1",
        f" * {L.BSD}\n * {L.DISCLAIMER}": "BSD-2-Clause", f"{L.BSD}\n3. {L.ENDORSE}\n{L.DISCLAIMER}": "BSD-3-Clause", f"{L.BSD}\n\n{L.ADVERTISING}\n4. {L.ENDORSE}\n\n{L.DISCLAIMER}": "BSD-4-Clause", f"Copyright 2020 A. Author\n\n{L.PERMIT}, {L.NOTICE}\n\n{L.AS_IS}": "MIT",
        f"ISC License\n\nCopyright (c) 2004\n\n{L.USE}, {L.KEEP}\n\n{L.AUTHOR}": "ISC", f"{L.USE}.\n\n{L.AUTHOR}": "0BSD", APACHE1: None, "This program is free software under the terms of the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "You have the right to remain silent, and all rights of way are open.": None, "The terms of the loan were fair.": None,
    }
    for code, name, versions, _ in L.NAMES:
        for v in versions:
            said[f"This project is licensed under the {name}{', version ' + v if v else ''}."] = code + (f"-{v}" if v else "")
    for kind in L.KINDS:
        for v in ("2.5", "4.0"):
            said[f"This work is licensed under the Creative Commons {'-'.join(['Attribution', *[L.ELEMENTS[k] for k in kind]])} {v} International License."] = "-".join(["CC-BY", *kind, v])
    return said


@pytest.mark.parametrize("others", [0, 2000])
def test_licenses_are_not_confused(spark, others):
    from tideline.llm import licenses

    cases = license_cases()
    rows = [(k, f"d{k}/f.txt", x) for k, x in enumerate(cases)] + [(10_000 + k, f"e{k}/f.txt", "All rights reserved.") for k in range(others)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("doc_id < 10000").collect()}
    wrong = {x[:60]: (got[k], want) for k, (x, want) in enumerate(cases.items()) if got[k] != want}
    assert len({v for v in cases.values() if v}) >= 40 and not wrong, wrong


def test_every_template_fits_itself():
    import re

    from tideline.llm import licenses as L

    def terms(x):
        x = x.lower()
        for old, new in L.NORMAL:
            x = re.sub(old, new, x)
        return set(re.findall(L.TERM, x))

    assert all(set(need) <= terms(x) and not set(bad) & terms(x) and re.search(L.ANCHOR, x) for _, x, need, bad in L.TEMPLATES)


def test_language_machines_are_optimal():
    """The machines' weights against the optimum of the same problem by projected gradients over its dual."""
    from tideline.llm import langid

    draw = np.random.default_rng(11)
    texts = [" ".join(draw.choice(["der", "die", "und", "nicht", "haus", "baum"] if k % 3 else ["the", "and", "not", "house", "tree", "die"], 12)) for k in range(60)]
    y = np.array([1.0 if k % 3 else -1.0 for k in range(60)])
    rows = [langid.sparse(f" {t} ".encode()) for t in texts]
    x = np.zeros((60, (1 << langid.BITS) + 1))
    for k, (at, v) in enumerate(rows):
        x[k, at], x[k, -1] = v, 1.0
    most = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    primal = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, most)
    best = alpha.sum() - 0.5 * alpha @ q @ alpha
    w, bias = langid.svm(rows, y, epochs=3000, tol=1e-9)
    assert best <= primal(np.append(w, bias)) + 1e-9 <= best * 1.01
    assert (y * (x @ np.append(*langid.svm(rows, y))) > 0.5).all()  # as it is stopped in use


def test_language_decisions_by_hand(spark, sf):
    """Every document's language by counting its n-grams and votes in plain loops."""
    import duckdb

    from tideline.llm import langid, registry
    from tideline.llm.shared import table

    docs = table(spark, sf, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_language_id"](spark, sf).collect()}

    def bucket(gram):
        v = sum(b << 8 * k for k, b in enumerate(gram)) * 2654435761 + len(gram) * 40503
        return (v & 0xFFFFFFFF) * 2246822519 % 2**32 >> 32 - langid.BITS

    for i in sorted(texts)[::12]:
        letters = "".join(c if c.isalpha() else " " for c in f" {texts[i] or ''} ".lower())
        b = (" " + " ".join(letters.split()) + " ").encode()
        grams = collections.Counter(b[k : k + n] for n in langid.ORDERS for k in range(len(b) - n + 1))
        if not letters.strip():
            assert got[i]["lang_pred"] == "und"
            continue
        total = sum(grams.values())
        margin = sum(n * model.weights[bucket(g)].astype(float) for g, n in grams.items()) * langid.SCALE / total + model.bias
        nf = len(model.families)
        f = int(np.argmax(margin[:nf])) if nf > 1 else 0
        names = model.families[f][1]
        votes = dict.fromkeys(range(len(names)), 0.0)
        for k, (g, x, y) in enumerate(model.pairs):
            if g == f:
                m = margin[nf + k]
                votes[x if m >= 0 else y] += 1
                votes[x] += np.tanh(m) / (4 * len(names))
                votes[y] -= np.tanh(m) / (4 * len(names))
        assert got[i]["lang_pred"] == names[max(votes, key=lambda v: (votes[v], -v))]


def one_fold(strata):
    """Earliest deadline first over all slots in one loop: (stratum, block, slot)."""
    names = sorted(strata)
    n, w = [strata[k][0] for k in names], [strata[k][1] for k in names]
    fluid = lambda v: sum(min(a * v, b) for a, b in zip(w, n))
    done, out = [0] * len(n), []
    for slot in range(sum(n)):
        open_ = [k for k in range(len(n)) if done[k] < n[k] and math.floor(fluid(done[k] / w[k]) + 1e-9) <= slot]
        k = min(open_, key=lambda k: (math.ceil(fluid((done[k] + 1) / w[k]) - 1e-9), k))
        out.append((names[k], done[k], slot))
        done[k] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_schedule_in_stretches_is_one_fold(spark, seed):
    """Stretches of 16 slots give the slots of one fold, also where sources run out and where a window is longer than a stretch; no source is a block off the fluid mixture."""
    rnd = random.Random(seed)
    raw = {f"s{k:02d}": (rnd.choice([1, 2, 30, 120, 200]), rnd.choice([1.0, 2.0, rnd.random() * 3 + 0.02])) for k in range([1, 3, 7, 12][seed])}
    total = sum(x for _, x in raw.values())
    strata = {k: (n, x / total) for k, (n, x) in raw.items()}
    rows = spark.createDataFrame([(k, n, w) for k, (n, w) in strata.items()], "stratum string, n long, w double")
    got = sorted((r["slot"], r["stratum"], r["block"]) for r in mixing.schedule(rows, stretch=16).collect())
    assert got == sorted((t, k, b) for k, b, t in one_fold(strata))
    assert sorted((t, k, b) for k, b, t in mixing.schedule(rows).select("stratum", "block", "slot").collect()) == got
    v, done = 0.0, dict.fromkeys(strata, 0)
    for slot, k, _ in got:
        done[k] += 1
        low, high = v, max(n / w for n, w in strata.values())
        for _ in range(80):
            v = (low + high) / 2
            low, high = (v, high) if sum(min(w * v, n) for n, w in strata.values()) < slot + 1 else (low, v)
        assert all(abs(done[s] - min(w * v, n)) < 1 + 1e-6 for s, (n, w) in strata.items())


def test_schedule_of_nothing(spark):
    assert mixing.schedule(spark.createDataFrame([], "stratum string, n long, w double")).count() == 0


def test_rows_without_an_id_share_out_their_places(spark):
    """Nine in ten rows have no id and the same text, some repeat an id, and columns clash with helpers' names: all rows come out once, with places and slots of their own."""
    rows = [(None, "same", "a", k) for k in range(900)] + [(k // 2, f"text {k}", "b" if k % 3 else None, 900 + k) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine int").repartition(7)
    for c in ("key", "lead", "at", "n", "position", "row", "held", "rn"):
        docs = docs.withColumn(c, F.col("mine") + 1)
    mixed = mixing.mixed(docs, place="spot").collect()
    assert sorted(r["spot"] for r in mixed) == list(range(1000))
    assert sorted(r["mine"] for r in mixed) == list(range(1000)) and all(r["key"] == r["n"] == r["row"] == r["mine"] + 1 for r in mixed)
    order = {(r["doc_id"], r["position"]) for r in mixing.mixed_order(docs).collect()}
    assert {(r["doc_id"], r["spot"]) for r in mixed} == order
    out = sharding.sharded(docs, 7).collect()
    assert sorted(r["mine"] for r in out) == list(range(1000)) and len({(r["shard"], r["slot"]) for r in out}) == 1000
    assert max(r["slot"] for r in out) == 142 and {r["shard"] for r in out} == set(range(7))
    assert mixing.mixed(docs.where("mine >= 900")).count() == 100 and sharding.sharded(docs.where("false")).count() == 0


def test_shards_are_stratified_within_the_mixture(spark):
    """In every stretch of places shards hold each source alike, to a row; counts are one apart at most, and a null source is one of its own."""
    from tideline.llm import sharding

    n, sources = 1000, ["a", "b", None, "a", "a", "b", "a"]
    docs = spark.createDataFrame([(k, sources[k * k % 7], k) for k in range(n)], "doc_id long, source string, place long")
    got = sharding.dealt(docs, "place", 4, slots=50).toPandas()
    assert got.columns.tolist() == ["doc_id", "source", "shard", "slot"] and sorted(got["doc_id"]) == list(range(n))
    assert all(sorted(g["slot"]) == list(range(250)) for _, g in got.groupby("shard"))
    got["stretch"], got["source"] = got["doc_id"] // 200, got["source"].fillna("-")
    assert (got["slot"] // 50 == got["stretch"]).all()
    each = got.groupby(["stretch", "source", "shard"]).size().unstack(fill_value=0)
    assert (each.max(axis=1) - each.min(axis=1) <= 1).all()


def test_passages_are_given_by_both_documents(spark, tmp_path):
    """The earliest holder of a passage has a row of its own, and the first of equal texts stands for its copies."""
    from tideline.llm import passages

    word = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    texts = {1: f"{word('a', 30)} {word('p', 80)}", 2: f"{word('p', 80)} {word('b', 30)}", 3: word("c", 70), 4: word("c", 70), 5: word("d", 90)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["other_id"]): (r["first"], r["last"], r["other_first"], r["other_last"]) for r in passages.op9_collinear_passages(spark, str(tmp_path)).collect()}
    assert rows == {(2, 1): (0, 80, 30, 110), (1, 2): (30, 110, 0, 80), (4, 3): (0, 70, 0, 70), (3, 3): (0, 70, 0, 70)}
