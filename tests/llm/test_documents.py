"""Near duplicates, decontamination, mixing, sharding, languages and pseudonyms on small tables and against brute force."""

import itertools
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, minhash, mixing, pii, sharding
from quern.llm.minhash import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, component string"


def docs(spark, *texts, source="a", lang="en"):
    rows = [(i, t, lang, source if isinstance(source, str) or source is None else source[i], len(t or ""), 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, percent=85):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edge_texts():
    long = words(30_000)
    base = words(200, 50_000)
    near = [base.replace(f"w{50_000 + 3 * k}", f"x{k}") for k in range(12)]
    return [None, "", "  \n\t", "a", "A", "b c", "B  c", "one two three four five", long, long + " tail", base, *near, base.upper(), "ünï çödé", "ÜNÏ çödé"]


@pytest.mark.parametrize("options", [{}, {"list_nodes": 2, "task_shingles": 500}, {"task_shingles": 1}])
def test_near_duplicates_against_brute_force(spark, options):
    texts = edge_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, *texts), **options).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    rows = table.collect()
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    want = brute_components([r.text for r in rows])
    for options in ({}, {"list_nodes": 3, "task_shingles": 2000}):
        found = minhash.near_duplicates(table, **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_odd_ids_and_no_rows(spark):
    text = words(20)
    rows = [(None, text), (3, text), (3, text), (5, text), (2, words(9)), (2, text)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id) == [(2, 2, True), (2, 2, True), (3, 2, False), (3, 2, False), (5, 2, False)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(2, False)]
    assert sorted((r.doc_id, r.n_shingles) for r in found if r.chosen) == [(2, 5), (2, 16)]
    found = minhash.near_duplicates(spark.createDataFrame([(None, text), (None, text), (None, words(9)), (None, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.chosen) for r in found) == [(0, True), (0, True), (5, True), (16, False), (16, True)] and {r.component_id for r in found} == {None}
    assert minhash.near_duplicates(docs(spark)).count() == 0


def test_near_duplicates_of_one_id_with_different_texts(spark):
    one, two = words(20), words(20, 100)
    near = lambda t: t + " end"
    for rows in ([(1, one), (1, two), (2, near(one)), (3, near(two))], [(1, two), (1, one), (2, near(one)), (3, near(two))]):
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_words_that_a_power_of_two_can_not_tell_apart(spark):
    """Polynomials modulo 2^64 give this word and its complement one hash, whatever the base."""
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd), words(4), "aaaaaaab", "aaaaaaba", "a" * 64, "a" * 65, "a" * 63 + "b"]
    found = minhash.near_duplicates(docs(spark, *texts)).collect()
    assert {r.component_id for r in found} == set(range(len(texts)))


def test_shingles_tell_what_words_tell():
    import numpy as np

    from quern.llm.shingles import shingle_sets

    rng = np.random.default_rng(5)
    some = ["".join(rng.choice(list("abcé"), rng.integers(1, 90))) for _ in range(60)] + ["x", "x\0", "\0"]
    texts = [" ".join(rng.choice(some, rng.integers(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    seen = {}
    for t, s in zip(texts, sets, strict=True):
        assert len(s[0]) == len(shingles(t))
        seen.setdefault((s[0].tobytes(), s[1].tobytes()), set()).add(frozenset(shingles(t)))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({frozenset(shingles(t)) for t in texts})


def test_pieces():
    import pyarrow as pa

    from quern.llm.shared import pieces

    batch = pa.record_batch([pa.array([None, "", *"abc", "d" * 100, *"efg"])], names=["text"])
    parts = list(pieces(iter([batch, batch.slice(0, 0)]), most=10, rows=2))
    assert [p.num_rows for p in parts] == [2, 2, 1, 1, 2, 1]
    assert pa.Table.from_batches(parts).combine_chunks()["text"].to_pylist() == batch["text"].to_pylist()


def test_connected_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


ITEM = "The quick brown fox jumps over the lazy dog, while seven wizards brew strange potions in old copper kettles by night"


def test_decontamination(spark):
    item_words = ITEM.split()
    texts = [
        f"{words(40)} {ITEM} {words(30)}",
        ITEM.upper().replace(",", " -- "),
        " ".join(item_words[:10]),
        words(60),
        None,
        "",
        f"{words(20_000)} {ITEM}",
        " ".join([*item_words, "more"]),
        " ".join([*item_words[:3], "other", *item_words[4:8], "different", *item_words[9:]]),
        f"{ITEM} {ITEM}",
        "to be",
        "it is to be decided",
    ]
    items = spark.createDataFrame([(1, ITEM, 0), (2, words(25, 900_000), 0), (3, None, 0), (4, "", 0), (5, "To be", 0), (None, words(60), 0)], "item_id long, text string, n int")
    blank = [r.doc_id for r in decontaminate.find(docs(spark, *texts), items).where("item_id is null").collect()]
    assert sorted(blank) == [3, 6]  # an item without an id is one too
    items = items.where("item_id is not null")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs(spark, *texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 1), (7, 1), (9, 1), (10, 5), (11, 5)}
    assert all(r.similarity == 1.0 and r.distance == 0 for r in got.values())
    assert got[0, 1].start == 40 and got[6, 1].start == 20_000 and got[9, 1].start == 0 and got[11, 5].start == 2
    assert decontaminate.find(docs(spark, *texts), items.where("item_id = 4")).count() == 0
    assert decontaminate.find(docs(spark), items).count() == 0


def test_decontamination_against_all_windows(spark):
    """Every window of an item's size, by plain counting; a long item with an edit at its end is within reach."""
    from collections import Counter

    item = words(40)
    edited = item.rsplit(" ", 2)[0] + " new end"
    texts = [f"x y z {edited} q r", f"{words(15)} {words(20, 15)} gap {words(5, 35)}", f"{words(12, 100)} {words(28)}"]
    got = {(r.doc_id): r.similarity for r in decontaminate.find(docs(spark, *texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want, b = {}, grams(item.split())
    for i, t in enumerate(texts):
        w = t.split()
        best = 0
        for s in range(max(1, len(w) - 39)):
            a = grams(w[s : s + 40])
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
        if best >= 0.8:
            want[i] = best
    assert got == pytest.approx(want) and want


def test_decontamination_of_reordered_passages(spark):
    """Parts in another order inside longer texts, held against every window and item by plain counting."""
    from collections import Counter

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    long, other, pad = words(59).split(), words(45, 200).split(), words(30, 900).split()
    texts = [
        [*pad, *long[30:], *long[:30], *pad],
        [*pad, *long[50:], *long[:50], *pad],
        [*pad, *other[22:], *other[:22], *pad],
        [*long[29:], *long[:29]],
        [*pad, *long[:40], *pad],
        [*pad, "new", "start", *long[2:], *pad, *long[30:], *long[:30]],
        long[:50],
    ]
    items = {1: long, 2: other}
    want = {}
    for (d, w), (i, item) in itertools.product(enumerate(texts), items.items()):
        n, b = len(item), grams(item)
        sims = [(sum((a & b).values()) / sum((a | b).values()), -s) for s in range(max(1, len(w) - n + 1)) if (a := grams(w[s : s + n]))]
        if max(sims)[0] >= 0.8:
            want[d, i] = max(sims)
    got = decontaminate.find(docs(spark, *map(" ".join, texts)), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in got} == {k: (pytest.approx(a), b) for k, (a, b) in want.items()}
    assert {d for d, _ in want} == {0, 1, 2, 3, 5, 6}


def grams(w):
    from collections import Counter

    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_decontamination_of_edited_passages_misses_nothing(spark):
    """Items of 20 to 200 words with words changed, put in, left out and moved, in filler, against every window by plain counting; and how far apart the fingerprints are."""
    import random

    rng = random.Random(8)
    items, texts = [], []
    for i, n in enumerate([20, 33, 48, 84, 84, 84, 120, 200] * 4):
        item = [f"i{i}x{rng.randrange(n)}" for _ in range(n)]  # some words repeat
        w = list(item)
        for _ in range(rng.randrange(0, 1 + n // 25)):
            at = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                w[at] = "other"
            elif kind == 1:
                w[at:at] = [f"new{j}" for j in range(rng.randrange(1, 5))]
            elif kind == 2:
                del w[at : at + 2]
            else:
                w = w[at:] + w[:at]
        if n == 84:  # the second and second-last words changed and four put in between
            w = [*item[:1], "other", *item[2:42], "a1", "a2", "a3", "a4", *item[42:-2], "other", item[-1]]
        items.append(item)
        texts.append([f"p{i}y{j}" for j in range(rng.randrange(40))] + w + [f"q{i}y{j}" for j in range(rng.randrange(40))])
    want = {}
    for d, w in enumerate(texts):
        n, b = len(items[d]), grams(items[d])
        sims = [(sum((a & b).values()) / sum((a | b).values()), -s) for s in range(max(1, len(w) - n + 1)) if (a := grams(w[s : s + n]))]
        if max(sims)[0] >= 0.8:
            want[d, d] = max(sims)
    got = decontaminate.find(docs(spark, *map(" ".join, texts)), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in got} == {k: (pytest.approx(a), b) for k, (a, b) in want.items()}
    assert len(want) >= 20 and {d for d, _ in want} >= {i for i in range(len(items)) if len(items[i]) == 84}
    assert max(r.distance for r in got) <= decontaminate.RADIUS - 8


def test_fingerprint_blocks_find_all_pairs_within_the_radius(spark):
    """The inverted blocks against comparing all pairs, on fingerprints that differ by chosen numbers of bits spread in the worst way."""
    import random

    rng = random.Random(3)
    base = [[rng.randrange(1 << 16) for _ in range(16)] for _ in range(3)]
    rows = []
    for f in base:
        for bits in (0, 15, 16, 47, 48, 62, 63, 64, 90):
            x = list(f)
            for j in range(bits):  # as evenly over the blocks as can be
                x[j % 16] ^= 1 << (j // 16 if j < 240 else 15)
            rows.append((20, x))
    windows = spark.createDataFrame(rows, "n int, f array<int>")
    items = spark.createDataFrame([(i, 20, f) for i, f in enumerate(base)] + [(9, 21, base[0])], "item long, n int, f array<int>")
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    want = {(tuple(x), i, far(x, f)) for _, x in rows for i, f in enumerate(base) if far(x, f) <= 63}
    assert {(tuple(r.f), r.item, r.distance) for r in decontaminate.candidates(windows, items).collect()} == want and len(want) == 21


def plain_targets(sizes, share=1.5, weights=(5, 2, 1), cap=2):
    """Share by weight, stop who is above the cap, and share anew, until none is."""
    order = [*sorted(s for s in sizes if s is not None), *[None] * (None in sizes)]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left, free = left - sum(cap * sizes[s] for s in over), [s for s in free if s not in over]
    return out


def targets_of(spark, sizes, **options):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.source_targets(table, **options).collect()}


def test_source_targets(spark):
    import random

    even = targets_of(spark, {"c": 100, "a": 100, None: 100, "b": 100})
    assert even == {"a": 200.0, None: 200.0, "b": pytest.approx(200 * 2 / 3), "c": pytest.approx(200 / 3)}
    rng = random.Random(1)
    for n in (1, 2, 5, 40):
        sizes = {rng.choice("abZé") + str(i): rng.choice([0, 1, 10, 10**rng.randrange(9)]) for i in range(n)} | ({None: 50} if n > 2 else {})
        got, want = targets_of(spark, sizes), plain_targets(sizes)
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] for s in sizes)
    assert targets_of(spark, {"a": 0, None: 0}) == {"a": 0.0, None: 0.0} and targets_of(spark, {}) == {}


def plain_rates(sizes, target, cap=2.0):
    """The rates of one source's documents, by halving the interval that the multiplier lies in."""
    import math

    live = [x for x in sizes if x]
    mean = sum(live) / len(live)
    if target >= cap * sum(live):
        return [cap if x else 0.0 for x in sizes]
    lo, hi = -1e4, 1e4
    rate = lambda x, t: 0.0 if not x else cap if t * x / mean > math.log(cap) else math.exp(t * x / mean)
    for _ in range(200):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if sum(x * rate(x, t) for x in live) < target else (lo, t)
    return [rate(x, lo) for x in sizes]


def test_mix(spark):
    texts = [None, "", *(words(1 + i * 7 % 50, i) for i in range(300)), words(25_000)]
    sources = [["s1", "s2", "s3", None, "s5"][i % 5] for i in range(len(texts))]
    table = docs(spark, *texts, source=sources)
    first = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(7), cell_rows=2).collect()
    assert len(first) == len(texts) == len(again)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mixing.mix(table.repartition(5)).collect()), key=str)
    size = {}
    for s, t in zip(sources, texts, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    want = plain_targets(size)
    tilts = set()
    for rows in (first, again):
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
        for s in size:
            own = sorted((r for r in rows if r.source == s), key=lambda r: r.doc_id)
            assert {r.source_size for r in own} == {size[s]} and [r.target for r in own] == pytest.approx([want[s]] * len(own))
            rates = plain_rates([r["size"] for r in own], want[s])
            assert [r.rate for r in own] == pytest.approx(rates, rel=1e-6, abs=1e-9)
            tilts.add(len({round(x, 6) for x in rates if x}) > 1)
            assert abs(sum(r.taken for r in own) - want[s]) <= max(3, max(r["size"] for r in own) / 2 if s == sources[-1] else 0)
    assert tilts == {True} or tilts == {True, False}
    taken = {r.doc_id: r.copies for r in first}
    back = mixing.mix_documents(table).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in back} == {i: n for i, n in taken.items() if n}
    assert mixing.mix(docs(spark)).count() == 0
    assert [(r["size"], r.taken) for r in mixing.mix(docs(spark, None, "")).collect()] == [(0, 0)] * 2


def test_mix_of_rows_without_ids_or_with_equal_ones(spark):
    texts = [*(words(1 + i % 9, i) for i in range(60)), "", None, *["same text here"] * 30]
    rows = [(None if i % 3 == 0 else 7, t, "s", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int")
    mixed = mixing.mix(table, share=0.5).collect()
    assert sum(r.taken for r in mixed) == pytest.approx(sum(len((t or "").split()) for t in texts) / 2, abs=3) and {r.copies for r in mixed} == {0, 1}
    out = mixing.mix_documents(table, share=0.5)
    assert out.columns == table.columns
    assert sorted(len(r.text.split()) for r in out.collect()) == sorted(r["size"] for r in mixed if r.copies)


def test_many_sources(spark):
    rows = [(i, words(1 + i % 5), f"s{i % 2000}") for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(mixed) == 4000 and all(abs(t - w) <= 5 for t, w in [(sum(r.taken for r in own), own[0].target) for own in [[r for r in mixed if r.source == f"s{i}"] for i in range(0, 2000, 97)]])


def plain_shards(rows, shards, seed=7):
    """{place: (shard, slot)} of rows (doc_id, source), by sorting them."""
    import hashlib

    by = {}
    for i, (doc, source) in enumerate(rows):
        by.setdefault("n" if source is None else "s" + source, []).append((hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest(), i))
    order = sorted(((2 * k + 1) / (2 * len(own)), name, h, i) for name, own in by.items() for k, (h, i) in enumerate(sorted(own)))
    out, slots = {}, [0] * shards
    for at, (*_, i) in enumerate(order):
        shard = at * shards // len(rows)
        out[i] = shard, slots[shard]
        slots[shard] += 1
    return out


def test_sharding(spark):
    texts = [None, "", "x", "x", *(f"text {i} é" for i in range(200)), words(20_000)]
    sources = [["hot", "hot", "b", None, "c"][i % 5] for i in range(len(texts))]
    table = docs(spark, *texts, source=sources)
    want = plain_shards(list(enumerate(sources)), 8)
    facts = table.selectExpr("doc_id as row", "doc_id", "source", "struct(0) as own")
    for ranges in (10_000, 7):
        rows = sharding.interleave(facts, 8, range_rows=ranges).collect()
        assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
        for s in set(sources):
            share = sources.count(s) / 8
            assert all(abs(sum(r.source == s for r in rows if r.shard == k) - share) <= 2 for k in range(8))
    want = plain_shards(list(enumerate(sources)), 24)
    for r in sharding.shard_digest(table).collect():
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(data)) and r.law == "rows" and r.grown_shard is None
        assert (r.shard, r.slot) == want[r.doc_id]
    assert sharding.shard_digest(docs(spark)).count() == 0
    twice = table.unionByName(table)
    full = sharding.shard_documents(twice, 6).collect()
    assert len(full) == 2 * len(texts) and len({(r.shard, r.slot) for r in full}) == len(full)
    few = sharding.shard_digest(docs(spark, "a", "b", "c")).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}


def test_sharding_of_odd_rows(spark):
    """Rows without an id, or all with one, are spread; columns of the input with the names of the output or of helpers don't matter."""
    rows = [(None if i % 3 else 5, f"t {i % 40}", ["a", None][i % 2], "x", "y", "z", "r") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, size string, text_crc32 string, _row string")
    out = sharding.shard_documents(table, 7)
    assert out.columns == ["doc_id", "text", "source", "size", "text_crc32", "_row", "shard", "slot"]
    got = out.collect()
    assert sorted((r.doc_id or 0, r.text, r.source or "", r["size"], r._row) for r in got) == sorted((r[0] or 0, r[1], r[2] or "", "y", "r") for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7)) and all(sorted(v) == list(range(len(v))) and len(v) in (128, 129) for v in by.values())
    assert all(abs(sum(r.source == "a" for r in got if r.shard == k) - 450 / 7) <= 2 for k in range(7))


def test_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(table.where(~held))
    found = langid.identify(table.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert sum(r.rejected for r in found) == 0
    odd = langid.identify(docs(spark, None, "", "1234 !!", "the and of the", "漢字仮名交じり文の長い例文です", words(40_000, 0) + " the of and"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in odd[:3])
    assert odd[3].lang_pred == "en" and not odd[3].rejected and odd[4].rejected
    assert all(0 <= r.score <= 1 for r in odd) and odd[3].source == "a"
    none = langid.train(table.where("lang is null"))
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs(spark, "some text", None), none).collect()} == {("und", True)}
    assert langid.identify(docs(spark), model).count() == 0


def test_languages_that_are_unknown(spark):
    """Long texts in other languages of the same letters are rejected, also where a language's sample has junk; short ones in known languages stay."""
    other = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek",
    ]
    known = [
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen",
        "the cat",
        "und der Hund",
        "A.",
    ]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1 - i, t, lang) for lang in ("de", "en", "es", "fr") for i, t in enumerate(["A.", "q", "zq"])], table.schema)
    model = langid.train(table.unionByName(junk))
    found = {r.doc_id: r.rejected for r in langid.identify(docs(spark, *other, *known), model).collect()}
    assert found == {i: i < len(other) for i in range(len(other) + len(known))}
    assert (model.least[:, 8:] > 0.1).all() and (model.least[:, :3] < 0.1).all()
    assert not any(r.rejected for r in langid.identify(table.where("length(text) > 0"), model).collect() if re.search(r"[^\W\d_]", r.text))


def luhn(x):
    return sum((int(c) * 2 // 10 + int(c) * 2 % 10) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def test_pseudonyms(spark):
    values = ["a.b-1@x.com", "Th.18@mail6.example.com", "102.181.51.64", "4111 1111 1111 1111", "4041894974608795", "2024-02-29", "31.12.1999", "+1 (487) 555-7209", "212-555-1234", "123-45-6789", "3782-822463-10005", "4451718024887799"]
    texts = ["; ".join(values), "again " + values[1] + " and " + values[4], None, "", "clean 12 of 300.1.2.3 and 2023-02-30", "9" * 50, "x" * 100_000 + " " + values[2], "a" * 300 + "@b.cc"]
    made = pii.pseudonymise(docs(spark, *texts), "key")
    rows = made.orderBy("doc_id").collect()
    new = rows[0].text.split("; ")
    assert rows[0].n_replaced == len(values) and all(a != b for a, b in zip(values, new, strict=True))
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    for a, b in zip(values, new, strict=True):
        assert shape(a) == shape(b) or a == "102.181.51.64"
    assert all(0 <= int(x) < 256 for x in new[2].split(".")) and luhn(new[3].replace(" ", "")) and new[3][0] == "4"
    assert rows[1].text == f"again {new[1]} and {new[4]}"
    assert [rows[i].text for i in (2, 3, 4, 5)] == texts[2:6] and {rows[i].n_replaced for i in (2, 3, 4, 5)} == {0}
    assert rows[6].text == "x" * 100_000 + " " + new[2] and rows[7].text == texts[7]
    assert [r.text for r in pii.pseudonymise(made, "key", invert=True).orderBy("doc_id").collect()] == texts
    assert pii.pseudonymise(docs(spark, texts[0]), "other").first().text != rows[0].text
    assert pii.pseudonymise(docs(spark), "key").count() == 0


def test_pseudonyms_of_what_is_valid_alone(spark):
    """Values that their own rule rejects stay; the key shows in no plan; other columns stay; pseudonyms are valid themselves."""
    invalid = ["000-00-0000", "666-12-1234", "900-12-3456", "123-00-4567", "123-45-0000", "000-000-0000", "123-456-7890", "212-155-1234", "1234567812345678", "1234 5678 1234 5678", "256.1.1.1", "2023-02-29", "31-04-2020"]
    table = docs(spark, *invalid, "4451718024887799 27", "42 4366089147969128").withColumns({"_found": F.lit("kept"), "_new": F.lit(3)})
    made = pii.pseudonymise(table, "a secret key")
    rows = made.orderBy("doc_id").collect()
    assert [(r.text, r.n_replaced) for r in rows[: len(invalid)]] == [(t, 0) for t in invalid]
    assert made.columns == [*table.columns, "n_replaced"] and {(r._found, r._new) for r in rows} == {("kept", 3)}
    assert [r.n_replaced for r in rows[-2:]] == [1, 1] and rows[-2].text.endswith(" 27") and rows[-1].text.startswith("42 ")
    shown = made._jdf.queryExecution().toString() + made._jdf.queryExecution().executedPlan().toJSON()
    assert "secret" not in shown
    numbers = [f"{100 + i}-{1 + i % 99:02}-{1 + i:04}" for i in range(560)] + [f"{667 + i}-99-9999" for i in range(230)] + ["001-01-0001", "899-99-9999", "665-01-0001"]
    new = [r.text for r in pii.pseudonymise(docs(spark, *numbers), "k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new)
    numbers = [f"({200 + i}) {999 - i}-{i:04}" for i in range(800)]
    new = [r.text for r in pii.pseudonymise(docs(spark, *numbers), "k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", x) for x in new)
    assert [r.text for r in pii.pseudonymise(docs(spark, *new), "k", invert=True).orderBy("doc_id").collect()] == numbers


def plain_pseudonym(key, kind, left, right, m, n):
    """The Feistel network in Python."""
    import hashlib

    f = lambda i, x: int(hashlib.sha256(f"{key}:{kind}:{m}:{n}:{i}:{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + f(i, right) % m) % m
        else:
            right = (right + f(i, left) % n) % n
    return left, right


def test_pseudonyms_against_a_plain_version(spark):
    import datetime

    values = ["10.20.30.40", "2001-09-30", "321-54-9876", "(415) 555-2671"]
    got = [r.text for r in pii.pseudonymise(docs(spark, *values), "key").orderBy("doc_id").collect()]
    a, b = plain_pseudonym("key", "ipv4", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    assert got[0] == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    day = (datetime.date(2001, 9, 30) - datetime.date(1900, 1, 1)).days
    a, b = plain_pseudonym("key", "date", day // 17, day % 17, 4297, 17)
    assert got[1] == str(datetime.date(1900, 1, 1) + datetime.timedelta(a * 17 + b))
    a, b = plain_pseudonym("key", "ssn", 320 * 99 + 53, 9875, 898 * 99, 9999)
    area = a // 99 + 1
    assert got[2] == f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
    a, b = plain_pseudonym("key", "phone", 215 * 800 + 355, 2671, 640000, 10000)
    assert got[3] == f"({a // 800 + 200}) {a % 800 + 200}-{b:04}"


def test_pipeline_links_near_duplicates_from_a_similarity_of_80(spark):
    import corpus_pipeline

    base = words(26).split()
    texts = [
        " ".join(base),
        " ".join([*base[:-2], "new", "end"]),  # 20 shared shingles of 24 in all
        words(24, 100),
        " ".join([words(24, 100), words(5, 900)]),  # 20 of 25
        words(23, 200),
        " ".join([words(23, 200), words(5, 950)]),  # 19 of 24
    ]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, *texts), SF).collect()}
    assert kept == {least for _, least in brute_components(texts, 80).values()} == {0, 2, 4, 5}
    assert {least for _, least in brute_components(texts, 85).values()} == set(range(6))


def test_pseudonyms_are_a_permutation(spark):
    numbers = docs(spark, *(f"{i // 250}.{i % 250}.7.9" for i in range(3000)))
    made = [r.text for r in pii.pseudonymise(numbers, "key").collect()]
    assert len(set(made)) == 3000
    days = [f"20{y:02}-{m:02}-{d:02}" for y in range(8) for m in range(1, 13) for d in range(1, 29)]
    made = [r.text for r in pii.pseudonymise(docs(spark, *days), "key").collect()]
    assert len(set(made)) == len(days) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in made)


def test_pipeline_of_rows_without_ids_or_with_equal_ones(spark):
    """Rows are told apart where ids don't: no text is lost, no copy or contaminated row stays, no clean one goes."""
    import corpus_pipeline as p

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) between 300 and 600").orderBy("doc_id").limit(6).collect()]
    a, b, c, d, e, f = texts
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    bad = f"{e} {item}"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, bad), (7, f), (7, bad + " end"), (None, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns)
    out = p.near_duplicates(spark, table, SF)
    kept = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert [t for _, t in kept if t not in (bad, bad + " end")] == [t for _, t in sorted([(0, ""), (0, d), (1, a), (2, b), (3, c), (7, f)])]
    assert sum(t in (bad, bad + " end") for _, t in kept) == 1 and out.columns == table.columns
    clean = sorted((r.doc_id or 0, r.text) for r in p.decontamination(spark, table, SF).collect())
    assert clean == sorted((i or 0, t) for i, t in rows if item not in t)
    spoken = sorted((r.doc_id or 0, r.text) for r in p.language(spark, table.withColumn("rejected", F.lit(1)), SF).collect())
    assert spoken == sorted((i or 0, t) for i, t in rows if t)
    mixed = p.mixture(spark, table, SF).collect()
    sizes = sum(len(t.split()) for _, t in rows)
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(1.5 * sizes, abs=100) and {r.text for r in mixed} <= {t for _, t in rows}
    placed = p.shards(spark, table, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in placed) == sorted((i or 0, t) for i, t in rows) and len({(r.shard, r.slot) for r in placed}) == len(rows)
    empty = table.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r for r in kept.collect()]
        out = stage(spark, kept, SF)
        rows = out.collect()
        if name != "shards":
            assert out.columns == columns
        if name == "language":
            assert all(r.text is None or not re.search(r"[^\W\d_]", r.text) for r in set(before) - set(rows))
        if name == "near_duplicates":
            ids = [r.doc_id for r in before]
            label = brute_components([r.text for r in before], 80)
            least = {}
            for i, r in enumerate(before):
                least[label[i][1]] = min(least.get(label[i][1], r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(least.values()) and len(ids) > len(rows)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in rows for t in items)
            assert len(before) - len(rows) >= sum(any(t in r.text for t in items) for r in before)
        if name == "mixture":
            assert set(rows) <= set(before)
        if name == "shards":
            assert len(rows) == len(before) == len({(r.shard, r.slot) for r in rows})
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{os.getpid()}-{name}"
        out.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
