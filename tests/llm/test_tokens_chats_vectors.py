"""Token files, token counts, chat repair and nearest neighbours against plain versions."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import ann, chat, queries, token_counts, token_files
from quern.llm.shared import new_path

SF = "/root/testdata/sf0.001"
BPE = f"{queries.TOKENIZERS}/word_bpe_49k.json"
RANKS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = [None, "", " \n ", "it's THE end's of it", "<|endoftext|> x<|startoftext|>y", "é ́x", "a" * 5000, "日本語 テキスト", "tab\tand\x1cfile\x85sep", "word " * 20_000, "12 345 $%& don't"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(7 * i + 1, t, "x", 5) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows[::-1], "doc_id long, text string, start string, n_tokens int").repartition(5)
    path = new_path(spark, "test")
    token_files.write_tokens(table, path, BPE, end_id=2)
    want, start = {}, 0
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = token_files.token_index(spark, path)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in index.collect()} == want
    some = token_files.read_tokens(spark, path, 8, 22).collect()
    assert sorted(r.doc_id for r in some) == [8, 15, 22]
    assert all(len(r.tokens) == r.n_tokens == want[r.doc_id][1] for r in some)
    import pyarrow.parquet as pq

    local = path.removeprefix("file://")
    import glob

    column = pq.ParquetFile(sorted(glob.glob(f"{local}/part-*"))[0]).metadata.row_group(0)
    names = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in names["tokens.list.element"].encodings) and "DELTA_BINARY_PACKED" in names["doc_id"].encodings
    assert all(c.has_offset_index for c in names.values())


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, n = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), None)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_encoder_compares_bytes(monkeypatch):
    """Two words that a polynomial modulo 2^64 can't tell apart, and a hash that tells only a few words apart."""
    from tokenizers import Tokenizer

    odd = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd), *ODD[1:], "some more words", "more Some word", "thing, (that) is: A"]
    want = [Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(token_files.WordEncoder(BPE), texts) == want
    monkeypatch.setattr(token_files, "hash_words", lambda low, a, b, seed: ((b - a).astype(np.uint64) % np.uint64(5),))
    weak = token_files.WordEncoder(BPE)
    for t, w in zip(texts, want, strict=True):
        assert encoded(weak, [t]) == [w]
    assert encoded(weak, texts) == want


def test_encoder_of_a_tokenizer_that_keeps_white_space():
    import glob

    from tokenizers import Tokenizer

    for path in glob.glob(f"{queries.TOKENIZERS}/*.json"):
        try:
            plain = Tokenizer.from_file(path)
        except Exception:  # noqa: BLE001 - a file of another kind
            continue
        texts = ["two  words and   spaces", " a", "b ", "x\ty\n\nz", "plain words"]
        assert encoded(token_files.WordEncoder(path), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts], path


def test_token_files_without_rows_or_ids(spark):
    path = new_path(spark, "test")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, BPE)
    assert token_files.token_index(spark, path).count() == 0
    path = new_path(spark, "test")
    token_files.write_tokens(spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string"), path, BPE)
    got = sorted((r.doc_id or -1, r.start, r.n_tokens) for r in token_files.token_index(spark, path).collect())
    assert got[0] == (-1, 0, 2) and sorted(n for *_, n in got[1:]) == [0, 1, 1] and {i for i, *_ in got[1:]} == {3}
    assert all(b[1] == a[1] + a[2] for a, b in itertools.pairwise(sorted(got, key=lambda r: (r[1], r[1] + r[2]))))


def test_token_files_of_many_partitions(spark):
    """Files count on past part-99999."""
    import glob
    import os

    path = new_path(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(spark.createDataFrame([(i, f"w {i}") for i in range(40)], "doc_id long, text string"), path, BPE, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"))
    assert len(files) > 1
    for n, f in enumerate(files):
        folder, name = os.path.split(f)
        os.rename(f, f"{folder}/part-{100_001 - len(files) + n:05}{name[10:]}")
    start = 0
    for r in token_files.token_index(spark, path).orderBy("doc_id").collect():
        assert r.start == start
        start += r.n_tokens


COUNTER = token_counts.Counter(RANKS, queries.PRETOKENS)
COUNT = COUNTER.whole


@settings(max_examples=150, deadline=None)
@given(st.text("ab cd  e.\n1é'日s", max_size=200), st.lists(st.tuples(st.integers(-3, 220), st.integers(-3, 220), st.text("ab c.\n's", max_size=30)), max_size=6))
def test_count_tree_equals_counting_anew(text, edits):
    tree = token_counts.CountTree(text, COUNTER, leaf=8)
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(max(a, 0), len(text))
        b = min(max(b, a), len(text))
        text = text[:a] + new + text[b:]
        assert str(tree) == text and tree.n_tokens == COUNT(text)


def height_is_logarithmic(tree):
    return tree.root is None or tree.root.height <= 1.45 * np.log2(tree.n_leaves + 2) + 1


def test_edits_touch_little_in_any_script():
    """The characters counted for an edit, for texts in which letter, space, letter is rare or never occurs."""
    texts = {
        "prose": "The quick brown fox jumps over the lazy dog. ",
        "japanese": "吾輩は猫である。名前はまだ無い、どこで生れたか頓と見当がつかぬ。",
        "numbers": "12 345, 6789; 0.25 -17 88 ",
        "code": "for(int i=0;i<n;++i){a[i]=b[i]*c[i]+0x1f;}\n\t",
        "urls": "https://a.example.org/x/y?z=1&w=2#top\n",
        "list": "Haus,Garten,Straße,Brücke,",
        "blank": "   \n\n  \t x",
    }
    for name, unit in texts.items():
        text = unit * (100_000 // len(unit))
        tree = token_counts.CountTree(text, COUNTER)
        for at, size, new in [(50_000, 3, "abc"), (10, 0, "x"), (99_000, 20, ""), (70_001, 5, " 'll be "), (30_000, 0, unit)]:
            done = tree.counted
            tree.edit(at, at + size, new)
            text = text[:at] + new + text[at + size :]
            assert tree.counted - done <= 4 * token_counts.LEAF_CHARS, name
        assert tree.n_tokens == COUNT(text) and str(tree) == text and height_is_logarithmic(tree), name


def test_large_inserts_and_deletions_keep_the_tree_balanced():
    rng = np.random.default_rng(4)
    text = "some words of a text, 12 of them. " * 3000
    tree = token_counts.CountTree(text, COUNTER)
    for _ in range(60):
        at = int(rng.integers(0, len(text)))
        size, new = (0, "neu 漢字 word. " * 800) if rng.random() < 0.5 else (10_000, "")
        done = tree.counted
        tree.edit(at, at + size, new)
        text = text[:at] + new + text[at + size :]
        assert tree.counted - done <= len(new) + 4 * token_counts.LEAF_CHARS and height_is_logarithmic(tree)
    assert tree.n_tokens == COUNT(text) and str(tree) == text
    long = "y" * 50_000  # one pre-token is counted whole
    tree = token_counts.CountTree(f"a {long} b", COUNTER)
    tree.edit(25_000, 25_001, "z")
    assert tree.n_tokens == COUNT(str(tree))


def test_edited_counts(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_before int")
    for r in token_counts.edited_counts(table, RANKS, queries.PRETOKENS, queries.three_edits).collect():
        text = texts[r.doc_id] or ""
        assert r.n_before == COUNT(text) and r.n_built == len(text) and r.n_edits == 3
        for a, b, new in queries.three_edits(text):
            text = text[:a] + new + text[b:]
        assert (r.n_after, r.n_chars) == (COUNT(text), len(text))
        if len(text) > 50_000:
            assert r.n_reencoded < 5_000
    listed = spark.createDataFrame([(1, "some words here", [(0, 4, "other")]), (2, "x", None)], "doc_id long, text string, edits array<struct<start:int,stop:int,new:string>>")
    assert {r.doc_id: r.n_after for r in token_counts.edited_counts(listed, RANKS, queries.PRETOKENS).collect()} == {1: COUNT("other words here"), 2: COUNT("x")}
    assert token_counts.edited_counts(table.limit(0), RANKS, queries.PRETOKENS, queries.three_edits).count() == 0


def brute_cost(roles):
    """The least cost over all ways, by trying what each turn may become and what may be inserted before it."""
    best = {chat._START: 0}
    numbers = [chat.role_number(r) for r in roles]

    def grow(costs):
        for _ in range(4):
            for s, c in list(costs.items()):
                for q in chat._NEXT[s]:
                    costs[q] = min(costs.get(q, 1 << 30), c + chat.INSERT)
        return costs

    for r in numbers:
        new = {}
        before = dict(best)
        for s, c in grow(dict(best)).items():
            for q in chat._NEXT[s]:
                other = 0 if r == q - 1 else chat.NAME if r == 3 else chat.RELABEL
                new[q] = min(new.get(q, 1 << 30), c + other)
        for s, c in before.items():
            if s:
                other = 0 if r == s - 1 else chat.NAME if r == 3 else chat.RELABEL
                new[s] = min(new.get(s, 1 << 30), c + other + chat.MERGE)
        best = new
    return grow(best)[chat._ASSISTANT]


def check_chat(roles, told, end):
    state, cost = chat._START, 0
    for r, (role, action, inserted) in zip(roles, told, strict=True):
        for q in inserted:
            assert chat.ROLES.index(q) + 1 in chat._NEXT[state]
            state, cost = chat.ROLES.index(q) + 1, cost + chat.INSERT
        to, n = chat.ROLES.index(role) + 1, chat.role_number(r)
        cost += 0 if n == to - 1 else chat.NAME if n == 3 else chat.RELABEL
        assert ("relabel" in action) == (n != to - 1)
        if action.startswith("merge"):
            assert to == state and not inserted
            cost += chat.MERGE
        else:
            assert to in chat._NEXT[state]
        state = to
    for q in end:
        assert chat.ROLES.index(q) + 1 in chat._NEXT[state]
        state, cost = chat.ROLES.index(q) + 1, cost + chat.INSERT
    assert state == chat._ASSISTANT
    return cost


def test_repair_is_cheapest():
    names = ["system", "user", "assistant", "tool"]
    for n in range(1, 6):
        for roles in itertools.product(names, repeat=n):
            cost, told, end = chat.repair(list(roles))
            assert cost == brute_cost(roles) == check_chat(roles, told, end)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_format_chats(spark, parts):
    rng = np.random.default_rng(3)
    names = ["system", "user", "assistant", "Human", "gpt", None, "narrator"]
    rows = [(7, t, names[rng.integers(7)], f"text {t}") for t in range(300)]
    rows += [(c, t, names[rng.integers(3)], "x <|im_end|> y") for c in range(8, 30) for t in range(rng.integers(1, 6))]
    rows += [(None, 1, "user", None), (None, 2, "assistant", ""), (40, None, "user", "no turn"), (41, 1, "user", "same"), (41, 1, "user", "same"), (42, 1, "assistant", "z" * 200_000)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chat.format_chats(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        cost, told, end = chat.repair([r[2] for r in own])
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0))
        assert [(r.role, r.action, tuple(filter(None, r.inserted.split(",")))) for r in mine] == told
        assert mine[-1].cost + chat.INSERT * len(end) == cost
        text = "".join(r.rendered for r in mine)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") and text.endswith("<|im_end|>\n")
        roles = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        state = chat._START
        for x in roles:
            assert chat.ROLES.index(x) + 1 in chat._NEXT[state]
            state = chat.ROLES.index(x) + 1
        assert state == chat._ASSISTANT
    assert chat.format_chats(table.limit(0)).count() == 0


def exact(ids, x, asked, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def test_nearest_against_all(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = exact(ids, x, np.flatnonzero(ids % 50 == 0))
    got = queries.op3_ann(spark, "/root/testdata/sf0.1").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want) and all([r["rank"] for r in v] == [1, 2, 3, 4, 5] for v in by.values())
    hits = sum(len({r.vec_id for r in by[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    place = {v: i for i, v in enumerate(ids)}
    for r in got:
        a, b = x[place[r.query_id]], x[place[r.vec_id]]
        assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


def test_nearest_odd_vectors(spark):
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    good = [[1.0, 0.0]] * 300 + [[0.0, 1.0], [1.0, 1.0], [-1.0, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(None, [1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = ann.nearest(table, table.where("vec_id in (0, 299, 300, 1000, 1003)"), block_rows=40, rerank=8).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3, 4, 5], 299: [0, 1, 2, 3, 4], 300: [301, 0, 1, 2, 3]}
    parted = ann.nearest(table, table.where("vec_id in (0, 299, 300, 1000, 1003)"), block_rows=40, query_rows=2, rerank=8).collect()
    assert sorted(parted) == sorted(got)
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, few.where("vec_id = 1")).collect()] == [(1, 1, 2)]
    assert ann.nearest(few.limit(0), few).count() == 0 and ann.nearest(few, few.limit(0)).count() == 0
    assert ann.nearest(table.where("vec_id = 1002"), few).count() == 0


def test_nearest_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e300, 1e300]), (2, [3e-200, 4e-200]), (3, [-1e-300, 0.0]), (0, [1e200, 1e200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(table, table).collect()}
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    for (a, b), score in got.items():
        assert score == pytest.approx(unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]), abs=1e-15)
    assert {a for a, _ in got} == {0, 1, 2, 3} and all((a, b) in got for a in range(4) for b in range(4) if a != b)


def test_queries_that_share_an_id(spark):
    table = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0])], table.schema)
    first = [tuple(r) for r in ann.nearest(table, asked).orderBy("rank").collect()]
    assert len(first) == 5 and first == [tuple(r) for r in ann.nearest(table, asked.orderBy("embedding").repartition(2)).orderBy("rank").collect()]


@pytest.mark.parametrize("noise", [0.01, 0.3])
def test_nearest_in_clusters_tighter_than_codes(spark, noise):
    """Rows that the codes can't tell apart, and neighbours in lists beyond those visited first."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20, 64))[rng.integers(20, size=12_000)] + noise * rng.normal(size=(12_000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table, table.where("vec_id % 200 = 0"), sample=2_000).collect()
    want = exact(np.arange(12_000), x, range(0, 12_000, 200))
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, i + 1): v for q, near in want.items() for i, (v, _) in enumerate(near)}


def test_lists_in_two_levels():
    """Clustered vectors: few of many lists hold nearly all neighbours; every row gets a list, and probing them all finds all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 32))
    x = ann._unit(np.repeat(centres, 40, 0) + 0.25 * rng.normal(size=(12_000, 32)))
    index = ann.fit(x, 4_000_000, two_levels=16)
    assert 300 <= len(index.coarse) <= 600 and len(index.tops) > 16 and index.first[-1] == len(index.coarse)
    own = index.place(x)
    sizes = np.bincount(own, minlength=len(index.coarse))
    visited = index.lists(x[::100], sizes, 1)
    near = np.argsort(-(x[::100] @ x.T), axis=1)[:, 1:6]
    found = np.mean([np.isin(own[n], v).mean() for n, v in zip(near, visited, strict=True)])
    assert found >= 0.95 and np.mean([sizes[v].sum() for v in visited]) < len(x) / 4
