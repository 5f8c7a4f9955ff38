"""Each operator against a brute-force version on small, awkward tables."""

import base64
import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm import encode, filekind, hashing, mix, neardup, repetition, spans, topn
from lintlake.llm.running import running_sum

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
AWKWARD = ["", " ", None, "a", "\r\n\t", "​\x00é", "<|endoftext|>", "x" * 5000, "ab " * 3000, "混合 text 😀", "\U0001d518" * 30, "'s 're 1234 $%^"]


# Problem 3


def brute_top(rows, n):
    groups = {}
    for g, score, path, i in set(rows):
        if None not in (g, score, path, i) and not math.isnan(score):
            groups.setdefault(g, []).append((-score, path.encode(), i))
    return {(g, i, at + 1) for g, items in groups.items() for at, (_, _, i) in enumerate(sorted(items)[:n])}


def top(spark, rows, n=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "g string, score double, path string, i long, group_key string, position int")
    out = topn.top_n_per_group(df, F.col("g"), [(F.col("score"), False), (F.col("path"), True)], F.col("i"), n)
    return {(r.group_key, r.item_id, r.position) for r in out.collect()}


def test_top_n_with_ties_repeats_nulls_and_one_huge_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "", "b", "c", "é"]), rng.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.0, float("inf")]), rng.choice(["a", "B", "é", None]), rng.randrange(400)) for _ in range(4000)]
    assert top(spark, rows) == brute_top(rows, 3)


def test_top_n_beyond_one_partition(spark):
    # more wanted than a partition holds: positions have to run on over partitions
    rows = [("hot", float(i % 50), "p", i) for i in range(3000)] + [("z", 1.0, "p", 1)]
    assert top(spark, rows, 2500) == brute_top(rows, 2500)


def test_top_n_of_an_empty_table(spark):
    assert top(spark, []) == set()


@QUIET
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1.0, 2.0, None]), st.sampled_from(["x", "y"]), st.integers(0, 9)), max_size=40))
def test_top_n_equals_brute_force(spark, rows):
    assert top(spark, rows, 2) == brute_top(rows, 2)


def test_running_sum_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(5)) for i in range(3000)]
    out = running_sum(spark.createDataFrame([(*r, 1) for r in rows], "g string, i long, v long, one long"), ["i"], {"v": "total", "one": "nth"}, "g")
    want, sums = {}, {}
    for g, i, v in sorted(rows):
        want[g, i] = sums[g] = sums.get(g, 0) + v
    got = out.collect()
    assert {(r.g, r.i): r.total for r in got} == want
    assert {(r.g, r.nth) for r in got} == {(g, n + 1) for g in "ab" for n in range(sum(r[0] == g for r in rows))}
    assert running_sum(spark.createDataFrame([], "g string, i long, v long"), ["i"], {"v": "total"}).collect() == []


# Problem 2


def brute_spans(records, span):
    """Characters of each record that lie in a window which another record has."""
    where = {}
    for key, text in records:
        for i in range(len(text) - span + 1):
            where.setdefault(text[i : i + span], set()).add(key)
    out = {}
    for key, text in records:
        covered = set()
        for i in range(len(text) - span + 1):
            if len(where[text[i : i + span]]) > 1:
                covered.update(range(i, i + span))
        if covered:
            out[key] = out.get(key, set()) | covered
    return out


def shared(spark, records, span, parts=3):
    df = spark.createDataFrame([("k", k, t, 1) for k, t in records], "kind string, key string, text string, start int").repartition(parts)
    out = {}
    for r in spans.shared_spans(df, span).collect():
        out.setdefault(r.key, set()).update(range(r.start, r.end))
    return out


@pytest.mark.parametrize("span", [40, 64, 200])
def test_shared_spans_equal_brute_force(spark, span):
    rng = random.Random(span)
    word = lambda n: "".join(rng.choice("ab é混😀") for _ in range(n))
    common = [word(span), word(span + 1), word(3 * span), word(span - 1), "z" * (2 * span)]
    records = [(f"r{i}", "".join(rng.choice([word(rng.randrange(span)), rng.choice(common)]) for _ in range(4))) for i in range(60)]
    records += [("copy1", common[2]), ("copy2", common[2]), ("copy2", common[2]), ("alone", word(400) + "q" * 400), ("short", "z"), ("empty", "")]
    assert shared(spark, records, span) == brute_spans(records, span)


def hot_records():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    header = word(150)
    records = [(f"r{i}", (header if i % 3 else "") + word(rng.randrange(80, 120)) + (word(10) + header[:70] if i % 5 == 0 else "")) for i in range(60)]
    return [*records, ("r0", records[0][1]), ("copy", records[1][1]), ("copy2", records[1][1]), ("run", "x" * 300), ("xs", "y" + "x" * 90 + "y")]


def test_hot_minimisers_are_made_longer(spark, monkeypatch):
    monkeypatch.setattr(spans, "BUCKET_CHARACTERS", 300)
    monkeypatch.setattr(spans, "SAMPLE", 1)
    records = hot_records()
    df = spark.createDataFrame([("k", k, t) for k, t in records], "kind string, key string, text string")
    hot = spans.hot_minimisers(df, 60, 10_000)
    assert len(hot) == 2 and all(len(h) for h in hot)
    assert shared(spark, records, 60) == brute_spans(records, 60)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_the_way_of_hot_windows_changes_no_result(spark, monkeypatch, levels):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    header, block = word(90), word(130)
    records = [("run", "x" * 9000 + word(50) + "x" * 80), ("xs", "y" + "x" * 100 + "y"), ("twice", header + block + word(70) + header + block), ("once", word(30) + header + block), ("alone", 2 * word(100))]

    every = np.unique(np.concatenate([spans.super_kmers([t], 60)[4] for _, t in records]))
    strings = {}
    for _, t in records:
        whole, _, start, windows, least = spans.super_kmers([t], 60)
        strings |= {whole[s : s + n + 59]: [m, []] for s, n, m in zip(start.tolist(), windows.tolist(), least.tolist())}
    longer = np.array([v[0] for v in spans.longer(strings, 60, spans.STEP).values()], np.uint64)
    monkeypatch.setattr(spans, "hot_minimisers", lambda *_: (every, longer)[:levels])
    df = spark.createDataFrame(spark.sparkContext.parallelize([("k", k, t) for k, t in records], len(records)), "kind string, key string, text string")
    got = {}
    for r in spans.shared_spans(df, 60).collect():
        got.setdefault(r.key, set()).update(range(r.start, r.end))
    assert got == brute_spans(records, 60)


@pytest.mark.parametrize("step", [32, 5, 1])
def test_equal_windows_have_equal_longer_minimisers(step):
    texts = [t for _, t in hot_records() if len(t) >= 60]
    whole, record, start, windows, least = spans.super_kmers(texts, 60)
    strings = [whole[s : s + n + 59] for s, n in zip(start.tolist(), windows.tolist())]
    string, first, count, key = spans.longer_minimisers(strings, least, 60, step)
    keys = {}
    for i, a, n, k in zip(string.tolist(), first.tolist(), count.tolist(), key.tolist()):
        for w in range(a, a + n):
            keys.setdefault(strings[i][w : w + 60], set()).add(k)
    assert all(len(k) == 1 for k in keys.values()) and sum(count) == sum(windows)
    assert step > 1 or len(set.union(*keys.values())) == len(keys)


def test_repetition_inside_one_record_is_no_match(spark):
    assert shared(spark, [("a", "abcdefghij" * 60), ("a", "abcdefghij" * 60)], 50) == {}


def test_long_runs_of_one_character(spark):
    records = [("a", "x" * 9000), ("b", "y" + "x" * 100 + "y"), ("c", "x" * 39)]
    assert shared(spark, records, 40) == brute_spans(records, 40)


def test_shared_spans_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("k", None, "a" * 300), ("k", "x", None), (None, "y", "a" * 300)], "kind string, key string, text string")
    assert spans.shared_spans(df, 200).collect() == [] and spans.shared_spans(df.limit(0), 200).collect() == []


def test_kinds_do_not_mix(spark):
    df = spark.createDataFrame([("k", "x", "a b c " * 50), ("l", "y", "a b c " * 50)], "kind string, key string, text string")
    assert spans.shared_spans(df, 200).collect() == []


def test_a_collision_of_hashes_changes_nothing(monkeypatch):
    texts = ["abcdefgh", "abcdefgx"]
    monkeypatch.setattr(spans, "window_hashes", lambda codes, span, seed=1: np.zeros(max(0, len(codes) - span + 1), np.uint64))
    got = spans.shared_windows(texts, np.array([0, 1]), np.array([False, False]), 7)
    assert got.tolist() == [True, False, True, False]


def test_shares_and_file_texts(spark):
    lines = spark.createDataFrame([("f", "b", [2, 3]), ("f", "a", [1]), ("f", "a", [1]), ("f", None, [4]), ("g", "x", None), (None, "y", [1])], "file_path string, norm_line string, line_nos array<int>")
    assert [tuple(r) for r in spans.file_texts(lines).collect()] == [("f", "a\nb\nb")]
    records = spark.createDataFrame([("k", "a", "x" * 10), ("k", "b", ""), ("k", "c", None)], "kind string, key string, text string")
    matches = spark.createDataFrame([("k", "a", 0, 4), ("k", "a", 2, 6), ("k", "a", 2, 6), ("k", "a", 8, 10)], "kind string, key string, start long, end long")
    assert {r.key: (r.n_shared, r.shared_share) for r in spans.shared_shares(records, matches).collect()} == {"a": (8, 0.8), "b": (0, 0.0)}


@QUIET
@given(text=st.text("ab\U0001f600", max_size=60), span=st.integers(1, 20))
def test_window_hashes_tell_windows_apart(text, span):
    hashes = hashing.window_hashes(hashing.code_points(text), span).tolist()
    windows = [text[i : i + span] for i in range(len(text) - span + 1)]
    assert len(hashes) == len(windows) and len(set(zip(hashes, windows))) == len(set(hashes)) == len(set(windows))


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13])
def test_sliding_minimum(width):
    x = np.random.default_rng(3).integers(0, 99, 50)
    assert hashing.sliding_minimum(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]


# Problem 5


def brute_pairs(rows, threshold=0.6):
    sets = {}
    for i, t in rows:
        tokens = neardup._TOKEN.findall(t.lower()) if t else []
        if len(tokens) >= 20:
            sets[i] = set(zip(tokens, tokens[1:], tokens[2:]))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def near(spark, rows):
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "i long, t string, a int, class_id int")
    similar, members = neardup.near_duplicates(df, F.col("i"), F.col("t"))
    return similar, members


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
    return " ".join(words)


def near_rows(seed=5, bases=12, copies=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(bases):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(copies):
            i += 1
            rows.append((i, edited(rng, words, rng.randrange(6))))
    rows += [(1000 + j, t) for j, t in enumerate(AWKWARD)] + [rows[0], rows[1], (2000, rows[0][1]), (2001, rows[0][1].upper())]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    want = brute_pairs(rows)
    got = {tuple(r) for r in neardup.all_pairs(*near(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_regions_that_are_too_large_go_deeper_and_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "TILE", 5)
    monkeypatch.setattr(neardup, "STRIP", 2)
    rows = near_rows(6, 2, 30)
    want = brute_pairs(rows)
    got = {tuple(r) for r in neardup.all_pairs(*near(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_regions_of_an_order_are_its_common_prefixes(data):
    """Each run of a sorted order with a common prefix: few members as pairs, more as members, too many as large and taken apart, however batches fall."""
    size, few, restore = 5, 2, (neardup.REGION, neardup.FEW)
    neardup.REGION, neardup.FEW = size, few
    try:
        rows = data.draw(st.lists(st.tuples(st.integers(0, 2), st.tuples(*[st.integers(0, 1)] * 4)), max_size=60))
        entries = sorted((h, sum(v << 8 * (3 - i) for i, v in enumerate(t)), n) for n, (h, t) in enumerate(rows))
        cuts = sorted(data.draw(st.lists(st.integers(0, len(entries)), max_size=4)))
        region, got = neardup._Region(0, 0), []
        for a, b in zip([0, *cuts], [*cuts, len(entries)]):
            part = np.array(entries[a:b], np.int64).reshape(-1, 3)
            got += [r for x in region.feed(*part.T.copy()) for r in x.to_pylist()]
        got += [r for x in region.finish() for r in x.to_pylist()]
    finally:
        neardup.REGION, neardup.FEW = restore
    want = {0: set(), 1: set(), 2: set()}

    def split(level, part):
        below = 8 * (7 - neardup.DEPTHS[level])
        runs = {}
        for h, t, n in part:
            runs.setdefault((h, t >> below << below), []).append((h, t, n))
        for (h, t), run in runs.items():
            ids = [n for *_, n in run]
            if level == 0 and 1 < len(run) <= few:
                want[0] |= {(min(x, y), max(x, y)) for x in ids for y in ids if x < y}
            elif 1 < len(run) <= size:
                want[1] |= {(level, h, t, n) for n in ids}
            elif len(run) > size:
                want[2] |= {(level, h, t, n) for n in ids}
                if level < 2:
                    split(level + 1, run)

    split(0, entries)
    assert {(r["a"], r["b"]) for r in got if r["kind"] == 0} == want[0]
    for kind in (1, 2):
        rows = [(r["level"], r["head"], r["tail"], r["a"]) for r in got if r["kind"] == kind]
        assert len(rows) == len(set(rows)) and set(rows) == want[kind]


def test_pairs_of_a_large_class_of_copies_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 3)
    members = spark.createDataFrame([(i, 0) for i in range(11)] + [(20, 20), (21, 21)], "id long, class_id long")
    similar = spark.createDataFrame([(20, 21)], "a long, b long")
    got = [tuple(r) for r in neardup.all_pairs(similar, members).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(11) for b in range(a + 1, 11)} | {(20, 21)}


def test_groups_are_the_connected_components(spark):
    rows = near_rows(7, 5, 6)
    similar, members = near(spark, rows)
    got = {r.id: (r.group_id, r.n_links) for r in neardup.duplicate_groups(similar, members).collect()}
    pairs = {tuple(r) for r in neardup.all_pairs(similar, members).collect()}
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: g for i, (g, _) in got.items()} == {i: find(i) for i in got}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(i in p for p in pairs) for i in got}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.group_id for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_no_near_duplicates_in_nothing(spark):
    similar, members = near(spark, [])
    assert neardup.all_pairs(similar, members).collect() == [] and neardup.duplicate_groups(similar, members).collect() == []


# Problem 6


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_library(spark, tokenizer):
    texts = [*AWKWARD, "aaaaaaaaaaaaab" * 7, " \n  \t word", "don't can't I'LL", "a" * 1000 + "é" * 333, "\n" * 500]
    df = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)] + [(0, texts[0], [7])], "doc_id long, text string, ids array<int>")
    got = encode.encode_texts(df, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == (tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
    assert encode.encode_texts(df.limit(0), F.col("doc_id"), F.col("text")).collect() == []


@QUIET
@given(text=st.text(max_size=80))
def test_ids_decode_to_the_text(tokenizer, text):
    merges, of_byte = encode.merge_table("byte_bpe_50k")
    encoder = encode.WordEncoder(merges, of_byte)
    words = encode.regex.findall(encode.WORDS, text)
    encoder.add(set(words))
    ids = [int(i) for w in words for i in encoder.known[w]]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        parts = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert encoder.bytes_of == parts
    assert b"".join(parts[i] for i in ids).decode() == text


def word_encoder():
    return encode.WordEncoder(*encode.merge_table("byte_bpe_50k"))


@pytest.mark.parametrize(("piece", "seam"), [(8, 1), (64, 8)])
def test_words_in_pieces_equal_those_of_the_library(tokenizer, monkeypatch, piece, seam):
    monkeypatch.setattr(encode, "WHOLE", piece)
    monkeypatch.setattr(encode, "PIECE", piece)
    monkeypatch.setattr(encode, "SEAM", seam)
    monkeypatch.setattr(encode, "STRETCH", 10 * piece)
    rng = random.Random(piece)
    words = ["a" * 65, "a" * 200, "ab" * 50 + "a", "abc" * 40, "é" * 70, "混合" * 30, "-=" * 49, "\U0001d518" * 30]
    words += ["".join(rng.choice(alphabet) for _ in range(100)) for alphabet in ("ab", "ing", "thequickbrown")]
    encoder = word_encoder()
    encoder.add(set(words))
    for w in words:
        assert encoder.known[w].tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_a_word_of_a_million_letters_is_encoded_in_bounded_queries(tokenizer, monkeypatch):
    encoder = word_encoder()
    sizes, query = [], encoder._query
    monkeypatch.setattr(encoder, "_query", lambda raw: sizes.append(sum(map(len, raw))) or query(raw))
    word = "a" * 1_000_000 + "b"
    encoder.add({word})
    assert encoder.known[word].tolist() == tokenizer.encode(word, add_special_tokens=False).ids and max(sizes) < 2 * encode.QUERY_BYTES


def test_texts_decode_to_themselves(spark, monkeypatch):
    monkeypatch.setattr(encode, "DECODE_TOKENS", 100)
    df = spark.createDataFrame([*enumerate(AWKWARD)], "doc_id long, text string")
    ids = encode.encode_texts(df, F.col("doc_id"), F.col("text")).unionByName(spark.createDataFrame([(90, None), (91, [-5])], "doc_id long, ids array<int>"))
    got = {r.doc_id: r.text for r in encode.decode_ids(ids, F.col("doc_id"), F.col("ids")).collect()}
    assert got == {**{i: t or "" for i, t in enumerate(AWKWARD)}, 90: "", 91: ""}


# Problem 7


TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **kwargs):
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame(targets, TARGETS)
    out = mix.weighted_mix(sized, targets, **kwargs)
    return sorted(out.collect(), key=lambda r: r.position), {r.source: r for r in mix.mix_shares(out, targets).collect()}


DOCS = [(i, ["big", "Big ", "small", "unlisted", None][i % 5], 5 + i % 7) for i in range(500)] + [(1000, "small", 0), (1001, "tiny-one", 10)]


def test_shares_are_reached_and_repeats_kept(spark):
    rows, shares = mixed(spark, DOCS, [("big", 0.5, 1), ("small", 0.4, 3), ("tiny_one", 0.1, 2), ("absent", 0.2, 1), (None, 0.3, 1)], budget=150)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert np.cumsum([r.n_tokens for r in rows]).tolist() == [r.total_tokens for r in rows] and 135 <= rows[-1].total_tokens <= 150
    assert [r.finish_time for r in rows] == sorted(r.finish_time for r in rows)
    assert abs(shares["big"].actual_share - 0.5) < 0.1 and abs(shares["small"].actual_share - 0.4) < 0.1 and shares["absent"].n_tokens == 0
    assert max(r.copy for r in rows if r.source == "tiny_one") <= 2


def test_the_default_budget_is_what_all_shares_allow(spark):
    rows, shares = mixed(spark, DOCS, [("big", 0.5, 1), ("small", 0.5, 2)])
    total = sum(n for _, s, n in DOCS if s == "small")
    assert shares["small"].most_uses <= 2 and abs(shares["big"].actual_share - 0.5) < 0.02
    assert rows[-1].total_tokens <= min(2 * total, sum(n for _, s, n in DOCS if s in ("big", "Big "))) * 2


def test_beyond_the_fair_budget_others_fill_up(spark):
    rows, shares = mixed(spark, DOCS, [("big", 0.5, 1), ("small", 0.5, 1)], budget=10**9)
    assert sum(r.source == "big" for r in rows) == 200 and sum(r.source == "small" for r in rows) == 100


def test_every_pass_takes_each_document_once_and_is_shuffled_anew(spark):
    rows, _ = mixed(spark, DOCS, [("small", 1.0, 2)])
    first, second = ([r.doc_id for r in rows if r.copy == c] for c in (1, 2))
    assert len(first) == len(set(first)) == 100 and set(second) <= set(first) and first[: len(second)] != second


def test_mixing_nothing(spark):
    assert mixed(spark, [], [("big", 0.5, 1)])[0] == [] and mixed(spark, DOCS, [("big", None, 1), ("small", 0.5, 0)])[0] == []


def test_sizes_are_those_of_the_tokenizer(spark, tokenizer):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(AWKWARD)], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_tokens for r in mix.token_sizes(df, F.col("doc_id"), F.col("source"), F.col("text")).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(AWKWARD)}


# Problem 8


def brute_share(text):
    text = repetition.regex.sub("[ \t\r\n]+", " ", text or "").strip(" ").lower()
    if len(text) < 200:
        return 0.0
    grams = [text[i : i + 20] for i in range(len(text) - 19)]
    return 1 - len(set(grams)) / len(grams)


def test_shares_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [*AWKWARD, *("".join(rng.choice(["word ", "Word\n", "\t", "longer phrase here ", "é混😀"]) for _ in range(120)) for _ in range(20)), "A" * 199, "a" * 200, " " + "b" * 199 + "\n"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, repeated_share double")
    got = {r.doc_id: r.repeated_share for r in repetition.repeated_shares(df, F.col("doc_id"), F.col("text")).collect()}
    assert got == {i: pytest.approx(brute_share(t)) for i, t in enumerate(texts)}
    assert repetition.repeated_shares(df.limit(0), F.col("doc_id"), F.col("text")).collect() == []


def language_model(spark, texts):
    df = spark.createDataFrame([(i, "En" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    return df, repetition.perplexities(df, F.col("doc_id"), F.col("lang"), F.col("text"))


def test_probabilities_of_a_context_sum_to_at_most_one(spark):
    rng = random.Random(9)
    rows = [([1, 1, *(rng.choice([5, 6, 7, 8, 9]) for _ in range(12)), 2],) for _ in range(40)]
    words = spark.createDataFrame(rows, "words array<long>")
    grams = {(a, b, w) for (ws,) in rows for a, b, w in zip(ws, ws[1:], ws[2:])}
    model = {r.gram: math.exp(r.logp) for r in repetition.kneser_ney(words).collect()}
    keys = spark.createDataFrame(sorted(grams), "a long, b long, w long").select("a", "b", F.xxhash64("a", "b", "w").alias("gram")).collect()
    sums = {}
    for r in keys:
        sums[r.a, r.b] = sums.get((r.a, r.b), 0) + model[r.gram]
    assert len(model) == len(grams) and all(0 < p <= 1 for p in model.values()) and all(0.5 < s <= 1 + 1e-6 for s in sums.values())


def test_repeating_texts_are_the_least_surprising(spark):
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(40)) for _ in range(60)] + ["buy now cheap offer " * 30] + AWKWARD
    _, scored = language_model(spark, texts)
    got = {r.doc_id: r for r in scored.collect()}
    assert {r.doc_id for r in sorted(got.values(), key=lambda r: r.perplexity)[:2]} == {60, 69}
    assert {r.lang for r in got.values()} == {"en", "unknown"} and 61 not in got and 63 not in got
    bands = repetition.perplexity_bands(scored, 0.2).where("rejected = 'low'").collect()
    assert 60 in {r.doc_id for r in bands}


def test_a_model_of_nothing(spark):
    df, scored = language_model(spark, ["", None])
    assert scored.collect() == [] and repetition.perplexity_bands(scored).collect() == []


# Problem 4


def file_rows():
    hand = "use std::fmt;\n\n/// Adds {0}.\npub fn add_{0}(left: u32) -> u32 {{\n    if left > {1} {{\n        return left;\n    }}\n    let mut total_{0} = vec![{1}];\n    for part in total_{0}.iter() {{\n        println!(\"{{}}\", part);\n    }}\n    left.checked_add({1}).map(|x| x + {1}).unwrap_or(left)\n}}\n"
    library = hand.format("library", 71) + hand.format("second", 72).replace("use std::fmt;", "")
    rows = [(i, f"crates/a/src/m{i}.rs", hand.format(f"name{i}", i)) for i in range(20)]
    rows += [
        (100, "crates/a/src/table.rs", "// Code generated from a.idl, do not edit.\n" + "".join(f"pub const NAME_OF_{i}: u32 = {i};\n" for i in range(20))),
        (101, "crates/a/src/unmarked.rs", "".join(f"pub const SOME_NAME_{i}: u32 = {i};\n" for i in range(20))),
        (102, "web/app.min.js", "var a=function(b){return b.c?d:1};" * 60),
        (103, "vendor/lib/src/x.rs", library),
        (104, "crates/a/src/copied.rs", library),
        (105, "crates/a/src/blob.rs", "pub static B: [u8; 64] = [\n" + "    0x12, 0x34, 0x56, 0x78, 0x9a, 0xbc,\n" * 12 + "];\n"),
        (106, "crates/a/src/by_hand.rs", "// Not generated: this is maintained by hand.\n" + hand.format("other", 3)),
        (107, "crates/vendor-a/src/vendor/own.rs", hand.format("own", 4)),
        (108, "third_party/lone/y.rs", hand.format("lone", 5)),
    ]
    return rows


NOT_BY_HAND = {100, 101, 102, 103, 104, 105, 108}


def kinds(spark, rows, labels=(), patterns=("vendor/*", "", None, "[x", "*")):
    files = spark.createDataFrame([(i, p, t, "c") for i, p, t in rows], "file_id long, file_path string, content string, label string")
    labels = spark.createDataFrame(list(labels), "file_id long, label string, annotator string")
    patterns = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    out = filekind.file_kinds(files, F.col("file_id"), F.col("file_path"), F.col("content"), labels, patterns)
    return {r.id: r for r in out.collect()}


def test_kinds_of_files(spark):
    rows = file_rows()
    got = kinds(spark, [*rows, rows[0], (900, "crates/a/src/null.rs", None)], [(1, "handwritten", "a"), (2, "generated", "a"), (2, "handwritten", "b"), (3, None, "a"), (4, "odd", "b")])
    assert {i for i, r in got.items() if r.label != "handwritten"} == NOT_BY_HAND
    assert got[103].label == got[104].label == "vendored" and 900 not in got and len(got) == len(rows)


def test_features_see_lines_to_their_ends():
    field = '"name": "' + "x" * 500 + '"'
    rows = "\n".join(f'{{"id": {i}, {field}}},' for i in range(10))
    assert filekind.content_features("a.rs", rows)["records"] == 1.0
    ids = "1, 2, 3, " * 60
    assert filekind.content_features("a.rs", "\n".join(f"{ids}use a" for _ in range(10)))["records"] == 0.0
    calls = "\n".join(f"run({'a + ' * 150}{'b - ' * i}c)" for i in range(20))
    assert filekind.content_features("a.rs", calls)["varied"] > 0.9
    assert not filekind._is_record("1," * 50_000 + "(")


def test_every_glob_counts_however_many_there_are(spark, monkeypatch):
    patterns = spark.createDataFrame([(f"none{i}/*",) for i in range(2000)] + [(p,) for p in ("a/*", "a/?.rs", "b.rs", "*", "", "[x", None, "a/*")], "pattern string")
    files = spark.createDataFrame([(1, "a/b.rs"), (2, "a/cc.rs"), (3, "c.rs"), (4, None), (5, "none1999/x")], "id long, path string")
    at = filekind._ORDER.index("excluded")
    own = filekind.own_features(files, F.col("id"), F.col("path"), F.lit("x"), patterns)
    assert {r.id: 2 * r.own[at] for r in own.collect()} == {1: 2.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}
    monkeypatch.setattr(filekind, "MOST_GLOB_BYTES", 100)
    with pytest.raises(ValueError, match="bytes of exclude globs"):
        filekind.own_features(files, F.col("id"), F.col("path"), F.lit("x"), patterns)


def test_headers_reach_to_the_first_line_of_code():
    licence = [f"Line {i} of a licence." for i in range(30)]
    marked = "Code generated from a.idl. DO NOT EDIT."
    head = lambda *lines: filekind.content_features("a.rs", "\n".join(lines))["head_marked"]
    assert head(*("// " + x for x in [*licence, marked]), "fn a() {}") == 1.0
    assert head("/*", *licence, marked, "*/", "fn a() {}") == 1.0
    assert head(*("// " + x for x in licence), "#![allow(dead_code)]", "// " + marked, "fn a() {}") == 1.0
    assert head("/*", *licence, "*/", "fn a() {}", "// " + marked) == 0.0
    assert head(*("// " + x for x in licence), f'const A: &str = "{marked}";') == 0.0
    assert head("fn a() {}", "// " + marked) == 1.0


def test_sequences_of_a_header():
    grams = filekind.header_grams
    assert grams("// Made by tool 12\nfn a() {}") == grams("# made by 77 TOOL") and len(grams("// Made by tool 12")) == 3
    assert len(grams("// 自动生成")) == 5 and grams("fn a() {}") == grams("") == set() and not grams("// one")


def test_what_headers_say_is_learned_from_beliefs_and_labels(spark):
    rows = [(i, [1, 2, 3 + i % 3], *((0.0, 1.0, 0.0, 0.0, 0.0) if i % 2 else (1.0, 0.0, 0.0, 0.0, 0.0))) for i in range(40)] + [(100 + i, [7], 1.0, 0.0, 0.0, 0.0, 0.0) for i in range(9)]
    rows += [(200 + i, [8], 0.0, 1.0, 0.0, 0.0, 0.0) for i in range(9)] + [(300, [9], 0.0, 1.0, 0.0, 0.0, 0.0), (301, [], 1.0, 0.0, 0.0, 0.0, 0.0)]
    beliefs = spark.createDataFrame(rows, "id long, grams array<long>, b0 double, b1 double, b2 double, b3 double, b4 double")
    odds = {r.gram: r.told_generated for r in filekind.header_odds(beliefs, None).collect()}
    assert set(odds) == {8} and odds[8] > 2
    labels = spark.createDataFrame([(100 + i, "vendored") for i in range(9)] + [(200 + i, "handwritten") for i in range(9)], "id long, label string")
    odds = filekind.header_odds(beliefs, labels)
    assert {r.gram: r.told_vendored > 2 for r in odds.collect()} == {7: True}
    own = spark.createDataFrame([(1, [7, 1]), (2, [1]), (3, [])], "id long, grams array<long>")
    assert {r.id: (r.told_generated, r.told_vendored > 3) for r in filekind.told_by_headers(own, odds).collect()} == {1: (0.0, True)}


@settings(max_examples=300, deadline=None)
@given(line=st.text("a,:[]{}(= ", max_size=9))
def test_records_are_what_the_expression_says(line):
    line = line.strip()
    expression = r"^[^(){}=;\"]+(?:,[^(){}=;\"]+){2,}$|^\s*[\[{].*[:,].*[\]}],?$"
    assert filekind._is_record(line) == bool(re.match(expression, line))


def test_one_wrong_label_does_not_turn_its_file(spark):
    assert kinds(spark, file_rows(), [(5, "generated", "a")])[5].label == "handwritten"


def test_kinds_without_labels_patterns_or_files(spark):
    assert kinds(spark, [], [], []) == {}
    got = kinds(spark, [(1, None, ""), (2, "a.rs", "x"), (3, "", " \n")], [], [])
    assert set(got) == {1, 2, 3}


def believed(spark, evidence):
    rows = []
    for n, (p, e) in enumerate(evidence.items()):
        up = filekind._upward(np.array([e], float), filekind.FILE_GIVEN_DIRECTORY)[0]
        rows.append((n, p, [], *map(float, e), *map(float, up)))
    schema = f"id long, path string, grams array<long>, {filekind._FIVE(filekind._P)}, {filekind._FIVE(filekind._U)}"
    beliefs, directories = filekind.propagate(spark.createDataFrame(rows, schema))
    joints = [r.joint for df in (beliefs, directories) for r in df.collect() if r.joint]
    assert not rows or sum(map(sum, joints)) >= len(rows) - 1e-6
    return {r.path: tuple(r[b] for b in filekind._B) for r in beliefs.collect()}


def test_trees_too_large_for_one_task_give_the_same_beliefs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    paths = ["x", "a/x", *(f"a/b{i % 7}/c{i % 3}/f{i}" for i in range(40)), *(f"a/flat/d{i}/vendor/f{i}" for i in range(9)), "vendor/q/r/s", "deep/e/e/e/e/e/f"]
    evidence = {p: rng.normal(size=5) * 2 for p in paths}
    want = believed(spark, evidence)
    monkeypatch.setattr(filekind, "SUBTREE", 3)
    got = believed(spark, evidence)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert believed(spark, {}) == {}


def test_beliefs_equal_those_of_an_enumeration(spark):
    """Exact marginals of a tree of two directories and three files, by summing over all labellings."""
    rng = np.random.default_rng(4)
    evidence = {"a/b/x": rng.normal(size=5), "a/b/y": rng.normal(size=5) * 3, "a/z": rng.normal(size=5)}
    beliefs = believed(spark, evidence)
    got = {p: np.array(b) for p, b in beliefs.items()}
    name = np.exp([0.2, 0, 0, 0, 0])
    d, f = filekind.DIRECTORY_GIVEN_PARENT, filekind.FILE_GIVEN_DIRECTORY
    x, y, z = (np.exp(e) for e in evidence.values())
    joint = np.einsum("r,a,b,ra,ab,bx,by,az,x,y,z->xyz", name, name, name, d, d, f, f, f, x, y, z, optimize=True)
    for axes, path in (((1, 2), "a/b/x"), ((0, 2), "a/b/y"), ((0, 1), "a/z")):
        want = joint.sum(axis=axes)
        assert got[path] == pytest.approx(want / want.sum(), abs=1e-9)


def test_fit_stays_at_the_start_without_labels_and_learns_with_them():
    start = filekind.starting_weights()
    assert (filekind.fit(np.zeros((0, len(filekind.FEATURES))), np.zeros(0, int)) == start).all()
    x = np.zeros((60, len(filekind.FEATURES)))
    x[:, 0] = 1
    x[30:, list(filekind.FEATURES).index("prose")] = 1
    w = filekind.fit(x, np.array([0] * 30 + [1] * 30))
    assert (x[40] @ w).argmax() == 1 and (x[0] @ w).argmax() == 0
