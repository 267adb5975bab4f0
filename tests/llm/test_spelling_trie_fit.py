"""Spelling variants, the conversation trie and best-fit packing against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import bestfit, packing, queries, spelling, trie
from test_llm import DOC, docs_of, empty, odd  # noqa: F401

TURN = "conv_id long, turn long, role string, text string"


# 11: spelling ---------------------------------------------------------------


def near_brute(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(docs, min_length=5, min_count=3):
    counts = collections.Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if c < "\x80" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    forms, out = {}, {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if near_brute(w, v))
        good = near and -near[0][0] >= 2 * n
        forms[w] = near[0][1] if good else None
        out[w] = [n, len(near), -near[0][0] if good else None]
    rows = set()
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, *out[w]))
    return rows


def spelled(seed, n_docs):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéüÿ×") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    texts = []
    for _ in range(n_docs):
        words = []
        for _ in range(40):
            w = base[int(len(base) * rng.random() ** 3)]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÉz") + w[i:], w[:i] + rng.choice("aeßz") + w[i + 1 :]])
            words.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        texts.append(rng.choice([" ", ", ", "_1", "日"]).join(words))
    return texts


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 200])
def test_spelling_equals_brute_force(spark, filter_bytes):
    """200 bytes: several filters one after the other, and some lengths in parts."""
    texts = [*spelled(1, 120), None, ""]
    got = spelling.spelling_variants(docs_of(spark, texts), filter_bytes=filter_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_brute(list(enumerate(texts)))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want) > 60
    assert any(r[2] != (r[1] or r[0]) for r in want)  # a chain of two forms or more


def test_spelling_of_chains_ties_and_long_words(spark):
    long = "a" * 3000
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "xxxxxx": 4, "xxxxxy": 8, "xxxxxz": 8, long: 3, long + "b": 6, long[:-1] + "z": 6, "once5": 1}
    texts = [" ".join([w] * n) for w, n in counts.items() for _ in range(3)]
    assert set(map(tuple, spelling.spelling_variants(docs_of(spark, texts)).collect())) == variants_brute(list(enumerate(texts)))


def test_spelling_in_stretches(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 50)
    text = spelled(2, 1)[0] + " " + "x" * 200 + " tail"
    parts = list(spelling.stretches(text.lower()))
    assert len(parts) > 3 and [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text.lower())


def test_filters_hold_all_their_words(spark):
    words = sorted({w for t in spelled(3, 60) for w in spelling.RUN.findall(t)})
    layout = spelling.Layout(collections.Counter(map(len, words)), 64)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    wanted = {(n, p) for n, parts in layout.parts.items() for p in range(parts)}
    passes = list(layout.passes(64))
    assert set().union(*passes) == wanted and all(sum(8 * layout.blocks[n] for n, _ in x) <= 64 or len(x) == 1 for x in passes)
    filters = spelling.build_filters(df, layout, wanted)
    for _, codes in spelling.by_length(words):
        h, n = spelling.mix(spelling.sums(codes)), codes.shape[1]
        for one, part in zip(h, layout.part_of(h, n)):
            bits = spelling.bits_of(np.array([one]))[0]
            assert filters[n, part][spelling.block_of(np.array([one]), layout.blocks[n])[0]] & bits == bits


def test_hashes_of_edits_are_those_of_the_edited_words():
    word = "aabÿcc"
    (_, codes), = spelling.by_length([word])
    seen = set()
    for length, i, rows, h, letter in spelling.edits(codes):
        for k in range(len(rows)):
            edited = word[:i] + ("" if letter is None else spelling.LETTERS[letter[k]]) + word[i + 1 :]
            assert len(edited) == length and spelling.sums(next(spelling.by_length([edited]))[1])[0] == h[k]
            seen.add(edited)
    brute = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + c + word[i + 1 :] for i in range(6) for c in spelling.LETTERS if c > word[i]}
    assert seen == brute


def test_spelling_odd_rows(spark, odd, empty):  # noqa: F811
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(odd).collect()}
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == {r[0]: r[3] for r in variants_brute(texts)}
    assert spelling.spelling_variants(empty).count() == 0


# 12: trie ---------------------------------------------------------------------


def trie_brute(rows):
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        of = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(of, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if paths[c] == p))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    )


def talks(seed, n, copies=0, deep=0):
    """Conversations of few texts, so prefixes are shared; many copies of one; some of the same long beginning."""
    rng = random.Random(seed)
    rows = []
    for c in range(-150, n - 150):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bb", "ccc é"])))
    for c in range(n, n + copies):
        rows += [(c, t, "user", "same") for t in range(7)]
    for c in range(n + copies, n + copies + deep):
        rows += [(c, t, "user", "deep") for t in range(40 + c % 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("conversations", [100_000, 60, 7])
def test_trie_equals_brute_force(spark, conversations):
    """Of few conversations a shard, copies span shards, nodes span many shards, and borders cut long ways."""
    rows = talks(1, 600, copies=100, deep=30)
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN), shard_conversations=conversations)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_brute(rows), key=str)


def test_trie_of_copies_alone(spark):
    """All shards hold nothing but one conversation: every node is on the skeleton."""
    rows = [(c * 100 + 99, t, "user", "x") for c in range(40) for t in range(8)]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN), shard_conversations=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_brute(rows), key=str)


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (5, None, None, None), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, None, "", ""), (7, 1, "a", "b" * 100_000), (103, 0, None, "only"), (2**62, 0, "r", "t")]
    df = spark.createDataFrame(rows, TURN)
    for c in ("path", "chars", "turns", "shard", "head", "of", "key", "t"):
        df = df.withColumn(c, F.lit("clash"))
    got = trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(trie_brute(rows), key=str)
    assert trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5][:7]
    rows = [(c, 0, "user", f"t{c}") for c in ids]
    (root,) = trie.conversation_trie(spark.createDataFrame(rows, TURN)).collect()
    assert tuple(root) == (ids[0], 0, None, 7, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_skeleton_names_nodes_by_their_first_shard():
    # the borders of five shards cut ways of 2, 0, 3 and 3 turns; only the fourth shard lies within one way
    s = trie.Skeleton([0, 1, 4, 5, 9], [2, 0, 3, 3], [0, 1, 0, 3, 0])
    name = lambda shard, depth: (shard << 32) | depth
    assert s.keys(0) == [] and s.left(0) == -1 and s.right(4) == -1
    assert s.keys(1) == [name(0, 0), name(0, 1), name(0, 2)]
    assert s.keys(2) == [name(0, 0)]
    assert s.keys(4) == [name(0, 0), name(2, 1), name(2, 2), name(2, 3)]
    # a node that begins where another one of its depth ends has a name of its own
    s = trie.Skeleton([0, 1, 2], [1, 1], [0, 0, 0])
    assert s.keys(2) == [name(0, 0), name(1, 1)]


# 13: best fit -------------------------------------------------------------------


def best_fit_brute(lengths, window):
    """Room left in each sequence after best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 64, 100, 257])
    pick = [lambda: rng.randint(1, window), lambda: rng.choice([window // 3, window // 2, window // 2 + 1, 1]), lambda: min(window, 1 + int(rng.expovariate(8 / window)))][seed % 3]
    lengths = [pick() for _ in range(1500)]
    counts = collections.Counter(lengths)
    plan = bestfit.Plan(dict(counts), window)
    assert len(plan.key) <= 2 * window * (2 * window) ** 0.5
    held = collections.defaultdict(list)
    for n, k in counts.items():
        for s, o in zip(*plan.place(np.full(k, n), np.arange(k))):
            held[int(s)].append((int(o), n))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
    assert sorted(held) == list(range(plan.sequences))
    assert sorted(window - sum(n for _, n in p) for p in held.values()) == best_fit_brute(lengths, window)


def test_tightest_capacity():
    rng = random.Random(9)
    for top in (1, 7, 8, 2048):
        tree, held = bestfit.Capacities(top), set()
        for _ in range(400):
            c = rng.randint(1, top)
            if c in held and rng.random() < 0.6:
                tree.pop(c)
                held.remove(c)
            elif c not in held:
                tree.push(c, 0, 1)
                held.add(c)
            n = rng.randint(1, top)
            assert tree.tightest(n) == min((h for h in held if h >= n), default=None)


def fit_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def fitted(rows, window):
    """Sequences are filled without gaps; returns their number."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(held)


def test_best_fit_of_texts(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta é", "日本", "<|endoftext|>", "\n\n"]
    texts = [" ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7)) % 700)) for _ in range(150)] + [None, "", "x y " * 5000]
    make = packing.json_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for window in (64, 2048):
        rows = bestfit.best_fit(docs_of(spark, texts), make, window=window).collect()
        ids, by_doc = fit_ids(texts), collections.defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
        assert sorted(by_doc) == list(range(len(texts)))
        for d, pieces in by_doc.items():
            pieces.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in pieces] == list(range(len(pieces)))
            assert pieces[0]["start"] == 0 and all(r["length"] == window for r in pieces[1:])
            assert sum(r["length"] for r in pieces) == len(ids[d]) and len(pieces) == -(-len(ids[d]) // window)
            for r in pieces:
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert fitted(rows, window) == len(best_fit_brute([r["length"] for r in rows], window))


def test_best_fit_odd_rows(spark, odd, empty):  # noqa: F811
    make = packing.json_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    got = bestfit.best_fit(odd, make).collect()
    assert fitted(got, 2048) and sum(r["start"] == 0 for r in got) == 8 and sum(r["doc_id"] is None for r in got) == 1
    assert bestfit.best_fit(empty, make).count() == 0
    many = spark.createDataFrame([(None, "same text", "en", "s", 1)] * 3000, DOC)
    assert fitted(bestfit.best_fit(many.repartition(7), make).collect(), 2048) == -(-3000 // (2048 // 3))


def test_queries_of_this_round_are_registered():
    assert {"op11_spelling", "op12_trie", "op13_best_fit"} <= set(queries.QUERIES)
    assert {"op11_spelling", "op12_trie"} <= set(queries.ORACLES)


# 8: confirmation of pairs with a frequent second row ----------------------------------


def test_a_row_in_many_pairs_is_confirmed_in_parts(spark, monkeypatch):
    """One document near many others that are not near each other: all links are found, whatever the parts."""
    from sketchloom.llm import minhash

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hub = [word() for _ in range(400)]
    texts = []
    for _ in range(30):
        own = list(hub)
        at = rng.randrange(370)
        own[at : at + 22] = [word() for _ in range(22)]
        texts.append(" ".join(own))
    texts = [" ".join(hub), *texts, *[" ".join(word() for _ in range(50)) for _ in range(5)]]
    df = docs_of(spark, texts)
    found = []
    for pairs in (64, 2):
        monkeypatch.setattr(minhash, "PAIRS", pairs)
        found.append({r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df).collect()})
    assert found[0] == found[1] == {i: 0 if i <= 30 else i for i in range(36)}
