"""Operators on documents against plain Python on small tables, edge cases included."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shoalsong.llm import bpe, linefreq, minhash, mixing, pll, queries, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, _tie string, kept string, size string, score string"


def some_words(seed, n, vocabulary=3000):
    rng = np.random.RandomState(seed)
    return [f"w{i}" for i in rng.randint(0, vocabulary, n)]


@pytest.fixture(scope="module")
def texts():
    base = some_words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + some_words(2, 60)
    long = " ".join(some_words(3, 60_000))
    return [
        (1, " ".join(base), "a"), (2, " ".join(base).upper(), "a"), (3, " ".join(near), None), (4, " ".join(far), "b"),
        (5, None, "b"), (6, "", None), (7, " \t\n ", "c"), (8, "One  two", "c"), (9, "one two", "c"), (10, long, "a"),
        (11, long + " end", "b"), (12, "x", "ü"), (1, " ".join(base), "a"), (1, "another text under one id", "a"),
        (None, " ".join(near[1:]), "b"), (None, None, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # Columns that operators use inside, or return, come in with the table.
    return spark.createDataFrame([(i, t, s, "t", "k", "z", "s") for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def linked(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(docs, texts, width):
    found = minhash.near_duplicates(docs, width).collect()
    sets = [shingles(t, width) for _, t, _ in texts]
    groups = linked(sets, 80)
    ids = collections.defaultdict(list)
    for (i, _, _), g in zip(texts, groups):
        ids[g] += [i] if i is not None else []
    wanted = [(i, len(s), min(ids[g], default=None), i == min(ids[g], default=None)) for (i, _, _), s, g in zip(texts, sets, groups)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found], key=key) == sorted(wanted, key=key)


def test_near_duplicates_of_a_group_without_a_common_partner(spark):
    """A chain: neighbours are similar, ends are not. And a group whose leader is like nobody."""
    base = some_words(5, 200, 10**6)
    chain = [" ".join(f"c{i}n{k}" if k < 6 * i else w for k, w in enumerate(base)) for i in range(12)]
    lone = [" ".join(base[:20] + some_words(50 + i, 180, 10**6)) for i in range(30)]
    rows = list(enumerate(chain + lone))
    found = {r.doc_id: r.component_id for r in
             minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert [found[i] for i, _ in rows] == linked([shingles(t, 4) for _, t in rows], 80)


def test_signatures_of_similar_sets_share_a_key():
    rng = np.random.RandomState(0)
    for _ in range(200):
        common = rng.randint(0, 2**63, 160, dtype=np.uint64)
        a, b = (minhash.signature(np.unique(np.r_[common, rng.randint(0, 2**63, 20, dtype=np.uint64)])) for _ in range(2))
        a, b = a.reshape(minhash.CHUNKS, -1), b.reshape(minhash.CHUNKS, -1)
        far = (a != b).sum()
        if far <= minhash.MAX_DISTANCE:
            assert ((a != b).sum(axis=1) <= 1).any()
        assert far <= minhash.MAX_DISTANCE  # J = 0.8: 2 in 100,000 are further apart


def test_one_of_each_group_stays(docs):
    stay = minhash.without_duplicates(docs, 5).collect()
    assert stay[0].asDict().keys() == set(docs.columns)
    known = collections.Counter((r.doc_id, r.text) for r in stay)
    assert max(known.values()) == 1
    ids = [r.doc_id for r in stay if r.text and r.text.startswith("w")]
    assert sorted(ids, key=lambda i: (i is None, i)) == [1, 4, 10]
    assert {r.doc_id for r in stay} >= {5, 6, 7, 8, 12}


def test_empty_tables(none, spark):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.without_duplicates(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert linefreq.quality_rules(none).count() == 0
    assert pll.pseudo_likelihood(none).count() == 0
    vocabulary = queries.vocabulary()
    assert bpe.decode(bpe.encode(none, vocabulary), vocabulary).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity_scores(none, toxicity.fit(none, labels)).count() == 0


def test_pieces_hold_all_words(texts):
    column = pa.array([t for _, t, _ in texts])
    for limit in (10, 1000, words.PIECE):
        found = collections.Counter()
        for rows, starts, ends, data in words.pieces(column, limit=limit):
            found.update((int(r), data[s:e].tobytes()) for r, s, e in zip(rows, starts, ends))
        assert found == collections.Counter(
            (i, w.lower().encode()) for i, (_, t, _) in enumerate(texts) for w in WORD.findall(t or ""))


def base_rules(text):
    found = WORD.findall(text or "")
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    count, inside = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside), len(found) < 50 or 100 * len(inside) > 50 * len(found))


def test_base_rules(spark, texts):
    more = ["a b c a b c", "a a a a a", "x\n x\nx\n\n \nx", "é#ü *\n", "a b c d a b c e b c d", "\x0b\x0c\r", "😀 😀 😀 😀"]
    rows = [(i, t) for i, t in enumerate([t for _, t, _ in texts] + more)]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in linefreq.quality_rules(frame).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t), t


def test_frequent_lines_deplete_documents(spark):
    common = " ".join(some_words(8, 60))
    rows = [(i, f"{common}\n" + " ".join(some_words(100 + i, 20)), "h") for i in range(30)]  # mostly the common line
    rows += [(100 + i, f"{common.upper()}\n" + " ".join(some_words(200 + i, 120)), "h") for i in range(10)]  # a third is
    rows += [(200 + i, " ".join(some_words(7, 80)) + "\nsecond line", "h") for i in range(60)]  # copies of one text
    rows += [(300 + i, f"{common}\n" + " ".join(some_words(400 + i, 20)), None) for i in range(5)]  # rare on its host
    found = {r.doc_id: r for r in linefreq.quality_rules(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [i for i, r in sorted(found.items()) if not r.kept] == list(range(30))
    assert found[100].n_lost_words == 60 and found[0].n_lost_words == 60 and found[300].n_lost_words == 0


def test_no_python_in_the_quality_rules(docs):
    plan = linefreq.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 30, 0])
def test_bpe_equals_the_library(spark, texts, hot):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marks = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    more = ["it's we'll 'S  \n\n a b \t\n", "hi<|endoftext|> x  <|endoftext|><|endoftext|>!!<|endoftext|>", "!!<|endoftext| >",
            marks, " ".join(marks), "é́    😀😀 𝟙٣Ⅷ²", "=" * 5000, "  ", "\r\n\r\n  \x85 end "]
    rows = [(i, t) for i, t in enumerate([t for _, t, _ in texts] + more)] + [(None, "no id"), (None, None)]
    vocabulary = queries.vocabulary()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    found = bpe.decode(bpe.encode(frame, vocabulary, hot_words=hot), vocabulary).collect()
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in found], key=key) == sorted(wanted, key=key)
    at_once = bpe.encode(frame, vocabulary, hot_words=hot, decoded=True).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, found))


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def water(sizes, weights, repeats=3):
    """Targets by resharing the excess until none is above its limit."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(repeats * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        out = [repeats * s if i in full else rest * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i, t in enumerate(out) if t > repeats * sizes[i] + 1e-9}
        if not above:
            return out
        full |= above


def test_mixture(spark):
    rng = np.random.RandomState(2)
    rows = []
    for name, n in (("a", 300), ("b", 40), ("B", 5), ("ü", 60), (None, 30), ("", 20)):
        rows += [(len(rows) + k, " ".join(some_words(k, rng.randint(0, 90))), name) for k in range(n)]
    rows += [rows[0], rows[0], (None, "a b c", "a"), (None, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    placed, mix = mixing.mixture(frame, block_words=64)
    found = mixing.taken_words(placed, mix).collect()
    again = mixing.taken_words(*mixing.mixture(frame.repartition(5), block_words=1000)).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, water([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    taken = collections.Counter()
    for r in found:
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-12) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in order)
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, found)) == sorted(map(key, again))  # neither blocks nor partitions matter


def test_schedule_is_even(spark):
    rows = [(i, " ".join(some_words(i, 50)), "ab"[i % 2]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, mix = mixing.mixture(frame, block_words=50)
    slots = {r.slot: (r.key, r.block) for r in mix.collect()}
    assert sorted(slots) == list(range(len(slots)))
    share = sum(k == "=a" for k, _ in slots.values()) / len(slots)
    count, last = 0, {}
    for slot in range(len(slots)):
        key, block = slots[slot]
        assert block == last.get(key, -1) + 1  # the blocks of a source come in order
        last[key] = block
        count += key == "=a"
        assert abs(count - share * (slot + 1)) < 3


def test_mixed_documents_keep_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert all(WORD.search(r.text) for r in out.collect())


def test_held_out_is_crc32(spark):
    ids = [*range(200), -5, 2**60]
    found = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(
        "doc_id", toxicity.held_out(toxicity.F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_toxicity_by_n_grams(spark):
    rng = np.random.RandomState(0)
    bad = ["grobwort", "schimpfel", "fluchding"]

    def text(toxic, n):
        out = some_words(rng.randint(10**6), n, 800)
        for _ in range(max(2, n // 25) if toxic else 0):
            out[rng.randint(n)] = bad[rng.randint(3)]
        return " ".join(out)

    rows = [(i, text(i % 4 == 0, int(rng.randint(20, 400)))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (1, None), (10**6, 1)],
                                   "doc_id bigint, toxic int")
    model = toxicity.fit(frame, labels)
    unseen = [(0, text(True, 60).replace("grobwort", "grobwortt").replace("fluchding", "fluchdingg"), 1.0), (1, "", 1.0),
              (2, None, 1.0), (None, " \n", 1.0), (3, " ".join(some_words(1, 50_000, 800)), 1.0)]
    scored = toxicity.toxicity_scores(frame, model).collect()
    out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.95
    more = toxicity.toxicity_scores(spark.createDataFrame(unseen, "doc_id bigint, text string, score double"), model).collect()
    by_id = {r.doc_id: r for r in more if r.doc_id is not None}
    assert by_id[0].predicted == 1 and by_id[3].predicted == 0
    assert by_id[1].score == by_id[2].score and 0 <= by_id[1].score < 0.5


def test_margins_do_not_depend_on_batches():
    rng = np.random.RandomState(0)
    table = rng.randn(1 << toxicity.BITS).astype(np.float32)
    texts = [" ".join(some_words(i, rng.randint(0, 3000))) for i in range(60)] + [None, "a"]
    whole = toxicity.margins(pa.array(texts), table, 0.5)
    parts = [toxicity.margins(pa.array([t], pa.string()), table, 0.5)[0] for t in texts]
    assert np.allclose(whole, parts)


def test_network_gradients():
    rng = np.random.RandomState(1)
    net = {k: v.astype(np.float64) for k, v in pll.initial().items()}
    around, target = rng.randint(0, pll.SIZE, (40, 2 * pll.REACH)), rng.randint(0, pll.SIZE, 40)
    grads = pll.gradients(net, around, target)
    for k, index in (("context", (1, around[3, 1], 2)), ("to_class", (3, 5)), ("to_word", (target[0] // pll.CLASSES, 2, 7)),
                     ("bias", (4,)), ("word_bias", (target[1] // pll.CLASSES, 3))):
        value, step = net[k][index], 1e-5
        sides = []
        for d in (step, -step):
            net[k][index] = value + d
            sides.append(pll.forward(net, around, target)[0].mean())
        net[k][index] = value
        assert math.isclose((sides[0] - sides[1]) / (2 * step), grads[k][index], rel_tol=2e-3, abs_tol=1e-7)


def test_probabilities_add_up():
    net = pll.initial()
    around = np.repeat(np.arange(2 * pll.REACH)[None], pll.SIZE, axis=0)
    assert abs(np.exp(pll.forward(net, around, np.arange(pll.SIZE))[0]).sum() - 1) < 1e-4


def test_pseudo_likelihood(spark, texts):
    rng = np.random.RandomState(4)
    rows = [(i, " ".join(f"{'abcdefgh'[(s + k) % 8]}" for k, s in enumerate([rng.randint(8)] * 60))) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:50]]
    odd = [(2000, None), (2001, ""), (2002, "solo"), (None, "a b c"), (2003, " ".join(["a b c d e f g h"] * 9000))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows + mixed + odd], "doc_id bigint, text string, n_tokens string")
    found = {r.doc_id: r for r in pll.pseudo_likelihood(frame).collect()}
    assert len(found) == len(rows) + len(mixed) + len(odd)
    assert all(found[i].n_tokens == len(WORD.findall(t or "")) for i, t in rows + mixed + odd)
    assert found[2000].log_prob == 0 and found[2000].mean_log_prob is None and found[2002].log_prob < 0
    ordered = np.mean([found[i].mean_log_prob for i, _ in rows[:50]])
    assert ordered > np.mean([found[1000 + i].mean_log_prob for i, _ in rows[:50]]) + 0.5


def test_counts_cover_all_words(spark, docs, texts):
    total = sum(len(WORD.findall(t or "")) for _, t, _ in texts)
    assert pll.bucket_counts(docs).agg({"n": "sum"}).first()[0] == total


def test_digests(spark):
    vocabulary = queries.vocabulary()
    frame = spark.createDataFrame([(1, "héllo"), (2, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(frame, vocabulary), vocabulary)).collect()}
    assert found[1].decoded_sha256 == hashlib.sha256("héllo".encode()).hexdigest()
    assert found[2].n_tokens == 0 and found[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_ranks_are_packed():
    edges = [0, 1, bpe.ONE - 1, bpe.ONE, bpe.TWO - 1, bpe.TWO, bpe.HOT_WORDS]
    ranks = np.array(edges + np.random.RandomState(0).randint(0, bpe.HOT_WORDS + 1, 1000).tolist(), np.int32)
    assert (bpe.unpack(bpe.pack(ranks), len(ranks)) == ranks).all()
    assert len(bpe.unpack(bpe.pack(ranks[:0]), 0)) == 0


def test_a_text_that_spans_batches(spark):
    """More chunks than an Arrow batch has rows, with a text before, between and behind."""
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary()
    library = Tokenizer.from_str(vocabulary.text)
    rows = [(1, "first one"), (2, " ".join(some_words(1, 700_000, 5000))), (3, None), (4, " ".join(some_words(2, 90_000, 9000))), (5, "last")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(frame, vocabulary, hot_words=3000).collect()}
    for i, text in rows:
        assert found[i] == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 3, 0])
def test_texts_are_encoded_where_they_are(spark, hot):
    """No text and no place of a word is shuffled, whatever the table holds."""
    rows = [(i, f"common words and rare{i}x {'z' * i}") for i in range(50)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoded = bpe.encode(frame, queries.vocabulary(), hot_words=hot, decoded=True)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Sort", plan)
    assert sorted((r.doc_id, r.text) for r in encoded.collect()) == sorted(rows)


def test_words_that_occur_once_are_not_in_the_table(spark):
    vocabulary = queries.vocabulary()
    frame = spark.createDataFrame([(w,) for w in ("a", "b", "a", " c")], "word string")
    found = bpe.word_table(frame, spark.sparkContext.broadcast(vocabulary.text)).collect()
    assert [(r.word, r.n) for r in found] == [("a", 2)]
