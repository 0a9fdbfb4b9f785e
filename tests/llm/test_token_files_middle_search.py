"""Token files against the tokenizers library, fill-in-the-middle and ranked search against plain Python."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoalsong.llm import fim, lexical, token_files

SCHEMA = "doc_id bigint, text string, part int, start string, rank string, n_tokens string, query int, tie string, score string, n string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "r", "n", 2, "t", "s", "n") for i, t in rows], SCHEMA)


def words_of(seed, n, kinds=400):
    rng = np.random.RandomState(seed)
    return " ".join(f"{'wxyz'[k % 4]}{k}" for k in (rng.zipf(1.4, n) % kinds))


ROWS = [
    (7, "The quick  brown\tfox, don't  STOP"), (3, None), (5, ""), (5, ""), (5, "again under this id"), (9, " \n\t "),
    (1, "café café İstanbul ΣΣ ẞ  x y\u0085z ​­ \U0001f600\U0001f9d1‍\U0001f4bb"),
    (4, "a<|endoftext|>b <|startoftext|> <|end oftext|>"), (None, "no id"), (None, None), (2, words_of(1, 50_000)),
    (8, "x" * 300 + " " + "y" * 5000), (12, "12,345.67 it's we'll ﬁ Å \x00 \x1f \x7f"), (7, "The quick  brown\tfox, don't  STOP"),
    (20, "mark <P> inside"), (21, "ends <"), (22, "<S"), (23, "S> <M <P <<"), (24, "　wide 　 \xa0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS + [(i, words_of(i, i % 37)) for i in range(100, 400)])


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- Token files ---------------------------------------------------------------


def library(path, texts, end=1):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [[*e.ids, end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def files(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens"))
    token_files.write_token_files(docs, WORD_BPE, path)
    return path


def test_tokens_equal_the_library(spark, files, texts):
    rows = token_files.read_token_files(spark, files).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows)
    want = sorted((-1 if i is None else i, ids) for (i, _), ids in zip(texts, library(WORD_BPE, [t for _, t in texts])))
    assert got == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_start_counts_the_ids_before(spark, files):
    rows = token_files.read_token_files(spark, files).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([len(r["ids"]) for r in rows])[:-1].tolist()]
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_token_digests(spark, files):
    tokens = token_files.read_token_files(spark, files)
    want = {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in tokens.collect()}
    got = token_files.digests(tokens).collect()
    assert {r["start"]: r["ids_crc32"] for r in got} == want


def test_no_documents(spark, tmp_path):
    token_files.write_token_files(frame(spark, []), WORD_BPE, str(tmp_path / "t"))
    assert token_files.digests(token_files.read_token_files(spark, str(tmp_path / "t"))).collect() == []


def test_a_tokenizer_that_keeps_white_space(spark, docs, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.words_stand_alone(json.load(open(path, encoding="utf-8")))
    token_files.write_token_files(docs, path, str(tmp_path / "t"))
    got = sorted(r["ids"] for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    assert got == sorted(library(path, [t for _, t in texts]))


def test_words_stand_alone_and_few_are_remembered(texts):
    spec = open(WORD_BPE, encoding="utf-8").read()
    assert token_files.words_stand_alone(json.loads(spec))
    encode = token_files.encoder(spec, most=3)
    for (_, text), ids in zip(texts[:60], library(WORD_BPE, [t for _, t in texts[:60]])):
        assert np.frombuffer(encode((text or "").encode()), "<u4").tolist() == ids[:-1]


@pytest.mark.parametrize("text", [
    "The END. Of, it., a.b 1,2 3. X.\ty.\r x,\n'S it'S. don'T, ...", "É. Ñandú, ÀÉ \xaa. \xb5, ª", "J\u030c E\u0301 K\u212a. \u0130,",
    "<|STARTOFTEXT|> x.", "a<|endoftext|>. B,", "<|endoftext|>A.", "x.<|startoftext|>", ".", ",", " . ", "a.", "A,", "\x1c.\x1d,a. \x85b.",
])
def test_words_that_share_ids(text):
    encode = token_files.encoder(open(WORD_BPE, encoding="utf-8").read())
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library(WORD_BPE, [text])[0][:-1]


def test_random_texts_have_the_same_ids():
    encode = token_files.encoder(open(WORD_BPE, encoding="utf-8").read())
    signs, rng = "aAbB99   ..,,\n\t'sS<|>É\u0301\u030cJßİ-…\xa0\u2003", np.random.RandomState(5)
    texts = ["".join(signs[k] for k in rng.randint(0, len(signs), rng.randint(1, 30))) for _ in range(3000)]
    texts += [t.encode("latin-1", "ignore").decode("latin-1") for t in texts]
    assert [np.frombuffer(encode(t.encode()), "<u4").tolist() for t in texts] == [x[:-1] for x in library(WORD_BPE, texts)]


def rows_scanned(df):
    """Rows that the file scans of an executed query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan orc"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total


def test_metadata_prunes_what_cannot_hold_the_document(spark, tmp_path):
    path = str(tmp_path / "t")
    even = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_token_files(even, WORD_BPE, path, files=2)
    tokens = spark.read.schema("doc_id bigint, ids array<int>").orc(f"{path}/tokens")
    # Smallest and largest value: one row group of 20. Bloom filter: an odd id is in the range, but in no
    # group; its rate of errors is one in 100.
    assert rows_scanned(tokens.where(F.col("doc_id").isin([20_000]))) == token_files.ROW_GROUP
    read = [rows_scanned(tokens.where(F.col("doc_id").isin([i]))) for i in range(1001, 40_000, 4000)]
    assert sum(n > 0 for n in read) <= 2
    got = token_files.read_token_files(spark, path, doc_ids=[20_000, 20_001, 4])
    assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().toString().replace("*", "")
    assert sorted((r["doc_id"], r["start"]) for r in got.collect()) == [(4, 6), (20_000, 30_000)]


def test_stripes_of_a_file_are_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.substring(F.md5(F.concat("id", F.lit(str(k))).cast("string")), 1, 12) for k in range(60)]).alias("text"))
    token_files.write_token_files(many, WORD_BPE, path, files=1, stripe_bytes=256 << 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        tokens = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(f"{path}/tokens")
        sizes = tokens.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(sizes) > 3 and sum(r["count"] for r in sizes) == 4000


# --- Fill in the middle --------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_middle_equals_plain_python(docs, texts):
    got = sorted(map(str, map(tuple, fim.fill_in_middle(docs).collect())))
    assert got == sorted(str((i, *middle(i, t))) for i, t in texts)


def test_every_text_under_many_ids(spark):
    rows = [(i, t) for i in range(40) for _, t in ROWS if t and len(t) < 1000]
    got = collections.Counter(map(tuple, fim.fill_in_middle(frame(spark, rows)).collect()))
    assert got == collections.Counter((i, *middle(i, t)) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_of_no_documents(spark):
    assert fim.digests(fim.fill_in_middle(frame(spark, []))).collect() == []


def test_slices_take_whole_rows():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c" * 3, "d" * 4])
    assert list(fim.slices(column, 12)) == [(0, 2), (2, 1), (3, 3)]
    assert list(fim.slices(column.slice(2), 1000)) == [(0, 4)]


# --- Ranked search -------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, top):
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    big_n, big_l = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 50 + (50 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) *
                        ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


ITEMS = [(1, "w1 x5 The quick fox"), (2, words_of(3, 3000)), (3, None), (4, ""), (5, "?! ..."), (1, "z7 Z7 y3 İstanbul"),
         (None, "again under this id"), (6, "unknown_word"), (7, "w0"), (8, words_of(9, 12))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, rank string, before int")


@pytest.mark.parametrize("options", [{}, {"block_docs": 7}, {"pass_terms": 3}, {"top": 3, "block_docs": 50}])
def test_search_equals_plain_python(docs, texts, items, options):
    got = found(lexical.search(docs, items, **options))
    assert got == ranking(texts, ITEMS, options.get("top", 50))


def test_search_in_equal_texts(spark, items):
    rows = [(i, "w0 x1 hot") for i in range(3000)] + [(i, "w0") for i in range(3000, 3100)] + [(5000, "other y2")]
    docs = frame(spark, rows).repartition(5)
    got = found(lexical.search(docs, items, top=20, block_docs=64))
    assert got == ranking(rows, ITEMS, 20)


def test_search_without_rows(spark, docs, items):
    assert lexical.search(frame(spark, []), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(frame(spark, [(1, None), (2, "!!")]), items).collect() == []
    assert lexical.search(docs, items.where("item_id in (3, 4, 5)")).collect() == []


def test_groups_are_evaluated_until_safely_finished():
    """Far fewer documents are scored than hold a term, and the best are all among them."""
    rng = np.random.RandomState(0)
    count, kinds = 20_000, 30
    sizes = rng.randint(1, 12, count)
    at = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(rng.choice(kinds, s, False)) for s in sizes]).astype(np.int32)
    tfs = np.ones(len(terms), np.int32)
    weights = np.sort(rng.randint(1, 9000, kinds))
    block = lexical.Block(sizes.astype(np.int64), at, terms, tfs, weights, count, int(sizes.sum()))
    own = np.arange(0, kinds, 3, dtype=np.int32)
    wanted = np.isin(np.arange(kinds), own)
    docs, scores = block.best(own, wanted, 0, 50)
    every = block.scores(np.arange(count), wanted)
    assert sorted(scores)[-50:] == sorted(every)[-50:] and (every[docs] == scores).all()
    assert len(docs) < count / 5
    docs, again = block.best(own, wanted, int(sorted(every)[-50]), 50)
    assert sorted(again)[-50:] == sorted(every)[-50:]
    assert len(block.best(own, wanted, int(block.most.sum()) + 1, 50)[0]) == 0


def test_long_products_stay_exact():
    n = np.array([1, 10**9, 3 * 10**11], np.int64)
    assert lexical.length_parts(n, 10**10, 10**13).tolist() == [50 + 50 * x * 10**10 // 10**13 for x in n.tolist()]


def test_signs_and_capitals_cost_no_whole_encoding():
    """Words with signs behind a letter or a capital letter up to U+00FF take the ids of their plain form."""
    from tokenizers import Tokenizer

    words = token_files._WordIds(Tokenizer.from_file(WORD_BPE), 1000)
    whole = []
    encode, words.encode = words.encode, lambda text, **options: whole.append(text) or encode(text, **options)
    seen = ["réen***", "Éierchê", "rajaó,", "x7$$$", "ÀÞ.", "a's!!", "it'S)", "a-b--", "e\u00d7?!", "\u00f7.", "ß&&&", "n\u00b0;"]
    for text, wanted in zip(seen, library(WORD_BPE, seen)):
        assert np.frombuffer(words[text.encode()], "<u4").tolist() == wanted[:-1], text
    assert not {"réen***", "Éierchê", "rajaó,", "x7$$$", "ÀÞ."} & set(whole)


def test_random_signs_have_the_same_ids():
    signs, rng = "aAbéÉßÞ7,.*$#-_()[]'s\"`~^@!?/\\|{}<>×÷°µª ", np.random.RandomState(7)
    encode = token_files.encoder(open(WORD_BPE, encoding="utf-8").read())
    texts = ["".join(signs[k] for k in rng.randint(0, len(signs), rng.randint(1, 20))) for _ in range(5000)]
    assert [np.frombuffer(encode(t.encode()), "<u4").tolist() for t in texts] == [x[:-1] for x in library(WORD_BPE, texts)]


def test_a_column_looks_up_each_plain_word_once(monkeypatch):
    """Words of a column that differ in capitals or signs at the end are one look-up, and a task that follows
    in the same process has the tokenizer and its words already."""
    spec, asked = open(WORD_BPE, encoding="utf-8").read(), []
    look_up = token_files._WordIds.__missing__
    monkeypatch.setattr(token_files._WordIds, "__missing__", lambda self, word: asked.append(word) or look_up(self, word))
    token_files.column_encoder.cache_clear()
    texts = ["Réen réen*** RÉEN.", "", " \t", "réen, x<y Réen.", "réen\x0bréen\x1f… É", "\n.\r"]
    for _ in range(2):
        ids, sizes = token_files.column_encoder(spec)(pa.array(texts))
        wanted = [x[:-1] for x in library(WORD_BPE, texts)]
        assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == wanted[0]
        assert ids.tolist() == sum(wanted, []) and sizes.tolist() == [len(x) for x in wanted]
    assert sorted(asked) == sorted({w.encode() for w in ["", "réen", "***", ".", ",", "x<y", "réen\x1f…", "é"]})


@pytest.mark.parametrize("texts", [[""], ["", " "], ["\t\n", ""], ["…"], ["<"], ["."]])
def test_columns_with_hardly_any_words(texts):
    ids, sizes = token_files.column_encoder(open(WORD_BPE, encoding="utf-8").read())(pa.array(texts))
    wanted = [x[:-1] for x in library(WORD_BPE, texts)]
    assert ids.tolist() == sum(wanted, []) and sizes.tolist() == [len(x) for x in wanted]
