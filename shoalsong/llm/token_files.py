"""Token ids in ORC files.

Documents lie in ascending order of their ids over the files and inside them.
The ids of a document are a list of integers, which ORC stores in runs and
deltas of as many bits as they need; a stripe is what one reader takes, so a
file is read by as many tasks as it has stripes. The document ids of files,
stripes and row groups have their smallest and largest value and a Bloom filter
in the metadata, so a look-up opens only the groups that may hold the document.

A document's place among all ids is the place in its file plus the ids of all
files before it, a small table beside the files.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalsong.llm.tables import partitions

END_ID = 1
STRIPE_BYTES, ROW_GROUP, BLOOM_RATE = 32 << 20, 1000, 0.01
#: Distinct words that a task remembers with their ids, and the longest of them in bytes.
KNOWN_WORDS, KNOWN_BYTES = 300_000, 64
#: Bytes of text for a file: at least the first, as long as that makes a file for every shuffle partition, and at most the second.
FILE_BYTES = 16 << 20, 256 << 20
#: Bytes of text that a task encodes and passes on at once, or one text.
TEXT_BYTES = 4 << 20

# Fixed value: a published splitting pattern whose matches hold no white space; the rest of the text is dropped.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_stand_alone(spec: dict) -> bool:
    """Whether the tokenizer gives a text the ids of its white-space separated words, one after the other,
    in lower case."""
    normalizer, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    first, *rest = split.get("pretokenizers", [split])
    own = all(s["type"] in ("NFC", "Lowercase") or
              (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    own = own and any(s["type"] == "Lowercase" for s in steps)
    own = own and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
    return (own and len(rest) == 1 and spec["post_processor"] is None and first.get("type") == "Split"
            and first["pattern"] == {"Regex": WORDS_ONLY} and first["behavior"] == "Removed" and first["invert"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"][0] != "<"
                        or t["content"].split() != [t["content"]] for t in spec["added_tokens"]))


#: Lower-case letters up to U+00FF alone: one piece, which normalisation leaves as it is.
_LETTERS = re.compile(rb"[a-z]*(?:\xc3[\x9f-\xb6\xb8-\xbf][a-z]*)+|[a-z]+")
#: Words that can be lower-cased first: no characters from U+0100 on, of which some combine with
#: a letter before them, and no sign that added tokens may begin with.
_NEAR = re.compile(rb"[^<\xc4-\xff]+")
#: A letter or digit before ASCII signs at the end, which are a piece of their own by the splitting pattern.
#: No apostrophe: it may begin a piece with the letters behind it.
_SIGNED = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))([!-&(-/:;=-@\[-`{-~]+)", re.DOTALL)


def byte_signs() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class _WordIds(dict):
    """The ids of words as bytes; unseen words are encoded and remembered up to a bound.

    Words that differ in capitals up to U+00FF or signs at the end share what is found, and plain letters
    go to the tokenizer's model at once, which saves more than half the time.
    """

    def __init__(self, tokenizer, most: int) -> None:
        self.encode, self.model, self.most = tokenizer.encode, tokenizer.model, most
        self.signs = {i: c for i, c in enumerate(byte_signs())}

    def __missing__(self, word: bytes) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            ids = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        elif _LETTERS.fullmatch(word):
            ids = array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.signs))]).tobytes()
        elif not _NEAR.fullmatch(word):
            ids = self.encoded(word)
        elif (low := word.decode().lower().encode()) != word:
            ids = self[low]
        elif parts := _SIGNED.fullmatch(word):
            ids = self[parts[1]] + self[parts[2]]
        else:
            ids = self.encoded(word)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def encoded(self, word: bytes) -> bytes:
        return array("I", self.encode(word.decode(), add_special_tokens=False).ids).tobytes()


#: `_NEAR` and `_SIGNED` for columns of words: the rest, the signs, and what may stand before them.
_FAR_TEXT, _SIGNS_TEXT = "[<\u0100-\U0010ffff]", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_PLAIN_TEXT = "[a-z0-9\u00df-\u00f6\u00f8-\u00ff]$"


def _parts(words: pa.Array) -> pa.Array:
    """Two parts of each word that `_WordIds` takes one after the other: the plain form and the signs at the end."""
    near = pc.invert(pc.match_substring_regex(words, _FAR_TEXT))
    low = pc.if_else(near, pc.utf8_lower(words), words)
    plain = pc.ascii_rtrim(low, characters=_SIGNS_TEXT)
    plain = pc.if_else(pc.and_(near, pc.match_substring_regex(plain, _PLAIN_TEXT)), plain, low)
    _, offsets, data = low.buffers()
    bounds = np.zeros(2 * len(low) + 1, np.int32)  # no text is copied: a part ends where the next begins
    bounds[::2] = np.frombuffer(offsets, np.int32, len(low) + 1, 4 * low.offset)
    bounds[1::2] = bounds[:-1:2] + pc.binary_length(plain).to_numpy()
    return pa.StringArray.from_buffers(2 * len(low), pa.py_buffer(bounds), data)


def _gathered(values, sizes, which):
    """The values of runs of `sizes`, one run behind the other, in the order `which`."""
    n = sizes[which]
    starts = (np.cumsum(sizes) - sizes)[which]
    return values[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _word_encoder(known: _WordIds):
    """A function from a column of texts to (ids of all, ids per text).

    Each distinct word of the column is taken apart once, and only distinct plain words and signs are looked up.
    """
    def encode(texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)  # at space and \t to \r only
        words = split.flatten().dictionary_encode()
        parts = _parts(words.dictionary).dictionary_encode()
        found = [known[w] for w in parts.dictionary.cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pairs = parts.indices.to_numpy().reshape(-1, 2)
        ids = _gathered(np.frombuffer(b"".join(found), "<i4"), sizes, pairs.ravel())
        sizes, places = sizes[pairs].sum(axis=1), words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[places])])[split.offsets.to_numpy()]
        return _gathered(ids, sizes, places), np.diff(ends)

    return encode


@functools.lru_cache(1)
def column_encoder(text: str, most: int = KNOWN_WORDS):
    """A function from a column of texts without nulls to (the library's ids of all, ids per text). The last one
    stays in its process, so tasks that follow in a Python worker need not read the tokenizer again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if words_stand_alone(json.loads(text)):
        return _word_encoder(_WordIds(tokenizer, most))

    def encode(texts: pa.Array):
        found = [np.array(tokenizer.encode(t.as_py(), add_special_tokens=False).ids, "<i4") for t in texts]
        return np.concatenate([np.zeros(0, "<i4"), *found]), np.array([len(x) for x in found], np.int64)

    return encode


def encoder(text: str, most: int = KNOWN_WORDS):
    """A function from text to the library's ids as little-endian unsigned 32-bit integers."""
    encode = column_encoder(text, most)
    return lambda data: encode(pa.array([data.decode()], pa.string()))[0].tobytes()


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, files: int | None = None,
                      stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP) -> None:
    """Encode every row of `docs` (doc_id, text, ...) and write `path`/tokens and `path`/parts.

    Null and empty texts have the end id alone. Null ids come first; rows of
    equal id follow each other as they do in the input. Other columns are
    ignored, whatever their names. An empty table gives tables without rows.
    Rows are dealt by ranges of (id, place in the input), so no id is too
    frequent for a file; there are `files` of them, by the bytes of all texts if
    not given. A retried task writes the same rows again.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)["doc_id"]
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
        files = max(-(-size // FILE_BYTES[1]), min(-(-size // FILE_BYTES[0]), partitions(spark)))
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    dealt = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        encode, before = column_encoder(shared.value), 0
        for batch in batches:
            texts, at = pc.fill_null(batch.column("text"), "").cast(pa.string()), 0
            length = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            while at < batch.num_rows:
                first, passed = at, length[at - 1] if at else 0
                at = max(at + 1, int(np.searchsorted(length, passed + TEXT_BYTES, "right")))
                ids, sizes = encode(texts.slice(first, at - first))
                sizes += 1
                ends = np.cumsum(sizes)
                values, own = np.full(ends[-1], end_id, "<i4"), np.ones(ends[-1], bool)
                own[ends - 1] = False
                values[own] = ids
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(before + ends - sizes), pa.array(sizes), lists],
                    ["doc_id", "part", "start", "n_tokens", "ids"])
                before += int(ends[-1])

    tokens = dealt.mapInArrow(run, f"doc_id {kind}, part int, start bigint, n_tokens bigint, ids array<int>")
    (tokens.write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", row_group).option("orc.rows.between.memory.checks", 100)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_RATE).orc(f"{path}/tokens"))
    # One row per file: a window over all of them is as small as the list of files.
    written = spark.read.schema(tokens.schema).orc(f"{path}/tokens")
    sums = written.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    parts.coalesce(1).write.orc(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, doc_ids: list | None = None, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files; start counts the ids of all documents before.

    With `doc_ids`, only documents of these ids; the condition reaches the
    files, where metadata tells which stripes and row groups may hold them.
    """
    schema = f"doc_id {kind}, part int, start bigint, n_tokens bigint, ids array<int>"
    tokens = spark.read.schema(schema).orc(f"{path}/tokens")
    if doc_ids is not None:
        tokens = tokens.where(F.col("doc_id").isin(doc_ids))
    parts = spark.read.schema("part int, n_docs bigint, n_tokens bigint, before bigint").orc(f"{path}/parts")
    # A row per file written, so the broadcast is bounded by the number of files.
    placed = tokens.join(F.broadcast(parts.select("part", "before")), "part")
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned crc32 of the ids as little-endian 32-bit integers."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
