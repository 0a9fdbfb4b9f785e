"""Byte-level BPE by a distinct-word table.

Spark splits the texts into words (pre-tokens) and counts them; each word that
occurs twice or more is encoded once, in its table row. Ids then go back to the
places of the words where the texts are, so no text is shuffled:

* The most frequent words, bounded in number and bytes (HOT_WORDS, HOT_BYTES),
  are broadcast and joined within the rows: some 99 of 100 places.
* Words outside of that part are encoded in the task that holds them, each once
  for a batch of rows.

Decoding joins ids with pieces; pieces are bounded by the vocabulary and so
broadcast. Ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalsong.llm import words
from shoalsong.llm.tables import staged

#: Bounds of the broadcast part of the table: words, bytes of words and ids, bytes of one word.
HOT_WORDS, HOT_BYTES, HOT_WORD_BYTES = 2_000_000, 64 << 20, 256
#: Words of a text that travel to a task as one row, so that a batch of rows stays small; texts finished at once;
#: words that the library encodes at once.
CHUNK, SLICE, PART = 128, 256, 4096

# Fixed value: the published splitting pattern of byte-level BPE, white space by its Unicode property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
           r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+")


class Vocabulary:
    """What a tokenizer file says, checked for the features this module has."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        spec = json.loads(self.text)
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or not plain:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with lstrip, rstrip or single_word are not supported")
        # Tokens spell bytes as printable characters: printable ones as themselves, others from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        ids = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        ids |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [ids.get(i, b"") for i in range(max(ids) + 1)]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


def pre_tokens(text: Column, special: list[str] = ()) -> Column:
    """The words of a text; special tokens are words of their own. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def split(part):
        return F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))

    if not special:
        return split(text)
    any_special = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in special)
    found = F.regexp_extract_all(text, F.lit(any_special), F.lit(0))
    parts = F.split(text, any_special, -1)
    mixed = F.flatten(F.zip_with(parts, found, lambda p, s: F.concat(
        split(p), F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.array(s)))))
    has = text.contains(special[0])
    for s in special[1:]:
        has = has | text.contains(s)
    return F.when(has, mixed).otherwise(split(text))


def in_chunks(split: DataFrame, column: str) -> DataFrame:
    """Rows (..., chunk, `column`) with at most CHUNK words each; a text without words is one row."""
    last = F.greatest(F.ceil(F.size(column) / CHUNK) - 1, F.lit(0)).cast("int")
    numbered = split.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    # Outside of a lambda, so that a slice costs its own length and not that of the text.
    return numbered.withColumn(column, F.slice(column, F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))


@functools.lru_cache(1)
def library(text: str):
    """The tokenizers library's encoder of words as arrays of ids, one per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(found: list[str]) -> list[np.ndarray]:
        parts = (found[i : i + PART] for i in range(0, len(found), PART))
        return [np.array(x.ids, "<u4") for part in parts for x in tokenizer.encode_batch(part, add_special_tokens=False)]

    return encode


def word_table(split: DataFrame, shared) -> DataFrame:
    """(word, n, ids) of each value of `split` (word) that occurs twice or more; ids is binary.

    A word that occurs once has one place, where it is encoded, so the table spares nothing by it.
    `shared` is the broadcast text of the vocabulary.
    """
    counted = split.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(batches):
        encode = library(shared.value)
        for batch in batches:
            ids = pa.array([x.tobytes() for x in encode(batch.column("word").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["word", "n", "ids"])

    return counted.mapInArrow(run, "word string, n bigint, ids binary")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data or b"", np.uint8)


def _hashes(strings: pa.Array, hasher: words.Hasher, size: int = 1 << 14) -> np.ndarray:
    """Of whole strings, some thousands at a time: the hasher needs 40 bytes for each byte."""
    out = [np.empty(0, np.uint64)]
    for i in range(0, len(strings), size):
        at, data = _bytes(strings.slice(i, size))
        out.append(hasher(at[:-1] - at[0], at[1:] - at[0], data[at[0] : at[-1]]))
    return np.concatenate(out)


def hot_part(table: pa.Table) -> tuple:
    """The broadcast part of the table (word, n, ids): words by rank, most frequent first, sorted hashes and their ranks,
    and of each rank the number of its ids, where they begin, and all ids. Rank 0 is the unknown word."""
    order = np.lexsort((np.arange(table.num_rows), -table.column("n").to_numpy()))
    table = table.select(["word", "ids"]).take(pa.array(order))
    known = pa.concat_arrays([pa.array([""]), *(c.cast(pa.string()) for c in table.column("word").chunks)])
    sizes, parts = [np.zeros(1, np.int64)], [np.empty(0, np.uint8)]
    for chunk in table.column("ids").chunks:
        at, data = _bytes(chunk)
        sizes.append(np.diff(at) // 4)
        parts.append(data[at[0] : at[-1]])
    size, flat = np.concatenate(sizes), np.concatenate(parts).view("<u4")
    hashes = _hashes(known, words.Hasher())[1:]
    ranks = np.argsort(hashes, kind="stable")
    begin = (np.cumsum(size) - size).astype(np.uint32)
    return known, hashes[ranks], (ranks + 1).astype(np.int32), size.astype(np.uint16), begin, flat


def rank_words(hot: tuple, distinct: pa.Array, hasher: words.Hasher) -> np.ndarray:
    """The rank of each word, 0 if it isn't in the broadcast part."""
    known, hashes, ranks = hot[:3]
    if not len(distinct) or not len(hashes):
        return np.zeros(len(distinct), np.int32)
    own = _hashes(distinct, hasher)
    found = ranks[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)]
    same = pc.equal(known.take(pa.array(found)), distinct).to_numpy(zero_copy_only=False)
    return np.where(same, found, 0)


def _gather(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `flat` with these beginnings and sizes, one after the other."""
    return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def word_ids(hot: tuple, strings: pa.Array, hasher: words.Hasher, encode) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words in order, and the number of each word's ids. `encode` gives those of words that
    aren't in the broadcast part."""
    coded = strings.dictionary_encode()
    distinct, places = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    *_, size, begin, flat = hot
    ranks = rank_words(hot, distinct, hasher)
    sizes, missing = size[ranks].astype(np.int64), np.flatnonzero(ranks == 0)
    own = _gather(flat, begin[ranks].astype(np.int64), sizes)
    begins = np.cumsum(sizes) - sizes
    if len(missing):
        found = encode(distinct.take(pa.array(missing)).to_pylist())
        sizes[missing] = [len(x) for x in found]
        begins[missing] = len(own) + np.cumsum(sizes[missing]) - sizes[missing]
        own = np.concatenate([own, *found])
    return _gather(own, begins[places], sizes[places]), sizes[places]


# A rank is one byte below ONE; else its first byte is ONE to 223 and one more follows, or 224 to 255 and two.
ONE, TWO = 160, 160 + 64 * 256


def pack(ranks: np.ndarray) -> bytes:
    """All first bytes, then all second and all third ones."""
    two, three = ranks - ONE, ranks - TWO
    first = np.where(ranks < ONE, ranks, np.where(ranks < TWO, ONE + (two >> 8), 224 + (three >> 16)))
    second = np.where(ranks < TWO, two & 255, (three >> 8) & 255)[ranks >= ONE]
    return np.concatenate([first, second, (three & 255)[ranks >= TWO]]).astype(np.uint8).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(data, np.uint8).astype(np.int32)
    first = data[:n]
    more, most = first >= ONE, first >= 224
    out = first.copy()
    second = np.zeros(n, np.int32)
    second[more] = data[n : n + more.sum()]
    out[more] = ONE + ((first[more] - ONE) << 8) + second[more]
    out[most] = TWO + ((first[most] - 224) << 16) + (second[most] << 8) + data[n + more.sum() :]
    return out


def _hot_level(table: DataFrame, most: int, size: int) -> Column:
    """A condition on `table`: the words of the highest counts that keep to the bounds."""
    level = F.floor(F.log2("n") * 8)
    short = F.octet_length("word") <= HOT_WORD_BYTES
    # One row per level, so at most some hundreds.
    levels = table.where(short).groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word") + F.octet_length("ids")).alias("bytes"))
    cut, total_words, total_bytes = None, 0, 0
    for row in sorted(levels.collect(), key=lambda r: -r["level"]):
        total_words, total_bytes = total_words + row["words"], total_bytes + row["bytes"]
        if total_words > most or total_bytes > size:
            break
        cut = row["level"]
    return F.lit(False) if cut is None else short & (level >= cut)


def _lists(column) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and where its rows begin and end in them."""
    at = column.offsets.to_numpy()
    return column.values.slice(at[0], at[-1] - at[0]), at - at[0]


def text_of(ids: bytes, pieces: list[bytes]) -> str:
    """The pieces of the ids joined; ids outside the vocabulary give nothing."""
    found = np.frombuffer(ids, "<u4")
    found = found[found < len(pieces)] if len(found) and found.max() >= len(pieces) else found
    return b"".join([pieces[k] for k in found.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, hot_words: int = HOT_WORDS, hot_bytes: int = HOT_BYTES,
           decoded: bool = False) -> DataFrame:
    """(doc_id, ids) per row of `docs` (doc_id, text), as the tokenizers library encodes
    without adding special tokens; their strings in a text are still recognised.

    Null and empty texts have no ids. Repeated rows, null ids and equal texts
    are rows like any other; other columns are ignored. Texts are taken whole.
    With `decoded`, `text` is what `decode` makes of the ids, joined in the same step.
    """
    spark = docs.sparkSession
    pieces = pre_tokens(F.col("text"), vocabulary.special)
    shared = spark.sparkContext.broadcast(vocabulary.text)
    table = staged(word_table(docs.select(F.explode(pieces).alias("word")), shared), "words")
    hot = spark.sparkContext.broadcast(hot_part(table.where(_hot_level(table, hot_words, hot_bytes)).toArrow()))
    pieces_of = spark.sparkContext.broadcast(vocabulary.pieces if decoded else [])
    doc_type = dict(docs.dtypes)["doc_id"]

    def texts(batches):
        # The chunks of a text follow each other; a text may go on in the next batch.
        hasher, encode_words, held, open_id = words.Hasher(), library(shared.value), None, None
        for batch in batches:
            values, at = _lists(batch.column("words"))
            ids, sizes = word_ids(hot.value, values, hasher, encode_words)
            at = np.concatenate([[0], np.cumsum(sizes)])[at]
            doc_ids = batch.column("doc_id")
            ends = [*np.flatnonzero(batch.column("chunk").to_numpy() == 0).tolist(), batch.num_rows]
            if held is not None:
                held.append(ids[: at[ends[0]]].tobytes())
            for i, j in zip(ends, ends[1:]):
                if held is not None:
                    yield open_id, b"".join(held)
                open_id, held = doc_ids[i], [ids[at[i] : at[j]].tobytes()]
        if held is not None:
            yield open_id, b"".join(held)

    def run(batches):
        found = texts(batches)
        while done := list(itertools.islice(found, SLICE)):
            doc_ids, ids = zip(*done)
            columns = {"doc_id": pa.array([x.as_py() for x in doc_ids], doc_ids[0].type), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["text"] = pa.array([text_of(x, pieces_of.value) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    split = in_chunks(docs.select("doc_id", pieces.alias("words")), "words")
    return split.mapInArrow(run, f"doc_id {doc_type}, ids binary" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded` with `text`, the pieces of the ids joined; bytes that are not UTF-8 become U+FFFD.

    Null ids give a null text, ids outside the vocabulary nothing, as in the library.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces)
    encoded = encoded.drop("text")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                texts = [None if x is None else text_of(x, shared.value) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
