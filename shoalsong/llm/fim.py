"""Fill-in-the-middle: documents cut in three at random units and put in another order.

All of it is pyarrow.compute on whole batches: texts become lists of units, the
lists are flattened with the row each unit comes from, a unit's ordinal in its
row tells its role, and the units of one role are made lists and joined again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a unit is, the marks, and the seed's text before the id.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80

#: Ends a unit inside a batch; no byte of UTF-8 text.
END = b"\xff"
#: Bytes of text that are cut at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def units_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """All units of the texts (binary), the row of each, and how many each row has."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=UNIT, replacement=b"\\1" + END)
    lists = pc.split_pattern(marked, END)
    units, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(units), 0)  # what follows the last mark is empty
    units, rows = units.filter(real), rows.filter(real)
    return units, rows, np.bincount(rows.to_numpy(), minlength=len(texts)).astype(np.int64)


def joined(units: pa.Array, rows: np.ndarray, chosen: np.ndarray, count: int) -> pa.Array:
    """The chosen units of each row, joined."""
    ends = np.cumsum(np.bincount(rows[chosen], minlength=count))
    lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), units.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar(b"", units.type)).cast(pa.large_string())


def transform(texts: pa.Array, hashes: list[np.ndarray], rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts, by the four hashes of their ids."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    units, parents, n = units_of(texts)
    rows = parents.to_numpy()
    ordinal = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
    a, b = hashes[0] % (n + 1), hashes[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    roles = [ordinal < low[rows], (ordinal >= low[rows]) & (ordinal < high[rows]), ordinal >= high[rows]]
    prefix, middle, suffix = (joined(units, rows, role, len(texts)) for role in roles)
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(texts), 0)), pa.array(hashes[2] % 100 >= rate))
    spm = pa.array(hashes[3] % 100 < spm_rate)

    def chain(*parts):
        return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts],
                                           pa.scalar("", pa.large_string()))

    output = pc.if_else(plain, texts, pc.if_else(
        spm, chain(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), chain(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    none = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(n), "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())), "output": output}


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that were transformed, from outputs and forms alone."""
    output = output.cast(pa.large_string())
    spm, plain = pc.equal(form, "spm"), pc.equal(form, "plain")
    first = pc.utf8_slice_codeunits(output, len(PREFIX))
    second_mark = pc.if_else(spm, PREFIX, SUFFIX)
    parts = []
    for mark in (PREFIX, SUFFIX):  # a piece holds no mark, so the first match of the mark between pieces is the right one
        cut = pc.split_pattern(first, mark, max_splits=1)
        rest = pc.list_element(pc.if_else(pc.equal(pc.list_value_length(cut), 2), cut, pa.scalar(["", ""], cut.type)), 1)
        head = pc.list_element(cut, 0)
        tail = pc.split_pattern(rest, MIDDLE, max_splits=1)
        last = pc.list_element(pc.if_else(pc.equal(pc.list_value_length(tail), 2), tail, pa.scalar(["", ""], tail.type)), 1)
        between = pc.list_element(tail, 0)
        before, after = (between, head) if mark == PREFIX else (head, between)
        whole = pc.binary_join_element_wise(before, last, after, pa.scalar("", pa.large_string()))
        parts.append(pc.if_else(pc.equal(second_mark, mark), whole, pa.scalar("", pa.large_string())))
    return pc.if_else(plain, output, pc.if_else(spm, parts[0], parts[1]))


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, count) of rows that follow each other and hold about `limit` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(column):
        held = ends[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(ends, held + limit, "right")))
        yield at, last - at
        at = last


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) per row of `docs` (doc_id, text, ...).

    Units are a word with the white space before it, or the white space at the
    end. The cuts and the form follow from the sha256 of seed and doc_id, so
    reruns and copies of a row agree. `rate` of 100 texts are transformed, and
    `spm_rate` of 100 of those begin with the suffix. Texts that are empty or
    null, or hold a mark themselves, stay plain. A null doc_id counts as an
    empty id. Other columns are ignored, whatever their names; an empty table
    gives an empty result; texts are taken whole.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", "text", digest.alias("digest"))
    hashes = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]
    rows = rows.select("doc_id", "text", *hashes)

    def run(batches):
        for batch in batches:
            for at, count in slices(batch.column("text")):
                part = batch.slice(at, count)
                out = transform(part.column("text"), [part.column(f"h{i}").to_numpy() for i in range(4)], rate, spm_rate)
                out["restored"] = restore(out["output"], out["form"])
                for name in ("form", "output", "restored"):
                    out[name] = out[name].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out.values()], ["doc_id", *out])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                "output string, restored string")


def digests(transformed: DataFrame) -> DataFrame:
    """The result with the digests of output and restored text in their place."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


_UNITS = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, {_UNITS} AS units, {', '.join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                    OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
