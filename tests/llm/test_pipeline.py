"""The pipeline's stages, each on all that its predecessor kept, against the plain definitions."""

import collections
import hashlib

import numpy as np
import pytest
from conftest import SMALL
from test_text_operators import WORD, base_rules, linked, shingles, water

import corpus_pipeline
from shoalsong.llm import toxicity
from shoalsong.llm.tables import load, staged


@pytest.fixture(scope="module")
def tables(spark):
    """The documents, and what each stage makes of them."""
    docs = load(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SMALL), name.replace(" ", "-")))
    return out


def rows(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "mixture", "tokens"]


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert tables[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxic_documents_go(spark, tables):
    import pyarrow as pa

    model = toxicity.fit(tables[0], load(spark, SMALL, "labels"))
    docs = rows(tables[0])
    margins = toxicity.margins(pa.array([t for _, t in docs]), *model)
    assert sorted(rows(tables[1])) == sorted(d for d, m in zip(docs, margins) if m < 0)


def test_poor_documents_go(tables):
    # No line of these small tables is in more than 20 texts of a host, so the base rules decide.
    assert sorted(rows(tables[2])) == sorted(d for d in rows(tables[1]) if not base_rules(d[1])[-1])


def test_one_of_each_group_stays(tables):
    docs = rows(tables[2])
    groups = linked([shingles(t, 5) for _, t in docs], 80)
    first = {}
    for (i, _), g in zip(docs, groups):
        first[g] = min(first.get(g, i), i)
    assert sorted(i for i, _ in rows(tables[3])) == sorted(first.values())


def test_mixture_keeps_to_the_targets(tables):
    kept = tables[3].select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in kept}
    total, longest = collections.Counter(), collections.Counter()
    for r in kept:
        total[r.source] += size[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    order = sorted(total)
    targets = dict(zip(order, water([total[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    taken, copies = collections.Counter(), collections.Counter()
    for r in tables[4].collect():
        taken[r.source] += size[r.doc_id]
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in order)


def test_tokens(tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = collections.Counter()
    for i, text in rows(tables[4]):
        ids = library.encode(text, add_special_tokens=False).ids
        wanted[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in tables[5].collect()) == wanted


def test_nulls_and_an_empty_table(spark):
    docs = load(spark, SMALL, "documents")
    none = docs.limit(0)
    odd = docs.limit(60).selectExpr("if(doc_id % 7 = 0, null, doc_id) as doc_id", "if(doc_id % 5 = 0, null, text) as text",
                                    "cast(null as string) as lang", "if(doc_id % 3 = 0, null, source) as source", "n_chars")
    for table in (none, odd.union(odd.limit(20))):
        for name, stage in corpus_pipeline.STAGES:
            table = staged(stage(spark, table, SMALL), name.replace(" ", "-"))
        assert table.columns[0] == "doc_id"


def test_run_is_the_chain_of_stages(spark, tables):
    assert corpus_pipeline.run(spark, SMALL).count() == tables[-1].count()
