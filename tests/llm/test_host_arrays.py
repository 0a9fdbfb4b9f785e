"""Boilerplate of pages that mark no article, against brute force, in one array a host and in many."""

import numpy as np
import pytest

from shoalsong.llm import extract

COLUMNS = "page_id bigint, url string, html string"


def generated(seed: int):
    """Pages of three hosts: menus, notices inside of own text, copies with their words in another order."""
    rng = np.random.RandomState(seed)
    menus = [[" ".join(f"m{h}x{k}x{i}" for i in range(rng.randint(5, 30))) for k in range(4)] for h in range(3)]
    rows = []
    for i in range(90):
        h = int(rng.randint(3))
        own = [" ".join(f"o{i}y{k}z{w}" for w in range(rng.randint(1, 25))) for k in range(rng.randint(1, 4))]
        parts = [menus[h][k] for k in range(4) if rng.rand() < (0.9, 0.5, 0.1, 0.04)[k]]
        joined = [f"{own[0]} {parts[0]} {own[-1]} tail{i}"] if parts and rng.rand() < 0.3 else []
        page = "".join(f"<div>{x}</div>" for x in parts + own + joined)
        rows.append((i, f"http://h{h}/{i}", page))
        if rng.rand() < 0.2:
            rows += [(1000 + 10 * i + c, f"http://h{h}/c", page if c % 2 else page + f"<div>{own[0]}</div>")
                     for c in range(4)]
    rows += [(5000 + i, "http://h0/a", f"<article>own {i} {menus[0][0]}</article><div>{menus[0][0]}</div>") for i in range(3)]
    return [*rows, (6000, None, None), (6001, "http://h1/e", ""), rows[0]]


def brute_force(rows):
    parsed = [(i, (url or "").split("/")[2] if url else "", extract.blocks(page or "")) for i, url, page in rows]
    places: dict = {}
    for _, host, page in parsed:
        text = [w.lower() for b in page for w in b[1].split(" ")]
        key = frozenset(text)
        for i in range(len(text) - 7):
            places.setdefault((host, *text[i : i + 8]), set()).add(key)
    out = []
    for number, host, page in parsed:
        text = [(w, k) for k, b in enumerate(page) for w in b[1].split(" ")]
        gone = set()
        for i in range(len(text) - 7):
            if len(places[(host, *[w.lower() for w, _ in text[i : i + 8]])]) >= 3:
                gone.update(range(i, i + 8))
        lines = []
        for k, b in enumerate(page):
            left = [w for i, (w, owner) in enumerate(text) if owner == k and i not in gone]
            if b[0] == extract.MAIN:
                lines.append(b[1])
            elif b[0] == extract.OPEN and left:
                lines.append(" ".join(left))
        out.append((number, "\n".join(lines)))
    return sorted(out)


@pytest.mark.parametrize("array_chars", [1 << 20, 4000, 700])
def test_texts_equal_brute_force(spark, array_chars):
    rows = generated(3)
    found = extract.main_texts(spark.createDataFrame(rows, COLUMNS), array_chars=array_chars).collect()
    wanted = brute_force(rows)
    assert sorted((r.page_id, r.text) for r in found) == wanted
    assert sum(text != "\n".join(b[1] for b in extract.blocks(page or "")) for (_, text), (_, _, page)
               in zip(wanted, sorted(rows, key=lambda r: r[0]))) > 40


@pytest.mark.parametrize("array_chars", [1 << 20, 600])
def test_unique_words_stay_whatever_their_share(spark, array_chars):
    shared = " ".join(f"s{k}" for k in range(48))
    menu = " ".join(f"m{k}" for k in range(200))
    rows = [(i, "http://a/", f"<div>own {i}a b{i} {shared} c{i} end{i}</div>") for i in range(4)]
    rows += [(10 + i, "http://b/", f"<div>{menu}</div><p>{' '.join(f'o{i}x{k}' for k in range(15))}</p>") for i in range(4)]
    rows += [(20, "http://c/", "<p>text</p><p><a href=x>one link that stands alone in a line</a></p><p>more</p>"),
             (21, "http://c/", "<ul><li><a href=x>Home</a><li><a href=x>News</a></ul><p>text of this page</p>")]
    found = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, COLUMNS), array_chars=array_chars).collect()}
    assert found[1] == "own 1a b1 c1 end1"
    assert found[12] == " ".join(f"o2x{k}" for k in range(15))
    assert found[20] == "text\none link that stands alone in a line\nmore"
    assert found[21] == "text of this page"


def test_many_copies_count_as_one_page_over_all_arrays(spark):
    own = " ".join(f"w{k}" for k in range(30))
    rows = [(i, "http://a/", f"<div>{own} page</div>{' ' * i}") for i in range(60)]
    found = extract.main_texts(spark.createDataFrame(rows, COLUMNS), array_chars=500).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(i, f"{own} page") for i in range(60)]
