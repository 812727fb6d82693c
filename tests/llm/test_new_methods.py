"""Tokenizer alignment, page extraction and filter interactions against plain versions."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest

from loreweave.llm import alignment, interaction, sitestyle

SF_DIR = "/root/testdata/sf0.001"


def aligned_by_brute_force(rows):
    """Every column of the alignment query, by sets of ends and plain counters."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.FILE_A}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.FILE_B}")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p, q = [of_a(t) for t in x], [of_b(t) for t in y]
        raw = (" " + text).encode() if text else b""
        if b"".join(p) != raw or b"".join(q) != raw:
            x, y, p, q = [], [], [], []
        ends_p, ends_q = np.cumsum([len(t) for t in p]).tolist(), np.cumsum([len(t) for t in q]).tolist()
        groups, links, s, t = [], [], 0, 0
        for e in sorted(set(ends_p) & set(ends_q)):
            m, n = ends_p.index(e, s) + 1, ends_q.index(e, t) + 1
            groups.append(",".join(map(str, x[s:m])) + "|" + ",".join(map(str, y[t:n])))
            links.append((x[m - 1], y[n - 1]))
            s, t = m, n
        found.append((i, len(x), len(y), ";".join(groups), links))
    count = Counter(pair for row in found for pair in row[4])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return sorted(
        (i, n, m, len(links), len(links), sum(count[z] == top[z[1]] for z in links), sum(count[z] for z in links), hashlib.sha256(g.encode()).hexdigest() if n else "")
        for i, n, m, g, links in found
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_brute_force(spark):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.op11(spark, SF_DIR).select(*COLUMNS).collect())
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got == aligned_by_brute_force([(r["doc_id"], r["text"]) for r in rows])


def test_alignment_of_odd_texts(spark, tmp_path):
    """Special tokens and byte pieces as plain text, runs of blanks, signs of many scripts,
    a text that the pieces do not give back, and a long one without blanks."""
    texts = [
        None, "", " ", "  two  blanks ", "<|endoftext|> and </s><0x41>", "a\nb\tc\r\n", "naïve café ﬁn ½", "日本語とかな 한국어", "🙂👩‍👩‍👧 emoji", "▁ low", "it's we'll I'M",
        "x" * 30_000, "​﻿zero width", "1234567 89", "Ωmega ſtraße",
    ]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.op11(spark, str(tmp_path)).select(*COLUMNS).collect())
    assert got == aligned_by_brute_force(rows)


@pytest.mark.parametrize("n, m", [(0, 0), (0, 5), (1, 400), (400, 1), (300, 280), (50, 50)])
def test_gallop_intersects(n, m):
    rng = np.random.default_rng(n + m)
    lists = [(np.unique(rng.integers(0, 500, n)), np.unique(rng.integers(0, 500, m))) for _ in range(7)]
    at_a, at_b = (np.append(0, np.cumsum([len(x[k]) for x in lists])) for k in (0, 1))
    ends_a, ends_b = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
    got = alignment.intersect(ends_a, ends_b, at_a, at_b)
    want = [(at_a[t] + i, at_b[t] + j) for t, (x, y) in enumerate(lists) for i, e in enumerate(x) for j, f in enumerate(y) if e == f]
    assert list(zip(got.a, got.b)) == want


def page(k):
    return (
        f"<html><head><title>t{k}</title></head><body><div class='greeting'>Welcome to this place</div>"
        f"<div class='story'><p>First  of\n page {'abcdefgh'[k] * 9} &amp; more.</p><p>Then {'ijklmnop'[k] * 7}</p></div>"
        f"<div class='makers'>Made by someone in {2000 + k}</div><script>var x = '<p>no</p>';</script></body></html>"
    )


def test_pages_lose_what_their_host_repeats(spark):
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(6, "http://b.example/", page(6)), (7, None, page(7)), (8, "http://a.example/8", None), (9, None, None), (2, "http://a.example/2", page(2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in sitestyle.extract(pages).collect())
    article = lambda k: f"First of page {'abcdefgh'[k] * 9} & more.\nThen {'ijklmnop'[k] * 7}"
    whole = lambda k: f"Welcome to this place\n{article(k)}\nMade by someone in {2000 + k}"
    assert got == sorted([*((k, article(k)) for k in (0, 1, 2, 2, 3, 4, 5)), (6, whole(6)), (7, whole(7)), (8, ""), (9, "")])


def test_importances_are_entropies(spark):
    rows = [(f"http://a.example/{k}", page(k)) for k in range(4)]
    tree = sitestyle.importances(sitestyle.parsed(spark.createDataFrame(rows, "url string, html string"))).collect()
    # Two paragraphs a page are one node with eight texts; the repeated boxes have one text each.
    assert sorted((r["pages"], round(r["content"], 9), round(r["presentation"], 9)) for r in tree) == [(4, 0.0, 0.0), (4, 0.0, 0.0), (4, 1.0, 0.0)]
    low = {round(r["importance"], 9) for r in tree}
    assert low == {0.0, round(sitestyle.GAMMA, 9)}


def test_markup_that_names_its_purpose(spark):
    html = (
        "<body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><article><h1>Head&eacute;</h1><p>One<p>Two <b>bold</b>"
        "<aside>Advert</aside><div class='share-buttons'>Share</div></article><div id='comments'><p>I say</p></div><footer>End</footer>"
    )
    (row,) = sitestyle.extract(spark.createDataFrame([("http://c/", html, "kept")], "url string, html string, extra string")).collect()
    assert (row["text"], row["extra"]) == ("Headé\nOne\nTwo bold", "kept")


def test_audit_counts_every_order(spark):
    """Steps and Shapley values by walking documents through all orders."""
    rng = np.random.default_rng(3)
    rows = [(p, int(m), int(n), int(n) // 2, int(n) // 3) for p in ("", "a") for m, n in zip(range(8), rng.integers(0, 9, 8)) if n]
    counts = spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in interaction.audit(counts, "ABC").collect()}
    assert len(got) == 2 * 6 * 3
    for part in ("", "a"):
        total = Counter()
        for order in permutations("ABC"):
            left = {m: (n, g, t) for p, m, n, g, t in rows if p == part}
            for step, f in enumerate(order, 1):
                bit = 1 << "ABC".index(f)
                gone = {m: left.pop(m) for m in list(left) if m & bit}
                r = got[part, "".join(order), step]
                sums = [sum(x[k] for x in gone.values()) for k in range(3)]
                assert (r["removed"], r["good_lost"], r["toxic_lost"]) == tuple(sums)
                assert r["kept"] == sum(x[0] for x in left.values())
                total[f] += sums[0]
                fails = sum(n for p, m, n, *_ in rows if p == part and m & bit)
                assert r["redundant"] == fails - sums[0]
                assert r["unique_fails"] == sum(n for p, m, n, *_ in rows if p == part and m == bit)
        for (p, order, step), r in got.items():
            if p == part:
                assert r["shapley"] == total[order[step - 1]]
    assert math.factorial(3) * sum(n for p, m, n, *_ in rows if p == "a" and m) == sum(r["shapley"] for (p, o, _), r in got.items() if p == "a" and o == "ABC")
