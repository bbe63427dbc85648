"""The first ten operators and the pipeline against brute force on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from barloom.llm import byte_bpe, html_text, language, licenses, near_duplicates, neighbours, packing, quality, queries, simple8b, winnowing  # noqa: E402

ODD = [(1, None), (2, ""), (3, " "), (4, "mit  LICENSE and GNU\nGeneral Public-License"), (5, "a b c"), (5, "a b c"), (6, "naïve Ünïcode 漢字かな 😀 \x1c x　y"), (7, "word " * 30000), (8, "."), (None, "no id here at all"), (9, "<|endoftext|> don't"), (10, "Σίσυφος ΑΣ İ")]
SCHEMA = "doc_id long, text string"


def write(spark, tmp_path, rows=ODD, name="documents", schema=SCHEMA):
    spark.createDataFrame(rows, schema).selectExpr("*", "'x' as n_tokens", "'y' as score").write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows_of(spark, sf_dir, columns="doc_id, text"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*columns.split(", ")).collect()]


@pytest.fixture(params=["odd", "real", "empty"])
def folder(request, spark, tmp_path, sf_dir):
    return sf_dir if request.param == "real" else write(spark, tmp_path, ODD if request.param == "odd" else [])


def test_byte_bpe(spark, folder):
    import tiktoken

    with open(queries.BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in rows_of(spark, folder):
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    got = [tuple(r) for r in queries.op1_byte_bpe(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_byte_bpe_columns(spark):
    docs = spark.createDataFrame([(1, "héllo wörld", "k"), (2, None, "l")], "doc_id long, text string, ids string")
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, queries.BYTE_BPE, public_tokenizers.PATTERN), queries.BYTE_BPE, public_tokenizers.PATTERN)
    assert [(r.doc_id, r.decoded) for r in both.orderBy("doc_id").collect()] == [(1, "héllo wörld"), (2, "")]


def test_utf8_machine_holds_back():
    machine = byte_bpe.Utf8Machine()
    data = "a😀é漢".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.finish() == "a😀é漢"
    assert machine.feed(b"\xf0\x9f") == "" and machine.finish() == "�"
    draw = np.random.default_rng(5)
    pool = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(500):
        data = bytes(draw.choice(pool, 12).tolist())
        got = "".join(machine.feed(data[i : i + 2]) for i in range(0, 12, 2)) + machine.finish()
        assert got == data.decode("utf-8", "replace")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_BPE)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, folder):
    rows = sorted(rows_of(spark, folder), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in queries.op2_token_files(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simple8b_round_trip():
    draw = np.random.default_rng(0)
    for _ in range(200):
        sizes = draw.integers(0, 70, draw.integers(1, 8))
        values = (draw.integers(0, 2**63, sizes.sum(), dtype=np.uint64) * np.uint64(2)) >> draw.integers(0, 64, sizes.sum()).astype(np.uint64)
        words, offsets, escaped = simple8b.pack(values, np.cumsum(sizes) - sizes)
        assert (simple8b.unpack(words, sizes, offsets, escaped) == values).all()


def test_packing(spark, folder):
    rows = rows_of(spark, folder)
    want = defaultdict(list)
    for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[doc_id, piece].append((at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])))
    got, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in queries.op6_packing(spark, folder).collect():
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= total / 4096 * 1.02 + 2


def test_plan_uses_exact_complements():
    made = packing.plan({3000: 2, 1096: 1, 500: 1, 596: 1}, 4096)
    assert sorted((sorted(x), n) for x, n in made) == [([500, 596, 3000], 1), ([1096, 3000], 1)]


def test_html_text(spark, sf_dir, tmp_path):
    page = "<html><head><title>t</title></head><body><header class='top'>Site</header><nav><a href=x>Home</a></nav><div class='sidebar'><p>Some other story that is not this one.</p></div><main><h1>Title &amp; more</h1><p>First   paragraph\n of text.<p>Second <b>one</b>.<div class='ad'>Buy this great thing now.</div></main><section id='comments'><p>I liked this story very much, thanks a lot for it.</p></section><div class='cookie-notice'>We use cookies.</div><script>var x='<p>no</p>'</script><footer>(c)</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (2, "u", None), (3, None, ""), (4, "u", "<article><p>Cut off in the mid"), (5, "u", "a < b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_html_text(spark, str(tmp_path)).collect()}
    assert got[1][0] == "Title & more\nFirst paragraph of text.\nSecond one."
    assert got[2] == ("", 0) and got[3] == ("", 0)
    assert got[4][0] == "Cut off in the mid"
    assert queries.op3_html_text(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_html_cut_decides_where_tags_say_nothing(spark):
    """Given pages without their article element: the cut mends what each block's own score gets wrong."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    changed = by_cut = by_sign = 0
    for page in pages:
        want = html_text.main_text(page)
        bare = re.sub(r"<(/?)article[^>]*>", r"<\1div>", page)
        blocks = html_text.blocks_of(bare)
        keep = html_text.min_cut([s for _, s, _ in blocks], html_text.edges_of(blocks))
        changed += sum((s > 0) != k for (_, s, _), k in zip(blocks, keep, strict=True))
        by_cut += "\n".join(t for (t, _, _), k in zip(blocks, keep, strict=True) if k) == want
        by_sign += "\n".join(t for t, s, _ in blocks if s > 0) == want
    print("labels changed by the cut:", changed, "pages right by cut, by sign:", by_cut, by_sign, "of", len(pages))
    assert changed > 0 and by_cut > by_sign and by_cut >= 0.99 * len(pages)


def test_html_given_pages_are_their_articles(spark, sf_dir):
    import html as references

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1|article|div|ul|li|table|tr|h2)[^>]*>", inside)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>First of all, it says.<p class='popular-science'>A main paragraph about science.<p>Third.</article>", "First of all, it says.\nA main paragraph about science.\nThird."),
        ("<article><p>Main.</p><section id='comments'><article class='comment'><p>" + "I liked this very much. " * 30 + "</p></article></section></article>", "Main."),
        ("<form><div class='sidebar'><p>Links of a kind here.</p></div><main><p>Main words here.</p></main></form>", "Main words here."),
        ("<div class='cookie-notice'>We use cookies on this site.</div><h1>Hi</h1><p>Short text.</p>", "Hi\nShort text."),
        ("<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", ""),
        ("plain text, a &lt; b", "plain text, a < b"),
        ("<main>" + "<p>word</p>" * 20_000 + "</main>", "\n".join(["word"] * 20_000)),
    ],
)
def test_html_pages(page, want):
    assert html_text.main_text(page) == want


PROSE = "<p>" + "A long paragraph of an article, with a sentence that goes on for a while and ends here. " * 3 + "</p>"
ARTICLE, NAV, FOOT = "<h1>A heading</h1>" + PROSE + PROSE, "<nav><a href=/>Home</a></nav>", "<footer>(c) 2020</footer>"


@pytest.mark.parametrize("name", ["page popular", "widget-container", "modal-body", "search-result", "content alert", "story related", "sidebar", "popup"])
def test_html_wrappers_keep_their_article(name):
    """What a page's whole text has in common tells nothing; beside an article it does."""
    want = html_text.main_text(f"<body>{NAV}<article>{ARTICLE}</article>{FOOT}</body>")
    assert want.count("\n") == 2
    assert html_text.main_text(f"<body>{NAV}<div class='{name}'>{ARTICLE}</div>{FOOT}</body>") == want
    assert html_text.main_text(f"<body><form class='{name}'>{NAV}<div class='{name}'>{ARTICLE}</div>{FOOT}</form></body>") == want
    if name in ("widget-container", "modal-body", "sidebar", "popup"):
        assert html_text.main_text(f"<body><article>{ARTICLE}</article><div class='{name}'>{PROSE}{PROSE}{PROSE}</div></body>") == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a &lt; b</p>", "a < b"),
        ("<pre>x = 1</pre>", "x = 1"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
        ("<div>This is a sentence with some seventy-six characters that stands in a div.</div>", "This is a sentence with some seventy-six characters that stands in a div."),
        (f"<body><form>{NAV}{PROSE}{FOOT}</form></body>", html_text.main_text(PROSE)),
        ("".join(f"<div>{PROSE}<a>Home</a></div>" for _ in range(50)), "\n".join([html_text.main_text(PROSE)] * 50)),
        ("<div>Wir verwenden Cookies. Akzeptieren</div>" + ARTICLE, html_text.main_text(ARTICLE)),
        # nothing but boilerplate stays empty
        ("<div class='cookie-notice'>We use cookies on this site.</div>", ""),
        ("<div class='comments'><p>" + "I like it. " * 30 + "</p></div>", ""),
        (f"{NAV}<nav><p>{'x y ' * 60}</p></nav>{FOOT}", ""),
        ("<form><p>Search here</p></form>", ""),
        (f"<div style='display:none'>{PROSE}</div>", ""),
    ],
)
def test_html_pages_without_other_text(page, want):
    assert html_text.main_text(page) == want


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "old", "<p>New text.</p>", "k"), (1, "old", None, None)], "page_id long, text string, html string, _x string")
    assert sorted((r.text, r._x) for r in html_text.extract_pages(df).collect()) == [("", None), ("New text.", "k")]
    assert html_text.extract_pages(df.limit(0)).collect() == []


def test_min_cut_equals_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(1, 8))
        scores = draw.integers(-9, 10, n).tolist()
        edges = [(int(a), int(b), int(c)) for a, b, c in zip(draw.integers(0, n, 6), draw.integers(0, n, 6), draw.integers(1, 6, 6), strict=True) if a != b]
        cost = lambda side: sum(-s if not k and s > 0 else 0 for s, k in zip(scores, side, strict=True)) * -1 + sum(-s for s, k in zip(scores, side, strict=True) if k and s < 0) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(scores, edges)) == best


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against the primal's value by a long subgradient descent on small rows."""
    draw = np.random.default_rng(9)
    rows = [np.sort(draw.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.where([(r < 20).sum() > 3 for r in rows], 1.0, -1.0)
    ratio = quality.log_count_ratio(rows, y)
    cost = np.full(60, 0.7)
    weight, bias = quality.dual_coordinate_descent(rows, y, ratio, cost, 400, 1)
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(np.square(ratio[r]).sum())
    plain = np.divide(weight[:40], ratio[:40], out=np.zeros(40), where=ratio[:40] != 0)
    value = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    w, b, best = np.zeros(40), 0.0, np.inf
    for t in range(1, 20_000):
        push = cost * y * (y * (x @ w + b) < 1)
        w, b = w - (w - push @ x) / t, b - (b - push.sum()) / t
        best = min(best, value(w, b))
    assert value(plain, bias) <= best * 1.005


def test_quality(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    up, down = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down]) > 0.9
    write(spark, tmp_path)
    spark.createDataFrame([(4, 1, 0), (4, None, 0), (None, 0, 0), (7, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(queries.op4_quality(spark, str(tmp_path)).collect()) == len(ODD)
    none = quality.train_quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.constant == 0.5


def brute_base(text):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, folder):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op5_licenses(spark, folder).collect()), key=str)
    assert got == sorted(((i, *brute_base(t)) for i, t in rows_of(spark, folder)), key=str)


def brute_blocks(rows):
    want = set()
    for doc_id, text in rows:
        words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        for t in licenses.templates_of(licenses.TEMPLATES, 0.8):
            for at in range(0, len(words), t.step):
                block = words[at : at + 2 * t.step]
                there = set(block)
                ordered = not t.phrase or any(tuple(block[i : i + len(t.phrase)]) == t.phrase for i in range(len(block)))
                if len(there & set(t.words)) >= t.need and there >= set(t.must) and not there & set(t.avoid) and ordered:
                    want.add((doc_id, at, 2 * t.step, t.label))
    return want


def test_license_join_is_exact(spark, sf_dir):
    found = licenses.scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", "inline(matches)").collect()
    want = brute_blocks(rows_of(spark, sf_dir))
    assert {(r.doc_id, r.word, r.width, r.label) for r in found} == want and want


def test_license_variants_are_told_apart(spark):
    """One version's notice is not another's, and short notices keep their order."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    cases = [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        (gpl + ", either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
        (gpl.replace("program", "library").replace("General", "Lesser General") + ".", "lgpl"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("all that we reserved were rights", ""),
        ("x. All rights reserved by y", "all-rights-reserved"),
        ("w " * 6 + "all rights reserved", "all-rights-reserved"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: r for r in licenses.license_rows(rows).collect()}
    assert [got[i].labels for i in range(len(cases))] == [want for _, want in cases]
    assert got[10].score == 0 and got[6].score == 0
    found = licenses.scan_documents(rows).selectExpr("doc_id", "inline(matches)").collect()
    assert {(r.doc_id, r.word, r.width, r.label) for r in found} == brute_blocks([(i, t) for i, (t, _) in enumerate(cases)])


def test_license_blocks_cross_lines(spark):
    grant = "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files, to deal in the Software\n * without restriction"
    rows = [(1, grant), (2, "all " + "w " * 300 + "rights " + "v " * 300 + "reserved"), (3, "x All rights\nreserved. y"), (4, None), (5, "q " * 50_000 + grant + " q" * 50_000), (6, grant.replace("free of charge", ""))]
    got = {r.doc_id: r.labels for r in licenses.license_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "mit-grant", 2: "", 3: "all-rights-reserved", 4: "", 5: "mit-grant", 6: "mit-grant"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_stated_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_language(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in rows_of(spark, sf, "doc_id, lang")}
    rows = queries.op7_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert sum(r.rejected for r in rows) <= 5
    model = language.train_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    names, scores, rejected = model.predict(["Дом стоит на горе и смотрит на реку", "", None, "12 !!", "the of and the"])
    assert rejected[:4] == [True] * 4 and names[1:4] == ["und"] * 3 and scores[1:4] == [0.0] * 3 and names[4] == "en"
    spark.createDataFrame([(i, t, None) for i, t in ODD], SCHEMA + ", lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.lang_pred for r in queries.op7_language(spark, str(tmp_path)).collect()} == {"und"}
    assert language.identify(spark.createDataFrame([], SCHEMA), model).collect() == []
    clash = language.identify(spark.createDataFrame([(1, "the of and the", "s")], "doc_id long, text string, score string"), model).first()
    assert clash.lang_pred == "en" and 0 <= clash.score <= 1
    # probabilities after a context sum to one over all symbols seen and unseen, and steps change nothing
    texts = ["the mat", "", None, "12 !!", "  x1y  zz " * 77, "Σίσυφος ΑΣ İ a", "word " * 3000]
    whole, sizes = model.entropies(texts)
    step, piece = language.STEP, language.PIECE
    try:
        language.STEP, language.PIECE = 7, 5
        again, same = model.entropies(texts)
    finally:
        language.STEP, language.PIECE = step, piece
    assert np.allclose(whole, again) and (sizes == same).all()


def plain_kneser_ney(texts):
    """Entropy per symbol of a text under interpolated Kneser-Ney on plain dictionaries of tuples."""
    cut = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
    top = language.ORDER
    seen = [{} for _ in range(top)]
    for text in map(cut, texts):
        for end in range(1, len(text)) if text.strip() else ():
            for o in range(min(top, end + 1)):
                gram = text[end - o : end + 1]
                seen[o][gram] = seen[o].get(gram, 0) + 1
    used = [dict.fromkeys(g, 0) for g in seen]
    used[-1] = dict(seen[-1])
    for o in range(top - 1):
        for gram in seen[o + 1]:
            used[o][gram[1:]] += 1
    once, twice = (sum(v == k for v in used[-1].values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.75
    total = sum(used[0].values())
    unseen = d * sum(v > 0 for v in used[0].values()) / total / 5000

    def chance(context, symbol):
        if not context:
            return max(used[0].get(symbol, 0) - d, 0) / total + unseen
        lower = chance(context[1:], symbol)
        follow = [v for g, v in used[len(context)].items() if g[:-1] == context and v > 0]
        if not follow:
            return lower
        return max(used[len(context)].get(context + symbol, 0) - d, 0) / sum(follow) + d * len(follow) / sum(follow) * lower

    def entropy(text):
        text = cut(text)
        return -sum(math.log(chance(text[max(0, i - top + 1) : i], text[i])) for i in range(1, len(text))) / max(1, len(text) - 1)

    return entropy


def test_language_equals_plain_kneser_ney(spark):
    """The sorted arrays of hashes give what dictionaries of tuples give, for each language."""
    draw = random.Random(4)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(1, 6)))
    letters = {"xx": "abcdé", "yy": "cdefя"}
    rows = [(i, " ".join(word(letters[x]) for _ in range(draw.randint(1, 12))), x) for i in range(60) for x in [draw.choice(["xx", "yy"])]]
    rows += [(100, "", "xx"), (101, "12 !?", "yy"), (102, "a", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) != 0).collect()  # the others calibrate
    model = language.train_languages(docs)
    tests = [r[1] for r in rows[:15]] + ["abc fed", "zzz q", "é", "Я-c, d", "a" * 40]
    got, _ = model.entropies(tests)
    assert model.languages == ["xx", "yy"]
    for k, x in enumerate(model.languages):
        entropy = plain_kneser_ney([r.text for r in learned if r.lang == x])
        assert np.allclose(got[:, k], [entropy(t) for t in tests], rtol=1e-4), x


def test_language_probabilities_sum_to_one():
    texts = ["the cat sat on the mat and the dog sat on the log " * 3]
    points, starts = language.symbols(texts)
    keys = language.gram_hashes(points, language.places_of(starts))
    counts = []
    for o in range(language.ORDER):
        at = np.flatnonzero((keys[o] > 0) & (language.places_of(starts) > 0))
        key, where, n = np.unique(keys[o][at], return_index=True, return_counts=True)
        where = at[where]
        counts.append((key, n, keys[o - 1][where] if o else key * np.uint64(0), keys[o - 1][where - 1] if o else key * np.uint64(0)))
    model = language.fit({"en": counts})
    alphabet = np.unique(points)
    chance = lambda context, symbol: float(np.exp(model.place_scores(language.gram_hashes(np.array([*context, symbol], np.uint64), np.arange(len(context) + 1) + 8))[-1, 0]))
    for context in ("sat", " th", "the", "qxz", "og "):
        context = [0 if c == " " else ord(c) for c in context]
        total = sum(chance(context, symbol) for symbol in alphabet.tolist()) + (5000 - len(alphabet)) * chance(context, 0x4E00)
        assert abs(total - 1) < 1e-3, (context, total)


def test_winnowing(spark, folder):
    rows = sorted(((i, t or "") for i, t in rows_of(spark, folder)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        cut, after = len(text) // 4, rows[(k + 1) % len(rows)][1]
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    got = queries.op8_winnowing(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_edited == 1 for r in got if r.n_chars < 4)


def brute_marks(text, k=12, window=8):
    """(place, hash) of each window's smallest hash, the rightmost on ties."""
    xxhash = pytest.importorskip("xxhash")
    visible = re.sub(r"[ \t-\r]", "", text or "")
    hashes = [xxhash.xxh64_intdigest(visible[i : i + k].encode("utf-32-be"), 42) >> 32 for i in range(max(1, len(visible) - k + 1))] if visible else []
    chosen = set()
    for at in range(max(1, len(hashes) - window + 1)) if hashes else ():
        low = min(hashes[at : at + window])
        chosen.add(max(i for i in range(at, min(len(hashes), at + window)) if hashes[i] == low))
    return [(i, hashes[i]) for i in sorted(chosen)]


def test_winnowing_equals_brute_force(spark, folder):
    rows = sorted(((i, t or "") for i, t in rows_of(spark, folder)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) < 20_000]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.text): [(m.place, m.hash) for m in r.m] for r in winnowing.add_fingerprint(docs, "text", "p").select("doc_id", "text", winnowing.marks("p").alias("m")).collect()}
    assert found == {r: brute_marks(r[1]) for r in rows}

    def like(a, b):
        a, b = ({h for _, h in brute_marks(t)} for t in (a, b))
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    want = []
    for n, (doc_id, text) in enumerate(rows):
        cut, after = len(text) // 4, rows[(n + 1) % len(rows)][1]
        want.append((doc_id, round(like(text, text[: len(text) - cut] + after[:cut]), 9), round(like(text, after), 9), len(brute_marks(text))))
    got = [(r.doc_id, round(r.near_edited, 9), round(r.near_next, 9), r.n_marks) for r in winnowing.compare_with_edits(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_winnowing_keeps_its_guarantee(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, "x y z " + shared), (2, "other words before " + shared + " after")], SCHEMA)
    a, b = [r.h for r in winnowing.add_fingerprint(df, "text", "p").select(winnowing.hashes("p").alias("h")).collect()]
    assert set(a) & set(b)
    marks = winnowing.add_fingerprint(df, "text", "p").select(winnowing.marks("p").alias("m")).first().m
    assert [m.place for m in marks] == sorted(m.place for m in marks)


def test_winnowing_finds_passages_at_any_offset(spark):
    draw = np.random.default_rng(4)
    runs = {"prose": "ab\ncd efg", "cjk": "".join(map(chr, range(0x4E00, 0x4E80))), "emoji": "😀😁😂漢a", "token": "ABCabc019+/"}
    for name, letters in runs.items():
        drawn = lambda n: "".join(draw.choice(list(letters), n))  # noqa: E731,B023
        shared = drawn(60)
        rows = [(offset, drawn(40)[:offset] + shared[offset % 5 :] + drawn(9)) for offset in range(40)]
        got = [(r.doc_id, {m.hash for m in r.m}, r.text, [m.place for m in r.m]) for r in winnowing.add_fingerprint(spark.createDataFrame(rows, SCHEMA), "text", "p").select("doc_id", "text", winnowing.marks("p").alias("m")).collect()]
        assert all(a & b for _, a, _, _ in got for _, b, _, _ in got), name
        for _, found, text, places in got:  # each window has its choice, the places are of visible characters
            visible = re.sub(r"[ \t-\r]", "", text)
            assert places == sorted(places) and places[0] < 8 and max(np.diff(places)) <= 8 and len(visible) - 12 - places[-1] < 8


def test_winnowing_takes_the_rightmost_minimum(spark):
    df = spark.createDataFrame([(1, "a" * 400), (2, "漢" * 19), (3, "ab"), (4, "a b"), (5, " \n")], SCHEMA)
    got = {r.doc_id: [(m.place, m.hash) for m in r.m] for r in winnowing.add_fingerprint(df, "text", "p").select("doc_id", winnowing.marks("p").alias("m")).collect()}
    assert [p for p, _ in got[1]] == list(range(7, 389)) and [p for p, _ in got[2]] == [7]
    assert len(got[3]) == 1 and got[3] == got[4] and got[5] == []


def neighbours_of(spark, df, **options):
    """(share of the true nearest that are found, levels): exact scores and order are asserted."""
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    got, levels = defaultdict(list), []
    for r in neighbours.nearest(df, df.vec_id % 20 == 0, report=levels, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = wanted = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for at in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[at]).sum(axis=1)
        scores[at] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        found = got[ids[at]]
        of = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        assert len(found) == 20 and all(abs(of[i] - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits, wanted = hits + len(best & {i for i, _ in found}), wanted + len(best)
    return hits / wanted, levels


def embedded(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_given_vectors(spark, sf):
    """Vectors without any structure: parts can spare little, but recall holds."""
    recall, levels = neighbours_of(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    print(sf, recall, levels)
    assert recall >= 0.9 and levels[0]["parts"] > 1 and levels[0]["probes"] < levels[0]["parts"]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_neighbours_recall_on_clusters(spark, spread):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(8000, 16)) + 2 * draw.normal(size=(40, 16))[draw.integers(0, 40, 8000)]
    x[100:160] = x[99]  # ties
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * draw.normal(size=(8000, 1)))
    recall, levels = neighbours_of(spark, embedded(spark, x))
    print("spread", spread, recall, levels)
    assert recall >= 0.9 and levels[0]["parts"] > 8 and 2 * levels[0]["probes"] <= levels[0]["parts"]


def test_neighbours_recall_over_levels(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(6000, 16)) + 2 * draw.normal(size=(30, 16))[draw.integers(0, 30, 6000)]
    recall, levels = neighbours_of(spark, embedded(spark, x), split=512, most=8)
    print("levels", recall, levels)
    assert recall >= 0.9 and len(levels) >= 2 and levels[1]["nodes"] > 1


def test_neighbours_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, df.vec_id % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 2), (20, 2, 0), (20, 3, 1)]


def test_neighbours_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "b"), (1, [2.0, 1.0], "c"), (40, None, None), (60, [0.0, 0.0], ""), (80, [float("nan"), 1.0], ""), (100, [None, 1.0], ""), (120, [1.0], ""), (None, [1.0, 1.0], "")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op9_neighbours(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]  # each row of a repeated id is a query and a candidate
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op9_neighbours(spark, f"{tmp_path}/none").collect() == []


def brute_classes(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * min(a, b) >= percent * max(a, b):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (a + b - n):
                    root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return [(r[0], len(s), r[0] if r[0] is None else low[top(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark, folder):
    rows = rows_of(spark, folder)
    got = queries.op10_near_duplicates(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_classes(rows, 4), key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("words", [4, 5])
def test_shingles_of_a_short_slice(spark, words):
    texts = ["", "one", "one two", "one two three", "one two three four", "one two three four five"]
    rows = [(i, t) for i, t in enumerate(texts)]
    parts = [spark.createDataFrame([r], SCHEMA).coalesce(1) for r in rows]  # a slice of its own each
    alone = {r.doc_id: (r.n_shingles, r.set_key) for p in parts for r in near_duplicates.sketches(p, words).collect()}
    together = {r.doc_id: (r.n_shingles, r.set_key) for r in near_duplicates.sketches(spark.createDataFrame(rows, SCHEMA).coalesce(1), words).collect()}
    assert alone == together and [alone[i][0] for i in range(6)] == [0, 1, 1, 1, 1, 6 - words]


def test_near_duplicates_of_one_base(spark, tmp_path):
    draw = np.random.default_rng(2)
    base = [f"w{i}" for i in draw.integers(0, 9999, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):  # more than a block
        copy = list(base)
        for k in draw.integers(0, 300, int(draw.integers(1, 6))):
            copy[k] = f"e{i}-{k}"
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, f"another text number {i} of {i * 7} words {i * 11} here") for i in range(50)]
    write(spark, tmp_path, rows)
    got = {r.doc_id: r.component_id for r in queries.op10_near_duplicates(spark, str(tmp_path)).collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[2000 + i] == 2000 + i for i in range(50))


def test_near_duplicates_lose_no_link(spark):
    """All 10,000 texts against the stated SQL, which compares all that share a shingle."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = dict(con.execute(f"SELECT doc_id, component_id FROM ({queries.ORACLE_SQL['op10_near_duplicates']})").fetchall())
    got = {r.doc_id: r.component_id for r in queries.op10_near_duplicates(spark, sf).collect()}
    lost = [i for i, c in want.items() if got[i] != c]
    print("texts in another class than by brute force:", len(lost), "of", len(want))
    assert len(want) == 10_000 and not lost


def test_cells_meet_all_but_one_label_with_itself(spark):
    """Every two nodes of different labels stand together in exactly one cell."""
    draw = np.random.default_rng(8)
    labels = [1] * 2500 + draw.integers(2, 6, 1500).tolist()
    members = spark.createDataFrame([(7, i, x) for i, x in enumerate(labels)] + [(8, 9001, 5), (8, 9002, 5)], "key long, node long, label long")
    cells = defaultdict(set)
    for r in near_duplicates._cells(members, ["key"]).collect():
        assert r.key == 7
        cells[r.low, r.high].add(r.node)
    assert max(map(len, cells.values())) < 2400
    for a, b in draw.integers(0, 4000, (3000, 2)).tolist():
        if labels[a] != labels[b]:
            assert any(a in c and b in c for c in cells.values())


def test_one_of_each_keeps_whole_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (5, text, "y"), (5, "quite another text that nobody else in the table has", "z"), (9, "some third text with words of its own that stand alone", "p"), (9, "some third text with words of its own that stand alone", "p"), (None, text + " eleven", "n"), (None, "a text without an id that is like no other one here", "m"), (2, None, "k"), (3, "", "l")]
    got = sorted((r.source for r in near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()))
    assert got == ["k", "l", "m", "n", "p", "z"]  # the null id comes first in its class; one of two equal rows
    assert near_duplicates.one_of_each(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        stage(spark, kept, sf).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
    deduped = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/quality").select("doc_id", "text").collect()]
    want = {i for i, _, c in brute_classes(deduped, 5) if i == c}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == want
    toxic = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in toxic.where("quality = 1").collect()}
    passed = {i for i, _ in deduped}
    assert len(good & passed) > 0.95 * len(good)


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Null, empty, repeated and extra: each stage keeps whole rows of its input, with the columns of documents."""
    columns = list(corpus_pipeline.COLUMNS)
    schema = "doc_id long, text string, lang string, source string, n_chars long, rejected string, quality_score string, row string"
    copy = "one two three four five six seven eight nine ten eleven twelve"
    odd = [(i, t, None, None, None, "x", "y", "z") for i, t in ODD] + [(20, copy, "en", "a", 1, "", "", ""), (21, copy, "en", None, 2, "", "", ""), (21, copy, "en", None, 2, "", "", "")]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), *[F.lit("k").alias(c) for c in ("rejected", "quality_score", "row")])
    odd_docs = spark.createDataFrame(odd, schema)
    key = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)
    for docs in (odd_docs, real.union(odd_docs)):
        given = key(docs.collect())
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            assert out.columns == columns and not key(rows) - given, name
            texts = [r.text for r in rows]
            if name == "language":
                assert None not in texts and "" not in texts and " " not in texts  # nothing to recognise
            if name == "near_duplicates":  # texts without words are linked with nothing, of copies the smallest id stays
                assert texts.count(None) == 1 and texts.count("") == 1 and texts.count("a b c") == 1
                assert [r.doc_id for r in rows if r.text == copy] == [20]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, *_ in given.elements())
        assert all(1 <= r.length <= 4096 for r in packed)
    empty = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_quality_is_fitted_by_a_task(spark, monkeypatch):
    """The sample's features do not reach the driver, and the model is the plain fit's."""
    texts = [(i, f"word{i % 7} " * (1 + i % 5) + ("good prose here" if i % 3 else "buy now cheap")) for i in range(60)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts], "doc_id long, quality int")
    places = {r.doc_id: r.place for r in labels.select("doc_id", F.xxhash64("doc_id").alias("place")).collect()}
    plain = sorted(texts, key=lambda t: (places[t[0]], t[0]))
    want = quality.fit([quality.indicators(t, np.zeros(quality.FEATURES, bool)) for _, t in plain], [int(i % 3 > 0) for i, _ in plain])
    monkeypatch.setattr(type(documents), "toArrow", None)
    got = quality.train_quality(documents, labels)
    assert np.array_equal(got.ratio, want.ratio) and np.array_equal(got.weight, want.weight)
    assert (got.bias, got.slope, got.offset, got.constant) == (want.bias, want.slope, want.offset, None)
    assert quality.train_quality(documents, labels.where("quality = 1")).constant == 1.0
