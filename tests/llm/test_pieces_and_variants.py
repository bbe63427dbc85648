"""SentencePiece, spelling variants and fill-in-middle against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from barloom.llm import fill_middle, piece_bpe, queries, spelling  # noqa: E402

ODD = [(1, None), (2, ""), (3, " "), (4, "   two  spaces  "), (5, "a b c\nd"), (5, "a b c\nd"), (6, "naïve Ünïcode 漢字かな 😀 \x1c x　y\r\n\tz"), (7, "wordword " * 20000 + "\n"), (8, "▁under▁"), (None, "no id here\nat all\n"), (9, "<s> </s> <0x0A> <unk>"), (10, "\n\n\n"), (11, "<P>kept\nplain"), (12, "x" * 50000), (13, "<P"), (14, ">\nS><\n"), (15, "ÉTRÉCH étrÉchie étrÉchie Étréchie")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(params=["odd", "real", "empty"])
def folder(request, spark, tmp_path, sf_dir):
    if request.param == "real":
        return sf_dir
    rows = ODD if request.param == "odd" else []
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as n", "'y' as word", "'z' as ids", "'w' as output").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)


def test_piece_bpe(spark, folder, library):
    want = []
    for doc_id, text in rows_of(spark, folder):
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = queries.op11_piece_bpe(spark, folder)
    assert rows(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want, key=str)


def test_piece_bpe_columns(spark, library):
    docs = spark.createDataFrame([(1, "héllo wörld", "k"), (2, None, "l")], "doc_id long, text string, ids string")
    encoded = piece_bpe.encode_documents(docs, queries.PIECE_BPE)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {1: library.encode("héllo wörld"), 2: []}
    both = piece_bpe.decode_documents(encoded.withColumnRenamed("text", "decoded"), queries.PIECE_BPE)
    assert [(r.doc_id, r.decoded) for r in both.orderBy("doc_id").collect()] == [(1, "héllo wörld"), (2, "")]


def test_pieces_at_random(library):
    """Runs of spaces share one score, long words have no cut, ids may be any."""
    draw, bpe = random.Random(1), piece_bpe.coder(queries.PIECE_BPE)
    parts = ["a", "b", "e", "t", "th", "ing", " ", "  ", "   ", "\n", "▁", "é", "漢", "😀", ".", "1", "<0x0A>", "<s>", "\x00", "\t", "\r\n", "İ", "ation", "//", "==", "a" * 30, " " * 20]
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        ids = library.encode(text)
        assert bpe.encode(text) == ids
        some = [draw.randrange(32000) if draw.random() < 0.6 else draw.randrange(262) for _ in range(draw.randint(0, 12))]
        assert bpe.decode(some) == library.decode(some)
    word = "".join(draw.choices("abcdeéth漢1", k=20000))
    assert bpe.encode(word) == library.encode(word)


def test_prefix_table_holds_each_prefix_last_token():
    bpe = piece_bpe.coder(queries.PIECE_BPE)
    text = "▁international漢ization"
    last = bpe.segments.last_tokens(text)
    for end in range(1, len(text) + 1):
        ids = bpe.segments.encode(text[:end])
        assert last[end] == ids[-1] if last[end] >= 0 else text[end - 1] == "漢"


def brute_spelling(documents, least=7):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    alike, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            alike[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def test_spelling(spark, folder):
    assert rows(queries.op12_spelling(spark, folder)) == brute_spelling(rows_of(spark, folder))


@pytest.mark.parametrize("most", [2, 64, 10**6])
def test_spelling_of_dense_words(spark, monkeypatch, most):
    """Words of two letters are near to many: short lists, long lists, both."""
    monkeypatch.setattr(spelling, "MAX_LIST", most)
    draw = random.Random(3)
    documents = [(k, "".join(draw.choices("ab", k=draw.randint(6, 10))) + " " + "Abcdefgh " * draw.randint(0, 30) + "aaaaaaaa") for k in range(3000)]
    got = spelling.spelling_forms(spark.createDataFrame(documents, SCHEMA))
    want = brute_spelling(documents)
    assert rows(got) == want
    assert any(r[1] is not None and r[1] != r[2] for r in want), "no chain of forms"


def test_two_near_words_share_a_list():
    """Whatever the dictionary and the ranks, one edit leaves a listed gram."""
    draw = random.Random(5)
    for _ in range(300):
        dictionary = {"".join(draw.choices("abc", k=draw.choice([2, 2, 3, 4]))): 9 for _ in range(draw.randint(0, 25))}
        cells = np.array([draw.randrange(5) for _ in range(64)]).repeat(spelling.CELLS // 64)
        word = "".join(draw.choices("abc", k=draw.randint(7, 12)))
        at, kind = draw.randrange(len(word)), draw.choice("ird")
        other = word[:at] + {"i": draw.choice("abc") + word[at], "r": draw.choice("abc"), "d": ""}[kind] + word[at + 1 :]
        keys = lambda w: {(c > 0, w[:c] if c > 0 else w[-c:]) for c in spelling.list_cuts(w, dictionary, cells)}
        if len(other) >= 7 and other != word:
            assert keys(word) & keys(other)


def test_gram_dictionary_is_pruned_and_bounded(spark, monkeypatch):
    words = spark.createDataFrame([(f"abcdef{k:04d}", 2) for k in range(500)], "word string, n long")
    dictionary = spelling.gram_dictionary(words)
    assert dictionary["ab"] == dictionary["abcd"] == 500 and "f00" in dictionary and "f000" not in dictionary
    monkeypatch.setattr(spelling, "MAX_GRAMS", 30)
    assert 0 < len(spelling.gram_dictionary(words)) < 30
    with pytest.raises(ValueError):
        spelling.near_words(words, least_length=6)


def brute_fill(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text))
    return (doc_id, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text))


def test_fill_middle(spark, folder):
    assert rows(queries.op13_fill_middle(spark, folder)) == sorted([brute_fill(*r) for r in rows_of(spark, folder)], key=str)


def test_fill_middle_at_random(spark):
    draw = random.Random(2)
    documents = [(k, "".join(draw.choices(["a", "\n", "é", "😀", "<", "P", ">", "S", "word "], k=draw.randint(0, 30)))) for k in range(2000)]
    frame = spark.createDataFrame(documents, SCHEMA).repartition(3)
    assert rows(fill_middle.digests(frame, rate=60, spm=20)) == sorted([brute_fill(*r, rate=60, spm=20) for r in documents], key=str)


def test_fill_middle_by_character_keeps_columns(spark):
    frame = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' as n", "'y' as output", "array(1) as more")
    made = fill_middle.transform(frame, unit="char")
    assert made.columns == ["doc_id", "text", "more", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in fill_middle.restore_texts(made).collect():
        assert r.restored == (r.text or "") and r.n == len(r.text or "") and r.more == [1]
        assert r.form == "plain" or 0 <= r.prefix_chars <= r.prefix_chars + r.middle_chars <= r.n
    broken = spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="three marks"):
        fill_middle.restore_texts(broken).collect()
    with pytest.raises(ValueError):
        fill_middle.transform(frame, unit="word")
