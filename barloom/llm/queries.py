"""The operators' registered queries: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, fill_middle, html_text, language, licenses, near_duplicates, neighbours, packing, piece_bpe, quality, spelling, token_files, winnowing
from barloom.llm.common import id_remainder, shared_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, 1, folder)
    return token_files.read_token_files(spark, folder)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(documents, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rows(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, 1, 4096)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train_languages(documents, id_remainder("doc_id", 4) != 2)
    found = language.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(table(spark, sf_dir, "documents"), PIECE_BPE)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"), least_length=7, least_n=2, slip=31, ratio=10)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


_ALL = (op1_byte_bpe, op2_token_files, op3_html_text, op4_quality, op5_licenses, op6_packing, op7_language, op8_winnowing, op9_neighbours, op10_near_duplicates, op11_piece_bpe, op12_spelling, op13_fill_middle)
QUERIES = {f.__name__: f for f in _ALL}


def _license_sql() -> str:
    """The license scan by plain comparison of every block with every template."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    known = licenses.templates_of(licenses.TEMPLATES, 0.8)
    words = ", ".join(f"({n}, {quoted(t.label)}, {len(t.words)}, {t.need}, {t.step}, {quoted(w)}, {w in t.must}, {w in t.avoid}, {len(t.must)})" for n, t in enumerate(known) for w in t.words + t.avoid)
    here = lambda phrase: " AND ".join(f"words[i + {k}] = {quoted(p)}" for k, p in enumerate(phrase.split(" "), 1))
    phrases = " UNION ALL ".join(f"SELECT row, {n} AS n, {len(t.phrase)} AS k, {t.step} AS step, unnest(list_filter(range(0, len(words)), lambda i: {here(' '.join(t.phrase))})) AS i FROM w" for n, t in enumerate(known) if t.phrase)
    ordered = ", ".join(str(n) for n, t in enumerate(known) if t.phrase)
    places = " UNION ALL ".join(f"SELECT row, {quoted(label)} AS label, unnest(list_filter(range(0, len(words)), lambda i: {here(phrase)})) AS i FROM w" for phrase, label in licenses.BASE_PHRASES.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS low FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(low, '{licenses.WORD}') AS words FROM d),
t(n, label, size, need, step, word, must, avoid, musts) AS (VALUES {words}),
p AS ({places}),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM p GROUP BY row),
u AS (SELECT row, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w),
h AS (SELECT row, n, label, size, need, must, avoid, musts, u.word, i // step AS own FROM u JOIN t ON u.word = t.word),
k AS (SELECT * EXCLUDE (own), own AS block FROM h UNION ALL SELECT * EXCLUDE (own), own - 1 FROM h WHERE own > 0),
f AS ({phrases}),
o AS (SELECT row, n, block FROM (SELECT *, unnest([i // step, i // step - 1]) AS block FROM f) WHERE block >= 0 AND i + k <= (block + 2) * step),
c AS (SELECT row, label, count(DISTINCT word) FILTER (NOT avoid) / size AS held FROM k WHERE n NOT IN ({ordered}) OR (row, n, block) IN (SELECT (row, n, block) FROM o) GROUP BY row, n, block, label, size, need, musts
  HAVING count(DISTINCT word) FILTER (NOT avoid) >= need AND count(DISTINCT word) FILTER (must) = musts AND NOT bool_or(avoid)),
m AS (SELECT row, max(held) AS held, list_distinct(list(label)) AS labels FROM c GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.held, 0)::DOUBLE END AS score
FROM w LEFT JOIN b ON b.row = w.row LEFT JOIN m ON m.row = w.row"""


#: Near-duplicates by counting the shingles that any two texts share.
_NEAR_DUPLICATE_SQL = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT row, len(w) AS k, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
g AS (SELECT row, k, i, concat_ws(' ', word, lead(word, 1) OVER q, lead(word, 2) OVER q, lead(word, 3) OVER q) AS one FROM u WINDOW q AS (PARTITION BY row ORDER BY i)),
z AS MATERIALIZED (SELECT DISTINCT row, one FROM g WHERE i + 4 <= k OR k < 4 AND i = 0),
own AS MATERIALIZED (SELECT z.row, min(w.doc_id) AS doc_id, count(*) AS n, hash(list_sort(list(one))) AS same FROM z JOIN w ON w.row = z.row GROUP BY z.row),
c AS (SELECT same, min(n) AS n, min(doc_id) AS doc_id, min(row) AS row FROM own WHERE doc_id IS NOT NULL GROUP BY same),
y AS MATERIALIZED (SELECT same, n, hash(one) AS one FROM c JOIN z ON z.row = c.row),
p AS (SELECT a.same AS a, b.same AS b, count(*) AS shared FROM y a JOIN y b ON a.one = b.one AND a.same <> b.same AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN c ca ON ca.same = p.a JOIN c cb ON cb.same = p.b WHERE 100 * shared >= 80 * (ca.n + cb.n - shared)),
reach AS (SELECT same, doc_id AS root FROM c UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.same JOIN c ON c.same = l.b WHERE reach.root < c.doc_id),
class AS (SELECT same, min(root) AS root FROM reach GROUP BY same)
SELECT w.doc_id, coalesce(own.n, 0) AS n_shingles, CASE WHEN w.doc_id IS NOT NULL THEN coalesce(class.root, w.doc_id) END AS component_id, coalesce(w.doc_id = coalesce(class.root, w.doc_id), true) AS kept FROM w LEFT JOIN own ON own.row = w.row LEFT JOIN class ON class.same = own.same"""

#: Words by plain hashing (crc32 from its table of 256, over the bytes of id and run); near words by equality without one place.
_SPELLING_SQL = """WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM (SELECT run, n, hex(encode(doc || ':' || run)) AS x FROM c), tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
l AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.rest UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.rest),
g AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM l GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL"""

_FILL_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: What SQL can state of them. The tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {"op5_licenses": _license_sql(), "op10_near_duplicates": _NEAR_DUPLICATE_SQL, "op12_spelling": _SPELLING_SQL, "op13_fill_middle": _FILL_SQL}
