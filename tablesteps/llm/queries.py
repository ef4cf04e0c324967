"""Registered queries of the training-data operators, one ``opN_<name>`` each, with the SQL that gives the same rows
where SQL can express it.  Each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, embedding_dedup, exact_dedup, html_extract, language_id, license_scan, line_dedup, pii, quality, sentencepiece, simhash, spelling
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


#: Vocabulary file of a public tokenizer that comes with the installation (a parameter of the operator).
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sha256_of(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query(
    "op1_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
repeated AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10
             GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.line, l.pos, coalesce(r.owner <> l.doc_id, false) AS lost
           FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op1(spark, d):
    out = line_dedup.drop_repeated_lines(table(spark, d, "documents"), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("kept")).alias("kept_sha256"))


@query("op2_sentencepiece")
def op2(spark, d):
    out = sentencepiece.encode_and_decode(table(spark, d, "documents"), PIECE_MODEL, ["doc_id"])
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op3_license_scan")
def op3(spark, d):
    out = license_scan.scan(table(spark, d, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("detected", ",").alias("detected"),
    )


@query("op4_pii")
def op4(spark, d):
    docs = table(spark, d, "documents")
    out = pii.sanitise(docs, pii.find_spans(docs), ["doc_id"])
    return out.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        "n_term",
        "n_secret",
        sha256_of(F.col("base_spans")).alias("base_sha256"),
        "spans",
        sha256_of(F.col("clean")).alias("clean_sha256"),
    )


@query("op5_simhash_near_dedup")
def op5(spark, d):
    return simhash.near_groups(table(spark, d, "documents"))


@query(
    "op6_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY bare) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
""",
)
def op6(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents"))


@query("op7_html_extraction")
def op7(spark, d):
    out = html_extract.extract(table(spark, d, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


@query("op8_language_id")
def op8(spark, d):
    docs = table(spark, d, "documents")
    out = language_id.predict(docs, language_id.train(docs), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query(
    "op9_benchmark_decontamination",
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS ipos
       FROM b WHERE len(ws) > 0),
bw AS (SELECT item_id, k, ipos, array_to_string(ws[ipos:ipos + k - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM bw) AS ks),
dw AS (SELECT doc_id, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') AS win FROM di),
m AS (SELECT DISTINCT dw.doc_id, dw.pos, dw.k, bw.item_id, bw.ipos FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, k, pos - ipos ORDER BY pos) AS run FROM m),
runs AS (SELECT doc_id, min(pos) - 1 AS first_at, count(*) + min(k) - 1 AS n
         FROM g GROUP BY doc_id, item_id, k, pos - ipos, run),
top AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id),
best AS (SELECT r.doc_id, min(r.n) AS longest, min(r.first_at) AS longest_at
         FROM runs r JOIN top t ON r.doc_id = t.doc_id AND r.n = t.longest GROUP BY r.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(best.longest, 0) AS BIGINT) AS longest_match, CAST(coalesce(best.longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
LEFT JOIN best ON d.doc_id = best.doc_id
""",
)
def op9(spark, d):
    found = decontaminate.find_matches(table(spark, d, "documents"), table(spark, d, "benchmark"), ["doc_id"])
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_of(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
        F.col("longest_at"),
    )


@query("op10_quality_classifier")
def op10(spark, d):
    docs = table(spark, d, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, d, "labels")), ["doc_id"])
    good = (F.col("score") >= quality.GOOD).cast("int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", good.alias("predicted"))


@query(
    "op11_embedding_near_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings
          UNION SELECT l.w, reach.r FROM reach JOIN links l ON reach.vec_id = l.u),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.u = c.vec_id
""",
)
def op11(spark, d):
    return embedding_dedup.near_vectors(table(spark, d, "embeddings"))


@query(
    "op12_spelling_variants",
    r"""
WITH RECURSIVE bits AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT),
      [CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT) FOR j IN range(length(x) // 2)]),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM counted), crc),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w
        FROM hashed) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
first AS (SELECT p.word, min(p.near) AS form FROM pairs p JOIN best b ON p.word = b.word AND p.near_n = b.top GROUP BY p.word),
forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * v.n THEN first.form END AS form,
                 CASE WHEN b.top >= 10 * v.n THEN b.top END AS form_n
          FROM v LEFT JOIN best b ON v.word = b.word LEFT JOIN first ON v.word = first.word),
chain AS (SELECT word, word AS far FROM forms
          UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.far = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.far AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.far AND e.form IS NULL
""",
)
def op12(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"))


@query(
    "op13_phrase_collocations",
    r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ph
      FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, ph, array_to_string(ph, ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
inside AS (SELECT lang, array_to_string(ph[i:i + m - 1], ' ') AS phrase, max(a) AS most
           FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, x.j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) x JOIN c ON x.lang = c.lang AND x.phrase = c.phrase
         JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ph[1:x.j], ' ')
         JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ph[x.j + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT low.* FROM low LEFT JOIN inside i ON low.lang = i.lang AND low.phrase = i.phrase
         WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n,
       CAST(score AS BIGINT) AS score
FROM kept JOIN n ON kept.lang = n.lang QUALIFY rank <= 2000
""",
)
def op13(spark, d):
    return collocations.collocations(table(spark, d, "documents"))
