"""The queries of the ten operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import backoff, decontaminate, fixity, jaccard, langid, pieces, quality, quotelink, toxicity, wrapper
from seriesloom.llm.common import remainder, table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer file is; executors have the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrapper.apply(pages, wrapper.induce(pages), ["page_id", "url"])


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 5) == 1
    docs = table(spark, sf_dir, "documents")
    out = backoff.score(docs, ~held, backoff.block_of(docs))
    # sums of logarithms depend on their order in the last digits
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.filter(remainder("doc_id", 5) != 0))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, language_model(docs), carry=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op4_quotelink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links all of ``conversations``, whose texts are first made to quote the turns before (the table itself holds no quote)."""
    return quotelink.link(quotelink.with_quotes(table(spark, sf_dir, "conversations")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_path(), carry=["doc_id"])


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of ``pages`` that storage has harmed in place in a known way; one row per record of the sound replica."""
    recs = fixity.records(table(spark, sf_dir, "pages"))
    turn = F.pmod(F.col("number"), F.lit(97))
    half = F.expr("substring(record, 1, cast(length(record) div 2 as int))")
    harmed = F.when(turn == 6, F.concat("record", F.lit(" "))).when(turn == 7, half).otherwise(F.col("record"))
    away = F.when(turn == 8, 512).otherwise(0)
    both = fixity.place(recs.withColumn("sha_b", F.sha2(harmed.cast("binary"), 256)))
    place = ["number", "file", "offset", "length", "sha256"]
    found = fixity.audit(both.select(*place), both.filter(turn != 5).select("number", "file", (F.col("offset") + away).alias("offset"), "length", F.col("sha_b").alias("sha256")))
    out = both.select(*place).join(found, "number", "left")
    return out.select(F.col("number").alias("page_id"), "file", "offset", "length", "sha256", F.coalesce("status", F.lit("sound")).alias("status"))


OP6_SQL = """
WITH body AS (SELECT coalesce(page_id, -1) AS page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
sized AS (SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS file, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256 FROM body)
SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha256, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, sha256, CASE page_id % 97 WHEN 5 THEN 'missing' WHEN 6 THEN 'damaged' WHEN 7 THEN 'damaged' WHEN 8 THEN 'moved' ELSE 'sound' END AS status
FROM sized"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontaminate.contaminated().alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    out = toxicity.rate(docs, model, carry=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_wrapper, op2_backoff, op3_langid, op4_quotelink, op5_pieces, op6_fixity, op7_quality, op8_jaccard, op9_decontaminate, op10_toxicity)}

_LOW = "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, member: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_LOW.upper()}', '{_LOW}'), '{member}')"


def jaccard_sql(size: int = jaccard.SIZE, least: tuple[int, int] = jaccard.LEAST) -> str:
    """All pairs that share a shingle, counted; components by walking along links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
link AS (SELECT a, b FROM common WHERE {least[1]} * c >= {least[0]} * (n + m - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN ways x ON r.b = x.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM ways GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.b AS component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM sets s JOIN least l ON s.doc_id = l.a LEFT JOIN links k ON s.doc_id = k.a"""


def decontaminate_sql(window: int = decontaminate.WINDOW) -> str:
    """Every window of every item looked up among every document's windows of as many words."""
    member = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    runs = "unnest(list_transform(range(1, len(ws) - k + 2), lambda i: {{'p': i, 'x': array_to_string(ws[i:i + k - 1], ' ')}}))".replace("{{", "{").replace("}}", "}")
    return f"""
WITH d AS (SELECT doc_id, {_words("text", member)} AS ws FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_words("text", member)} AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, k, r.x AS x FROM (SELECT item_id, k, {runs} AS r FROM (SELECT *, least(len(ws), {window}) AS k FROM i WHERE len(ws) > 0))),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, r.p AS p, r.x AS x FROM (SELECT doc_id, k, {runs} AS r FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT DISTINCT w.doc_id, w.k, w.p, j.item_id FROM dw w JOIN iw j ON w.k = j.k AND w.x = j.x),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN words w ON d.doc_id = w.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id"""


#: crc32 of doc_id as text, bit by bit (DuckDB has no such function).
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL: dict[str, str] = {"op2_backoff": backoff.sql(f"{CRC} % 5 <> 1", f"{CRC} % 5 = 1"), "op4_quotelink": quotelink.sql(quotelink.QUOTES_SQL), "op6_fixity": OP6_SQL, "op8_jaccard": jaccard_sql(), "op9_decontaminate": decontaminate_sql()}
