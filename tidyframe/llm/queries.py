"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, divergence, exact_dedup, hyper_minhash, language_model, lexical_search, pieces, simhash, token_count, toxicity, url_filter, warc
from .shared import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 64-bit fingerprints of 4-word shingles differ in 4 bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, bits=64, radius=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by byte-level BPE, and which have more than 512."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids, begin and end among them, and of the text decoded from these."""
    return pieces.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages' URLs."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations and one of control strings."""
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_chats(chat.format_chats(turns.withColumn("content", chat.text_part(F.col("text")))))
    lines = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts; the row with the largest doc_id stays."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="most")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold: digests of the payloads read back, and which records refer to which."""
    path = shared_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("bigint")
    whole = F.col("record_type") == "response"
    digest = F.when(whole, warc.base32(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    return read.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        F.when(~whole, page("refers_to")).alias("refers_to"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out seventh."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = language_model.score_texts(_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows outside the held-out third."""
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    judged = toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~fold("doc_id"))
    return judged.select("doc_id", fold("doc_id").alias("held_out"), "score", "predicted")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms differ from those of its language's other sources, and which terms do most."""
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.85 or more."""
    return hyper_minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=5, similarity=0.85)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return lexical_search.best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_simhash, op3_token_counts, op4_sentencepiece, op5_url_filters, op6_chat_format, op7_exact_dedup, op8_warc, op9_lm_scoring, op10_toxicity, op11_divergence, op12_hyper_minhash, op13_lexical_search)
}


def _words(key: str, table: str) -> str:
    """SQL for the words (id, w) of a table's texts."""
    words = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return f"SELECT {key} AS id, string_split({words}, ' ') AS w FROM {table} WHERE {words} <> ''"


def _grams(words: str) -> str:
    """SQL for the distinct shingles (id, g) of k words from rows (id, w, k)."""
    return f"SELECT DISTINCT id, list_slice(w, i, i + k - 1) AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM {words})"


def _terms(pattern: str) -> str:
    """SQL for the list of a text's matches of a pattern, only A-Z lower-cased."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


_TERM = "regexp_matches(u, '(^|[^a-z0-9]){}($|[^a-z0-9])')"


def _escaped(column: str) -> str:
    """SQL for what ``chat.escape`` gives."""
    sql = f"replace(replace({column}, '\\', '\\\\'), '</turn>', '<\\/turn>')"
    for kind in chat.ATTACHED:
        sql = f"replace({sql}, '<|{kind}|>', '<\\|{kind}|>')"
    return f"replace({sql}, '### ', '#\\## ')"


ORACLE_SQL = {
    "op1_decontamination": f"""
WITH bw AS (SELECT *, least(len(w), 5) AS k FROM ({_words("item_id", "benchmark")})),
     dw AS (SELECT * FROM ({_words("doc_id", "documents")}), (SELECT DISTINCT k FROM bw)),
     d AS ({_grams("dw")}), b AS ({_grams("bw")}),
     n AS (SELECT id, count(*) AS item_shingles FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS matched, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM d JOIN b ON d.g = b.g JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(item_shingles) - 1e-9""",
    "op5_url_filters": f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
r AS (SELECT *, CASE WHEN host = 'www.example.com' AND starts_with(path, '/en/') OR ends_with(host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN {" OR ".join(_TERM.format(t) for t in url_filter.STRICT)} THEN 'block'
            WHEN {" + ".join(_TERM.format(t) + "::INT" for t in url_filter.SOFT)} >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op6_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, {_escaped("text")} AS said FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(said) + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to
FROM d""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    "op11_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_terms(divergence.TERM)} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + l.v) AS p
      FROM n JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q FROM k JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 200""",
    "op12_hyper_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_terms(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op13_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms(lexical_search.TERM)} AS w FROM documents),
own AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_terms(lexical_search.TERM)}) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM own),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, big_n),
scored AS (SELECT item_id, doc_id, r, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
           FROM i JOIN t USING (term) JOIN f USING (term) JOIN own USING (r), s GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
