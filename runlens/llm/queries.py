"""The registered queries of the corpus operators, with DuckDB SQL where that can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, decontaminate, langid, licenses, linededup, neardup, spelling, sptok, tokencount, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 in another layout, formatted and read back."""
    rows = chat.turn_rows(_read(spark, sf_dir, "conversations"))
    trap = "\\### Assistant: </turn> ok"
    one = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(trap).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("json"),
    )
    one = chat.from_json_records(one, "json").select("conv_id", "record")
    back = chat.read_back(chat.format_turns(chat.canonical(rows.unionAll(one), "record")))
    whole = F.array_join(F.transform("turns_back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns_back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') AS name FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(name) + 16)::BIGINT AS formatted_chars,
  CASE WHEN conv_id = -7 THEN 'messages' ELSE 'turn rows' END AS layout
FROM e GROUP BY conv_id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in an occurrence of ten consecutive words of a benchmark item."""
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and the records read back from them."""
    archives = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(url, 'about:blank') AS url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, n >= 100 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST, url))
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f
"""


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a source tree: every 50th is a licence file of its directory, the rest stand one deeper."""
    docs = _read(spark, sf_dir, "documents")
    top = F.concat_ws("/", "source", F.expr("CAST(pmod(doc_id div 50, 10) AS string)"))
    path = F.when(F.expr("pmod(doc_id, 50) = 0"), F.concat_ws("/", top, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string")))).otherwise(F.concat_ws("/", top, F.expr("CAST(pmod(doc_id, 7) AS string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    found = licenses.inherit(licenses.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")))
    return found.select(F.col("file_id").alias("doc_id"), "own", F.round("score", 6).alias("score"), "license", "inherited_from")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised into flat files, and the tokens of each counted by scanning these for separators."""
    placed = tokencount.write_token_files(_read(spark, sf_dir, "documents"))
    return placed.join(tokencount.count_tokens(placed), ["path", "ordinal"]).select("doc_id", "n_tokens")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(_remainder(5) > 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.predict(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    return sptok.round_trip(_read(spark, sf_dir, "documents")).drop("pieces")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _read(spark, sf_dir, "documents")
    langs, log_p = langid.train(docs.where((_remainder(3) != 1) & (_remainder(3) >= 0)))
    return langid.predict(docs.select("doc_id", "text"), langs, log_p).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, every 199th of which (by a checksum) has lost a letter."""
    # a run that is shorter than a word can't become one
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z\u00C0-\u00FF]{6,})"), F.lit(1))).alias("run")
    runs = _read(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    ascii_ = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.variants(words)


OP11_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT id, run, count(*) AS k FROM r GROUP BY 1, 2),
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
b AS (SELECT id, run, k, hex(encode(id || ':' || run)) AS x FROM u),
s AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
o AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM s),
v AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT DISTINCT word, n, i, CASE WHEN i = 1 THEN '' ELSE word[1 : i - 1] END || word[i + 1 :] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT DISTINCT d.word AS a, d.n AS na, v.word AS b, v.n AS nb FROM d JOIN v ON d.cut = v.word),
p AS (SELECT * FROM one UNION ALL SELECT b, nb, a, na FROM one UNION ALL SELECT x.word, x.n, y.word, y.n FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-nb, b)) AS b, max(nb) AS nb FROM p GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 5 * v.n THEN b END AS form, CASE WHEN nb >= 5 * v.n THEN nb END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT c.word, c.up, f.form FROM chain c JOIN f ON c.up = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain USING (word) WHERE up IS NULL
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in at least ten of them."""
    kept = linededup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH l AS (
  SELECT r, doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))),
f AS (SELECT k FROM (SELECT DISTINCT r, k FROM l WHERE k <> '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY r, doc_id
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language in all documents."""
    return collocations.collocations(_read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words >= 2),
cut AS (SELECT lang, phrase, f, unnest(range(1, words)) AS k, words, w FROM c),
s AS (SELECT x.lang, x.phrase, x.f AS a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * x.f * x.f) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cut x
      JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM c WHERE words = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_neighbours": op9_neighbours,
    "op10_language": op10_language,
    "op11_spelling": op11_spelling,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op3_decontaminate": OP3_SQL, "op5_warc": OP5_SQL, "op11_spelling": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
