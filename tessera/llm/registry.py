"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_windows, divergence, fingerprints, lexical_search, line_dedup, near_dedup, packing, pieces, quality_classifier, quality_rules, shared, suffix_dedup, token_files, toxicity

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_cascade(shared.documents(spark, sf_dir)).drop("rejected_by")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(shared.documents(spark, sf_dir))


def op3_best_fit_packing(spark, sf_dir):
    return packing.best_fit_pack(shared.documents(spark, sf_dir), shared.tokenizer_path(WORD_BPE))


def op4_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(shared.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_toxicity(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_sentencepiece(spark, sf_dir):
    return pieces.encode_pieces(shared.documents(spark, sf_dir), shared.tokenizer_path(PIECE_BPE), keep_ids=False)


def op7_chat_windows(spark, sf_dir):
    """All conversations and conversation -1, whose texts look like a template's marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_windows.digests(chat_windows.read_windows(chat_windows.format_conversations(rows.unionByName(odd))))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(shared.documents(spark, sf_dir), words=3, pct=85)


def op9_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(shared.documents(spark, sf_dir))


def op10_token_files(spark, sf_dir):
    return token_files.token_file_round_trip(shared.documents(spark, sf_dir), shared.tokenizer_path(WORD_BPE))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.ranked_documents(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_quality_classifier(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(shared.documents(spark, sf_dir))


def queries():
    return {"op1_quality_rules": op1_quality_rules, "op2_suffix_dedup": op2_suffix_dedup, "op3_best_fit_packing": op3_best_fit_packing, "op4_line_dedup": op4_line_dedup, "op5_toxicity": op5_toxicity, "op6_sentencepiece": op6_sentencepiece, "op7_chat_windows": op7_chat_windows, "op8_minhash_near_dedup": op8_minhash_near_dedup, "op9_fingerprints": op9_fingerprints, "op10_token_files": op10_token_files, "op11_lexical_search": op11_lexical_search, "op12_quality_classifier": op12_quality_classifier, "op13_source_divergence": op13_source_divergence}


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM (
    SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, array_to_string(list_slice(ws, i, i + 4), ' ') AS five FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, text, ws, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_n, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower_n,
    length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
    coalesce(list_max(map_values(list_histogram(ws))), 0) AS top_n
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 0 AND 10 * n_dup_lines > 3 * len(ls))
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR upper_n > lower_n OR 2 * letters < word_chars OR 10 * top_n > 4 * n_words) AS kept
FROM b
"""
#: Lines of one word or more if equal, of six or more within one word's edit.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), c AS (
  SELECT * FROM (SELECT doc_id, no, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l) WHERE len(ws) >= 1
), f AS (SELECT ws, min([doc_id, no]) AS place FROM c GROUP BY ws),
g AS (SELECT ws, place, len(ws) AS n FROM f WHERE len(ws) >= 6),
v AS (SELECT place, i, list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, len(ws))) AS k FROM (SELECT ws, place, unnest(range(1, n + 1)) AS i FROM g) u),
near AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY k, i) AS m FROM v) WHERE m < place
  UNION SELECT v.place FROM v JOIN g ON g.ws = v.k WHERE g.place < v.place
  UNION SELECT g.place FROM v JOIN g ON g.ws = v.k WHERE v.place < g.place
), gone AS (
  SELECT c.doc_id, c.no FROM c JOIN f ON f.ws = c.ws LEFT JOIN near ON near.place = f.place WHERE near.place IS NOT NULL OR f.place < [c.doc_id, c.no]
), o AS (
  SELECT l.doc_id, count(*) AS n_lines, CAST(count(gone.no) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM o
"""
OP7_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text, (length(text) + 3) // 4 + 8 AS tok FROM base
), p AS (
  SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) - tok AS before,
    length('<turn|' || i || '|c|' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '&bar;') || '>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</turn>' || chr(10)) AS len FROM r
), s AS (
  SELECT conv_id, (role = 'system')::INT AS sys, CASE WHEN role = 'system' THEN tok ELSE 0 END AS systok, CASE WHEN role = 'system' THEN len ELSE 0 END AS syslen FROM p WHERE i = 0
), scan AS (
  SELECT conv_id, CAST(sys AS BIGINT) AS i, CAST(systok AS HUGEINT) AS at, CAST(sys AS BIGINT) AS start FROM s
  UNION ALL
  SELECT c.conv_id, c.i + 1, CASE WHEN p.before + p.tok - c.at > greatest(1, 768 - s.systok) AND c.i + 1 > c.start THEN p.before ELSE c.at END,
    CASE WHEN p.before + p.tok - c.at > greatest(1, 768 - s.systok) AND c.i + 1 > c.start THEN c.i + 1 ELSE c.start END
  FROM scan c JOIN p ON p.conv_id = c.conv_id AND p.i = c.i + 1 JOIN s ON s.conv_id = c.conv_id
), w AS (
  SELECT DISTINCT scan.conv_id, start, sys, syslen FROM scan JOIN s ON s.conv_id = scan.conv_id WHERE start > sys
), extra AS (
  SELECT w.conv_id, sum(syslen + CASE WHEN start - 2 >= sys AND a.before - b2.before <= 256 THEN b1.len + b2.len WHEN start - 1 >= sys AND a.before - b1.before <= 256 THEN b1.len ELSE 0 END) AS more
  FROM w JOIN p a ON a.conv_id = w.conv_id AND a.i = start LEFT JOIN p b1 ON b1.conv_id = w.conv_id AND b1.i = start - 1 LEFT JOIN p b2 ON b2.conv_id = w.conv_id AND b2.i = start - 2 GROUP BY w.conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(len) AS len FROM p GROUP BY conv_id
)
SELECT g.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(len + coalesce(more, 0) AS BIGINT) AS formatted_chars FROM g LEFT JOIN extra ON extra.conv_id = g.conv_id
"""
#: Words are runs of other than ASCII white space; A-Z alone are lower-cased.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), f AS (SELECT doc_id, unnest(sh) AS x FROM s),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT p.a, p.b FROM pair p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (len(x.sh) + len(y.sh) - p.n)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.d
), comp AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN comp ON comp.d = s.doc_id
"""
OP11_SQL = r"""
WITH terms AS (
  SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL)
), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM terms GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM (SELECT doc_id, any_value(n) AS n FROM tf GROUP BY doc_id)),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
q AS (
  SELECT item_id, term, count(*) AS qn FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), corpus GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (gn.total + 5 * v.v) AS p,
    1 + (1000000000 * (kept.n + 5)::HUGEINT) // (v.total + 5 * v.v) AS q
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql():
    return {"op1_quality_rules": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_chat_windows": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL, "op13_source_divergence": OP13_SQL}
