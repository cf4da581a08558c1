"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.conversations import damage, repair_digest
from tidemark.llm.decontaminate import LEAKS_SQL, benchmark_leaks
from tidemark.llm.divergence import divergences
from tidemark.llm.jaccard_join import near_copies
from tidemark.llm.language_id import identify
from tidemark.llm.packing import packed_digest
from tidemark.llm.pii import replace_personal_data
from tidemark.llm.quality_bands import judge_quality
from tidemark.llm.rank_tree import coded_digest
from tidemark.llm.substring_dedup import passage_digest
from tidemark.llm.token_lengths import context_limits, length_histogram, token_lengths
from tidemark.llm.toxicity import fit, rate, toxic_grades
from tidemark.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Vocabulary file of the public tokenizer that the token queries take."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY 1) USING (doc_id)"""

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
l AS (SELECT h, max(page_id) AS leader FROM p WHERE strlen(h) >= 1000 GROUP BY 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM p LEFT JOIN l USING (h)"""

PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
wi AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM wi GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM wi JOIN f USING (s), range(0, 13) t(j) WHERE first < doc_id),
wo AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT wo.doc_id, count(gone.i) AS n, string_agg(word, ' ' ORDER BY wo.i) FILTER (gone.i IS NULL) AS kept FROM wo LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


REPAIR_SQL = r"""
WITH RECURSIVE codes AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
names AS (SELECT DISTINCT n FROM (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS n FROM conversations)),
crc(n, rest, c) AS (
  SELECT n, n, CAST(4294967295 AS BIGINT) FROM names
  UNION ALL SELECT n, substr(rest, 2), xor(c >> 8, t[CAST(xor(c, ascii(rest)) & 255 AS INTEGER) + 1]) FROM crc, codes WHERE rest <> ''),
code AS (SELECT n, xor(c, 4294967295) % 20 AS code FROM crc WHERE rest = ''),
hit AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM conversations JOIN code ON n = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM hit),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM placed),
told AS (
  SELECT conv_id, turn, role, text, pos, initial, earlier,
    CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
states AS (SELECT unnest([0, 1, 2, 3]) AS q), gaps AS (SELECT unnest([0, 1, 2]) AS k),
entered AS (SELECT q, k, CASE WHEN k = 0 THEN q WHEN (q = 2) = (k = 1) THEN 3 ELSE 2 END AS e,
  CASE WHEN k = 0 THEN '' WHEN q = 2 THEN left(chr(10) || 'assistant:' || chr(10) || 'user:', 11 + 6 * (k - 1)) ELSE left(chr(10) || 'user:' || chr(10) || 'assistant:', 6 + 11 * (k - 1)) END AS put FROM states, gaps),
moves AS (
  SELECT q, k, put, 'D' AS edit, '' AS initial, 2 AS cost, e AS reached FROM entered
  UNION ALL SELECT q, k, put, 'R', '', 1, CASE e WHEN 2 THEN 3 ELSE 2 END FROM entered
  UNION ALL SELECT q, k, put, 'K', 's', 0, 1 FROM entered WHERE e = 0
  UNION ALL SELECT q, k, put, 'K', 'u', 0, 2 FROM entered WHERE e <> 2
  UNION ALL SELECT q, k, put, 'K', 'a', 0, 3 FROM entered WHERE e = 2),
walk(conv_id, pos, q, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} FROM told
  UNION ALL
  SELECT w.conv_id, t.pos, m.reached, min({'cost': best.cost + 5 * m.k + m.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END, 'audit': best.audit || repeat('I', m.k) || edit,
    'lines': best.lines || put || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE m.reached WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END})
  FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1
    JOIN moves m ON m.q = w.q AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR m.initial = t.initial))
  GROUP BY w.conv_id, t.pos, m.reached),
ends AS (SELECT conv_id, max(pos) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
done AS (
  SELECT e.conv_id, min({'cost': best.cost + CASE q WHEN 2 THEN 5 WHEN 1 THEN 10 ELSE 0 END, 'audit': best.audit || CASE q WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END,
    'lines': best.lines || CASE q WHEN 2 THEN chr(10) || 'assistant:' WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}) AS best
  FROM ends e JOIN walk w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.pos = e.n GROUP BY e.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
lv AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
gt AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM gt GROUP BY 1, 2) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(gt.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(gt.n, 0) + 1)) // (g.n + v) AS p,
  1 + (1000000000::HUGEINT * (k.total + 1)) // (lv.n + v) AS q
  FROM g JOIN lv USING (lang) JOIN k USING (lang) LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pa AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
tp AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pa UNION ALL FROM tp)
QUALIFY part = 'pair' OR rank <= 200"""

@query("op1_jaccard_join", JACCARD_SQL)
def jaccard_join(spark, sf):
    return near_copies(table(spark, sf, "documents"))


@query("op2_token_lengths")
def token_length_limits(spark, sf):
    lengths = token_lengths(table(spark, sf, "documents"), tokenizer())
    return context_limits(length_histogram(lengths))


@query("op3_warc_dictionary", ARCHIVE_SQL)
def warc_dictionary(spark, sf):
    return archived(spark, table(spark, sf, "pages"))


@query("op4_language_filters")
def language_filters(spark, sf):
    return identify(table(spark, sf, "documents"))


@query("op5_compression_bands")
def compression_bands(spark, sf):
    return judge_quality(table(spark, sf, "documents"))


@query("op6_ordinal_toxicity")
def ordinal_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return rate(docs, fit(docs, toxic_grades(table(spark, sf, "labels")), split=3))


@query("op7_best_two_fit")
def best_two_fit(spark, sf):
    return packed_digest(table(spark, sf, "documents"), tokenizer())


@query("op8_substring_dedup", PASSAGES_SQL)
def substring_dedup(spark, sf):
    return passage_digest(table(spark, sf, "documents"))


#: A stand-in; production passes its own secret.
SURROGATE_KEY = "tidemark-surrogates"


@query("op9_surrogates")
def surrogates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return replace_personal_data(docs, SURROGATE_KEY)


@query("op10_spaced_seeds", LEAKS_SQL)
def spaced_seeds(spark, sf):
    return benchmark_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op11_rank_tree")
def rank_tree(spark, sf):
    return coded_digest(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query("op12_edit_lattice", REPAIR_SQL)
def edit_lattice(spark, sf):
    conversations = table(spark, sf, "conversations")
    return repair_digest(damage(conversations), conversations)


@query("op13_count_cells", DIVERGENCE_SQL)
def count_cells(spark, sf):
    return divergences(table(spark, sf, "documents"))
