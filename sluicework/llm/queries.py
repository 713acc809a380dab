"""The registered queries of this subpackage, each beside the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_chunks, decontaminate, hard_negatives, html_main, language_id, merkle, quality_rules, shingle_join, simhash_gray, suffix_dedup, token_files, toxicity, url_filter
from .common import reachable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary() -> str:
    """The vocabulary file of the queries that make token ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(reachable(spark), sf_dir)
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return register


# ---- 5: quality rules -------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))


def _broken_sql() -> str:
    parts = []
    for rule in quality_rules.RULES:
        outside = [f"{rule.measure} {sign} {limit}" for sign, limit in (("<", rule.low), (">", rule.high)) if limit is not None]
        parts.append(f"CASE WHEN {' OR '.join(outside)} THEN '{rule.name}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_SPACE = r"[\x20\x09-\x0D]"
_QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_ellipses
  FROM w LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbols_per_word,
         CASE WHEN n_words >= {quality_rules.STOP_MIN_WORDS} THEN n_stop_words / n_words END AS stop_words_per_word, n_dup_lines / nullif(n_lines, 0) AS duplicate_lines,
         n_bullets / nullif(n_lines, 0) AS bullet_lines, n_ellipses / nullif(n_lines, 0) AS ellipsis_lines
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len({_broken_sql()}) = 0 AS kept, n_stop_words,
       array_to_string({_broken_sql()}, ',') AS failed_rules
FROM r"""


@query(_QUALITY_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and threshold rules over every document."""
    judged = quality_rules.quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


# ---- 6: URL filters ---------------------------------------------------------------------------

#: Host labels whose pages make up the list of the query: it grows with the table.
SPAM_HOST = r"(casino|pills|viagra|jackpot)"
_HOST = "translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _fits(rule: url_filter.HostRule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


_BY_LENGTH = sorted(url_filter.RULES, key=lambda r: (-len(r.text), -len(r.host), r.text))
_RULE = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _BY_LENGTH) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _BY_LENGTH) + " END"
_URL_SQL = rf"""
WITH h AS (SELECT page_id, url, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM pages),
c AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))) AS params FROM h),
u AS (
  SELECT page_id, host, path, CASE WHEN url LIKE '%://%' THEN
           regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url
  FROM c),
spam AS (SELECT DISTINCT canonical_url FROM u WHERE regexp_matches(host, '{SPAM_HOST}') AND canonical_url IS NOT NULL),
v AS (
  SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS ruled,
         coalesce(canonical_url IN (SELECT canonical_url FROM spam), FALSE) AS hit FROM u)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict,
       hit AND ruled IS NULL AS listed
FROM v"""


@query(_URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL against the rules, then against the list of URLs on spam hosts."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(SPAM_HOST))
    return url_filter.judge_urls(pages, listed)


# ---- 2, 3, 4, 7, 8, 9, 10: no SQL; tested against brute force, round trips and held-out rows ---------------

@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to compressed files and read back."""
    return token_files.written_and_read(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of the documents that a repeated 400-byte string covers, cut out."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by reuse of chunks and decoded again."""
    return bpe_chunks.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that the document holds."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query()
def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that link."""
    return simhash_gray.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("mark")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query()
def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


# ---- 12: Merkle manifest ------------------------------------------------------------------------

#: Levels that the SQL unrolls: 8 ** 7 rows a language, 8 ** 3 languages. The operator has no such bound.
_LEAF_LEVELS, _TOP_LEVELS = 7, 3


def _sha_sql(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns) + ")"


def _levels_sql(name: str, group: str, levels: int) -> str:
    """CTEs name0 (group, nr, h) upwards: g{k} has the children of each node, name{k+1} the nodes of trees that go on."""
    parts = []
    for k in range(levels):
        parts.append(f"g_{name}{k} AS (SELECT {group}, nr >> 3 AS up, list(h ORDER BY nr) AS kids FROM {name}{k} "
                     f"WHERE {group} IN (SELECT {group} FROM {name}{k} GROUP BY 1 HAVING COUNT(*) > 1) GROUP BY 1, 2)")
        parts.append(f"{name}{k + 1} AS (SELECT {group}, up AS nr, sha256(array_to_string(kids, '')) AS h FROM g_{name}{k})")
    return ",\n".join(parts)


def _climb_sql(name: str, group: str, levels: int, start: str, at: str, tag: str) -> tuple[str, str]:
    """CTEs that carry proof (texts) and acc (folded digest) of each leaf up one level after the other."""
    parts, last = [], start
    for k in range(levels):
        here, pos = f"{tag}{k}", f"(({at} >> {3 * k}) & 7)"
        parts.append(
            f"{here} AS (SELECT t.* REPLACE (proof || coalesce(array_to_string(kids[:{pos}] || kids[{pos} + 2:], ''), '') AS proof, "
            f"CASE WHEN kids IS NULL THEN acc ELSE sha256(array_to_string(kids[:{pos}] || [acc] || kids[{pos} + 2:], '')) END AS acc) "
            f"FROM {last} t LEFT JOIN g_{name}{k} g ON t.{group} = g.{group} AND t.{at} >> {3 * k + 3} = g.up)")
        last = here
    return ",\n".join(parts), last


_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: "
        "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")
_UP, _LAST = _climb_sql("n", "tree", _LEAF_LEVELS, "start", "nr", "c")
_UP_TOP, _LAST_TOP = _climb_sql("m", "one", _TOP_LEVELS, _LAST, "top_at", "d")
_MERKLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sha_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_sha_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS lowered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nr FROM leaves),
n0 AS (SELECT tree, nr, leaf AS h FROM placed),
{_levels_sql('n', 'tree', _LEAF_LEVELS)},
every AS ({' UNION ALL '.join(f'SELECT {k} AS level, * FROM n{k}' for k in range(_LEAF_LEVELS + 1))}),
subroots AS (SELECT tree, subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS top_at
  FROM (SELECT tree, arg_max(h, level) AS subroot FROM every WHERE nr = 0 GROUP BY tree)),
m0 AS (SELECT 1 AS one, top_at AS nr, subroot AS h FROM subroots),
{_levels_sql('m', 'one', _TOP_LEVELS)},
tops AS ({' UNION ALL '.join(f'SELECT {k} AS level, * FROM m{k}' for k in range(_TOP_LEVELS + 1))}),
start AS (SELECT doc_id, leaf, subroot, p.tree, nr, top_at, 1 AS one, '' AS proof, coalesce(lowered, leaf) AS acc
  FROM placed p JOIN subroots s ON p.tree = s.tree),
{_UP},
{_UP_TOP}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM {_LAST_TOP}, (SELECT h AS root FROM tops WHERE nr = 0 ORDER BY level DESC LIMIT 1)"""


@query(_MERKLE_SQL)
def op12_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and folded root, a third of them tampered with."""
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    return merkle.verified(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


# ---- 13: hard-negative mining -------------------------------------------------------------------

_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


@query(_NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are off by one."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


# ---- 11: n-gram Jaccard join --------------------------------------------------------------------

_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 85 * (x.n + y.n - COUNT(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, MIN(r.v) AS component_id
FROM w JOIN reach r ON r.u = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n"""


@query(_JOIN_SQL)
def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size of every document and the class of those that link."""
    return shingle_join.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
