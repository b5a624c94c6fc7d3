"""The operators as registered queries over the test tables, with production parameters.

``QUERIES`` and ``ORACLES`` are read by ``__spark_entry__`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm import bpe, chosenpath, exactcopies, lattice, license, merkle, mixing, negatives, pivots, quality, suffixes, tokenfile, toxicity
from corpusql.llm.learning import held_out
from corpusql.session import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the folder is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(
        load(spark, d, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, hidden = load(spark, d, "documents"), held_out("doc_id", 4, 2)
    model = toxicity.train(docs, load(spark, d, "labels"), ~hidden)
    return toxicity.score(docs, model).select("doc_id", hidden.alias("held_out"), "score", "predicted")


@query("op5_quality")
def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, hidden = load(spark, d, "documents"), held_out("doc_id", 5, 0)
    model = quality.train(docs, load(spark, d, "labels"), ~hidden)
    return quality.score(docs, model).select("doc_id", hidden.alias("held_out"), "score", "predicted")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, d: str) -> DataFrame:
    return tokenfile.round_trip(load(spark, d, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


LINKS_SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN low l ON e.vec_id = l.vec_id LEFT JOIN counts c ON e.vec_id = c.vec_id
"""


@query("op2_lattice_near_dedup", LINKS_SQL)
def op2_lattice_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lattice.near_duplicates(load(spark, d, "embeddings"))


TOP_SQL = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op4_pivot_topk", TOP_SQL)
def op4_pivot_topk(spark: SparkSession, d: str) -> DataFrame:
    return pivots.top_k(load(spark, d, "embeddings"), F.col("id") % 50 == 0)


@query("op7_chosen_path_join")
def op7_chosen_path_join(spark: SparkSession, d: str) -> DataFrame:
    return chosenpath.join(load(spark, d, "documents"))


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    cut = suffixes.remove_repeats(load(spark, d, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license.scan(load(spark, d, "documents"))


# The tree of the test tables: sources by their number in three domains.
LEVELS = {
    "domain": r"element_at(array('web', 'books', 'news'), coalesce(try_cast(regexp_extract(source, '(\\d{1,4})', 1) AS INT), 0) % 3 + 1)",
    "lang": "lang",
    "source": "source",
}
WEIGHTS = {
    ("web",): 5, ("books",): 3, ("news",): 2,
    ("web", "en"): 6, ("books", "en"): 4, ("news", "en"): 5,
    ("web", "de"): 2, ("web", "fr"): 2, ("books", "de"): 2, ("books", "fr"): 3,
}


def mix_sql(budget: str, epochs: int, seed: int) -> str:
    """The mixture in SQL: the same rule on plain windows."""
    level = """
{name}_in AS (
  SELECT {own}, sum(tokens) * {epochs} AS capacity, max(w{depth}) AS weight{above_in}
  FROM leaves {join} GROUP BY ALL),
{name}_line AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {last}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(weight) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {last}
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_in),
{name}_full AS (SELECT *, capacity * rest <= weight * (above - taken) AS isfull FROM {name}_line),
{name}_open AS (
  SELECT *, sum(CASE WHEN NOT isfull THEN weight END) OVER (PARTITION BY {parents}) AS ow,
         above - coalesce(sum(CASE WHEN isfull THEN capacity END) OVER (PARTITION BY {parents}), 0) AS ob FROM {name}_full),
{name}_part AS (SELECT *, CASE WHEN isfull THEN capacity ELSE weight * ob // ow END AS part FROM {name}_open),
{name}_out AS (
  SELECT {own}, part + CASE WHEN NOT isfull AND row_number() OVER (PARTITION BY {parents}, isfull ORDER BY {last})
         <= above - sum(part) OVER (PARTITION BY {parents}) THEN 1 ELSE 0 END AS above FROM {name}_part)"""
    names = list(LEVELS)
    steps = []
    for depth in range(1, 4):
        own, parents = names[:depth], names[: depth - 1]
        steps.append(level.format(
            name=f"l{depth}", own=", ".join(own), last=own[-1], parents=", ".join(parents) or "0", depth=depth, epochs=epochs,
            above_in=", above",
            join=f"JOIN l{depth - 1}_out USING ({', '.join(parents)})" if parents else "CROSS JOIN total",
        ))
    case = {1: [], 2: []}
    for path, weight in WEIGHTS.items():
        same = " AND ".join(f"{c} = '{v}'" for c, v in zip(names, path))
        case[len(path)].append(f"WHEN {same} THEN {weight}")
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         ['web', 'books', 'news'][coalesce(try_cast(regexp_extract(source, '(\\d{{1,4}})', 1) AS INTEGER), 0) % 3 + 1] AS domain,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::HUGEINT AS n_tokens FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens,
         (CASE {' '.join(case[1])} ELSE 1 END)::HUGEINT AS w1, (CASE {' '.join(case[2])} ELSE 1 END)::HUGEINT AS w2, 1::HUGEINT AS w3
  FROM docs GROUP BY ALL),
total AS (SELECT least((SELECT sum(n_tokens)::HUGEINT {budget} FROM docs), (SELECT sum(tokens)::HUGEINT * {epochs} FROM leaves)) AS above),
{','.join(steps)},
budgets AS (
  SELECT l.*, o.above AS budget, CASE WHEN tokens > 0 THEN o.above // tokens ELSE 0 END AS whole
  FROM leaves l JOIN l3_out o USING (domain, lang, source)),
placed AS (
  SELECT d.*, b.whole, b.budget - b.whole * b.tokens AS rest,
         md5('{seed}:' || (b.whole + 1) || ':' || coalesce(d.doc_id::VARCHAR, '')) AS place
  FROM docs d JOIN budgets b USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM placed),
counted AS (SELECT *, whole + CASE WHEN whole < {epochs} AND upto <= rest THEN 1 ELSE 0 END AS epochs FROM summed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(1, epochs::BIGINT + 1))::INTEGER AS epoch
FROM counted WHERE epochs > 0
"""


@query("op10_mixing", mix_sql("* 3 // 4", 2, 17))
def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), LEVELS, WEIGHTS, budget_share=(3, 4), max_epochs=2, seed=17)


COPIES_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM texts t JOIN groups g ON t.text = g.text
"""


@query("op13_exact_dedup", COPIES_SQL)
def op13_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exactcopies.copies(load(spark, d, "documents"))


TREE_SQL = """
WITH RECURSIVE
digits AS (
  SELECT doc_id, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT) AS codes
  FROM documents WHERE doc_id IS NOT NULL),
sums AS (
  SELECT doc_id, xor(4294967295::UBIGINT, list_reduce(codes, lambda c, b: {steps}, 4294967295::UBIGINT)) AS crc FROM digits),
rows AS (
  SELECT d.*, coalesce(s.crc % 7 = 0, false) AS hit, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id NULLS FIRST) - 1 AS pos
  FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id),
leaves AS (
  SELECT doc_id, lang, pos, {leaf} AS leaf, CASE WHEN hit THEN {changed} ELSE {leaf} END AS late FROM rows),
trees AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM trees
  WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM trees WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, pos // 2),
walk AS (
  SELECT doc_id, lang, pos AS place, 0 AS level, pos, late, '' AS proof, false AS top FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.place, CASE WHEN t.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN t.n = 1 THEN s.pos ELSE w.pos // 2 END,
         CASE WHEN t.n = 1 THEN w.late WHEN o.digest IS NULL THEN sha256(w.late)
              WHEN w.pos % 2 = 0 THEN sha256(w.late || o.digest) ELSE sha256(o.digest || w.late) END,
         w.proof || CASE WHEN t.n = 1 THEN '' ELSE coalesce(o.digest, '') END, t.n = 1
  FROM walk w JOIN trees t ON NOT w.top AND t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = w.pos
  LEFT JOIN trees o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.pos = xor(w.pos, 1)
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang),
climb AS (
  SELECT doc_id, lang, place, 0 AS level, pos, late, proof FROM walk WHERE top
  UNION ALL
  SELECT c.doc_id, c.lang, c.place, c.level + 1, c.pos // 2,
         CASE WHEN o.digest IS NULL THEN sha256(c.late) WHEN c.pos % 2 = 0 THEN sha256(c.late || o.digest) ELSE sha256(o.digest || c.late) END,
         c.proof || coalesce(o.digest, '')
  FROM climb c JOIN crown t ON t.level = c.level AND t.pos = c.pos AND t.n > 1
  LEFT JOIN crown o ON o.level = c.level AND o.pos = xor(c.pos, 1)),
ended AS (SELECT * FROM climb QUALIFY level = max(level) OVER ()),
root AS (SELECT digest FROM crown WHERE n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.late AS folded_root, e.late = r.digest AS verified
FROM leaves l JOIN ended e ON e.lang IS NOT DISTINCT FROM l.lang AND e.place = l.pos
JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root r
"""


def tree_sql() -> str:
    """Leaves, trees and paths in SQL; crc32 bit by bit."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"

    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))[1]"
    parts = [field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    own, changed = (f"sha256({' || '.join([*parts[:3], n, parts[4]])})" for n in (parts[3], field("(n_chars + 1)")))
    return TREE_SQL.format(steps=step, leaf=own, changed=changed)


@query("op11_merkle_manifest", tree_sql())
def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    later = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string")
    count = F.coalesce(F.concat(F.octet_length(later).cast("string"), F.lit(":"), later), F.lit("-"))
    return merkle.verify(load(spark, d, "documents"), ["doc_id", "source", "lang", count, "text"])


NEGATIVES_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM fit a JOIN fit c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
