"""One registered query per operator, over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import (
    hard_negatives,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pruned_graph,
    quality_rules,
    secret_scan,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_filters,
    whitening,
)
from promptloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Target weights of the mixture: domains, then languages within them; sources weigh what they hold.
WEIGHTS = {
    ("web",): 0.4,
    ("curated",): 0.6,
    **{(d, lang): w for d in ("web", "curated") for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))},
}


def domain() -> Column:
    """The tree's first level: one large crawl, and everything else."""
    return F.when(F.col("source") == "src0", "web").otherwise("curated")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages: runs of repeated sentences of ``line_dedup.LEAST_RUN`` words, whole copies at any length."""
    return line_dedup.dedup(table(spark, sf_dir, "documents"), least_words=1, sentences=True, least_run=line_dedup.LEAST_RUN)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the fixed patterns, their digest, and all spans with those of the battery. A null text has none."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line statistics of every document, whether the base rules fail, and the verdict of the outlier test."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a 100-byte string which starts earlier, and the digest of what is left."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; rows held out by their id are scored by a model that has not seen their labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, linked by four-word shingles at 85 %."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for the target weights, of 80 % of all tokens and two epochs at most."""
    docs = table(spark, sf_dir, "documents")
    return mixing.copies(docs, WEIGHTS, most_epochs=2, share=0.8, seed=7, domain=domain())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match pieces of every document over a byte-level vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_vector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, at a cosine of 0.93 within its label."""
    return vector_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all others, by Euclidean distance."""
    vectors = table(spark, sf_dir, "embeddings")
    return pruned_graph.search(pruned_graph.build(vectors), vectors.where("vec_id % 100 = 0"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; the label of every seventh is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 50 = 0")


REGISTERED: tuple[Query, ...] = (
    op1_line_dedup,
    op2_secret_scan,
    op3_quality_rules,
    op4_suffix_dedup,
    op5_toxicity,
    op6_ngram_join,
    op7_mixing,
    op8_token_counts,
    op9_packing,
    op10_vector_filters,
    op11_graph_search,
    op12_whitening,
    op13_hard_negatives,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in REGISTERED}


# --- SQL, where SQL can say it ---------------------------------------------------------------------

_NORMALISED = r"""trim(regexp_replace(lower(unit),
  '[\x20\x09-\x0D,.;:!?]*(?:[\x20\x09-\x0D]|$)[\x20\x09-\x0D]*', ' ', 'g'))"""

_SENTENCES = rf"""string_split(regexp_replace(line, '([.!?][\x20\x09\x0B-\x0D])', concat('\1', chr(57344)), 'g'), chr(57344))"""

_LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d),
  s AS (SELECT doc_id, line_no, unnest({_SENTENCES}) AS unit, generate_subscripts({_SENTENCES}, 1) AS sentence_no, len({_SENTENCES}) AS sentences FROM l),
  u AS (SELECT *, row_number() OVER w AS pos, CAST(coalesce(sum(length(unit) + CASE WHEN sentence_no = sentences THEN 1 ELSE 0 END)
    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, sentence_no)),
  n AS (SELECT *, {_NORMALISED} AS norm FROM u),
  k AS (SELECT doc_id, pos, length(norm) - length(replace(norm, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth,
    count(*) OVER (PARTITION BY doc_id) AS of_all, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS again FROM n WHERE norm <> ''),
  i AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM k WHERE again),
  r AS (SELECT doc_id, pos, sum(words) OVER run >= {line_dedup.LEAST_RUN} OR count(*) OVER run = of_all AS goes
    FROM i WINDOW run AS (PARTITION BY doc_id, run)),
  j AS (SELECT n.*, r.goes IS NOT NULL AS again, coalesce(goes, false) AS goes FROM n LEFT JOIN r USING (doc_id, pos)),
  t AS (SELECT doc_id, line_no, string_agg(unit, '' ORDER BY pos) AS line FROM j WHERE NOT goes GROUP BY doc_id, line_no),
  x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM t GROUP BY doc_id)
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (again) AS n_repeated, count(*) FILTER (goes) AS n_removed,
    coalesce(string_agg(concat(begins, ':', begins + length(unit)), ',' ORDER BY pos) FILTER (goes), '') AS spans,
    coalesce(any_value(x.text), '') AS text FROM j LEFT JOIN x USING (doc_id) GROUP BY doc_id"""


def _reached(nodes: str, links: str) -> str:
    """Common table expressions: the smallest node that the links of each node reach."""
    return f"""reach AS (SELECT {nodes} AS x, {nodes} AS y FROM ids UNION
    SELECT reach.x, l.b FROM reach JOIN {links} l ON reach.y = l.a),
  least AS (SELECT x AS {nodes}, min(y) AS component_id FROM reach GROUP BY x)"""


_JOIN = rf"""WITH RECURSIVE ids AS (SELECT doc_id FROM documents),
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  both_ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  {_reached('doc_id', 'both_ways')}
  SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN least USING (doc_id)"""

_VECTORS = f"""WITH RECURSIVE ids AS (SELECT vec_id FROM embeddings),
  v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
  {_reached('vec_id', 'p')},
  n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
  FROM ids LEFT JOIN n USING (vec_id) JOIN least USING (vec_id)"""

_NEGATIVES = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; what is missing is tested against brute force, exact round trips or held-out rows."""
    return {"op1_line_dedup": _LINES, "op6_ngram_join": _JOIN, "op10_vector_filters": _VECTORS, "op13_hard_negatives": _NEGATIVES}
