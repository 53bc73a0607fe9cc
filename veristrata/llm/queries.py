"""The registered queries of this subpackage: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, html_text, jaccard_join, mixing, pii, quality, sentencepiece_bpe, token_counts, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [pii.number("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.sentencepiece_roundtrip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_exact_dedup, op4_html_text, op5_quality, op6_url_filter, op7_embedding_dedup, op8_jaccard_join, op9_mixing, op10_token_counts)}


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


_COMPONENTS = """e AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
cc(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, cc.root FROM cc JOIN e ON cc.node = e.u),
comp AS (SELECT node, min(root) AS component_id FROM cc GROUP BY node)"""

OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
{_COMPONENTS},
deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT x.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, x.vec_id) AS component_id, x.vec_id = coalesce(component_id, x.vec_id) AS kept
FROM embeddings x LEFT JOIN deg ON x.vec_id = deg.a LEFT JOIN comp ON x.vec_id = comp.node
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp ON d.doc_id = comp.node
"""


def _fill_sql(name: str, source: str, parent: str, child: str, budget: str, cap: str, weight: str, out: str, carry: str) -> str:
    """CTE `name`: the budget of each parent split among its children by water filling."""
    return f"""{name}_o AS (SELECT *, CASE WHEN {weight} > 0 THEN {cap} / {weight} ELSE -1.0 END AS r_, CASE WHEN {weight} > 0 THEN {weight} ELSE 0.0 END AS w_, CASE WHEN {weight} > 0 THEN {cap} ELSE 0.0 END AS c_ FROM {source}),
{name}_l AS (SELECT *, ({budget} - coalesce(sum(c_) OVER (PARTITION BY {parent} ORDER BY r_, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / nullif(sum(w_) OVER (PARTITION BY {parent} ORDER BY r_, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level_ FROM {name}_o),
{name}_f AS (SELECT *, max(CASE WHEN NOT coalesce(level_ >= r_, true) THEN level_ END) OVER (PARTITION BY {parent}) AS first_ FROM {name}_l),
{name} AS (SELECT {carry}, CASE WHEN coalesce(level_ >= r_, true) THEN c_ ELSE greatest(0.0, least(c_, first_ * w_)) END AS {out} FROM {name}_f)"""


def _weight_sql(weights: dict[str, float], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v!r}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


OP9_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS digit, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens FROM documents),
r AS (SELECT doc_id, CASE WHEN digit IN ('7', '8') THEN 'code' WHEN digit = '9' THEN 'books' ELSE 'web' END AS domain, lang, source, n_tokens FROM t),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap, 1.0::DOUBLE AS w_s FROM r GROUP BY ALL),
la AS (SELECT domain, lang, sum(cap) AS cap_l, {_weight_sql(mixing.LANG_WEIGHTS, 'lang')} AS w_l FROM leaf GROUP BY domain, lang),
dm AS (SELECT domain, sum(cap_l) AS cap_d, 0 AS top, {_weight_sql(mixing.DOMAIN_WEIGHTS, 'domain')} AS w_d, sum(sum(cap_l)) OVER () * ({mixing.BUDGET_FRACTION / mixing.MAX_EPOCHS!r}::DOUBLE) AS root FROM la GROUP BY domain),
{_fill_sql("bd", "dm", "top", "domain", "root", "cap_d", "w_d", "budget_d", "domain")},
lb AS (SELECT la.*, budget_d FROM la JOIN bd USING (domain)),
{_fill_sql("bl", "lb", "domain", "lang", "budget_d", "cap_l", "w_l", "budget_l", "domain, lang")},
sb AS (SELECT leaf.*, budget_l FROM leaf JOIN bl USING (domain, lang)),
{_fill_sql("bs", "sb", "domain, lang", "source", "budget_l", "cap", "w_s", "budget", "domain, lang, source, tokens")},
e AS (SELECT r.*, CAST(floor(budget) AS BIGINT) AS leaf_budget, tokens, epoch FROM r JOIN bs USING (domain, lang, source), range(1, {mixing.MAX_EPOCHS + 1}) x(epoch)),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat_ws(':', '{mixing.SEED}', epoch, coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, CAST(sum(CASE WHEN run <= leaf_budget - (epoch - 1) * tokens AND leaf_budget - (epoch - 1) * tokens > 0 THEN 1 ELSE 0 END) AS BIGINT) AS copies
FROM q GROUP BY doc_id, domain, lang, source, n_tokens, leaf_budget
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op7_embedding_dedup": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op9_mixing": OP9_SQL}
