"""The text operators' queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, gif, jaccard_join, mixing, multiset_hash, rule_ensemble, sharding, site_tree, suffix_dedup, token_coder
from rasterloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Target weights of the mixing query and of the pipeline's stage.
WEIGHTS = {
    "domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 2.0, "domain3": 1.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {"src0": 1.0, "src4": 2.0, "src8": 3.0},
}
MIX = {"fraction": 0.5, "max_epochs": 4, "seed": 17, "weights": WEIGHTS}


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an animated GIF and read back."""
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages that a smaller id has."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op4_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), values=False)


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness."""
    return multiset_hash.compare_edits(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text."""
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after the two-pass shuffle into 40 shards."""
    return sharding.digests(table(spark, sf_dir, "documents"), 40)


def op8_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, read back from the coded files."""
    folder = token_coder.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_coder.read_tokens(spark, folder, values=False)


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those whose shingle sets are alike."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and epochs that the budget tree takes."""
    taken = mixing.epochs(mixing.decide(table(spark, sf_dir, "documents"), **MIX))
    return taken.select("doc_id", F.col("__domain").alias("domain"), F.col("__language").alias("language"), F.col("__leaf").alias("source"), F.col("__tokens").alias("n_tokens"), "mix_epoch")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Name and function of each query."""
    own = (op1_gif_media, op2_suffix_dedup, op3_site_style_tree, op4_bpe_queue, op5_multiset_fingerprint, op6_rule_ensemble, op7_external_shuffle, op8_token_coder, op9_partenum_join, op10_hierarchical_mix, pipeline)
    return {f.__name__: f for f in own}


def _values(name: str, column: str) -> str:
    rows = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(WEIGHTS[name].items()))
    return f"(VALUES {rows}) AS w({column}, w)"


def _share(source: str, parents: str, node: str, weights: str) -> str:
    """Water-filling of each parent's budget over its nodes, as SQL."""
    within = f"PARTITION BY {parents} " if parents else ""
    return f"""(SELECT * EXCLUDE (w, ratio, lv, l), CASE WHEN l IS NULL OR ratio <= l THEN cap ELSE w * l END AS given FROM (
        SELECT *, max(CASE WHEN ratio > lv THEN lv END) OVER ({within}) AS l FROM (
        SELECT *, (budget - coalesce(sum(cap) OVER ({within}ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER ({within}ORDER BY ratio, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM (
        SELECT *, cap / w AS ratio FROM (SELECT s.*, coalesce(w.w, 1.0) AS w FROM {source} s LEFT JOIN {weights} ON w.{node} = s.{node})))))"""


def mixing_sql() -> str:
    """The budget tree and the prefixes in DuckDB's SQL."""
    languages = _share("(SELECT l.*, d.given AS budget FROM (SELECT domain, language, sum(cap) AS cap FROM leaves GROUP BY ALL) l JOIN domains d USING (domain))", "domain", "language", _values("language", "language"))
    sources = _share("(SELECT l.domain, l.language, l.source, l.tokens, l.cap, g.given AS budget FROM leaves l JOIN languages g USING (domain, language))", "domain, language", "source", _values("source", "source"))
    return f"""
    WITH rows_ AS (SELECT doc_id, coalesce(lang, '?') AS language, coalesce(source, '?') AS source,
            'domain' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN '?' ELSE (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4)::VARCHAR END AS domain,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))::BIGINT AS n_tokens FROM documents),
    leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MIX["max_epochs"]})::DOUBLE AS cap FROM rows_ GROUP BY ALL),
    domains AS (SELECT * FROM {_share(f"(SELECT domain, sum(cap) AS cap, (SELECT floor(sum(tokens) * {MIX['fraction']}) FROM leaves)::DOUBLE AS budget FROM leaves GROUP BY domain)", "", "domain", _values("domain", "domain"))}),
    languages AS (SELECT * FROM {languages}),
    sources AS (SELECT * FROM {sources}),
    plan AS (SELECT domain, language, source, CASE WHEN tokens > 0 THEN taken // tokens ELSE {MIX["max_epochs"]} END AS epochs, CASE WHEN tokens > 0 THEN taken % tokens ELSE 0 END AS rest
        FROM (SELECT *, least(floor(given + 1e-3), tokens * {MIX["max_epochs"]})::BIGINT AS taken FROM sources)),
    placed AS (SELECT r.*, p.epochs, p.rest, md5('{MIX["seed"]}:' || p.epochs::VARCHAR || ':' || coalesce(r.doc_id::VARCHAR, '?')) AS place FROM rows_ r JOIN plan p USING (domain, language, source)),
    summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY place) AS upto FROM placed),
    times AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
    SELECT doc_id, domain, language, source, n_tokens, unnest(range(times))::BIGINT AS mix_epoch FROM times WHERE times > 0"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {"op10_hierarchical_mix": mixing_sql()}
