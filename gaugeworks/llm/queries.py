"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, linededup, mixing, mpegts, neardup, syncmers, toxicity, urlfilter, warc
from .common import crc32_of_id, load

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL query, in the order they were given.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(load(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path("byte_bpe_50k.json"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(load(spark, sf_dir, "documents"))


def op3_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Weights of the mixing query's tree; nodes not named weigh 1.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, (None, "en"): 4, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 2}
#: Share of all words to take, times a document is taken at most, seed of the epochs.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 7


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("n_words"))
    return mixing.select(docs, MIX_LEVELS, id_col="doc_id", token_col="n_words", weights=MIX_WEIGHTS, total_share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0
    model = toxicity.learn(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model, ["doc_id"], "text")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "distance", "passage_distance")


def op6_mpeg_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.round_trip(load(spark, sf_dir, "documents"), ["doc_id"], "text")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages"), urlfilter.rules_table(spark, URL_RULES))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2
    model = langid.learn(docs, learnable=~held_out)
    scored = langid.identify(docs, model, ["doc_id"], "text")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(load(spark, sf_dir, "documents"))


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe_encode_decode, op2_syncmer_fingerprints, op3_warc_content_addressed, op4_mixing, op5_toxicity, op6_mpeg_transport_stream, op7_url_filter, op8_language_id, op9_line_dedup, op10_weighted_minhash)}

_BASE32 = " || ".join(f"translate(to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32, 4), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(8))

ORACLE_SQL: dict[str, str] = {
    "op3_warc_content_addressed": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op7_url_filter": """
        WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
                 FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""",
    "op9_line_dedup": """
        WITH l AS (SELECT doc_id, i, unnest(line) AS line, unnest(range(len(line))) AS n FROM (SELECT doc_id, doc_id AS i, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)),
        k AS (SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        g AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.doc_id, n, line, first IS NOT NULL AND first <> k.doc_id AS dropped FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}


def mixing_sql(weights: dict = MIX_WEIGHTS, share: float = MIX_SHARE, epochs: float = MIX_EPOCHS) -> str:
    """Leaves on a path of weight 0 are left out first. The tree is filled level by level: a child is full if the level of its ratio for all would stay within the parent's budget."""
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"
    same = lambda a, b, names: " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in names)
    bare = [(dict(zip(MIX_LEVELS, p, strict=False))) for p, w in weights.items() if w <= 0]
    weighed = "".join(" AND NOT (" + " AND ".join(f"{n} IS NOT DISTINCT FROM '{v}'" for n, v in p.items() if v is not None) + ")" for p in bare)
    ctes = [
        f"""d AS (SELECT doc_id, CASE WHEN coalesce({number}, '') = '' THEN 'other' ELSE 'd' || ({number}::INT % 4) END AS domain, lang, source,
            len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS tokens FROM documents)""",
        f"leaves AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE * {float(epochs)} AS capacity FROM d WHERE tokens > 0{weighed} GROUP BY ALL)",
        f"n0 AS (SELECT *, least((SELECT sum(tokens) FROM d) * {share}, (SELECT sum(capacity) FROM leaves)) AS budget FROM leaves)",
    ]
    for level, name in enumerate(MIX_LEVELS):
        here, above = MIX_LEVELS[: level + 1], MIX_LEVELS[:level]
        cases = "".join(f" WHEN {" AND ".join(f"{n} = '{v}'" for n, v in zip(MIX_LEVELS, p, strict=False) if v is not None)} THEN {float(w)}" for p, w in weights.items() if len(p) == level + 1)
        family = f"PARTITION BY {', '.join(above)}" if above else ""
        ctes += [
            f"c{level} AS (SELECT {', '.join(here)}, sum(capacity) AS c, first(budget) AS parent, {f'CASE{cases} ELSE 1.0 END::DOUBLE' if cases else '1.0::DOUBLE'} AS w FROM n{level} GROUP BY {', '.join(here)})",
            f"f{level} AS (SELECT *, sum(c) OVER ({family} ORDER BY c / w) + (sum(w) OVER ({family}) - sum(w) OVER ({family} ORDER BY c / w)) * (c / w) <= parent AS is_full FROM c{level})",
            f"s{level} AS (SELECT *, CASE WHEN is_full THEN c ELSE (parent - sum(CASE WHEN is_full THEN c ELSE 0.0 END) OVER ({family})) / sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER ({family}) * w END AS share FROM f{level})",
            f"n{level + 1} AS (SELECT n{level}.* EXCLUDE (budget), s{level}.share AS budget FROM n{level} JOIN s{level} ON {same(f'n{level}', f's{level}', here)})",
        ]
    ctes += [
        "plan AS (SELECT domain, lang, source, floor(budget / tokens)::BIGINT AS whole, budget - floor(budget / tokens) * tokens AS rest FROM n3)",
        f"keyed AS (SELECT d.*, whole, rest, md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN plan ON {same('d', 'plan', MIX_LEVELS)} WHERE tokens > 0)",
        "placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS so_far FROM keyed)",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, domain, lang, source, tokens, whole + CASE WHEN so_far <= rest THEN 1 ELSE 0 END AS epochs FROM placed WHERE whole + CASE WHEN so_far <= rest THEN 1 ELSE 0 END > 0"


ORACLE_SQL["op4_mixing"] = mixing_sql()
