"""Queries that apply each operator, with production parameters, to its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, langid, lm, mixing, neardup, quality, topk, toxicity, warc
from palimpsest.llm.common import Scratch, read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Weights of languages in every domain.
WEIGHTS = {("*", "en"): 0.4, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.2}


def levels() -> dict:
    """The tree of the mixture: a source's name without its number is its domain."""
    return {"domain": F.regexp_replace("source", "[0-9]+$", ""), "lang": F.col("lang"), "source": F.col("source")}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op2_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10, bits=64)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), least_bytes=0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return chat.digests(chat.format_conversations(rows.union(more), path, pattern), path, pattern)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs, Scratch(spark, "lm")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), levels(), WEIGHTS, total_share="0.9", max_epochs=4, seed=1)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, threshold="0.8")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_topk_hamming, op3_langid, op4_warc, op5_quality, op6_chat, op7_bpe, op8_pseudo_likelihood, op9_mixing, op10_near_duplicates)
    return {f.__name__: f for f in own}


_OP2 = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
found AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.c[i] = r.c[i] THEN 0 ELSE 1 END)) AS distance
          FROM codes q CROSS JOIN codes r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS BIGINT) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM found) WHERE rank <= 10
"""

_OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}', CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def _longer(column: str) -> str:
    """SQL for the length of an escaped text."""
    marks = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL)]
    return f"length({column}) + " + " + ".join(marks)


_OP6 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + {_longer("role")} + {_longer("text")}
                + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.id = d.doc_id
"""


def _mixture(total_share: str, max_epochs: int, seed: int) -> str:
    """SQL that fills the budgets level by level from the root, then takes whole passes and a prefix of each leaf."""
    names = ["domain", "lang", "source"]
    weight = "CASE " + " ".join(f"WHEN lang = '{lang}' THEN {w}" for (_, lang), w in WEIGHTS.items()) + " ELSE 1.0 END"
    parts = [r"""d AS (
  SELECT doc_id, coalesce(regexp_replace(source, '[0-9]+$', ''), chr(0)) AS domain, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents)""",
        "leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM d GROUP BY ALL)",
        f"g0 AS (SELECT CAST(floor(CAST(sum(supply) AS DECIMAL(38, 0)) * {total_share}) AS DOUBLE) AS give FROM leaf)",
    ]
    for i, name in enumerate(names):
        own, node = ", ".join(names[: i + 1]), ", ".join(names[:i])
        every = f"PARTITION BY {node}" if node else ""
        order = f"{every} ORDER BY room / w, {name} ROWS BETWEEN"
        parts += [
            f"r{i} AS (SELECT {own}, CAST(sum(supply) AS DOUBLE) * {max_epochs} AS room, CAST({weight if name == 'lang' else '1.0'} AS DOUBLE) AS w FROM leaf GROUP BY {own})",
            f"f{i} AS (SELECT *, (give - coalesce(sum(room) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r{i} " + (f"JOIN g{i} USING ({node}))" if node else f"CROSS JOIN g{i})"),
            f"g{i + 1} AS (SELECT {own}, least(room, w * max(rate) OVER ({every})) AS give FROM f{i})",
        ]
    parts += [
        "b AS (SELECT domain, lang, source, supply, CAST(floor(round(give, 6)) AS BIGINT) AS budget FROM leaf JOIN g3 USING (domain, lang, source))",
        f"p AS (SELECT *, least(CASE WHEN supply > 0 THEN budget // supply ELSE 1 END, {max_epochs}) AS passes FROM b)",
        f"q AS (SELECT *, CASE WHEN passes < {max_epochs} THEN budget - passes * supply ELSE 0 END AS rest FROM p)",
        f"h AS (SELECT d.*, passes, rest, CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(passes AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS place FROM d JOIN q USING (domain, lang, source))",
        "t AS (SELECT *, passes + CASE WHEN rest > 0 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST) <= rest THEN 1 ELSE 0 END AS taken FROM h)",
    ]
    shown = ", ".join(f"nullif({n}, chr(0)) AS {n}" for n in names)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {shown}, tokens, CAST(unnest(range(taken)) AS INTEGER) AS epoch FROM t"


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_hamming": _OP2, "op4_warc": _OP4, "op6_chat": _OP6, "op9_mixing": _mixture("0.9", 4, 1), "op10_near_duplicates": _OP10}
