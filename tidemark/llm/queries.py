"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, html_text, line_dedup, mixing, pii, quality_rules, simhash, suffix_dedup, toxicity, warc
from tidemark.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and near-duplicate component."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_sql() -> str:
    """XXH64 written out in 128-bit numbers: a product or sum is cut to 64 bits, and a rotation is a product modulo 2^64 - 1."""
    p = [f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    left = lambda x, k: f"(({x}) * {2**k}::UHUGEINT % 18446744073709551615::UHUGEINT)"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, ({at}) * 2 + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    lane = lambda v: cut(f"{left(cut(f'{v} * {p[1]}'), 31)} * {p[0]}")
    fold = lambda items, step, first: f"list_reduce({items}, lambda a, v: {step}, {first})"
    seed = simhash.SEED
    firsts = [(seed + 11400714785074694791 + 14029467366897019727) % 2**64, (seed + 14029467366897019727) % 2**64, seed, (seed - 11400714785074694791) % 2**64]
    stripes = ", ".join(fold(f"list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}])", cut(f"{left(cut(f'a + {cut(f"v * {p[1]}")}'), 31)} * {p[0]}"), f"{firsts[k]}::UHUGEINT") + f" AS v{k}" for k in range(4))
    merged = cut(" + ".join(left(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = cut(f"{xor(merged, lane(f'v{k}'))} * {p[0]} + {p[3]}")
    eights = cut(f"{left(xor('a', lane('v')), 27)} * {p[0]} + {p[3]}")
    four = cut(f"{left(xor('h', cut(f'{number("n // 8 * 8", 4)} * {p[0]}')), 23)} * {p[1]} + {p[2]}")
    ones = cut(f"{left(xor('a', cut(f'v * {p[4]}')), 11)} * {p[0]}")
    bits = ", ".join(f"sum(times * ((h >> {k}) & 1)) AS b{k}" for k in range(64))
    value = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {2**k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
    return f"""WITH RECURSIVE listed AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
single AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM listed),
three AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS shingle FROM single WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
shingles AS MATERIALIZED (SELECT doc_id, shingle, count(*) AS times FROM (SELECT * FROM three WHERE shingle IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM listed WHERE len(words) BETWEEN 1 AND 2) GROUP BY ALL),
h0 AS (SELECT shingle, hex(encode(shingle)) AS x, strlen(shingle)::BIGINT AS n FROM (SELECT DISTINCT shingle FROM shingles)),
h1 AS (SELECT *, list_transform(range(n // 8), lambda i: {number("8 * i", 8)}) AS lanes FROM h0),
h2 AS (SELECT *, {stripes} FROM h1),
h3 AS (SELECT shingle, x, n, lanes, {cut(f"n::UHUGEINT + CASE WHEN n >= 32 THEN {merged} ELSE {seed}::UHUGEINT + {p[4]} END")} AS h FROM h2),
h4 AS (SELECT shingle, x, n, {fold("lanes[4 * (n // 32) + 1:]", eights, "h")} AS h FROM h3),
h5 AS (SELECT shingle, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM h4),
h6 AS (SELECT shingle, {fold(f"list_transform(range(n - n % 4, n), lambda i: {number('i', 1)})", ones, "h")} AS h FROM h5),
h7 AS (SELECT shingle, {cut(f"{xor('h', f'h // {2**33}::UHUGEINT')} * {p[1]}")} AS h FROM h6),
h8 AS (SELECT shingle, {cut(f"{xor('h', f'h // {2**29}::UHUGEINT')} * {p[2]}")} AS h FROM h7),
hashes AS (SELECT shingle, ({xor("h", f"h // {2**32}::UHUGEINT")})::UBIGINT AS h FROM h8),
counted AS (SELECT doc_id, sum(times) AS n, {bits} FROM shingles JOIN hashes USING (shingle) GROUP BY doc_id),
fps AS MATERIALIZED (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN (SELECT doc_id, ({value})::UBIGINT AS fp FROM counted) c ON d.doc_id = c.doc_id),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS rep FROM fps GROUP BY fp),
edges AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)) <= {simhash.RADIUS}),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS fp, min(rep) AS component_id FROM reach JOIN nodes ON b = nodes.fp GROUP BY a)
SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM fps JOIN named USING (fp)"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.find(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that start earlier."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


#: Every string of 100 bytes, cut from overlapping chunks of a text: the first of each stays, the others cover what goes.
OP4_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, base, array_slice(b, base + 1, base + 355) AS part, least(256, n - 99 - base) AS size FROM (SELECT doc_id, b, n, unnest(range(0, n - 99, 256)) AS base FROM d WHERE n >= 100)),
p AS (SELECT doc_id, base, part, unnest(range(size)) AS off FROM c),
w AS (SELECT doc_id, base + off AS pos, row_number() OVER (PARTITION BY array_slice(part, off + 1, off + 100) ORDER BY doc_id, base + off) AS nth FROM p),
m AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 100, true) AS opens FROM w WHERE nth > 1),
r AS (SELECT doc_id, pos, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
s AS (SELECT doc_id, min(pos) AS start, max(pos) + 100 AS stop FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS stop,
             string_agg(substr(hex(b), 2 * since + 1, 2 * (start - since)), '' ORDER BY start) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hex(b), 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
counts AS (SELECT source, k, count(DISTINCT doc_id) AS pages FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT c.source, c.k FROM counts c JOIN totals t ON c.source = t.source WHERE c.pages >= 3 AND c.pages > 0.05::DOUBLE * t.total),
marked AS (SELECT l.*, b.k IS NOT NULL AS gone FROM keyed l LEFT JOIN bad b ON l.source = b.source AND l.k = b.k)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped
FROM marked GROUP BY doc_id, source
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept when tokens are raked to source, language and topic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), "text")
    margins = {m: F.col(m) for m in ("source", "lang", "topic")}
    return mixing.mix(docs, margins, details=("n_tokens", "probability")).drop("text")


def op7_sql(final: str = "SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability FROM kept") -> str:
    """Iterative proportional fitting written out, round by round."""
    keys = ("source", "lang", "topic")
    parts = [r"""docs0 AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(text, 'icensed under') OR contains(text, 'LICENSED UNDER') THEN 'legal'
        WHEN contains(text, ' | ') THEN 'tabular' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '***') OR contains(text, '!!') THEN 'markup' ELSE 'prose' END AS topic,
        len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM docs0) AS w FROM docs0 GROUP BY ALL)"]
    for m in keys:
        parts.append(f"s_{m} AS MATERIALIZED (SELECT {m}, pow(sum(n), {mixing.POWERS[m]}) AS t FROM w0 GROUP BY {m})")
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, t / (SELECT sum(t) FROM s_{m}) AS t FROM s_{m})")
    # One step a margin in turn; the working table of the recursion is the whole set of cells.
    parts.append(f"""r AS (SELECT 0 AS k, w0.*, a.t AS ta, b.t AS tb, c.t AS tc FROM w0 JOIN t_source a ON w0.source = a.source JOIN t_lang b ON w0.lang = b.lang JOIN t_topic c ON w0.topic = c.topic
        UNION ALL SELECT k + 1, source, lang, topic, n, w * (CASE k % 3 WHEN 0 THEN ta WHEN 1 THEN tb ELSE tc END)
        / sum(w) OVER (PARTITION BY CASE k % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END), ta, tb, tc FROM r WHERE k < {3 * mixing.ROUNDS})""")
    parts.append(f"f AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN n > 0 THEN w / (n / (SELECT sum(n) FROM w0)) ELSE 1 END AS f FROM r WHERE k = {3 * mixing.ROUNDS})")
    parts.append(f"rate AS MATERIALIZED (SELECT least({mixing.RATE}, 1.0::DOUBLE / max(f)) AS rate FROM f)")
    parts.append(f"kept AS (SELECT d.*, least(1.0, rate * f) AS p FROM docs0 d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic, rate WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE < least(1.0, rate * f))")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict, by a decision list learned from labels.quality."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an ARC archive and a WARC archive, and back."""
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, out)
    return warc.records(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32: eight groups of five hex digits, of four letters each.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (g * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * k)::INTEGER) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest FROM h),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to FROM l
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_pii, op3_decontamination, op4_suffix_dedup, op5_toxicity, op6_line_dedup, op7_mixing, op8_html_extraction, op9_quality_rules, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash": op1_sql(), "op4_suffix_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_mixing": op7_sql(), "op10_warc": OP10_SQL}
