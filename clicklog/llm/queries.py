"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklog.llm import decontaminate, embedding_dedup, html_extract, language_id, mixing, ngram_join, periodic_runs, quality, sharding, spelling, substring_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents judged toxic, with the chain's probabilities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return judged.where("is_toxic").drop("text")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.learnable(docs))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = quality.rank(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return ranked.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one document of ten, by the crc32 of its doc_id, the words from one place on repeat a part of themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    parted = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), words).alias("words"))
    parted = parted.withColumn("n", F.size("words")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return parted.select("doc_id", F.when(F.expr("h % 10 = 0 and n > 0"), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as down)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-longest.back").alias("start"), "longest.length", F.expr("-longest.down").alias("period"),
        F.expr("1000 * longest.length div -longest.down").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_decontamination, op4_toxicity, op5_ngram_join, op6_mixing, op7_language_id, op8_quality, op9_html_extract, op10_embedding_dedup, op11_periodic_runs, op12_spelling, op13_substring_dedup)}

#: Labels spread along the links until none falls: the recursion keeps each (document, label) once.
_SPREAD = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.y AS b FROM reach r JOIN links l ON l.x = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

#: SQL for the queries whose results do not depend on a model or on draws.
ORACLES: dict[str, str] = {
    "op5_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs), nodes AS (SELECT doc_id AS id FROM documents),
""" + _SPREAD + """ SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN comp ON comp.id = documents.doc_id""",
    "op10_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS z FROM v WHERE e IS NOT NULL),
pairs AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.id < b.id AND len(a.e) = len(b.e) AND a.z > 0 AND b.z > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.z * b.z),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs), nodes AS (SELECT vec_id AS id FROM embeddings), k AS (SELECT x, count(*) AS c FROM links GROUP BY 1),
""" + _SPREAD + """ SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN k ON k.x = vec_id""",
    # crc32 bit by bit: a byte is folded into the state, then shifted out under the polynomial
    "op12_spelling": r"""WITH RECURSIVE t AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i)),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS c FROM t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
k AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
b AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM k),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, tab.c[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, tab),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM w, unnest(range(0, length(word))) u(i)),
pairs AS (SELECT word AS a, less AS b FROM cut WHERE less IN (SELECT word FROM w) UNION SELECT less, word FROM cut WHERE less IN (SELECT word FROM w)
UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.less = y.less AND x.word <> y.word),
p AS (SELECT a, w.word AS b, w.n FROM pairs JOIN w ON w.word = b),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN b END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON a = w.word),
up AS (SELECT word, form AS r, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.r WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(r, step) AS r FROM up GROUP BY 1)
SELECT f.word, form, coalesce(r, f.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM f LEFT JOIN root ON root.word = f.word""",
    "op13_substring_dedup": r"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
v AS (SELECT k, doc_id, unnest(range(0, len(ws) - 12)) AS i, ws FROM d WHERE len(ws) >= 13),
w AS MATERIALIZED (SELECT k, doc_id, i, md5(array_to_string(ws[i + 1 : i + 13], ' ')) AS x FROM v),
first AS (SELECT x, min(doc_id) AS least FROM w GROUP BY 1),
gone AS (SELECT DISTINCT k, i + o AS place FROM w JOIN first ON first.x = w.x AND least < doc_id, unnest(range(0, 13)) u(o)),
g AS (SELECT k, list(place) AS places, count(*) AS c FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed,
sha256(array_to_string(CASE WHEN c IS NULL THEN ws ELSE list_transform(list_filter(range(0, len(ws)), lambda j: NOT list_contains(places, j)), lambda j: ws[j + 1]) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g ON g.k = d.k""",
}
