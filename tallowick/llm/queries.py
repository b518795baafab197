"""The registered queries of the text operators, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.llm import collocations, cotraining, decontaminate, fingerprints, line_dedup, merkle, minhash_dedup, packing, ppm, quality_rules, secret_scan, suffix_dedup, warc
from tallowick.llm.workspace import new_path, small_batches


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(small_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.page_records(warc.read_archives(spark, path))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
e AS (SELECT h, min(page_id) AS first, count(*) AS c FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN c > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN e USING (h)
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; ``kept`` is false where bad quality is the likelier."""
    scored = cotraining.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(F.col("id").alias("doc_id"), "p_content", "p_metadata", "p_good", (F.col("p_good") >= 0.5).alias("kept"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: one row for each such pair."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
    SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines
), keyed AS (
    SELECT r, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), often AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
    SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    samples = secret_scan.labelled_samples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = secret_scan.scan(docs, samples)
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), total AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS phrase FROM worded, (VALUES (1), (2), (3), (4)) v(k)
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT lang, phrase, a, unnest(range(1, k)) AS c FROM f WHERE k > 1
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, CAST(CAST(cuts.a AS HUGEINT) * 2000000 // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.phrase[1:c] JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.phrase[c + 1:]
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), around AS (
    SELECT lang, a, unnest([phrase[1:2], phrase[2:3], phrase[3:4], phrase[1:3], phrase[2:4]]) AS phrase, k FROM f WHERE k > 2
), hidden AS (
    SELECT DISTINCT w.lang, w.phrase FROM weakest w JOIN around s ON s.lang = w.lang AND s.phrase = w.phrase
    WHERE s.k > len(w.phrase) AND 100 * CAST(s.a AS HUGEINT) >= 80 * CAST(w.a AS HUGEINT)
), kept AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, array_to_string(w.phrase, ' ')) AS rank
    FROM weakest w LEFT JOIN hidden h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.phrase IS NULL
)
SELECT kept.lang, rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM kept JOIN total ON total.lang = kept.lang WHERE rank <= 2000
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by its id's checksum) is checked with its text in lower case."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(changed, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.manifest(documents(spark, sf_dir), altered=[text if f == "text" else F.col(f) for f in merkle.FIELDS])
    root = merkle.folded(F.col("altered"), F.col("path"))
    checked = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, level by level: each level's nodes have their run's other digests to the left and right."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, start: str) -> list[str]:
        out = [f"{name}0 AS ({start})"]
        for i in range(levels):
            run = "string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN "
            own = f"CASE WHEN n > 1 THEN coalesce({run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN n > 1 THEN coalesce({run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r"
            out.append(f"{name}{i}s AS (SELECT *, {own} FROM {name}{i})")
            out.append(f"{name}{i + 1} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h, (any_value(n) + 7) // 8 AS n FROM {name}{i} GROUP BY g, p // 8)")
        return out

    parts = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS h, {leaf(f'(CASE WHEN {crc} % 3 = 0 THEN {lower} ELSE text END)')} AS t FROM documents)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        *tree("a", "SELECT lang AS g, p, h, n FROM ranked"),
        *tree("b", f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, h, count(*) OVER () AS n, g AS lang FROM a{levels}"),
    ]
    steps = [("a", i, f"ON a{i}s.g IS NOT DISTINCT FROM x.lang AND a{i}s.p = x.p // {8**i}") for i in range(levels)]
    steps += [("b", i, f"ON b{i}s.p = b0.p // {8**i}") for i in range(levels)]
    joins = " ".join(f"JOIN {t}{i}s {on}" for t, i, on in steps)
    proof = " || ".join(f"coalesce({t}{i}s.l || {t}{i}s.r, '')" for t, i, _ in steps)
    parts.append(f"paths AS (SELECT x.doc_id, x.h AS leaf, x.t AS f0, b0.h AS subroot, {proof} AS proof, " + ", ".join(f"{t}{i}s.l AS l{k}, {t}{i}s.r AS r{k}" for k, (t, i, _) in enumerate(steps)) + f" FROM ranked x JOIN b0 ON b0.lang IS NOT DISTINCT FROM x.lang {joins})")
    for k in range(len(steps)):
        parts.append(f"fold{k + 1} AS (SELECT * REPLACE (CASE WHEN l{k} IS NULL THEN f0 ELSE sha256(l{k} || f0 || r{k}) END AS f0) FROM {f'fold{k}' if k else 'paths'})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, f0 AS folded_root, f0 = top.h AS verified FROM fold{len(steps)}, b{levels} AS top"


OP13_SQL = _op13_sql()

QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_classifier, op3_suffix_array_dedup, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_line_dedup, op7_secret_scan, op8_lm_scoring, op9_best_fit_packing, op10_quality_rules, op11_collocations, op12_document_fingerprints, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op6_line_dedup": OP6_SQL, "op11_collocations": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
