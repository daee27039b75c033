"""The operators of this folder as queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parecer.llm import (
    chat,
    decontaminate,
    hard_negatives,
    license_scan,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    quality_rules,
    quality_votes,
    sharding,
    suffix_dedup,
    url_filter,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(
        table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER)
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op7_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    doc_id = F.col("doc_id")
    scored = quality_votes.scored(
        table(spark, folder, "documents"), table(spark, folder, "labels"), doc_id
    )
    return scored.select(
        F.col("row").alias("doc_id"),
        quality_votes.held_out(F.col("row")).alias("held_out"),
        "score",
        (F.col("score") >= quality_votes.ACCEPTED).cast("int").alias("predicted"),
    )


#: A conversation that speaks the template's own control strings.
OWN_CONVERSATION = r"""SELECT -7L AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS own(turn, role)"""


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    told = chat.read_back(chat.examples(rows.unionByName(spark.sql(OWN_CONVERSATION))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.array_join("losses", "")

    def digest(text):
        return F.sha2(text.cast("binary"), 256)

    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(said, "")).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        digest(trained).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op10_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


#: Texts of every tenth doc_id repeat their words from some place on with some period.
MADE_PERIODIC = r"""SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(transform(
    sequence(0, n - 1), i -> words[if(i < g % n, i,
      g % n + (i - g % n) % (1 + (n - g % n) div (3 + g % 8)))]), ' ') ELSE text END AS text
  FROM (SELECT *, h div 10 AS g, cast(size(words) AS bigint) AS n
    FROM (SELECT *, CASE WHEN h % 10 = 0 THEN regexp_extract_all(
        coalesce(text, ''), r'[^\x20\x09-\x0D]+', 0) END AS words
      FROM (SELECT doc_id, text, crc32(cast(cast(doc_id AS string) AS binary)) AS h
        FROM {documents})))"""
_GREATEST_EXPONENT = """aggregate(runs, cast(null AS struct<start: long, length: long,
  period: long>), (best, r) -> if(best IS NULL OR r.length * best.period > best.length * r.period,
  r, best))"""


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    texts = spark.sql(MADE_PERIODIC, documents=documents)
    told = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                   F.lit("\n"))
    )
    return (
        periodic_runs.periodic_runs(texts)
        .withColumn("best", F.expr(_GREATEST_EXPONENT))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.start", "best.length", "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, vec_id % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_quality_votes": op7_quality_votes,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_mixing": op11_mixing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_AS_WRITTEN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _escaped(text: str) -> str:
    for plain, safe in chat.ESCAPES.items():
        text = f"replace({text}, '{plain}', '{safe}')"
    return text


ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({decontaminate.WINDOW}, len(w)) AS n
              FROM (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL)
              WHERE len(w) > 0),
        phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
                    FROM b, unnest(range(1, len(w) - n + 2)) AS t(i)),
        sizes AS (SELECT DISTINCT n FROM phrases),
        windows AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
                    FROM (SELECT * FROM d, sizes), unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT r, i, windows.n, item
                 FROM windows JOIN phrases ON windows.n = phrases.n AND windows.s = phrases.s),
        words AS (SELECT r, COUNT(DISTINCT j) AS n_hit
                  FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY r),
        items AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
          coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r""",
    "op8_chat": rf"""
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations
          UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok'
          FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(turn, role)),
        placed AS (
          SELECT *, COUNT(*) OVER (PARTITION BY conv_id) AS n,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
            length('{chat.HEAD}' || {_escaped("role")} || '{chat.COLON}' || {_escaped("text")}
                   || ' </turn>' || chr(10)) AS size
          FROM said),
        grown AS (SELECT *, SUM(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM placed)
        SELECT conv_id, COUNT(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
          CAST(coalesce(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
          CAST(SUM(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM grown GROUP BY conv_id""",
    "op10_minhash_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
              FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c
                   FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 100 * c >= {minhash_dedup.PERCENT} * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS node, doc_id AS root FROM d
                  UNION SELECT b, root FROM reach JOIN links ON a = node),
        least_one AS (SELECT node, MIN(root) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id,
          component_id = d.doc_id AS kept
        FROM d JOIN least_one ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_mixing": f"""
        WITH d AS (SELECT doc_id, source, len({_AS_WRITTEN}) AS size FROM documents),
        g AS (SELECT source, doc_id, size, COUNT(*) AS copies FROM d GROUP BY ALL),
        s AS (SELECT *, {mixing.MOST_COPIES} * source_size AS most,
                {list(mixing.WEIGHTS)}[k % {len(mixing.WEIGHTS)} + 1] AS weight
              FROM (SELECT source, CAST(SUM(size * copies) AS BIGINT) AS source_size,
                      CAST(SUM(CAST(size AS HUGEINT) * size * copies) AS DOUBLE) AS squares,
                      row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
                    FROM g GROUP BY source)),
        levels AS (SELECT any_value(a.most / a.weight) AS most_each,
                     any_value(total) - coalesce(SUM(b.most) FILTER (b.most / b.weight
                       < a.most / a.weight), 0) AS shared,
                     SUM(b.weight) FILTER (b.most / b.weight >= a.most / a.weight) AS weights
                   FROM s a, s b, (SELECT {mixing.GROWTH} * SUM(source_size) AS total FROM s)
                   GROUP BY a.k),
        level AS (SELECT shared, weights FROM levels WHERE shared / weights <= most_each
                  ORDER BY most_each LIMIT 1),
        t AS (SELECT *, least(shared * weight / weights, most) AS target FROM s, level),
        w AS (SELECT *, least({mixing.MOST_COPIES}, coalesce(floor(target / nullif(source_size, 0)), 0)) AS whole
              FROM t),
        c AS (SELECT g.*, source_size, target, whole, due,
                CASE WHEN due > 0 AND size > 0 THEN due * size / squares END AS share,
                (CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
                  || size), 1, 12) AS BIGINT) + 0.5) / 281474976710656 AS chance
              FROM g JOIN (SELECT *, target - whole * source_size AS due FROM w) x
                ON g.source IS NOT DISTINCT FROM x.source),
        o AS (SELECT *, coalesce(share >= 1, FALSE) AS certain, CASE WHEN share < 1 THEN
                ln(chance / (1 - chance)) - ln(share / (1 - share)) END AS odds FROM c),
        r AS (SELECT *, SUM(size * copies) OVER (PARTITION BY source
                ORDER BY certain DESC, odds, doc_id NULLS FIRST, size
                ROWS UNBOUNDED PRECEDING) - size * copies AS before
              FROM o WHERE share IS NOT NULL),
        n AS (SELECT o.*, CASE WHEN o.certain THEN o.copies ELSE coalesce(least(o.copies,
                greatest(0, floor((o.due - before) / o.size + 0.5))), 0) END AS drawn
              FROM o LEFT JOIN r ON o.source IS NOT DISTINCT FROM r.source
                AND o.doc_id IS NOT DISTINCT FROM r.doc_id AND o.size = r.size)
        SELECT doc_id, size, source_size, target,
          CAST((whole + CASE WHEN i < drawn THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM n, unnest(range(copies)) AS u(i)""",
    "op12_periodic_runs": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_AS_WRITTEN} AS w FROM documents),
        h AS (SELECT r, list_reduce([4294967295] || [CAST(ord(x) AS BIGINT)
                FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS c
              FROM d WHERE doc_id IS NOT NULL),
        g AS (SELECT d.r, doc_id, w, len(w) AS n, xor(c, 4294967295) % 10 AS h0,
                xor(c, 4294967295) // 10 AS g FROM d LEFT JOIN h ON d.r = h.r),
        a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g),
        v AS (SELECT r, doc_id, n, CASE WHEN h0 = 0 AND n > 0 THEN
                [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)]
                ELSE w END AS w FROM a),
        k AS (SELECT r, i, w[i + 1] AS s, n FROM v, unnest(range(n)) AS t(i)),
        same AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.s = y.s
                 AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT r, q, MIN(i) AS start, COUNT(*) + q AS length
                    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS o
                          FROM same) GROUP BY r, q, o),
        long AS (SELECT * FROM islands WHERE length >= greatest({periodic_runs.LEAST_WORDS},
                 {periodic_runs.LEAST_EXPONENT} * q)),
        runs AS (SELECT r, start, length, q FROM long WHERE NOT EXISTS (FROM islands b
                 WHERE b.r = long.r AND b.q < long.q AND b.start <= long.start
                   AND b.start + b.length >= long.start + long.length)),
        told AS (SELECT r, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || q
                   || chr(10), '' ORDER BY start, q) AS s,
                   list({{'start': start, 'length': length, 'period': q}}
                     ORDER BY length / q DESC, start, q)[1] AS best
                 FROM runs GROUP BY r),
        gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + q, start + length)) AS t(i)),
        left_over AS (SELECT r, string_agg(s, ' ' ORDER BY i) AS s
                      FROM k WHERE NOT EXISTS (FROM gone WHERE gone.r = k.r AND gone.i = k.i)
                      GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length,
          best.period AS period, 1000 * best.length // best.period AS exponent_milli,
          sha256(coalesce(told.s, '')) AS runs_sha256,
          sha256(coalesce(left_over.s, '')) AS collapsed_sha256
        FROM v LEFT JOIN told ON told.r = v.r LEFT JOIN left_over ON left_over.r = v.r""",
    "op13_hard_negatives": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     [floor({hard_negatives.SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
                     CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                   FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
                      FROM scores WHERE own = label QUALIFY row_number() OVER (
                        PARTITION BY anchor_id ORDER BY score DESC, vec_id)
                        <= {hard_negatives.POSITIVES})
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id
            ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score,
          score AS negative_score
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND own <> label
          AND {hard_negatives.LOWEST} * positive_score <= 100 * score
          AND 100 * score <= {hard_negatives.HIGHEST} * positive_score
        QUALIFY rank <= {hard_negatives.NEGATIVES}""",
}
