"""The operators as queries over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from netvigil.llm import (
    chat,
    decontaminate,
    hmm,
    jaccard,
    lines,
    mixing,
    quality,
    repeats,
    runs,
    sharding,
    toxicity,
    trie,
    wordpiece,
)
from netvigil.llm.common import let, table, text_or_empty, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    chats = chat.format_chats(rows.unionByName(extra)).select(
        "conv_id",
        "valid",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("trained"),
    )
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""
    )
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op2_mix_sources(spark, sf):
    return mixing.mix_plan(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_decontaminate(spark, sf):
    found = decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_hidden_markov(spark, sf):
    return hmm.score(table(spark, sf, "documents"))


def op5_shard(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
    )
    return sharding.shard(docs, 8, identity=("doc_id", "text_crc32")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_repeats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeats.removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_jaccard_join(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"))


def op8_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256")
    )


def op9_token_counts(spark, sf):
    pieces = wordpiece.read_ranks(VOCABULARY)
    return wordpiece.count_tokens(
        table(spark, sf, "documents"), wordpiece.Automaton(pieces), prefix=b" "
    )


def op10_quality_rules(spark, sf):
    measured = quality.measure_documents(table(spark, sf, "documents"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(measured, quality.thresholds(measured)).select(
        "doc_id", *[F.col("m")[f].alias(f) for f in fields], "base_failed", "kept"
    )


def _with_planted_periods(docs):
    """Texts of every tenth checksum of doc_id repeat a stretch of their own words to the end."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(checksum / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long"))
        at = F.transform(place, lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " "))

    planted = F.when(checksum % 10 == 0, let(words(text_or_empty()), repeated))
    return docs.withColumn("text", F.when(checksum % 10 == 0, planted).otherwise(F.col("text")))


def op11_periodic_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = runs.periodic_runs(_with_planted_periods(docs))
    order = F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period))
    best = F.array_max(order)
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(rows)))


def op13_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.train(docs.where(~held_out), table(spark, sf, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst",
        "worst_probability",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_mix_sources, op3_decontaminate, op4_hidden_markov, op5_shard,
        op6_repeats, op7_jaccard_join, op8_line_dedup, op9_token_counts, op10_quality_rules,
        op11_periodic_runs, op12_prefix_trie, op13_toxicity,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_FLOORS = " ".join(f"WHEN '{name}' THEN {value}" for name, value in quality.FLOOR.items())


def _fences_sql(group: str) -> str:
    """Fences of the sketches merged per group, a list of columns with a comma behind each."""
    return f"""SELECT {group} measure, max(total) AS n, min(value) FILTER (upto >= {quality.MIDDLE} * total) AS middle,
    middle + {quality.REACH}::DOUBLE * greatest(
      middle - min(value) FILTER (upto >= {quality.LOW} * total), CASE measure {_FLOORS} END::DOUBLE) AS fence
  FROM (SELECT {group} measure, CASE WHEN bin = 0 THEN 0.0::DOUBLE
        ELSE {quality.SMALLEST}::DOUBLE * pow({quality.GROWTH}::DOUBLE, bin - 0.5::DOUBLE) END AS value,
      sum(sum(n)) OVER (PARTITION BY {group} measure ORDER BY bin)::DOUBLE AS upto,
      sum(sum(n)) OVER (PARTITION BY {group} measure)::DOUBLE AS total
    FROM bins GROUP BY {group} measure, bin) GROUP BY {group} measure"""


# The others cannot be put in SQL as a whole: see tests/llm for their plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""
WITH texts AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
ahead AS (
  SELECT doc_id, i, list(word) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS words FROM placed),
windows AS (
  SELECT doc_id, i, size, array_to_string(words[1 : size], ' ') AS key
  FROM ahead JOIN (SELECT DISTINCT size FROM item_windows) ON len(words) >= size),
found AS (SELECT doc_id, i, size, item_id FROM windows JOIN item_windows USING (key, size)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found))
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_quality_rules": f"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(body, {_SPACED}) AS w
  FROM documents),
placed AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM texts),
triples AS (
  SELECT doc_id, i, a, lead(a, 1) OVER later AS b, lead(a, 2) OVER later AS c
  FROM placed WINDOW later AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, unnest(range(i, i + 3)) AS place FROM triples WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM twice GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM split WHERE regexp_matches(line, {_SPACED}) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
valued AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure,
    coalesce(unnest([n_symbols::DOUBLE / nullif(word_chars, 0), n_dup_lines::DOUBLE / nullif(n_lines, 0),
      n_repeat_words::DOUBLE / nullif(n_words, 0), word_chars::DOUBLE / nullif(n_words, 0)]), 0.0) AS value
  FROM counted),
bins AS (
  SELECT lang, source, measure, count(*) AS n, CASE WHEN value >= {quality.SMALLEST}::DOUBLE
    THEN floor(ln(value / {quality.SMALLEST}::DOUBLE) / ln({quality.GROWTH}::DOUBLE)) + 1 ELSE 0 END AS bin
  FROM valued WHERE NOT base_failed GROUP BY lang, source, measure, bin),
own AS ({_fences_sql("lang, source,")}),
by_lang AS ({_fences_sql("lang,")}),
by_all AS ({_fences_sql("")}),
fences AS (
  SELECT o.lang, o.source, o.measure, o.n / (o.n + {quality.BORROW}) AS own_weight,
    l.n / (l.n + {quality.BORROW}) AS lang_weight, own_weight * o.fence
      + (1 - own_weight) * (lang_weight * l.fence + (1 - lang_weight) * a.fence) AS fence
  FROM own o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
    JOIN by_all a ON a.measure = o.measure),
outside AS (
  SELECT DISTINCT doc_id FROM valued v JOIN fences f ON f.lang IS NOT DISTINCT FROM v.lang
    AND f.source IS NOT DISTINCT FROM v.source AND f.measure = v.measure
  WHERE v.value > f.fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM counted""",
    "op8_line_dedup": """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
firsts AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE coalesce(keeper >= doc_id, true)), ''))
    AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id""",
}
