"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saunter.llm import alignment, decontam, exact_dedup, langid, line_dedup, minhash, ngram_join, packing, prefix_trie, quality, secrets, token_count, token_store
from saunter.llm.shared import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: n_shingles, component_id. No words: an empty set, linked with nothing. Null ids never name a component that has another; equal rows get equal results; an empty table gives no rows."""
    return ngram_join.jaccard_components(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a row. Null and empty texts are the end id alone; rows with one id or none are packed each for itself; an empty table gives no rows."""
    return packing.pack_documents(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: a learned language, or `und` with score 0 for a null text or one without a letter. Null ids are neither held out nor learned from; equal texts get equal results; an empty table gives no rows."""
    return langid.identify(_documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row. Null texts have no words, items without words no windows; a null item id reads `null`; repeated rows get a row each; an empty benchmark leaves all clean."""
    return decontam.report(decontam.find_contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row. Null text is the empty text; of equal texts the largest id stays, a null id only where all are null; rows that repeat an id and a text are marked alike; an empty table gives no rows."""
    return exact_dedup.mark_duplicates(_documents(spark, sf_dir), keep="largest")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row, read back from the store. Null text is the end id alone; null ids come first, repeated ids stand side by side; an empty table gives no rows."""
    return token_store.read_back(spark, token_store.write_store(_documents(spark, sf_dir)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: words, tokens and unknown words; null and empty texts have none; repeated rows get a row each; an empty table gives no rows."""
    return token_count.count_tokens(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per span to remove. Null texts have no units; the earliest of equal units stays by (id, row), null ids last; repeated rows lose all but the first; an empty table gives no rows."""
    return line_dedup.find_units(_documents(spark, sf_dir))


def op8_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repeated line of any length and per repeated passage of 50 words, exactly. Nulls, ties and empty tables as in `op8_substring_dedup`."""
    return line_dedup.repeated_text(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repeated line of 20 words or more. Nulls, ties and empty tables as in `op8_substring_dedup`."""
    return line_dedup.find_repeats(_documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row, null texts scored as empty ones. Null ids are neither held out nor learned from, null labels are not learned from; without labels all scores are 0.5; an empty table gives no rows."""
    return quality.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row, null text as empty. Rows that repeat an id get a row each, by their own texts; an empty table gives no rows."""
    found = secrets.find_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node. Rows without a conv_id are of no conversation; null turns first, equal turns by role and text; repeated rows are turns each; an empty table gives no rows."""
    conv = F.col("conv_id")
    return prefix_trie.shared_prefixes(_table(spark, sf_dir, "conversations"), conv - conv % 100, crc_mod("conv_id", 6), 5)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: n_shingles, component_id and whether the row has that id. No words: an empty set, linked with nothing. Null ids never name a component that has another; equal rows get equal results; an empty table gives no rows."""
    found = minhash.sketch_components(_documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row. Null and empty texts, and those whose tokens' bytes differ from a space and the text, have zeros and no digest; repeated and null ids get a row each; an empty table gives no rows."""
    return alignment.link_report(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_best_fit_packing, op3_language_id, op4_decontamination, op5_exact_dedup,
    op6_token_store, op7_token_counts, op8_substring_dedup, op8_repeated_text, op8_line_dedup, op9_quality_classifier, op10_secret_scan, op11_conversation_trie,
    op12_minhash_dedup, op13_tokenizer_alignment)}

ORACLES = {
    "op4_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bi),
        di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        occ AS (SELECT doc_id, i, d.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM di) d
                JOIN win USING (n, gram)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


def _secrets_sql() -> str:
    """Match positions as sums of the lengths before them: of pieces between matches and of matches."""
    kinds = []
    for order, r in enumerate((*secrets.BASE_RULES, *secrets.ADDED_RULES)):
        regex = r.regex.replace("'", "''")
        kinds.append(f"""
            SELECT doc_id, {order} AS k, '{r.kind}' AS kind, {str(r in secrets.BASE_RULES).lower()} AS base, m, p, g
            FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_split_to_array(t, '{regex}') AS p,
                         regexp_extract_all(t, '{regex}', {r.group}) AS g, {r.least} AS least FROM d WHERE regexp_matches(t, '{regex}'))""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate((*secrets.BASE_RULES, *secrets.ADDED_RULES)))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(kinds)}),
        each AS (SELECT doc_id, k, kind, base, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM found),
        spans AS (
            SELECT doc_id, k, kind, base,
                   list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
                   length(m[i]) AS n
            FROM each WHERE length(g[i]) >= CASE k {least} END),
        listed AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) FILTER (base) AS b,
                   string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS a
            FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
        FROM d LEFT JOIN listed USING (doc_id)"""


ORACLES["op8_line_dedup"] = r"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
    u AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS unit,
                 CAST(i - 1 + coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(l[i]) AS n_chars,
                 regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM e),
    h AS (SELECT doc_id, unit, start, start + n_chars AS "end", CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM u WHERE len(w) >= 20),
    r AS (SELECT *, row_number() OVER o AS nth, first_value(doc_id) OVER o AS keep_id, first_value(unit) OVER o AS keep_unit
          FROM h WINDOW o AS (PARTITION BY digest ORDER BY doc_id, unit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT doc_id, unit, start, "end", n_words, digest, keep_id, keep_unit FROM r WHERE nth > 1"""
ORACLES["op8_repeated_text"] = ORACLES["op8_line_dedup"].replace("len(w) >= 20", "len(w) >= 1").replace("SELECT doc_id, unit, start,", "SELECT 'line' AS kind, doc_id, unit, start,")
#: Passages by every window of 50 words as it stands; offsets are sums of the lengths before.
ORACLES["op8_repeated_text"] += r"""
    UNION ALL SELECT * FROM (
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS m, regexp_split_to_array(text, '[^\x20\x09-\x0D]+') AS p FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, unnest(m) AS w, unnest(p[1:len(m)]) AS gap, unnest(range(0, len(m))) AS i FROM m),
    pos AS (SELECT doc_id, i, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(w) AS n FROM each),
    low AS (SELECT doc_id, list_transform(m, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS m FROM m WHERE len(m) >= 50),
    win AS (SELECT doc_id, m, unnest(range(0, len(m) - 49)) AS i FROM low),
    h AS (SELECT doc_id, i, md5(array_to_string(m[i + 1:i + 50], ' ')) AS h FROM win),
    f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS kd, first_value(i) OVER o AS ki FROM h WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)),
    g AS (SELECT *, doc_id = kd AND i < ki + 50 AS inside FROM f WHERE NOT (doc_id = kd AND i = ki)),
    s AS (SELECT g.doc_id, g.i, kd, ki, CASE WHEN inside THEN ki + 50 ELSE g.i END AS word, CASE WHEN inside THEN c.e ELSE a.e - a.n END AS s, b.e
          FROM g JOIN pos a ON a.doc_id = g.doc_id AND a.i = g.i JOIN pos b ON b.doc_id = g.doc_id AND b.i = g.i + 49
          LEFT JOIN pos c ON c.doc_id = g.doc_id AND c.i = ki + 49 AND inside),
    cut AS (SELECT *, word > max(i + 50) OVER (PARTITION BY doc_id ORDER BY word, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM s),
    part AS (SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word, i) AS part FROM cut),
    top AS (SELECT doc_id, min(struct_pack(word, s, i, kd, ki)) AS t, max(e) AS e, max(i + 50) AS z FROM part GROUP BY doc_id, part)
    SELECT 'passage' AS kind, doc_id, CAST(t.word AS INTEGER) AS unit, CAST(t.s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(z - t.word AS BIGINT) AS n_words,
           CAST(NULL AS VARCHAR) AS digest, t.kd AS keep_id, CAST(t.ki AS INTEGER) AS keep_unit FROM top)"""
ORACLES["op10_secret_scan"] = _secrets_sql()
#: The crc32 of a decimal number, bit by bit; prefixes as lists of turns, ancestors by their digests.
ORACLES["op11_conversation_trie"] = """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY j) AS l FROM t GROUP BY conv_id),
    c AS (SELECT conv_id, l, conv_id - conv_id % 100 AS template,
                 CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                      lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT) % 6 AS BIGINT) AS h FROM o),
    r AS (SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], c.l[c.h + 1:]) AS l FROM c LEFT JOIN o b ON b.conv_id = c.template),
    p AS (SELECT conv_id, len(l) AS size, l, unnest(range(0, len(l) + 1)) AS depth FROM r),
    k AS (SELECT conv_id, size, depth, CASE WHEN depth > 0 THEN length(l[depth].text) ELSE 0 END AS n_chars, sha256(CAST(l[1:depth] AS JSON)) AS node, sha256(CAST(l[1:depth - 1] AS JSON)) AS up FROM p),
    n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars,
                 string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size) AS ends FROM k GROUP BY depth, node),
    f AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.up = n.node) AS n_children FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.up),
    below AS (SELECT k.depth, k.node, x.node AS part, x.n_convs, x.n_chars, x.n_children FROM k JOIN k y ON y.conv_id = k.conv_id AND y.depth >= k.depth JOIN f x ON x.depth = y.depth AND x.node = y.node GROUP BY ALL),
    s AS (SELECT depth, node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n_chars) AS BIGINT) AS saved_tokens FROM below GROUP BY depth, node)
    SELECT f.conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN s USING (depth, node)"""


def _near_sql(size: int, percent: int, more: str = "") -> str:
    """Classes of equal sets, pairs of classes by what they share, and least ids spread along links until nothing changes."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {size}, 0) + 2),
                     lambda i: hash(array_to_string(w[i:i + {size - 1}], ' '))))) END AS l FROM d),
        c AS (SELECT l, min(doc_id) AS id, len(l) AS n FROM s WHERE len(l) > 0 GROUP BY l),
        e AS (SELECT id, n, unnest(l) AS h FROM c),
        k AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.h = b.h AND a.id < b.id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
              GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        reach AS (SELECT id, id AS least FROM c UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id AND r.least < l.b),
        least AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)
        SELECT s.doc_id, CAST(len(s.l) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id{more} FROM s LEFT JOIN c ON c.l = s.l LEFT JOIN least ON least.id = c.id"""


ORACLES["op1_ngram_jaccard_join"] = _near_sql(5, 75)
ORACLES["op12_minhash_dedup"] = _near_sql(3, 85, ", s.doc_id = coalesce(component_id, s.doc_id) AS kept")
