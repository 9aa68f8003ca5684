"""Queries of the corpus operators, one for each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontaminate, exact, language, lpf, mixing, phrases, pii, quality, sharding, simhash, templates, url_lists
from tidemark.llm.common import read_table


LISTS = ("adult", "malware", "spam")


def _captures(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch times: page p is fetched (37 p mod 8760) hours into 2024."""
    hours = F.pmod(F.col("page_id") * 37, F.lit(8760))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + hours * 3600).alias("fetched_at"))


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on the hosts of ``pages``, whose first page is m: four turns
    from day (11 m + 97 k) mod 365 on, on the host, its parent or its /en pages."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("host"), "page_id").where("host is not null").groupBy("host").agg(F.min("page_id").alias("m"))
    kind = F.col("m") % 5
    key = F.when(kind < 3, F.col("host")).when(kind == 3, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.concat("host", F.lit("/en")))
    turns = hosts.where("m % 4 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    day = F.pmod(F.col("m") * 11 + F.col("k") * 97, F.lit(365))
    return turns.select(
        F.element_at(F.array(*map(F.lit, LISTS)), (F.col("m") % 3 + 1).cast("int")).alias("list"),
        key.alias("key"),
        F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"),
        F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400).alias("at"),
    )


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.filter_captures(_captures(pages), _list_entries(pages)).drop("url", "fetched_at")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items, keep=["doc_id"]).drop("spans")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.drop("redactions")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), keep=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_lists, op2_repeated_passages, op3_decontamination, op4_exact_dedup, op5_sharding, op6_mixing, op7_line_templates, op8_quality, op9_personal_data, op10_simhash, op11_language, op12_phrases, op13_alignment)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_url_lists": r"""
        WITH p AS (SELECT page_id, TIMESTAMP '2024-01-01' + to_hours(page_id * 37 % 8760) AS fetched_at,
                nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
        h AS (SELECT host, min(page_id) AS m FROM p WHERE host IS NOT NULL GROUP BY host),
        e AS (SELECT ['adult', 'malware', 'spam'][m % 3 + 1] AS list, CASE WHEN m % 5 < 3 THEN host WHEN m % 5 = 3 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/en' END AS key,
                CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action, TIMESTAMP '2024-01-01' + to_days(CAST((m * 11 + k * 97) % 365 AS INT)) AS since
            FROM (SELECT *, unnest(range(4)) AS k FROM h WHERE m % 4 <> 0)),
        o AS (SELECT list, key, since, max(action) AS action FROM e GROUP BY ALL),
        t AS (SELECT *, lag(action) OVER w AS before FROM o WINDOW w AS (PARTITION BY list, key ORDER BY since)),
        i AS (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS valid_to FROM t WHERE before IS NULL OR before <> action),
        a AS (SELECT page_id, fetched_at, unnest(list_distinct(list_concat(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda x: array_to_string(string_split(host, '.')[x:], '.')),
                CASE WHEN seg <> '' THEN [host || '/' || seg] ELSE [] END))) AS key FROM p WHERE host IS NOT NULL),
        f AS (SELECT page_id, count(*) AS n, list_sort(list(DISTINCT list)) AS lists, list_sort(list(DISTINCT key)) AS keys
            FROM a JOIN (SELECT * FROM i WHERE action = 'add') USING (key) WHERE since <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
        SELECT p.page_id, host, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries,
            coalesce(array_to_string(lists, ','), '') AS lists, coalesce(array_to_string(keys, ','), '') AS matched_keys
        FROM p LEFT JOIN f USING (page_id)
    """,
    "op2_repeated_passages": """
        WITH d AS (SELECT doc_id, octet_length(b) AS n, b FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
        w AS (SELECT doc_id, k, b[k + 1 : k + 50] AS win FROM (SELECT doc_id, b, unnest(range(n - 49)) AS k FROM d WHERE n >= 50)),
        m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
        h AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM w JOIN m USING (win) WHERE doc_id > low),
        g AS (SELECT doc_id, k, sum(CASE WHEN prev IS NULL OR k > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM h),
        s AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY doc_id, run),
        p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
        r AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(p.b - a) AS BIGINT) AS n_removed, string_agg(CASE WHEN a > since THEN hex(d.b[since + 1 : a]) ELSE '' END, '' ORDER BY a) AS kept, max(p.b) AS last FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN kept IS NULL THEN hex(b) ELSE kept || CASE WHEN last < n THEN hex(b[last + 1 : n]) ELSE '' END END)) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, iw, least(10, len(iw)) AS n FROM (SELECT item_id, {_WORDS} AS iw FROM benchmark) WHERE len(iw) > 0),
        iwin AS (SELECT DISTINCT item_id, n, array_to_string(iw[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(iw) - n + 2)) AS k FROM b)),
        dwin AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iwin))),
        hit AS (SELECT doc_id, item_id, k, n FROM dwin JOIN iwin USING (n, win)),
        hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op7_line_templates": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        x AS (SELECT *, array_to_string(list_transform(string_split(trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' '), ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS masked FROM t),
        l AS (SELECT DISTINCT doc_id, masked FROM x WHERE masked <> ''),
        v0 AS (SELECT masked, string_split(masked, ' ') AS ws, count(*) AS n FROM l GROUP BY masked),
        v1 AS (SELECT *, len(ws) AS c, ws[1:3] AS head FROM v0),
        busy AS (SELECT c, head FROM v1 JOIN l USING (masked) GROUP BY c, head HAVING count(DISTINCT doc_id) >= 8),
        v AS (SELECT * FROM v1 SEMI JOIN busy USING (c, head)),
        u AS (SELECT masked, c, head, n, unnest(ws) AS w, unnest(range(c)) AS pos FROM v),
        k AS (SELECT c, head, pos, w, sum(n) AS held FROM u GROUP BY ALL),
        z AS (SELECT c, head, sum(n) AS every FROM v GROUP BY ALL),
        f AS (SELECT masked, c, head, share, list(CASE WHEN held >= greatest(8, share * every) THEN w END ORDER BY pos) AS shape
            FROM u JOIN k USING (c, head, pos, w) JOIN z USING (c, head), (VALUES (0.5::DOUBLE), (0.125::DOUBLE), (0.03125::DOUBLE), (0::DOUBLE)) AS q(share) GROUP BY ALL),
        of AS (SELECT DISTINCT masked, c, head, shape FROM f WHERE len(list_filter(shape, lambda e: e IS NOT NULL)) >= 0.7::DOUBLE * c UNION SELECT masked, c, head, ws FROM v),
        common AS (SELECT c, head, shape FROM of JOIN l USING (masked) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 8),
        gone AS (SELECT DISTINCT masked, true AS gone FROM of SEMI JOIN common USING (c, head, shape))
        SELECT doc_id, CASE WHEN any_value(text) = '' THEN 0 ELSE count(*) END AS n_lines, count(gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
        FROM x LEFT JOIN gone USING (masked) GROUP BY doc_id
    """,
    "op12_phrases": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
        g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS t(k) WHERE len(ws) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1 : j], ' ') AS first, array_to_string(ws[j + 1 : k], ' ') AS rest FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k >= 2)),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, n, 1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN n ON n.lang = c.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (SELECT lang, a, array_to_string(ws[x : x + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS x FROM (SELECT lang, k, a, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS m FROM b WHERE k > 2))),
        o AS (SELECT b.* FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
