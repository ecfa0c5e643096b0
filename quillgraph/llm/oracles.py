"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE_PATTERN, SENTENCE_END_PATTERN, SEPARATORS, Rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql(rules: Rules = Rules()) -> str:  # noqa: B008
    """All of the quality report but the cleaned text."""
    k = rules.repeat_window
    separators = "[" + ", ".join(quoted(x) for x in sorted(SEPARATORS)) + "]"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
        l AS (SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
        r AS (SELECT doc_id, line, len(lw) AS n, CASE
            WHEN len(lw) > 2 AND 5 * len([w FOR w IN lw IF list_contains({separators}, w)]) >= len(lw) THEN 'navigation'
            WHEN 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > length(line) OR 2 * len(regexp_extract_all(line, '[!?]')) > len(lw) THEN 'punctuation'
            WHEN len(regexp_extract_all(line, '[A-Za-z]')) >= 20 AND 5 * len(regexp_extract_all(line, '[A-Z]')) > 3 * len(regexp_extract_all(line, '[A-Za-z]')) THEN 'punctuation'
            WHEN len(lw) <= {rules.boilerplate_words} AND regexp_matches(line, {quoted('(?i)(?:' + BOILERPLATE_PATTERN + ')')}) THEN 'boilerplate'
            WHEN NOT regexp_matches(line, {quoted(SENTENCE_END_PATTERN)}) THEN 'punctuation' END AS rule FROM l WHERE len(lw) > 0),
        p AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (rule = 'punctuation') AS lost_punctuation, count(*) FILTER (rule = 'navigation') AS lost_navigation,
            count(*) FILTER (rule = 'boilerplate') AS lost_boilerplate, coalesce(sum(n) FILTER (rule IS NOT NULL), 0)::BIGINT AS n_lost_words FROM r GROUP BY 1),
        s AS (SELECT doc_id, unnest(range(1, len(ws) - {k - 2})) AS start, ws FROM d),
        g AS (SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[start:start + {k - 1}], ' ')) AS n FROM s),
        c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(start, start + {k})) AS place FROM g WHERE n > 1) GROUP BY 1),
        b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d),
        a AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
            coalesce(lost_punctuation, 0)::BIGINT AS lost_punctuation, coalesce(lost_navigation, 0)::BIGINT AS lost_navigation, coalesce(lost_boilerplate, 0)::BIGINT AS lost_boilerplate,
            coalesce(n_lost_words, 0)::BIGINT AS n_lost_words FROM b LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id))
        SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
            NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND n_lost_words <= {rules.max_lost_share} * n_words AS kept FROM a
    """


def shares(rows: str, out: str, by: str, key: str, weight: str, seats: str, most: str) -> str:
    """Seats of `by`-groups of a table by the highest quotients, as common table expressions that end in one of this name: (by, key, n)."""
    return f"""{out}_q AS (SELECT {by}, {key}, {seats} AS seats, unnest(range(0, {most})) AS j, {weight} AS w FROM {rows} WHERE {weight} > 0),
        {out} AS (SELECT {by}, {key}, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY w / (2 * j + 1) DESC, {key}, j) AS place FROM {out}_q) WHERE place <= seats GROUP BY 1, 2)"""


MIXING = f"""
        WITH z AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
        lots AS (SELECT *, md5('17:' || doc_id || ':' || size) AS lot FROM z),
        so AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n_docs FROM z GROUP BY 1),
        ra AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM so),
        we AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 3 * size AS fill, 0 AS grp FROM ra),
        le AS (SELECT *, fill / weight AS cap_at, sum(size) OVER () AS total, (sum(size) OVER () - coalesce(sum(fill) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM we WINDOW before AS (ORDER BY fill / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        op AS (SELECT (SELECT level FROM le WHERE level <= cap_at ORDER BY cap_at, rank LIMIT 1) AS level),
        ta AS (SELECT le.* EXCLUDE (level), coalesce(least(fill::DOUBLE, weight * op.level), fill::DOUBLE) AS target, greatest(1, least(1024, floor(total / 65536)))::BIGINT AS block FROM le, op),
        pl AS (SELECT *, floor(sum(target) OVER () / block + 0.5)::BIGINT AS seats, ceil(n_docs / 4096)::BIGINT AS shards, (3 * ceil(size / block))::BIGINT AS most FROM ta),
        {shares("pl", "qu", "grp", "rank", "target", "seats", "most")},
        pa AS (SELECT pl.*, coalesce(qu.n, 0) AS quota FROM pl LEFT JOIN qu USING (rank)),
        la AS (SELECT doc_id, lots.source, lots.size, pa.size AS source_size, target, rank, block, quota, ('0x' || lot[1:8])::BIGINT % shards AS shard, lot FROM lots JOIN pa ON lots.source IS NOT DISTINCT FROM pa.source),
        st AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY lot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM la),
        sh AS (SELECT rank, shard, block, quota, ceil(sum(size) / block)::BIGINT AS blocks FROM la GROUP BY 1, 2, 3, 4),
        ti AS (SELECT *, CASE WHEN sum(blocks) OVER (PARTITION BY rank) > 0 THEN least(quota // sum(blocks) OVER (PARTITION BY rank), 3) ELSE 0 END::BIGINT AS times, sum(blocks) OVER (PARTITION BY rank) AS own FROM sh),
        re AS (SELECT *, CASE WHEN times < 3 THEN quota - times * own ELSE 0 END::BIGINT AS rest FROM ti),
        {shares("re", "ex", "rank", "shard", "blocks", "rest", "blocks")},
        bl AS (SELECT re.rank, re.shard, coalesce(ex.n, 0) AS extra, times, block, unnest(range(0, blocks)) AS k FROM re LEFT JOIN ex USING (rank, shard)),
        ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank, shard ORDER BY md5('17:' || rank || ':' || shard || ':' || k), k) AS drawn FROM bl) WHERE drawn <= extra),
        du AS (SELECT st.doc_id, st.lot, sum(least(st.start + st.size, (k + 1) * ch.block) - greatest(st.start, k * ch.block)) AS once FROM st JOIN ch ON st.rank = ch.rank AND st.shard = ch.shard
            AND st.size > 0 AND k * ch.block < st.start + st.size AND (k + 1) * ch.block > st.start GROUP BY 1, 2)
        SELECT st.doc_id, source, st.size, source_size, target, (st.size * times + coalesce(once, 0))::BIGINT AS taken FROM st JOIN ti USING (rank, shard) LEFT JOIN du USING (doc_id, lot)
    """

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_sql(),
    "op9_mix_sources": MIXING,
    "op3_repeated_phrases": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS start, ws FROM d),
        w AS (SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(ws[start:start + 19], ' ') ORDER BY doc_id, start) AS n FROM s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM w WHERE n > 1),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
        kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS l FROM documents),
        g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY l DESC, doc_id) AS keep_id FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS g FROM d),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN c USING (doc_id) JOIN m ON x = d.doc_id
    """,
    "op10_warc_packages": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM h)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to FROM g
    """,
}
