"""DuckDB SQL for the queries that SQL can express; plain formulations without any index."""
from __future__ import annotations

from .common import LOWER, UPPER
from .line_rules import BOILERPLATE, NAVIGATION, Limits
from .url_filters import LISTED, general_rules, listed_rule


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_filters() -> str:
    """Every rule against every URL."""
    rows = [listed_rule(*r) for r in LISTED] + general_rules()
    rules = ", ".join(f"({_text(r[0])}, {_text(r[1])}, {_text(r[2])}, {r[4]}, {r[5]})" for r in rows)
    return f"""
    WITH rules(rule, action, pattern, listed, weight) AS (VALUES {rules}),
    cut AS (SELECT page_id, row_number() OVER () AS k,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    best AS (SELECT k, arg_max(struct_pack(rule := rule, action := action, listed := listed), (listed, weight, action = 'block', -o)) AS r
             FROM parts, (SELECT *, row_number() OVER (ORDER BY rule) AS o FROM rules)
             WHERE regexp_matches(host || path, pattern) GROUP BY k)
    SELECT page_id, host, path, CASE WHEN r.listed = 1 THEN r.rule END AS rule,
           CASE WHEN r.listed = 0 THEN r.rule END AS pattern, coalesce(r.action, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (k)"""


def quality_rules(lim: Limits = Limits()) -> str:
    space = r"[\x20\x09-\x0D]+"

    def squeezed(x: str) -> str:
        return f"length(regexp_replace({x}, '{space}', '', 'g'))"

    fails = f"""{squeezed('x')} > 0 AND (
        length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > {squeezed('x')} * {lim.symbol_share}
        OR length(regexp_replace(x, '[^|]+', '', 'g')) > len(regexp_split_to_array(x, '{space}')) * {lim.bar_share}
        OR (len(regexp_split_to_array(x, '{space}')) >= 4 AND length(regexp_replace(x, '[^\\p{{Lu}}!]+', '', 'g')) > {squeezed('x')} * {lim.shout_share})
        OR (length(x) <= 160 AND (regexp_matches(x, {_text(NAVIGATION)}) OR regexp_matches(x, {_text(BOILERPLATE)}))))"""
    return f"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: {squeezed('x')} > 0) AS l FROM t),
    g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w),
    g3 AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM g),
    rep AS (SELECT k, count(DISTINCT p) AS r FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY k),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({squeezed('text')} AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
                 coalesce(list_sum(list_transform(list_filter(list_distinct(l), lambda x: NOT ({fails})), lambda x: {squeezed('x')})), 0) AS left_chars
          FROM w LEFT JOIN rep USING (k))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {lim.min_words} OR 100 * n_repeat_words > {lim.repeat_percent} * n_words AS base_failed,
           NOT (n_words < {lim.min_words} OR 100 * n_repeat_words > {lim.repeat_percent} * n_words)
               AND 1 - left_chars / greatest(word_chars, 1) <= {lim.lost_share} AS kept
    FROM m"""


def sharding(shards: int = 8, per: int = 1000) -> str:
    """Boundaries from running sums over all texts and rows; tolerance one part in ``per``."""
    def edges(rows: str, by: str) -> str:
        """The row of ``rows`` that each boundary k falls into; ends a and b, sought point k * total / shards."""
        return f"""SELECT k, {by}, b - size AS a, b, total, shards * (2 * b - size) >= 2 * k * total AS first,
                   least(k * total - shards * (b - size), shards * b - k * total) AS miss
            FROM {rows} WHERE shards * (b - size) <= k * total AND k * total < shards * b"""

    # CRC-32 by its table of 256 entries, one byte at a time.
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(text), '..'), lambda y: CAST('0x' || y AS BIGINT))),
                 lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295)"""
    tab = """SELECT list(list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
             FROM range(256) u(i)"""
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, tab FROM documents, ({tab})),
    d AS (SELECT doc_id, strlen(text) + 1 AS size, {crc} AS crc, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 1, 15) AS BIGINT) AS s FROM docs),
    c AS (SELECT k, {shards} AS shards, (SELECT CAST(sum(size) AS HUGEINT) FROM d) AS total FROM range(1, {shards}) t(k)),
    texts AS (SELECT h, size, rows, sum(size) OVER (ORDER BY h) AS b FROM (SELECT h, CAST(sum(size) AS HUGEINT) AS size, count(DISTINCT s) AS rows FROM d GROUP BY h)),
    t AS ({edges('texts, c', 'h, rows')}),
    rows AS (SELECT h, s, size, sum(size) OVER (ORDER BY h, s) AS b FROM (SELECT h, s, CAST(sum(size) AS HUGEINT) AS size FROM d GROUP BY h, s)),
    r AS ({edges('rows, c', 'h, s')}),
    cuts AS (SELECT k, CASE WHEN t.miss * {per} <= t.total OR t.rows = 1 THEN h + if(t.first, 0, 1) ELSE h END AS ch,
                    CASE WHEN t.miss * {per} <= t.total OR t.rows = 1 THEN 0 ELSE r.s + if(r.first, 0, 1) END AS cs FROM t JOIN r USING (k, h)),
    p AS (SELECT d.*, (SELECT count(*) FROM cuts WHERE ch < d.h OR (ch = d.h AND cs <= d.s)) AS shard FROM d)
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY s, h) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


def ranked_search(k: int = 10) -> str:
    """Every term of every item against every document."""
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS u, doc_id, {terms} AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
    q AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {terms} AS w FROM benchmark)),
    p AS (SELECT u, any_value(doc_id) AS doc_id, any_value(len(w)) AS len, term, count(*) AS tf FROM (SELECT u, doc_id, w, unnest(w) AS term FROM d) GROUP BY u, term),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n),
    scored AS (SELECT i, item_id, u, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n) // CAST(l AS BIGINT))))) AS BIGINT) AS score
               FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY i, item_id, u, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, u) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {k}"""


def filter_audit() -> str:
    """All orders by joins of the letters; every count straight from the documents' masks."""
    letters = "ABCDE"
    order = " || ".join(f"l{i}.f" for i in range(5))
    joins = " JOIN ".join([f"letters l{i}" + (" ON " + " AND ".join(f"l{i}.f <> l{j}.f" for j in range(i)) if i else "") for i in range(5)])
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    return f"""
    WITH letters(f, bit) AS (VALUES {values}),
    t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
    m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask,
                 doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
    orders AS (SELECT {order} AS filter_order FROM {joins}),
    steps AS (SELECT filter_order, step, f, bit, (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE instr(filter_order, e.f) < step) AS before
              FROM orders, range(1, 6) s(step) JOIN letters ON f = substr(filter_order, step, 1)),
    counted AS (SELECT part, filter_order, step, f,
               sum(CASE WHEN mask & CAST(before + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
               FROM steps, cells GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""
