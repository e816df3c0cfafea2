"""SQL over the same tables that the corpus queries must equal, where SQL can express them."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

EXACT = rf"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '{BLANK}+', '', 'g')) AS h,
      FROM documents),
    g AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""

#: Full shingle sets, every pair that shares a shingle, and all that is reachable over the links.
NEAR = rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
      FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
      FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    e AS (
      SELECT a.doc_id AS u, b.doc_id AS v
      FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.d),
    m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON d = doc_id
"""

WARC = """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low
      FROM pages)
    SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(h, (10 * (i // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
           CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN low = page_id THEN NULL ELSE low END AS refers_to
    FROM p
"""

SUBSTRING = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    o AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
    p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM o),
    f AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g),
    gone AS (
      SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN f USING (g) WHERE low < doc_id)),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
    k AS (
      SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone.j IS NULL) AS kept
      FROM x LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
"""


def mixing(budget: float = 0.8, power: float = 0.7, rounds: int = 12, seed: int = 7) -> str:
    """Raking written out: one step for each axis of each pass."""
    axes = ("source", "lang", "topic")
    steps, last = [], "c"
    for k in range(rounds):
        for axis in axes:
            now = f"{axis}{k}"
            steps.append(
                f"""{now} AS (
      SELECT source, lang, topic, tokens, want, s_source, s_lang, s_topic,
             least(tokens, weight * CASE WHEN have > 0 THEN s_{axis} * want / have ELSE 0 END) AS weight
      FROM (SELECT *, sum(weight) OVER (PARTITION BY {axis}) AS have FROM {last}))"""
            )
            last = now
    shares = ",\n    ".join(
        f"""sh_{a} AS (SELECT {a}, pow(own / greatest(total, 1), {power}) / sum(pow(own / greatest(total, 1), {power})) OVER () AS s_{a}
      FROM (SELECT {a}, sum(tokens) AS own FROM g GROUP BY {a}), (SELECT sum(tokens) AS total FROM g))"""
        for a in axes
    )
    return rf"""
    WITH r AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
             CASE WHEN contains(x, '|') THEN 'table'
                  WHEN contains(x, 'icense') OR contains(x, 'opyright') THEN 'legal'
                  WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) * 20 > length(x) THEN 'record'
                  WHEN length(x) < 600 THEN 'short' ELSE 'prose' END AS topic,
             len(regexp_extract_all(x, '{WORD}'))::BIGINT AS n_tokens,
             ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(x))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw
      FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
    g AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL),
    {shares},
    c AS (
      SELECT g.*, s_source, s_lang, s_topic, {budget} * (SELECT sum(tokens) FROM g) AS want, tokens * {budget} AS weight
      FROM g JOIN sh_source USING (source) JOIN sh_lang USING (lang) JOIN sh_topic USING (topic)),
    {", ".join(steps)}
    SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, round(draw, 6) AS draw, draw < p AS kept
    FROM (SELECT r.*, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS p FROM r JOIN {last} USING (source, lang, topic))
"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": EXACT,
    "op2_minhash_near_dedup": NEAR,
    "op5_warc_packages": WARC,
    "op7_substring_dedup": SUBSTRING,
    "op10_mixing": mixing(),
}
