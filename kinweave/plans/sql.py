"""The linkage queries once more, in plain SQL: what the registered queries must equal."""

from __future__ import annotations

from ..functions import normalize as N


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(pairs: dict[str, str]) -> str:
    keys, values = (", ".join(f"'{x}'" for x in side) for side in (pairs, pairs.values()))
    return f"map([{keys}], [{values}])"


def _skeleton(t: str) -> str:
    out = f"regexp_replace({t}, '[^a-z]', '', 'g')"
    for old, new in N.SOUNDS:
        out = f"replace({out}, '{old}', '{new}')"
    # one h after a consonant goes; what follows a removed h was judged in the same pass
    out = f"regexp_replace({out}, '([bcdfgjklmnpqrstvxz])h', '\\1', 'g')"
    out = f"regexp_replace({out}, '[aeiou]', '', 'g')"
    for c in "bcdfghjklmnpqrstvwxyz":
        out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
    return out


def _unleet(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[a-z]') THEN translate({t}, '{N.LEET[0]}', '{N.LEET[1]}') ELSE {t} END"


_NUMBER = "'^0*([0-9]+)(?:st|nd|rd|th|e|er|eme)?$'"
_CANON = {v: k for k, vs in N.ADDRESS_WORDS.items() for v in vs.split()}

UNIVERSE = r"""
tok AS (SELECT doc_id AS id, lang AS country,
               list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t
        FROM documents),
rec AS (SELECT id, country, t[1:6] AS nt, t[7:18] AS adr, array_to_string(t[1:6], ' ') AS business_name,
               array_to_string(t[7:18], ' ') AS business_address FROM tok),
uni AS (SELECT *, min(id) OVER (PARTITION BY country, business_name) AS leader FROM rec),
ent AS (SELECT *, id = leader AND id % 4 <> 0 AS is_ref FROM uni)
"""

PREPARED = f"""{UNIVERSE},
n1 AS (SELECT *, list_transform(nt, lambda x: {_unleet('x')}) AS nc FROM ent),
n2 AS (SELECT *, list_filter(nc, lambda x: x NOT IN {_list(N.LEGAL + N.LEGAL_FRENCH)}) AS c0 FROM n1),
n3 AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE nc END AS core FROM n2),
n4 AS (SELECT *, list_filter(list_transform(core, lambda x: {_skeleton('x')}), lambda x: x <> '' AND x NOT IN {_list(N.LEGAL_SKELETONS)}) AS sk,
       CASE WHEN len(adr) = 0 THEN [] ELSE CASE WHEN map_contains({_map(N.STATES)}, business_address) THEN [map_extract({_map(N.STATES)}, business_address)[1]] ELSE adr END END AS a0 FROM n3),
n5 AS (SELECT *, list_transform(a0, lambda x: coalesce(map_extract({_map({w: str(k) for k, w in enumerate(N.ORDINALS)})}, x)[1], x)) AS a1 FROM n4),
n6 AS (SELECT *, list_filter(list_transform(a1, lambda x: CASE WHEN regexp_matches(x, {_NUMBER}) THEN regexp_extract(x, {_NUMBER}, 1)
         WHEN coalesce(map_extract({_map(_CANON)}, x)[1], x) IN {_list(N.ADDRESS_DROPPED)} THEN ''
         ELSE {_unleet(f"coalesce(map_extract({_map(_CANON)}, x)[1], x)")} END), lambda x: x <> '') AS ac FROM n5),
prep AS (SELECT id, country, business_name, business_address, leader, is_ref, nc, core, sk, ac,
       list_filter(ac, lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS al, list_filter(ac, lambda x: regexp_matches(x, '^[0-9]+$')) AS nu,
       len(adr) = 0 AS addr_empty FROM n6),
full_ AS (SELECT *, list_filter(list_transform(al, lambda x: {_skeleton('x')}), lambda x: x <> '') AS ask, array_to_string(core, '') AS compact FROM prep)"""

KEYS = """
nk AS (SELECT id, country, is_ref, unnest(list_distinct(list_concat(list_transform(core, lambda x: 'w:' || x),
         list_transform(list_filter(sk, lambda x: length(x) >= 2), lambda x: 'k:' || x),
         CASE WHEN length(compact) >= 4 THEN ['c:' || compact, 'p:' || compact[1:6]] ELSE [] END))) AS k FROM full_),
ak AS (SELECT id, country, is_ref, unnest(list_distinct(list_concat(list_transform(al, lambda x: 'a:' || x),
         list_transform(list_filter(ask, lambda x: length(x) >= 3), lambda x: 'ak:' || x), list_transform(nu, lambda x: 'n:' || x),
         CASE WHEN len(nu) > 0 AND len(al) > 0 THEN ['h:' || nu[1] || '_' || al[1]] ELSE [] END))) AS k FROM full_),
post AS (SELECT 'name' AS field, * FROM nk UNION ALL SELECT 'addr', * FROM ak),
sizes AS (SELECT country, count(*) AS n FROM full_ WHERE NOT is_ref GROUP BY country),
dfs AS (SELECT country, field, k, count(*) AS df FROM post WHERE NOT is_ref GROUP BY ALL)"""


def weights(cap: int | None, post: str = "post", dfs: str = "dfs", tag: str = "") -> str:
    frequent = "" if cap is None else f"coalesce(df, 0) <= {cap} AND "
    return f"""
w0{tag} AS (SELECT p.*, ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM {post} p JOIN sizes USING (country) LEFT JOIN {dfs} USING (country, field, k)
       WHERE {frequent}ln((n + 1) / (coalesce(df, 0) + 1)) <> 0),
w1{tag} AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id, field)) AS u FROM w0{tag})"""


def pairs(cap: int | None = 2500) -> str:
    return f"""WITH {PREPARED}, {KEYS}, {weights(cap)},
prs AS (SELECT a.id AS q, b.id AS r, round(coalesce(sum(a.u * b.u) FILTER (a.field = 'name'), 0), 6) AS name_cos,
        round(coalesce(sum(a.u * b.u) FILTER (a.field = 'addr'), 0), 6) AS addr_cos
        FROM w1 a JOIN w1 b ON a.is_ref AND NOT b.is_ref AND a.country = b.country AND a.field = b.field AND a.k = b.k GROUP BY ALL)"""


def top(k: int, score: str, source: str = "prs") -> str:
    return f"""SELECT q, r, score FROM (SELECT q, r, round({score}, 6) AS score FROM {source}) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, r) <= {k}"""


def base() -> str:
    return f"""base AS (SELECT q, r, max(score) AS score FROM ({top(45, 'name_cos + addr_cos')} UNION ALL {top(10, 'name_cos')}) GROUP BY ALL)"""


def conj_pairs(cap: int = 500) -> str:
    return f"""cs AS (SELECT *, list_filter(sk, lambda x: length(x) >= 2)[1:3] AS s3, ac[1:8] AS a8 FROM full_),
ck AS (SELECT id, country, is_ref, 'conj' AS field, unnest(list_distinct(list_concat(
   flatten(list_transform(list_sort(list_distinct(a8)), lambda a: list_transform(list_filter(list_sort(list_distinct(a8)), lambda b: b > a), lambda b: 'aa:' || a || '|' || b))),
   flatten(list_transform(s3, lambda n: list_transform(a8, lambda a: 'sa:' || n || '|' || a))),
   flatten(list_transform(list_sort(list_distinct(s3)), lambda a: list_transform(list_filter(list_sort(list_distinct(s3)), lambda b: b > a), lambda b: 'nn:' || a || '|' || b)))))) AS k FROM cs),
cdf AS (SELECT country, field, k, count(*) AS df FROM ck WHERE NOT is_ref GROUP BY ALL), {weights(cap, 'ck', 'cdf', 'c')},
cprs AS (SELECT a.id AS q, b.id AS r, sum(a.u * b.u) AS c FROM w1c a JOIN w1c b ON a.is_ref AND NOT b.is_ref AND a.country = b.country AND a.k = b.k GROUP BY ALL)"""


def bm25_pairs(cap: int = 10000) -> str:
    return f"""bk AS (SELECT DISTINCT id, country, is_ref, k FROM post), bdf AS (SELECT country, k, count(*) AS df FROM bk WHERE NOT is_ref GROUP BY ALL),
bl AS (SELECT f.id, f.country, count(k) AS dl FROM full_ f LEFT JOIN bk b ON f.id = b.id WHERE NOT f.is_ref GROUP BY ALL),
bm AS (SELECT country, greatest(avg(dl), 1) AS mean FROM bl GROUP BY country),
bw AS (SELECT b.country, b.id, b.k, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / mean)) AS w
       FROM bk b JOIN bdf USING (country, k) JOIN sizes USING (country) JOIN bl ON bl.id = b.id JOIN bm ON bm.country = b.country WHERE NOT b.is_ref AND df <= {cap}),
bprs AS (SELECT a.id AS q, b.id AS r, sum(w) AS c FROM bk a JOIN bw b ON a.country = b.country AND a.k = b.k WHERE a.is_ref GROUP BY ALL)"""


RESCUE = """rk AS (SELECT id, country, is_ref, unnest(list_concat(CASE WHEN length(compact) >= 5 THEN ['c:' || compact] ELSE [] END,
   CASE WHEN length(array_to_string(list_sort(sk), '')) >= 4 THEN ['s:' || array_to_string(list_sort(sk), '')] ELSE [] END,
   CASE WHEN length(array_to_string(list_distinct(nu), '')) >= 4 THEN ['n:' || array_to_string(list_sort(list_distinct(nu)), '|')] ELSE [] END)) AS k FROM full_),
rs AS (SELECT country, k FROM rk WHERE NOT is_ref GROUP BY ALL HAVING count(*) <= 30),
resc AS (SELECT DISTINCT a.id AS q, b.id AS r, 1.0::DOUBLE AS score FROM rk a JOIN rk b ON a.is_ref AND NOT b.is_ref AND a.country = b.country AND a.k = b.k
         JOIN rs ON rs.country = b.country AND rs.k = b.k)"""

TRUTH = "truth AS (SELECT leader AS q, id AS r FROM ent WHERE NOT is_ref AND leader % 4 <> 0)"
SCORED = f"{base()}, scored AS (SELECT b.q, b.r, name_cos, addr_cos, round(0.6 * name_cos + 0.4 * addr_cos, 6) AS p FROM base b JOIN prs USING (q, r))"


# ---- pieces of the feature and diagnostic queries --------------------------------------------------------------------


def jaccard(x: str, y: str) -> str:
    """Share of common distinct items of two lists; 0 if either is empty."""
    both, either = f"len(list_intersect(list_distinct({x}), list_distinct({y})))", f"len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN round({both} / {either}, 6) ELSE 0 END"


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial EDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return f"[{', '.join(out)}]"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte; needs the table ``crc`` with its column t."""
    each = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


CRC = f"crc AS (SELECT {_crc_table()}::BIGINT[] AS t)"


def _bits(items: str, table: dict[str, int]) -> str:
    keys, values = ", ".join(f"'{k}'" for k in table), ", ".join(map(str, table.values()))
    return f"coalesce(list_bit_or(list_transform({items}, lambda x: coalesce(map_extract(map([{keys}], [{values}]::BIGINT[]), x)[1], 0))), 0)"


def profiles(legal: dict[str, int], noise: dict[str, int], sounds: dict[str, int]) -> str:
    """pro: legal, noise, wsig, hnum, hlen of every record."""
    return f"""{CRC},
p0 AS (SELECT *, list_filter(nc, lambda x: x NOT IN {_list(legal)}) AS plain FROM full_),
p1 AS (SELECT *, list_filter(plain, lambda x: x NOT IN {_list(noise)}) AS other FROM p0),
p2 AS (SELECT *, list_transform(list_filter(other, lambda x: length(x) >= 5), lambda x: {_skeleton('x')}) AS far,
         list_filter(list_transform(list_filter(other, lambda x: length(x) < 5 OR {_skeleton('x')} NOT IN {_list(sounds)}), lambda x: {_skeleton('x')}), lambda x: x <> '') AS marks,
         coalesce(regexp_extract(nu[1], '^([0-9]+)', 1), '') AS digits FROM p1),
pm AS (SELECT id, bit_or((1::HUGEINT << ({crc32('mark')} & 63)::INT)) AS wsig FROM (SELECT id, unnest(marks) AS mark FROM p2), crc GROUP BY id),
pro AS (SELECT p2.id, country, is_ref, core, {_bits('nc', legal)} | {_bits('far', sounds)} AS legal, {_bits('plain', noise)} AS noise, coalesce(wsig, 0::HUGEINT) AS wsig,
         CASE WHEN digits <> '' THEN substr(digits, 1, 15)::BIGINT ELSE -1 END AS hnum, length(digits) AS hlen FROM p2 LEFT JOIN pm ON pm.id = p2.id)"""


#: Bucket features of true pairs; ``missed`` where the first 3 by both and the first by name lack the pair.
MISSED = f"""few AS (SELECT q, r FROM ({top(3, 'name_cos + addr_cos')}) UNION SELECT q, r FROM ({top(1, 'name_cos')})),
freq AS (SELECT country, core, count(*) AS n FROM full_ WHERE NOT is_ref GROUP BY country, core),
pt0 AS (SELECT t.q, t.r, coalesce(name_cos + addr_cos, 0) AS comb, few.q IS NULL AS missed, a.country, a.core AS lcore, b.core AS rcore, a.sk AS lsk, b.sk AS rsk,
    a.ac AS lac, b.ac AS rac, a.nu AS lnu, b.nu AS rnu, a.compact AS lcompact, b.compact AS rcompact, b.addr_empty AS r_addr_empty,
    regexp_matches(b.business_name, '[\u0900-\u0D7F]') AS r_native, regexp_matches(b.business_name, 'formerly|fka|aka|dba|trading as|doing business as') AS r_alias_or_web,
    regexp_extract_all(a.business_address, '\\b([0-9]{{5,6}})\\b', 1) AS lpost, regexp_extract_all(b.business_address, '\\b([0-9]{{5,6}})\\b', 1) AS rpost,
    a.business_address AS laddr, b.business_address AS raddr, coalesce(n, 0) AS s1_name_freq
  FROM truth t JOIN full_ a ON t.q = a.id JOIN full_ b ON t.r = b.id LEFT JOIN prs ON prs.q = t.q AND prs.r = t.r LEFT JOIN few ON few.q = t.q AND few.r = t.r
  LEFT JOIN freq ON freq.country = a.country AND freq.core = a.core),
pt AS (SELECT *, 'S2' AS source, {jaccard('lcore', 'rcore')} AS name_tok_jac, {jaccard('lsk', 'rsk')} AS name_skel_jac, {jaccard('lac', 'rac')} AS addr_tok_jac,
    {jaccard('lnu', 'rnu')} AS num_jac, lcompact = rcompact AS name_compact_eq, len(lnu) > 0 AS s1_has_num, len(rnu) > 0 AS r_has_num, len(lpost) > 0 AND len(rpost) > 0 AS postcode_both,
    len(list_intersect(lpost, rpost)) > 0 AS postcode_eq, laddr = raddr AS last_comp_eq, len(lcore) AS s1_name_tokens, length(array_to_string(lcore, ' ')) AS s1_name_chars,
    len(rac) AS r_addr_tokens FROM pt0)"""


def modes(rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules)
    return f"SELECT mode, country, count(*) AS pairs FROM (SELECT country, CASE {cases} ELSE 'other' END AS mode FROM pt WHERE missed) GROUP BY mode, country"


def flags(rules: dict[str, str]) -> str:
    share = lambda rule, side: f"round(coalesce(avg(({rule})::INT::DOUBLE) FILTER ({side}), 0), 6)"
    rows = " UNION ALL ".join(f"SELECT '{name}' AS flag, {share(rule, 'missed')} AS share_of_misses, {share(rule, 'NOT missed')} AS share_of_hits FROM pt" for name, rule in rules.items())
    return f"SELECT *, round(share_of_misses / nullif(share_of_hits, 0), 6) AS lift FROM ({rows})"
