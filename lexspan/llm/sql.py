"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lexspan.llm.secrets import STEPS, Entropy
from lexspan.llm.urls import RULES, Templates


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def secret_scan_sql(how: Entropy | None = None) -> str:
    """The secret scan. Backward references and limited case folding are written out."""
    how = how or Entropy()
    keys = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {
        "assign": assign,
        "access": "AKIA[A-Z0-9]{14,}",
        "hex": "[0-9a-f]{16,}",
        "entropy": f"[A-Za-z0-9+/_-]{{{how.window},}}",
    }
    letters = [chr(c) for c in range(0x21, 0x7F) if chr(c).isalnum() or chr(c) in "/_-"]
    runs = "|".join([r"\+" * 6, *(c * 6 for c in letters)])
    allowed = [runs if p == r"(.)\1{5}" else p for p in how.allowed if p != STEPS]
    terms = "[" + ", ".join(map(str, how.terms())) + "]"
    word = "(?:[A-Za-z]|[A-Z]*|[A-Z]?[a-z]+|(?:[A-Z]?[a-z]{2,})+)[0-9]*"
    rest = "m.c"
    for p in allowed:
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"

    def mixed(x: str) -> str:
        return f"regexp_matches({x}, '[0-9]') AND regexp_matches({x}, '[A-Za-z]')"

    def limit(x: str, letters: str) -> str:
        return f"CASE WHEN regexp_full_match({x}, '[{letters}]+') THEN {how.limit(how.hex_bits)} ELSE {how.limit(how.key_bits)} END"

    def reaches(x: str, most: str) -> str:
        least = (
            f"list_min(list_transform(range(0, length(w) - {how.window - 1}), lambda i: "
            f"list_sum(list_transform(map_values(list_aggregate(string_split(substr(w, CAST(i AS INT) + 1, {how.window}), ''), "
            f"'histogram')), lambda n: CAST({terms}[CAST(n AS INT) + 1] AS BIGINT)))))"
        )
        return f"len(list_filter(string_split({x}, ' '), lambda w: length(w) >= {how.window} AND {least} <= {most})) > 0"

    whole = reaches(rest, limit("m.c", "0-9a-fA-F"))
    by_step = f"len(list_filter(string_split({rest}, '/'), lambda x: {mixed('x')} AND {reaches('x', limit('x', '0-9a-fA-F '))})) > 0"
    worded = f"len(list_filter(regexp_split_to_array(m.c, '[-_+/]+'), lambda x: NOT regexp_full_match(x, '{word}'))) = 0"
    found = whole
    if STEPS in how.allowed:
        found = f"CASE WHEN NOT regexp_matches(m.c, '{STEPS}') THEN {whole} WHEN {by_step} THEN true WHEN {worded} THEN false ELSE {whole} END"
    fits = f"CASE WHEN {mixed('m.c')} THEN {found} ELSE false END"
    parts, chosen = [], []
    for k, (kind, p) in enumerate(patterns.items()):
        values = f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else "[]"
        parts.append(
            f"""{kind}_found AS (
  SELECT row, unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack(
      s := CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INT),
      k := {k}, c := h[i], v := {'v[i]' if kind == 'assign' else "''"}))) AS m
  FROM (SELECT row, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS h, {values} AS v
    FROM texts) WHERE len(h) > 0)"""
        )
        keep = {"assign": "length(m.v) >= 12", "entropy": fits}.get(kind, "true")
        chosen.append(
            f"SELECT row, m.s AS s, m.k AS k, m.s + length(m.c) AS e, '{kind}:' || m.s || ':' || (m.s + length(m.c)) AS w "
            f"FROM {kind}_found WHERE {keep}"
        )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
spans AS ({" UNION ALL ".join(chosen)}),
folded AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    count(*) FILTER (k = 3) AS n_entropy, string_agg(w, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    string_agg(w, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM texts LEFT JOIN folded USING (row)
"""


def url_filter_sql(how: Templates | None = None) -> str:
    how = how or Templates()
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    levels = []
    for d in range(how.depth):
        levels.append(
            f"""c{d} AS (SELECT host, t, segs[{d + 1}] AS seg, count(*) AS n FROM p{d} WHERE len(segs) > {d} GROUP BY ALL),
n{d} AS (SELECT host, t, sum(n) AS every, count(*) AS kinds FROM c{d} GROUP BY ALL),
p{d + 1} AS (SELECT p.* EXCLUDE (t), CASE WHEN len(segs) > {d} THEN p.t || '/' || CASE
    WHEN NOT (kinds >= {how.children} AND every <= {how.pages_per_child} * kinds)
      OR (n >= {how.own_pages} AND 100 * n >= {how.own_percent} * every) THEN segs[{d + 1}] ELSE '*' END ELSE p.t END AS t
  FROM p{d} p LEFT JOIN c{d} c ON c.host = p.host AND c.t = p.t AND c.seg = p.segs[{d + 1}]
  LEFT JOIN n{d} m ON m.host = p.host AND m.t = p.t)"""
        )
    rules = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{v}', '{h}{p}']"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return rf"""
WITH bad_docs AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
cut AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
p0 AS (SELECT page_id, host, path, bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS t
  FROM parsed LEFT JOIN bad_docs ON doc_id = try_cast(regexp_extract(path, '/(\d{{1,18}})[^/\d]*/?$', 1) AS BIGINT)),
{", ".join(levels)},
placed AS (SELECT * EXCLUDE (t), CASE WHEN len(segs) > {how.depth} THEN t || '/**' ELSE t END AS template FROM p{how.depth}),
stats AS (SELECT host, template, regexp_replace(template, '/[^/*][^/]*', '/+', 'g') AS shape,
  count(bad) AS labelled, count(*) FILTER (bad) AS n_bad FROM placed GROUP BY ALL),
shapes AS (SELECT host, shape, sum(n_bad) / greatest(sum(labelled), 1) AS share FROM stats GROUP BY ALL),
total AS (SELECT (sum(labelled) - sum(n_bad) + 1) / (sum(labelled) + 2) AS prior FROM stats),
branched AS (SELECT stats.*, CASE WHEN labelled > 0 AND abs(n_bad / greatest(labelled, 1) - share)
    > {how.z} * sqrt(share * (1 - share) / greatest(labelled, 1)) + 1e-12 THEN template ELSE shape END AS branch
  FROM stats JOIN shapes USING (host, shape)),
judged AS (SELECT host, branch, CAST(sum(labelled) - sum(n_bad) + {how.prior}::DOUBLE * any_value(prior) AS DOUBLE)
    / CAST(sum(labelled) + {how.prior}::DOUBLE AS DOUBLE) AS purity FROM branched, total GROUP BY ALL),
ruled AS (SELECT *, CASE {rules} END AS r FROM placed)
SELECT page_id, host, path, r[2] AS rule,
  coalesce(r[1], CASE WHEN purity < {how.threshold} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled JOIN branched USING (host, template) JOIN judged USING (host, branch)
"""


def conversation_repair_sql() -> str:
    """The repair of damaged conversations: the best way to every last role, one row after the other."""

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def more(way: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'e': {way}.e || '{edit}'}} END"

    # One word for every last role: n(othing), s(ystem), u(ser), a(ssistant).
    user = best("u", *(more(x, "5", "I") for x in "nsa"))
    way = "STRUCT(c BIGINT, e VARCHAR)"

    def after(role: str) -> str:
        other = {"u": ("n", "s", "a"), "a": ("u",)}.get(role, ())
        stay = f"CASE WHEN stays THEN {{}} END"
        kept = [stay.format(f"CASE WHEN initial = '{role}' THEN {more(x, 'extra', 'K')} END") for x in other]
        kept += [stay.format(more(x, "extra + 1", "R")) for x in other]
        if role == "s":
            kept = [stay.format(f"CASE WHEN initial = 's' THEN {more('n', 'extra', 'K')} END")]
        return best(more(role, "2", "D"), *kept)

    def opened(source: str) -> str:
        """Inserts in front of the next row."""
        return f"SELECT * REPLACE ({best('a', more('u', '5', 'I'))} AS a) FROM (SELECT * REPLACE ({user} AS u) FROM {source})"

    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
        "lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"
    )
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM hurt),
judged AS (
  SELECT conv_id, turn, role, text, place, left(role, 1) AS initial, NOT regexp_matches(text, '{word}') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) NOT IN ('su', 'ua', 'au'),
      false) AS unlawful FROM placed),
line AS (
  SELECT *, NOT (blank OR again) AS stays, CASE WHEN cut THEN 5 ELSE 0 END AS extra,
    place = max(place) OVER (PARTITION BY conv_id) AS ends FROM judged),
ways AS (
  SELECT conv_id, 0::BIGINT AS place, false AS ends, {{'c': 0::BIGINT, 'e': ''}}::{way} AS n, NULL::{way} AS s,
    NULL::{way} AS u, NULL::{way} AS a FROM line WHERE place = 1
  UNION ALL
  SELECT conv_id, place, ends, {after("n")} AS n, {after("s")} AS s, {after("u")} AS u, {after("a")} AS a
  FROM (SELECT w.* EXCLUDE (place, ends), l.place, l.ends, l.initial, l.stays, l.extra
    FROM ({opened("ways")}) w JOIN line l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.place = w.place + 1)),
cheapest AS (SELECT conv_id, {best("n", "a")} AS best FROM ({opened("ways")}) WHERE ends),
edits AS (
  SELECT conv_id, spot, best.e[spot] AS edit, sum(CASE best.e[spot] WHEN 'I' THEN 0 ELSE 1 END) OVER w AS place,
    sum(CASE best.e[spot] WHEN 'D' THEN 0 ELSE 1 END) OVER w AS number
  FROM (SELECT conv_id, best, unnest(range(1, length(best.e) + 1)) AS spot FROM cheapest)
  WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
repaired AS (
  SELECT e.conv_id, e.spot, CASE WHEN edit = 'K' THEN l.role
      WHEN (number + max(CASE WHEN edit = 'K' AND l.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id)) % 2 = 1
        THEN 'user' ELSE 'assistant' END AS role,
    CASE edit WHEN 'I' THEN '' ELSE l.text END AS text
  FROM edits e LEFT JOIN line l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.place = e.place WHERE edit <> 'D'),
digests AS (
  SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY spot)) AS digest FROM repaired GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT blank AND NOT again) AS truncated,
    count_if(unlawful) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN cheapest b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
