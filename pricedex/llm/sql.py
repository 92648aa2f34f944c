"""DuckDB SQL of the training-data queries that SQL can express at the scale of the SQL check."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _url_filter(order: int = 4) -> str:
    """The whole model in SQL: rules, n-gram levels, Witten-Bell smoothing, calibrated threshold."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = [
        ("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
        ("org", "/", "allow")
    ]
    parts = [
        "base AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base)",
        f"ruled AS (SELECT *, CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in rules)} END AS rule, CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)} END AS ruled, host || path AS scored FROM split)",
        f"urls AS (SELECT scored, count(*) AS n, any_value(ruled) AS ruled, instr('0123456789abcdef', substr(md5(scored), 1, 1)) % 5 = 0 AS held, repeat(chr(2), {order}) || scored || chr(3) AS padded FROM ruled GROUP BY scored)",
        f"grams AS (SELECT scored, n, ruled, held, substr(padded, i, {order + 1}) AS gram FROM urls, unnest(range(1, length(padded) - {order} + 1)) AS t(i))",
        f"l{order} AS (SELECT gram, coalesce(sum(n) FILTER (ruled = 'allow' AND NOT held), 0) AS a, coalesce(sum(n) FILTER (ruled = 'block' AND NOT held), 0) AS b FROM grams GROUP BY gram)",
    ]
    for k in range(order - 1, -1, -1):
        parts.append(f"l{k} AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM l{k + 1} GROUP BY 1)")
    for k in range(order + 1):
        below = f"JOIN p{k - 1} ON p{k - 1}.gram = substr(l{k}.gram, 2)" if k else "CROSS JOIN (SELECT 1.0 / count(*) AS qa, 1.0 / count(*) AS qb FROM l0)"
        parts.append(
            f"c{k} AS (SELECT substr(gram, 1, {k}) AS ctx, sum(a) AS ta, sum(b) AS tb, greatest(count(*) FILTER (a > 0), 1) AS da, greatest(count(*) FILTER (b > 0), 1) AS db FROM l{k} GROUP BY 1)"
        )
        parts.append(
            f"p{k} AS (SELECT l{k}.gram, (a + da * qa) / (ta + da) AS qa, (b + db * qb) / (tb + db) AS qb FROM l{k} JOIN c{k} ON ctx = substr(l{k}.gram, 1, {k}) {below})"
        )
    parts += [
        f"weights AS (SELECT gram, CAST(round((ln(qa) - ln(qb)) * 1000000) AS BIGINT) AS weight FROM p{order})",
        "scores AS (SELECT scored, any_value(ruled) AS ruled, any_value(held) AS held, any_value(n) AS n, CAST(floor(sum(weight) / count(*)) AS BIGINT) AS score FROM grams JOIN weights USING (gram) GROUP BY scored)",
        "bins AS (SELECT CAST(floor(least(greatest(score, -10000000), 10000000) / 200) * 200 AS BIGINT) AS edge, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b FROM scores WHERE held AND ruled IS NOT NULL GROUP BY 1)",
        "sums AS (SELECT edge, sum(a) OVER (ORDER BY edge) AS below_a, sum(b) OVER (ORDER BY edge) AS below_b, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b FROM bins)",
        "tries AS (SELECT 0 AS k, min(edge) AS cut, max(all_a) * max(all_b) AS wrong, max(all_a) AS all_a, max(all_b) AS all_b FROM sums UNION ALL SELECT 1, edge + 200, below_a * all_b + (all_b - below_b) * all_a, all_a, all_b FROM sums)",
        "cut AS (SELECT CASE WHEN coalesce(max(all_a), 0) = 0 OR coalesce(max(all_b), 0) = 0 THEN 0 ELSE arg_min(cut, (wrong, k, cut)) END AS cut FROM tries)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(ruled.ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM ruled JOIN scores USING (scored) CROSS JOIN cut"


#: Every start of every document that shares a shingle with the item (others have similarity 0), whatever it is aligned with.
#: Texts and items below five words have their whole sequence as one shingle.
_DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL), b AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT item, item_id, w AS v, len(w) AS n, least(len(w), 5) AS g FROM b WHERE len(w) > 0),
bs AS (SELECT item, n, g, array_to_string(v[i:i + g - 1], ' ') AS s, count(*) AS c FROM sizes, unnest(range(1, n - g + 2)) AS t(i) GROUP BY ALL),
ds AS (SELECT doc_id, w, g, i AS p, array_to_string(w[i:i + g - 1], ' ') AS s FROM d, (SELECT DISTINCT g FROM sizes) AS k, unnest(range(1, len(w) - g + 2)) AS t(i) WHERE len(w) >= g),
pairs AS (SELECT DISTINCT doc_id, w, item, n, g FROM ds JOIN bs USING (g, s)),
starts AS (SELECT doc_id, item, n, g, least(n, len(w)) AS span, i AS start, w[i:i + least(n, len(w)) - 1] AS x FROM pairs, unnest(range(1, greatest(len(w) - n, 0) + 2)) AS t(i)),
ws AS (SELECT doc_id, item, span, g, start, array_to_string(x[i:i + g - 1], ' ') AS s, count(*) AS c FROM starts, unnest(range(1, span - g + 2)) AS t(i) GROUP BY ALL),
common AS (SELECT doc_id, item, span, start, ws.g, any_value(n) AS n, sum(least(ws.c, bs.c)) AS inter FROM ws JOIN bs USING (item, g, s) GROUP BY doc_id, item, span, start, ws.g),
scored AS (SELECT *, (span - g + 1) + (n - g + 1) - inter AS union_n FROM common),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(floor(100 * inter / union_n) AS BIGINT) DESC, start DESC) AS rn FROM scored JOIN (SELECT item, item_id FROM b) USING (item) WHERE 100 * inter >= 75 * union_n)
SELECT doc_id, item_id, CAST(start - 1 AS BIGINT) AS start, CAST(span AS BIGINT) AS n_words, CAST(floor(100 * inter / union_n) AS BIGINT) AS similarity FROM best WHERE rn = 1"""

_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_id ON x = d.doc_id"""

_TOKENS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _crc(strings: str) -> str:
    """Tables that give crc(s, code) of the distinct s in `strings`: the code is linear, so it is the xor of each byte's part by its distance from the end."""
    return f"""shifts AS (SELECT b, b AS c, 0 AS k FROM range(256) AS r(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM shifts WHERE k < 8),
bytes_of AS (SELECT b, c FROM shifts WHERE k = 8),
keys AS (SELECT s, hex(encode(s)) AS x FROM ({strings}) GROUP BY s),
longest AS (SELECT coalesce(max(length(x) // 2), 0) AS n FROM keys),
parts AS (SELECT 0 AS k, b, c FROM bytes_of UNION ALL SELECT k + 1, parts.b, xor(parts.c // 256, t.c) FROM parts JOIN bytes_of t ON t.b = parts.c % 256 WHERE k < (SELECT n FROM longest)),
blank AS (SELECT CAST(0 AS BIGINT) AS n, CAST(4294967295 AS BIGINT) AS c UNION ALL SELECT blank.n + 1, xor(blank.c // 256, t.c) FROM blank JOIN bytes_of t ON t.b = blank.c % 256 WHERE blank.n < (SELECT n FROM longest)),
places AS (SELECT s, length(x) // 2 AS n, i, (instr('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1 AS b FROM keys, unnest(range(1, length(x) // 2 + 1)) AS t(i)),
sums AS (SELECT s, any_value(n) AS n, bit_xor(c) AS c FROM places JOIN parts ON parts.k = places.n - places.i AND parts.b = places.b GROUP BY s),
crc AS (SELECT s, xor(xor(sums.c, blank.c), 4294967295) AS code FROM sums JOIN blank USING (n))"""


_RESAMPLED = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT {_TOKENS} AS w FROM benchmark),
df AS (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, unnest([1, 2, 3]) AS u(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS s FROM b, unnest([1, 2, 3]) AS u(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
{_crc("SELECT s FROM df UNION ALL SELECT s FROM bf")},
sc AS (SELECT code % 10000 AS bucket, count(*) AS n FROM df JOIN crc USING (s) GROUP BY 1), tc AS (SELECT code % 10000 AS bucket, count(*) AS n FROM bf JOIN crc USING (s) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(tc.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM sc) AS DOUBLE) + 10000) / ((CAST(sc.n AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM tc) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sc LEFT JOIN tc USING (bucket)),
sums_of AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM df JOIN crc USING (s) JOIN gains ON bucket = code % 10000 GROUP BY r),
digits AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM d LEFT JOIN sums_of ON sums_of.r = d.r),
hashed AS (SELECT *, (SELECT sum((instr('0123456789abcdef', substr(x, CAST(i AS INT), 1)) - 1) * CAST(pow(16, 8 - i) AS BIGINT)) FROM unnest(range(1, 9)) AS t(i)) AS h FROM digits),
scored AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM hashed),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS place, count(*) OVER () AS total FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN place <= floor(5 * total / 100) THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""

#: A node is the set of rebuilt prefixes with one digest; sums over its subtree go over its members, each of which brings the nodes that it is the smallest member of.
_TRIE = f"""WITH RECURSIVE t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, mark, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS nr FROM t),
{_crc("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS s FROM t")},
c AS (SELECT conv_id, count(*) AS own, any_value(code) % 4 AS h, conv_id - conv_id % 20 AS base FROM o JOIN crc ON s = CAST(conv_id AS VARCHAR) GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS length FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, nr AS d, mark, w FROM k JOIN o ON o.conv_id = base AND nr <= h UNION ALL SELECT k.conv_id, nr - h + taken, mark, w FROM k JOIN o ON o.conv_id = k.conv_id AND nr > h),
p AS (SELECT conv_id, d, w, sha256(string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS x FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY d) AS px FROM p),
n AS (SELECT x, min(conv_id) AS c, any_value(d) AS d, any_value(px) AS px, any_value(w) AS w, count(*) AS n FROM q GROUP BY x),
kids AS (SELECT px AS x, count(*) AS n_children FROM n WHERE px IS NOT NULL GROUP BY px),
held AS (SELECT c, d, (n - 1) * w AS saved, n_children IS NULL AS leaf FROM n LEFT JOIN kids USING (x)),
sub AS (SELECT x, sum(saved) AS saved, count(*) FILTER (leaf) AS n_leaves FROM p JOIN held ON c = conv_id AND held.d >= p.d GROUP BY x),
ends AS (SELECT x, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN k USING (conv_id) WHERE d = length GROUP BY x)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n up ON up.x = n.px LEFT JOIN kids ON kids.x = n.x JOIN sub ON sub.x = n.x LEFT JOIN ends ON ends.x = n.x"""

def _license_scan() -> str:
    """Base phrases at every place, and templates by their rarest words at one start with all key phrases verified."""
    from pricedex.llm.license_scan import ANCHORS, BASE, TEMPLATES

    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    places = values((k, t.label, q, w) for k, t in enumerate(TEMPLATES) for q, w in enumerate(t.text.split()))
    phrases = values(
        (k, m, (" " + t.text + " ").split(" " + p + " ")[0].count(" "), len(p.split()), p.split()[0], p) for k, t in enumerate(TEMPLATES) for m, p in enumerate(t.phrases)
    )
    base = values((p, p.split()[0], len(p.split()), label) for p, label in BASE.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
tok AS (SELECT r, w, i - 1 AS i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
tp AS (SELECT * FROM (VALUES {places}) AS v(t, label, q, word)),
ph AS (SELECT * FROM (VALUES {phrases}) AS v(t, m, q, n, word, phrase)),
bp AS (SELECT * FROM (VALUES {base}) AS v(phrase, word, n, label)),
bh AS (SELECT r, i, label FROM tok JOIN bp USING (word) WHERE array_to_string(w[i + 1:i + n], ' ') = phrase),
bs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM bh GROUP BY r),
df AS (SELECT word, count(DISTINCT r) AS n FROM tok WHERE word IN (SELECT word FROM tp) GROUP BY word),
kinds AS (SELECT DISTINCT t, word, coalesce(n, 0) AS n FROM tp LEFT JOIN df USING (word)),
anchors AS (SELECT t, word, CAST(floor(1000 * ln(CAST((SELECT count(*) FROM d) + 1 AS DOUBLE) / (n + 1))) AS BIGINT) + 1 AS weight FROM kinds QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= {ANCHORS}),
alls AS (SELECT t, sum(weight) AS total FROM anchors GROUP BY t),
hits AS (SELECT DISTINCT r, ph.t, i - q AS start, m FROM tok JOIN ph USING (word) WHERE array_to_string(w[i + 1:i + n], ' ') = phrase),
full_hits AS (SELECT r, t, start FROM hits JOIN (SELECT t, count(*) AS needed FROM ph GROUP BY t) USING (t) GROUP BY r, t, start, needed HAVING count(*) = needed),
votes AS (SELECT DISTINCT f.r, f.t, f.start, anchors.word, weight FROM full_hits f JOIN tp ON tp.t = f.t JOIN anchors ON anchors.t = tp.t AND anchors.word = tp.word JOIN tok ON tok.r = f.r AND tok.word = tp.word AND tok.i = f.start + tp.q),
found AS (SELECT r, votes.t, start, sum(weight) AS matched FROM votes GROUP BY ALL),
kept AS (SELECT r, (SELECT any_value(label) FROM tp WHERE tp.t = found.t) AS label, CAST(matched AS DOUBLE) / total AS share FROM found JOIN alls USING (t) WHERE 2 * matched >= total),
own AS (SELECT r, max(share) AS share FROM kept GROUP BY r),
bl AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM bh GROUP BY r),
el AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM bh UNION ALL SELECT r, label FROM kept) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(el.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN bl USING (r) LEFT JOIN el USING (r) LEFT JOIN own USING (r)"""


ORACLE_SQL: dict[str, str] = {"op1_url_filter": _url_filter(), "op3_decontamination": _DECONTAMINATION, "op4_jaccard_join": _JACCARD, "op13_importance_resampling": _RESAMPLED, "op11_conversation_trie": _TRIE, "op12_license_scan": _license_scan()}
