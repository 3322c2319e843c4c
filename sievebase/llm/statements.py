"""DuckDB statements for the queries of this subpackage that SQL can express, written independently of them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string, bit by bit."""
    turn = "lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {turn})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    parts = " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({parts})"


def _tree(name: str, leaves: str) -> str:
    """A recursive table (grp, level, i, digest) over leaves (grp, i, digest)."""
    return f"""{name} AS (
      SELECT grp, 0 AS level, i, digest, count(*) OVER (PARTITION BY grp) AS width FROM {leaves}
      UNION ALL
      SELECT grp, level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), max((width + 1) // 2)
      FROM {name} WHERE width > 1 GROUP BY grp, level, i // 2)"""


OP11 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf('n_chars')} AS digest,
    CASE WHEN n_chars IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM leaf),
{_tree('low', 'placed')},
subs AS (SELECT grp AS name, '' AS grp, digest, row_number() OVER (ORDER BY grp) - 1 AS i FROM low WHERE width = 1),
{_tree('high', 'subs')},
top AS (SELECT digest AS root FROM high WHERE width = 1),
steps AS (
  SELECT p.doc_id, p.grp, p.i, t.level, p.i >> t.level AS own, s.digest AS sibling, s.i AS at
  FROM placed p JOIN low t ON t.grp = p.grp AND t.i = p.i >> t.level AND t.width > 1
  LEFT JOIN low s ON s.grp = p.grp AND s.level = t.level AND s.i = xor(p.i >> t.level, 1)
  UNION ALL
  SELECT p.doc_id, p.grp, p.i, 1000 + t.level, u.i >> t.level, s.digest, s.i
  FROM placed p JOIN subs u ON u.name = p.grp JOIN high t ON t.i = u.i >> t.level AND t.width > 1
  LEFT JOIN high s ON s.level = t.level AND s.i = xor(u.i >> t.level, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp, i ORDER BY level) AS step FROM steps),
folds AS (
  SELECT grp, i, 0::BIGINT AS step, coalesce(changed, digest) AS digest FROM placed
  UNION ALL
  SELECT f.grp, f.i, f.step + 1, sha256(CASE WHEN n.at < n.own THEN n.sibling || f.digest ELSE f.digest || coalesce(n.sibling, '') END)
  FROM folds f JOIN numbered n ON n.grp = f.grp AND n.i = f.i AND n.step = f.step + 1),
proofs AS (SELECT grp, i, string_agg(sibling, '' ORDER BY step) AS siblings FROM numbered GROUP BY grp, i)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, top.root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = top.root AS verified, p.i AS rank
FROM placed p JOIN subs s ON s.name = p.grp CROSS JOIN top
LEFT JOIN proofs q ON q.grp = p.grp AND q.i = p.i
JOIN (SELECT grp, i, arg_max(digest, step) AS digest FROM folds GROUP BY grp, i) f ON f.grp = p.grp AND f.i = p.i
"""

OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


OP1 = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM texts),
items AS (SELECT r, len(s) AS n, unnest(s) AS x FROM shingles),
links AS (
  SELECT a.r AS a, b.r AS b FROM items a JOIN items b ON a.x = b.x AND a.r <> b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT r AS a, r AS b FROM shingles UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(min(t.doc_id), s.doc_id) AS component_id
FROM shingles s JOIN reach ON reach.a = s.r JOIN shingles t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""

_RULES = {"symbol_rate": 0.01, "other_rate": 0.02, "upper_rate": 0.03, "dup_line_rate": 0.08, "repeat_rate": 0.05, "mean_word": 0.4}


def _op2() -> str:
    rows = " UNION ALL ".join(f"SELECT r, lang, source, '{rule}' AS rule, {floor} AS floor, {rule}::DOUBLE AS x FROM rates WHERE n_words > 0" for rule, floor in _RULES.items())
    quantiles = lambda keys: f"""
  SELECT {keys} rule, any_value(floor) AS floor, max(total) AS docs, min(CASE WHEN upto >= 0.5 * total THEN v END) AS mid, min(CASE WHEN upto >= 0.25 * total THEN v END) AS low
  FROM (SELECT {keys} rule, floor, CASE WHEN bin IS NULL THEN 0 ELSE 2 * pow(1.02, bin) / 2.02 END AS v, sum(n) OVER (PARTITION BY {keys} rule ORDER BY coalesce(bin, -1e9)) AS upto,
      sum(n) OVER (PARTITION BY {keys} rule) AS total FROM (SELECT {keys} rule, floor, bin, count(*) AS n FROM bins GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    names = " || ".join(
        [f"CASE WHEN bool_or(f.rule = '{r}' AND x > mid + reach) THEN ',{r}' ELSE '' END" for r in _RULES] + ["CASE WHEN bool_or(f.rule = 'mean_word' AND x < mid - reach) THEN ',mean_word_low' ELSE '' END"]
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
keys AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, array_to_string(w[i:i + 7], ' ') AS k FROM texts WHERE len(w) >= 8),
again AS (SELECT r, i FROM keys QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
counts AS (
  SELECT t.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(array_to_string(w, ''), '[\p{{L}}\p{{M}}]+', '', 'g')) AS n_other, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM texts t LEFT JOIN covered c USING (r)),
rates AS (
  SELECT *, n_symbols / word_chars AS symbol_rate, n_other / word_chars AS other_rate, n_upper / word_chars AS upper_rate, n_dup_lines / len(lines) AS dup_line_rate,
    n_repeat_words / n_words AS repeat_rate, word_chars / n_words AS mean_word, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
long AS ({rows}),
bins AS (SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02)) END AS bin FROM long),
own AS ({quantiles("lang, source,")}), of_lang AS ({quantiles("lang,")}), of_all AS ({quantiles("")}),
fences AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.docs >= 50 THEN o.mid WHEN l.docs >= 50 THEN l.mid ELSE a.mid END AS mid,
    6 * greatest(CASE WHEN o.docs >= 50 THEN o.mid - o.low WHEN l.docs >= 50 THEN l.mid - l.low ELSE a.mid - a.low END, o.floor) AS reach
  FROM own o JOIN of_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule JOIN of_all a ON a.rule = o.rule),
verdicts AS (
  SELECT f.r, substr({names}, 2) AS broken FROM (
    SELECT b.r, b.rule, b.x, g.mid, g.reach FROM long b JOIN fences g ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source AND g.rule = b.rule) f
  GROUP BY f.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(broken, '') = '' AS kept, coalesce(broken, '') AS broken
FROM rates LEFT JOIN verdicts USING (r)
"""


OP3 = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce('s' || source, 'null') AS q, len({WORDS})::BIGINT AS size,
    ('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents),
sources AS (
  SELECT q, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY (q = 'null')::INT, q) - 1 AS rank FROM sized GROUP BY q),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w FROM sources),
-- The level at which all that do not stop before share the rest.
levels AS (
  SELECT *, 3 * source_size / w AS stop, row_number() OVER (ORDER BY 3 * source_size / w, rank) AS n,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3 * source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT q, source_size, rank, least(3 * source_size::DOUBLE, coalesce((SELECT arg_min(level, n) FROM levels WHERE level <= stop), 0) * w) AS target FROM levels),
queues AS (
  SELECT s.*, g.source_size, g.rank, g.target, sum(size) OVER (PARTITION BY s.q ORDER BY u, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS sent
  FROM sized s JOIN goals g ON g.q = s.q),
sends AS (SELECT *, (t * source_size + sent)::DOUBLE / target AS f FROM queues, (VALUES (0), (1), (2)) turns(t) WHERE size > 0 AND target > 0),
served AS (SELECT r, size, sum(size) OVER (ORDER BY f, rank, u, coalesce(doc_id::VARCHAR, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sends)
SELECT doc_id, source, size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queues LEFT JOIN (SELECT r, sum(size) AS taken FROM served WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY r) t USING (r)
"""


def llm_statements() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1, "op2_quality_rules": _op2(), "op3_source_mix": OP3, "op11_merkle_manifest": OP11, "op13_fill_middle": OP13}
