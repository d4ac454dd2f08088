"""SQL of the queries whose text is long: DuckDB's dialect, built from the operators' parameters."""

from __future__ import annotations

import string

from lekhya.llm import merkle, rules

LANG_LEVELS, TOP_LEVELS = 8, 3  # enough for 16 million rows of a language, 512 languages


def crc32_sql(octets: str) -> str:
    """Unsigned crc32 of a list of octets, bit by bit."""
    bits = (f"flatten(list_transform({octets}, lambda o: "
            "list_transform(range(8), lambda k: (o >> k::INT) & 1)))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: CASE WHEN "
            "xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), "
            "4294967295::BIGINT)")


def octets_sql(value: str) -> str:
    """The octets of a string's UTF-8."""
    code = f"hex(encode({value}))"
    return (f"list_transform(range(0, len({code}), 2), lambda i: "
            f"('0x' || substr({code}, i + 1, 2))::BIGINT)")


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _tree(prefix: str, levels: int) -> str:
    """prefix0 (tree, rank, digest) to prefix{levels}; a tree that is one node stays so."""
    many = "count(*) OVER (PARTITION BY tree)"
    steps = []
    for k in range(levels):
        steps.append(f"""
     {prefix}g{k} AS (SELECT tree, rank // {merkle.FANOUT} AS rank, max(many) AS many,
                list(digest ORDER BY rank) AS nodes
         FROM (SELECT *, {many} AS many FROM {prefix}{k}) GROUP BY tree, rank // {merkle.FANOUT}),
     {prefix}{k + 1} AS (SELECT tree, rank, CASE WHEN many > 1
                THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS digest
         FROM {prefix}g{k})""")
    return ",".join(steps)


def _climb(rows: str, prefix: str, levels: int, out: str) -> str:
    """Rows (tree, rank, node, proof) one level after the other to the top of their tree."""
    f, steps = merkle.FANOUT, []
    for k in range(levels):
        at = f"c.rank % {f}"
        steps.append(f"""
     {out}{k + 1} AS (SELECT c.doc_id, c.row, c.tree, c.rank // {f} AS rank,
            CASE WHEN g.many > 1 THEN sha256(array_to_string(g.nodes[:{at}], '') || c.node ||
                 array_to_string(g.nodes[{at} + 2:], '')) ELSE c.node END AS node,
            CASE WHEN g.many > 1 THEN c.proof || array_to_string(g.nodes[:{at}], '') ||
                 array_to_string(g.nodes[{at} + 2:], '') ELSE c.proof END AS proof
         FROM {rows if k == 0 else f'{out}{k}'} c
         JOIN {prefix}g{k} g ON g.tree = c.tree AND g.rank = c.rank // {f})""")
    return ",".join(steps)


_LOW = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ID = "CAST(doc_id AS VARCHAR)"
_HEAD = " || ".join(_framed(c) for c in (_ID, "source", "lang", "CAST(n_chars AS VARCHAR)"))
MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree,
                  sha256({_HEAD} || {_framed('text')}) AS leaf,
                  CASE WHEN {crc32_sql(octets_sql(_ID))} % 3 = 0
                       THEN sha256({_HEAD} || {_framed(_LOW)}) END AS tampered FROM documents),
     r AS (SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS row,
                  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1
                  AS rank FROM d),
     n0 AS (SELECT tree, rank, leaf AS digest FROM r),{_tree('n', LANG_LEVELS)},
     t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, digest,
                   tree AS lang FROM n{LANG_LEVELS}),{_tree('t', TOP_LEVELS)},
     c0 AS (SELECT doc_id, row, tree, rank, coalesce(tampered, leaf) AS node, '' AS proof FROM r),
     {_climb('c0', 'n', LANG_LEVELS, 'c').lstrip()},
     u0 AS (SELECT c.doc_id, c.row, t.tree, t.rank, c.node, c.proof, t.digest AS subroot
            FROM c{LANG_LEVELS} c JOIN t0 t ON t.lang = c.tree),
     {_climb('u0', 't', TOP_LEVELS, 'u').lstrip()}
SELECT r.doc_id, r.leaf, u0.subroot, t.digest AS root, sha256(u.proof) AS proof_sha256,
       u.node AS folded_root, u.node = t.digest AS verified
FROM r JOIN u0 USING (row) JOIN u{TOP_LEVELS} u USING (row) CROSS JOIN t{TOP_LEVELS} t"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                      coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n,
                  {crc32_sql(octets_sql('CAST(conv_id AS VARCHAR)'))} % 6 AS h
           FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
     s AS (SELECT c.conv_id, b.pos, b.role, b.text FROM c
           JOIN t b ON b.conv_id = c.base AND b.pos <= c.h
           UNION ALL
           SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text FROM c
           JOIN t o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
     k AS (SELECT conv_id, pos AS depth, length(text) AS size,
                  sha256(string_agg(sha256(length(role) || ':' || role || text), '/')
                         OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM s),
     p AS (SELECT conv_id, depth, size, node,
                  coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent
           FROM k UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
     v AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent,
                  min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size
           FROM p GROUP BY node),
     h AS (SELECT parent AS node, count(*) AS n_children FROM v WHERE parent IS NOT NULL
           GROUP BY parent),
     u AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN h USING (node)),
     a AS (SELECT p.node, count(*) FILTER (u.n_children = 0) AS n_leaves,
                  sum((u.n_convs - 1) * u.size) AS saved
           FROM u JOIN p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node),
     e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
           FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id)
           GROUP BY node)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, u.n_convs,
       CAST(u.n_children AS BIGINT) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN a USING (node) LEFT JOIN v m ON m.node = u.parent LEFT JOIN e ON e.node = u.node"""

_SPACE = "[\\x20\\x09-\\x0D]"
_WINDOW = rules.REPEAT_WINDOW
_RATIO = (f"ln((target + {rules.PRIOR} * share) / (raw + {rules.PRIOR}) / share)")
RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT row, doc_id, text,
                  regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(text, chr(10)),
                              lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
     x AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
     y AS (SELECT row, pos, list(word) OVER (PARTITION BY row ORDER BY pos
                  ROWS BETWEEN CURRENT ROW AND {_WINDOW - 1} FOLLOWING) AS win FROM x),
     z AS (SELECT row, pos, count(*) OVER (PARTITION BY row, win) AS n FROM y
           WHERE len(win) = {_WINDOW}),
     o AS (SELECT row, count(DISTINCT pos + k) AS covered
           FROM z, range({_WINDOW}) AS r(k) WHERE n > 1 GROUP BY row),
     b AS (SELECT w.row, doc_id, CAST(len(words) AS BIGINT) AS n_words,
                  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                  coalesce(covered, 0) AS n_repeat_words FROM w LEFT JOIN o USING (row)),
     v AS (SELECT word, {crc32_sql(octets_sql('word'))} AS h FROM (SELECT DISTINCT word FROM x)),
     g AS (SELECT row, h, lead(h) OVER (PARTITION BY row ORDER BY pos) AS next
           FROM x JOIN v USING (word)),
     f AS (SELECT row, 0 AS part, h % {rules.BINS} AS bin FROM g
           UNION ALL
           SELECT row, 1, (h * {rules.FACTOR} + next) % 4294967296 % {rules.BINS} FROM g
           WHERE next IS NOT NULL),
     l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
     q AS (SELECT part, bin, count(*) AS raw, count(l.doc_id) AS target
           FROM f JOIN d USING (row) LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY part, bin),
     s AS (SELECT part, sum(target) / sum(raw) AS share FROM q GROUP BY part),
     a AS (SELECT part, bin, CASE WHEN share > 0 THEN {_RATIO} ELSE 0 END AS ratio
           FROM q JOIN s USING (part)),
     m AS (SELECT row, sum(mean) AS score FROM (SELECT row, part, avg(ratio) AS mean
               FROM f JOIN a USING (part, bin) GROUP BY row, part) GROUP BY row),
     j AS (SELECT b.*, n_words < {rules.LEAST_WORDS}
                  OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
                  coalesce(score, 0) AS score FROM b LEFT JOIN m USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND score >= {rules.LEAST_SCORE} AS kept
FROM j"""
