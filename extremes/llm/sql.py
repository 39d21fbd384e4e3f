"""SQL of the training-data queries that SQL can state, over the same tables (DuckDB)."""

from __future__ import annotations

from .chat import END, SAYS, TURN

WORDS = r"[^\x20\x09-\x0D]+"


def packing(buckets: int = 8, token_budget: int = 32768) -> str:
    """Layers of the dynamic programme one by one; of equal costs the least cut. For tables of one salt."""
    layers = ["l1 AS (SELECT j, pad AS cost, 0 AS cut FROM p WHERE i = 0 UNION ALL SELECT 0, 0, 0)"]
    for k in range(2, buckets + 1):
        layers.append(f"l{k} AS (SELECT j, b.c AS cost, b.i AS cut FROM (SELECT p.j, min({{'c': l.cost + p.pad, 'i': p.i}}) AS b FROM p JOIN l{k - 1} l ON l.j = p.i GROUP BY p.j) UNION ALL SELECT 0, 0, 0)")
    cuts = [f"c{buckets} AS (SELECT max(j) AS j FROM x)"] + [f"c{k - 1} AS (SELECT l.cut AS j FROM c{k} c JOIN l{k} l USING (j))" for k in range(buckets, 1, -1)]
    ends = " UNION ".join(f"SELECT j FROM c{k}" for k in range(1, buckets + 1))
    return f"""WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens, count(*) AS c FROM d GROUP BY 1),
x AS (SELECT row_number() OVER w AS j, n_tokens AS n, CAST(sum(c) OVER w AS BIGINT) AS r, CAST(sum(c * n_tokens) OVER w AS BIGINT) AS s FROM h WINDOW w AS (ORDER BY n_tokens) UNION ALL SELECT 0, 0, 0, 0),
p AS (SELECT a.j AS i, b.j, (b.r - a.r) * b.n - (b.s - a.s) AS pad FROM x a JOIN x b ON a.j < b.j),
{', '.join(layers)}, {', '.join(cuts)},
e AS (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS bucket, n AS bucket_len, greatest(1, {token_budget} // greatest(n, 1)) AS per, coalesce(lag(n) OVER (ORDER BY n), -1) AS above FROM x WHERE j IN ({ends}) AND j > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens) - 1 AS k FROM d JOIN e ON n_tokens > above AND n_tokens <= bucket_len),
f AS (SELECT bucket, sum(b) OVER (ORDER BY bucket) - b AS first FROM (SELECT bucket, ceil(count(*) / any_value(per)) AS b FROM o GROUP BY 1))
SELECT doc_id, n_tokens, bucket, bucket_len, CAST(first + k // per AS BIGINT) AS batch_id, CAST(k % per AS BIGINT) AS row_in_batch, bucket_len - n_tokens AS padding FROM o JOIN f USING (bucket)"""


def chat() -> str:
    said = "'</s>[INST] ok [/INST]'"
    # a backslash is doubled, then one is put behind the first character of every control string
    escape = lambda x: f"regexp_replace(replace({x}, '\\', '\\\\'), '(<)(\\||/?s>|</?SYS>>)|(\\[)(/?INST\\])', '\\1\\3\\\\\\2\\4', 'g')"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
w AS (SELECT *, {escape('text')} AS content FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (WHERE role = 'assistant'), '') AS learnt,
  sum(length({escape('role')}) + length(content) + {len(TURN + SAYS + END)}) AS size, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))) AS n FROM w GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(n AS BIGINT) AS n_tokens FROM g"""


def fingerprint() -> str:
    # pieces that end with a blank line (a line end): a line end that follows one is a piece alone; after the last end an empty one
    section = r"^\n\n|^\n[^\n]+(?:\n[^\n]+)*(?:\n\n|\n)?|^\n|[^\n]+(?:\n[^\n]+)*(?:\n\n|\n)?|\n"
    pieces = lambda x, pattern, end: f"(CASE WHEN {x} = '' THEN [''] WHEN {end} THEN list_append(regexp_extract_all({x}, '{pattern}'), '') ELSE regexp_extract_all({x}, '{pattern}') END)"
    span = "[^.!?]{0,96}[.!?]+|[^.!?]{1,96}"
    leaves = f"list_transform(regexp_extract_all(p, '{span}'), lambda z: sha256(z))"
    paragraphs = pieces("s", r"[^\n]*\n|[^\n]+", "ends_with(s, chr(10))")
    sections = pieces("text", section, "ends_with(text, chr(10) || chr(10))")

    def tree(source: str, out: str) -> str:
        return f"""{out}1 AS (SELECT doc_id, text, list_transform({sections}, lambda s: list_transform({paragraphs}, lambda p: {leaves})) AS t FROM {source}),
{out}2 AS (SELECT doc_id, list_transform(t, lambda s: list_transform(s, lambda p: {{'node': sha256(array_to_string(p, '')), 'n': len(p)}})) AS ps, flatten(flatten(t)) AS lv FROM {out}1),
{out}3 AS (SELECT doc_id, lv, list_transform(ps, lambda s: {{'node': sha256(array_to_string(list_transform(s, lambda p: p.node), '')), 'ps': s}}) AS ss FROM {out}2),
{out} AS (SELECT doc_id, sha256(array_to_string(list_transform(ss, lambda s: s.node), '')) AS root, list_distinct(list_transform(lv, lambda z: z[1:8])) AS tags,
  list_transform(ss, lambda s: {{'tag': s.node[1:8], 'ps': list_transform(s.ps, lambda p: p.node[1:8] || '*' || p.n)}}) AS shape, list_transform(lv, lambda z: z[1:8]) AS lv FROM {out}3)"""

    text = lambda x: f"{x}.root || ':' || array_to_string(list_transform({x}.shape, lambda s: s.tag || '/' || array_to_string(s.ps, ',')), ';') || ':' || array_to_string({x}.lv, ',')"
    near = lambda x, y: f"CASE WHEN {x}.root = {y}.root THEN 1.0 ELSE 2.0 * len(list_intersect({x}.tags, {y}.tags)) / greatest(len({x}.tags) + len({y}.tags), 1) END"
    both = "greatest(len(a.shape), len(b.shape))"
    differ = f"""list_sum(list_transform(range(1, {both} + 1), lambda i: CASE WHEN a.shape[i] IS NOT DISTINCT FROM b.shape[i] OR a.shape[i].tag || array_to_string(a.shape[i].ps, ',') IS NOT DISTINCT FROM b.shape[i].tag || array_to_string(b.shape[i].ps, ',') THEN 0
  ELSE list_sum(list_transform(range(1, greatest(coalesce(len(a.shape[i].ps), 0), coalesce(len(b.shape[i].ps), 0)) + 1), lambda j: CASE WHEN a.shape[i].ps[j] IS NOT DISTINCT FROM b.shape[i].ps[j] THEN 0 ELSE 1 END)) END))"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
m AS (SELECT doc_id, next_id, CAST(length(text) AS BIGINT) AS n_chars, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS text FROM n),
{tree('d', 'fa')}, {tree('m', 'fb')}
SELECT m.doc_id, m.n_chars, sha256(m.text) AS edited_sha256, {text('a')} AS fingerprint, {text('b')} AS edited_fingerprint, CAST({near('a', 'b')} AS DOUBLE) AS near_edited, CAST({near('a', 'c')} AS DOUBLE) AS near_next,
  CASE WHEN a.root = b.root THEN 0 ELSE CAST(coalesce({differ}, 0) AS BIGINT) END AS n_differing_paragraphs
FROM m JOIN fa a USING (doc_id) JOIN fb b USING (doc_id) JOIN fa c ON c.doc_id = m.next_id"""


def jaccard(width: int = 5) -> str:
    """Shingles, links by counting common ones, and the closure of the links."""
    ends = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {ends})) END) AS g FROM d),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT l.a, l.b FROM l JOIN k x ON x.doc_id = l.a JOIN k y ON y.doc_id = l.b WHERE 100 * l.c >= 80 * (x.n + y.n - l.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN k USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""


def spelling() -> str:
    """crc32 byte by byte; near words by the variants that lack one code point; forms followed by recursion."""
    step = lambda c: f"CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    tab = "".join(f"t{k + 1} AS (SELECT i, {step('c')} AS c FROM t{k}), " for k in range(8))
    octets = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END))"
    return f"""WITH RECURSIVE t0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) r(i)), {tab}tab AS (SELECT list(c ORDER BY i) AS tab FROM t8),
o AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_transform({octets}, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM o, tab),
w AS (SELECT CASE WHEN h % 97 <> 0 THEN run ELSE substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.part UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.part),
b AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY 1),
f AS (SELECT b.word, min(p.near) AS form, any_value(b.best_n) AS form_n FROM b JOIN w USING (word) JOIN p ON p.word = b.word AND p.n = b.best_n WHERE b.best_n >= 2 * w.n GROUP BY 1),
r AS (SELECT word, word AS last, 0 AS k FROM w UNION ALL SELECT r.word, f.form, r.k + 1 FROM r JOIN f ON f.word = r.last)
SELECT w.word, f.form, e.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n FROM w JOIN (SELECT word, arg_max(last, k) AS root FROM r GROUP BY 1) e USING (word) LEFT JOIN b USING (word) LEFT JOIN f USING (word)"""


def lines() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
g AS (SELECT k, min(doc_id) AS low FROM l WHERE length(k) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(g.k) FILTER (WHERE doc_id > low) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL OR doc_id = low), '')) AS kept_sha256
FROM l LEFT JOIN g USING (k) GROUP BY 1"""


ORACLE_SQL = {"op3_packing": packing(), "op4_chat": chat(), "op6_fingerprint": fingerprint(), "op9_jaccard": jaccard(), "op11_spelling": spelling(), "op13_lines": lines()}
