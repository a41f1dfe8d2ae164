"""DuckDB SQL for the operators that SQL can express at the size of the correctness tables."""

SPACE_WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH w AS (SELECT doc_id, {SPACE_WORDS.format(text="text")} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
win AS (SELECT doc_id, n, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM p),
rep AS (SELECT doc_id, pos FROM win WHERE pos <= n - 34 QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM rep, range(35) t(i)),
kept AS (SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ALNUM = "regexp_extract_all(coalesce({text}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(text=LOWER)
FRAMES = " UNION ALL ".join(f"SELECT id, pos, n, {k} AS len, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS s FROM {{src}}" for k in range(1, 11))

OP2 = f"""WITH d AS (SELECT doc_id AS id, {ALNUM} AS ws FROM documents), b AS (SELECT item_id AS id, row_number() OVER () AS text_no, {ALNUM} AS ws FROM benchmark),
dp AS (SELECT id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d), bp AS (SELECT id, text_no, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM b),
bwp AS (SELECT id AS item, text_no, pos, len, s FROM ({FRAMES.format(src="bp").replace("SELECT id,", "SELECT id, text_no,").replace("PARTITION BY id", "PARTITION BY text_no")}) WHERE len = least(10, n) AND pos <= n - len + 1), bw AS (SELECT DISTINCT item, len, s FROM bwp),
dw AS (SELECT id, pos, len, s FROM ({FRAMES.format(src="dp")}) WHERE pos <= n - len + 1),
hit AS (SELECT dw.id, pos, dw.len, item FROM dw JOIN bw USING (len, s)),
words AS (SELECT DISTINCT id, pos + i AS pos FROM hit, range(10) t(i) WHERE i < len),
nh AS (SELECT id, count(*) AS n_hit FROM words GROUP BY id), it AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hit) GROUP BY id),
diagonal AS (SELECT dw.id, item, text_no, dw.pos, dw.len, dw.pos - bwp.pos AS diag, dw.pos - row_number() OVER (PARTITION BY dw.id, text_no, dw.len, dw.pos - bwp.pos ORDER BY dw.pos) AS run FROM dw JOIN bwp USING (len, s)),
longest AS (SELECT id, item, min(pos) - 1 AS place, count(*) + any_value(len) - 1 AS words FROM diagonal GROUP BY id, item, text_no, len, diag, run QUALIFY row_number() OVER (PARTITION BY id ORDER BY words DESC, place, item NULLS LAST) = 1)
SELECT d.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(words, 0)::BIGINT AS longest_words, place::BIGINT AS longest_at, item::BIGINT AS longest_item
FROM d LEFT JOIN nh USING (id) LEFT JOIN it USING (id) LEFT JOIN longest USING (id)"""

OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACE_WORDS.format(text=LOWER)} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
f AS (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM p),
sh AS (SELECT DISTINCT doc_id, s FROM f WHERE pos <= greatest(n - 4, 1)), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM documents d LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""

# CRC-32 of a conv_id's digits, from the published polynomial.
CRC = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda r, b: xor(r >> 8, crc[(xor(r, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

OP12 = f"""WITH poly AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b)) AS crc),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {CRC} % 4 AS h FROM (SELECT DISTINCT c FROM turns), poly),
rebuilt AS (SELECT i.c, p, role, text FROM ids i JOIN turns t ON t.c = i.c - i.c % 20 AND p < h UNION ALL SELECT i.c, p, role, text FROM ids i JOIN turns t ON t.c = i.c AND p >= h),
path AS (SELECT c, 0 AS d, '' AS node, 0 AS words FROM ids UNION ALL SELECT c, row_number() OVER (PARTITION BY c ORDER BY p), md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY p)), len({SPACE_WORDS.format(text="text")}) FROM rebuilt),
steps AS (SELECT *, lag(node) OVER w AS above, lead(node) OVER w IS NULL AS ends FROM path WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (SELECT d, node, any_value(above) AS above, min(c) AS rep, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM steps GROUP BY d, node),
children AS (SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, node)),
below AS (SELECT s.d, s.node, sum((n - 1) * y.words) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM counted y JOIN steps s ON s.c = y.rep AND s.d <= y.d GROUP BY s.d, s.node)
SELECT x.rep::BIGINT AS conv_id, x.d::BIGINT AS depth, u.rep::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM counted x JOIN below USING (d, node) LEFT JOIN nodes u ON u.d = x.d - 1 AND u.node = x.above"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op2_suffix_decontamination": OP2, "op5_ngram_jaccard_join": OP5, "op12_conversation_trie": OP12}
