"""DuckDB SQL for the numbered operators that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLES["op1_decontaminate"] = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows
), docs AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.i, d.n, m.item_id FROM doc_windows d JOIN item_windows m ON d.n = m.n AND d.gram = m.gram
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

ORACLES["op10_preferences"] = """
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), sides AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS is_chosen, place, role, text,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM placed
), aligned AS (
  SELECT pair_id, place, max(shown) FILTER (WHERE is_chosen) AS c, max(shown) FILTER (WHERE NOT is_chosen) AS r
  FROM sides GROUP BY pair_id, place
), prefix AS (
  SELECT pair_id, coalesce(min(place) FILTER (WHERE c IS DISTINCT FROM r), max(place) + 1) - 1 AS n_prompt_turns
  FROM aligned GROUP BY pair_id
), rest AS (
  SELECT s.*, coalesce(sum(length(shown)) OVER (PARTITION BY s.pair_id, is_chosen ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sides s JOIN prefix p USING (pair_id) WHERE place > n_prompt_turns
), completions AS (
  SELECT pair_id, is_chosen, string_agg(shown, '' ORDER BY place) AS body,
         coalesce(string_agg(CAST(begins + length(role) + 5 AS BIGINT) || '-' || CAST(begins + length(shown) - 1 AS BIGINT), ',' ORDER BY place)
                  FILTER (WHERE role = 'assistant'), '') AS mask
  FROM rest GROUP BY pair_id, is_chosen
), prompts AS (
  SELECT pair_id, string_agg(c, '' ORDER BY place) AS prompt FROM aligned JOIN prefix USING (pair_id) WHERE place <= n_prompt_turns GROUP BY pair_id
)
SELECT p.pair_id, CAST(p.n_prompt_turns AS BIGINT) AS n_prompt_turns, coalesce(q.prompt, '') AS prompt,
       coalesce(a.body, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
       coalesce(b.body, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
FROM prefix p LEFT JOIN prompts q USING (pair_id)
LEFT JOIN completions a ON a.pair_id = p.pair_id AND a.is_chosen
LEFT JOIN completions b ON b.pair_id = p.pair_id AND NOT b.is_chosen
"""

# The schedule's golden-ratio points, a source's ranked slots, and the blocks of its shuffled stream that they serve.
ORACLES["op6_mix_sources"] = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('20240601:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS shuffled
  FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 3.0::DOUBLE AS cap FROM totals
), ranked AS (
  SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), solved AS (SELECT level FROM levels WHERE level <= ratio ORDER BY place LIMIT 1
), plan AS (
  SELECT row_number() OVER (ORDER BY l.source NULLS LAST) AS sid, l.source, source_size, least(cap, (SELECT level FROM solved) * weight) AS target FROM levels l
), sizes AS (
  SELECT greatest(1, CAST(floor(min(target) FILTER (WHERE target > 0) / 64) AS BIGINT), CAST(floor(sum(target) / 2000000) AS BIGINT)) AS block, sum(target) AS total FROM plan
), shares AS (
  SELECT sid, floor(target) AS quota, CAST(ceil(floor(target) / block) AS BIGINT) AS needed,
         coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS low FROM plan, sizes
), ends AS (SELECT *, coalesce(lead(low) OVER (ORDER BY sid), 1.0) AS high FROM shares
), points AS (
  SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS point FROM (SELECT unnest(generate_series(0, CAST(ceil(total / block) AS BIGINT) - 1)) AS slot FROM sizes)
), dealt AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points JOIN ends ON low <= point AND point < high
), missing AS (
  SELECT CAST(ceil(total / block) AS BIGINT) + rank AS slot, sid, rank
  FROM (SELECT e.sid, unnest(generate_series((SELECT count(*) FROM dealt d WHERE d.sid = e.sid), e.needed - 1)) AS rank FROM ends e), sizes
), slots AS (
  SELECT slot, sid, rank, rank * block AS low, least((rank + 1) * block, quota) AS high
  FROM (SELECT * FROM dealt UNION ALL SELECT * FROM missing) JOIN ends USING (sid), sizes WHERE rank < needed
), placed AS (
  SELECT s.*, p.sid, p.source_size, p.target,
         coalesce(sum(size) OVER (PARTITION BY p.sid ORDER BY shuffled, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, row_number() OVER () AS n
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), passes AS (
  SELECT n, sid, begins + epoch * source_size AS start, begins + epoch * source_size + size AS stop FROM placed, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0
), served AS (
  SELECT n, slot, least(stop, high) - greatest(start, low) AS words
  FROM (SELECT *, unnest(generate_series(CAST(floor(start / block) AS BIGINT), CAST(floor((stop - 1) / block) AS BIGINT))) AS rank FROM passes, sizes) JOIN slots USING (sid, rank)
  WHERE least(stop, high) > greatest(start, low)
), taken AS (SELECT n, CAST(sum(words) AS BIGINT) AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM served GROUP BY n
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM placed LEFT JOIN taken USING (n)
"""

ORACLES["op12_infill"] = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, [CAST('0x' || digest[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM cut
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""

# A prefix is told by the digests of its turns; a node is the smallest member and the depth. crc32 is the reflected polynomial, a byte at a time.
ORACLES["op11_prefix_trie"] = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(generate_series(0, 255)) AS BIGINT) AS i)
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS giver,
         xor(list_reduce(list_prepend(4294967295, [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
), rebuilt AS (
  SELECT i.conv_id, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.giver AND o.place <= i.h
  UNION ALL SELECT i.conv_id, o.place + 4, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         string_agg(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), paths AS (
  SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM numbered
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY node, depth
), parents AS (
  SELECT n.node, n.depth, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.node AND p.depth = n.depth - 1
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL
), sums AS (
  SELECT a.node, a.depth, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.node AND a.depth <= n.depth LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth GROUP BY ALL
)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node, depth) LEFT JOIN parents p USING (node, depth) LEFT JOIN children c USING (node, depth)
"""
