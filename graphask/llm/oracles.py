"""SQL over the raw tables with the rows of the queries that SQL can express."""

from __future__ import annotations

from graphask.llm import quality_rules as qr
from graphask.llm import secret_scan

_NAMES = [name for name, *_ in qr.RULES]


def _label_model_sql() -> str:
    """Expectation-maximisation as a recursive table of one row a round."""

    def bounded(value: str, least: float, most: float) -> str:
        return f"least(greatest({value}, {least}::DOUBLE), {most}::DOUBLE)"

    k = qr.PSEUDO_COUNT
    rates = [(name, kind) for name in _NAMES for kind in qr.START]
    odds = qr.odds_sql(lambda name, kind: f"{name}_{kind}", f"{qr.PRIOR_GOOD}::DOUBLE")
    start = ", ".join(f"{qr.START[kind]}::DOUBLE AS {name}_{kind}" for name, kind in rates)
    sums = qr.vote_sums_sql()
    step = ", ".join(
        bounded(
            f"({sums[f'{name}_{kind}']} + {k * qr.START[kind]}) / ({sums['good' if kind.endswith('good') else 'bad']} + {k})",
            *qr.BOUNDS[kind],
        )
        for name, kind in rates
    )
    votes = ", ".join(f"{qr.vote_sql(against, for_)} AS {name}" for name, against, for_ in qr.RULES)
    return f"""
texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
          FROM texts),
places AS (SELECT k, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS piece
           FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
again AS (SELECT k, i FROM places QUALIFY count(*) OVER (PARTITION BY k, piece) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(5) AS t(j) GROUP BY k),
signals AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM split LEFT JOIN covered USING (k)),
counted AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars FROM signals),
voted AS (SELECT *, {votes} FROM counted),
patterns AS (SELECT {", ".join(_NAMES)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
model AS (
  SELECT 0 AS round, {start}
  UNION ALL
  SELECT round + 1, {step}
  FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS q FROM model, patterns WHERE round < {qr.ROUNDS}) GROUP BY round),
rated AS (SELECT voted.*, 1 / (1 + exp(-({odds}))) AS posterior FROM voted, model WHERE round = {qr.ROUNDS})"""


OP1 = f"""
WITH RECURSIVE {_label_model_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 4) AS posterior
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM rated)
"""

#: All 50-byte strings as hexadecimal digits; the first document of each decides.
OP5 = """
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT k, doc_id, i, substr(h, 2 * i + 1, 100) AS s
            FROM (SELECT k, doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM texts)),
firsts AS (SELECT md5(s) AS m, min(doc_id) AS first FROM strings GROUP BY ALL HAVING count(*) > 1),
copied AS (SELECT k, i FROM strings JOIN firsts ON md5(s) = m WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
marked AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM copied),
numbered AS (SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT k, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY k, span),
cuts AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS from_here,
                lead(a) OVER (PARTITION BY k ORDER BY a) AS next FROM spans),
pieces AS (SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed,
                  string_agg(substr(h, 2 * from_here + 1, 2 * (a - from_here))
                             || CASE WHEN next IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
           FROM cuts JOIN texts USING (k) GROUP BY k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts LEFT JOIN pieces USING (k)
"""

#: The 256 table entries of the checksum, each computed bit by bit.
_CRC_ENTRIES = """entries AS (
  SELECT list(list_reduce(list_concat([b], [8, 8, 8, 8, 8, 8, 8, 8]),
                          lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b))"""


def _crc_sql(text: str) -> str:
    """The checksum of a text, byte by byte, beside a row of ``entries``."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, v: xor(c // 256, t[(xor(c % 256, v) + 1)::BIGINT])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {values}), {step}), 4294967295)::BIGINT"


OP10 = f"""
WITH {_CRC_ENTRIES},
summed AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, entries),
placed AS (
  SELECT *, sum(size) OVER () AS total,
         sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place
  FROM summed),
cut AS (SELECT *, least(15, ((2 * upto - size) * 16) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Matches are set between two private characters; their places follow from the lengths between them."""
    rules = ", ".join(
        f"({place}, {_quoted(r.kind)}, {_quoted(('(?i)' if r.any_case else '') + r.pattern)}, {r.group}, {r.least}, {place < len(secret_scan.BASE_RULES)})"
        for place, r in enumerate(secret_scan.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {_quoted(r.kind)}) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
rules(place, kind, pattern, part, least, base) AS (VALUES {rules}),
marked AS (SELECT k, place, kind, pattern, part, least, base,
                  string_split(regexp_replace(text, pattern, chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS pieces
           FROM texts, rules WHERE regexp_matches(text, pattern)),
piece AS (SELECT *, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM marked),
placed AS (SELECT *, split_part(piece, chr(57345), 1) AS found,
                  sum(length(piece) - CASE WHEN i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k, place ORDER BY i)
                  - length(piece) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS a
           FROM piece),
spans AS (SELECT k, place, kind, base, a, concat_ws(':', kind, a::BIGINT, (a + length(found))::BIGINT) AS span FROM placed
          WHERE i > 0 AND length(CASE part WHEN 0 THEN found WHEN 1 THEN regexp_extract(found, pattern, 1)
                                      ELSE regexp_extract(found, pattern, 2) END) >= least),
joined AS (SELECT k, {counts}, string_agg(span, ',' ORDER BY a, place) FILTER (base) AS base_spans,
                  string_agg(span, ',' ORDER BY a, place) AS spans FROM spans GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (k)
"""


OP11 = _secrets_sql()

#: One row at a time: every state keeps its cheapest and then least audit, with the lines that it gives.
OP12 = f"""
WITH RECURSIVE {_CRC_ENTRIES},
spaced AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
           FROM conversations, entries),
hurt AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
         FROM spaced WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
told AS (SELECT *, substr(role, 1, 1) AS r,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
         FROM placed),
pairs AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM told),
measured AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                    count(*) FILTER (fault = 'truncated') AS truncated,
                    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
             FROM pairs GROUP BY conv_id),
inserts(state, after, cost, word, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
         (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
edits(after, letter, r, next, cost) AS (
  VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4),
         (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3),
         (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM measured
  UNION ALL
  SELECT ways.conv_id, ways.i + 1, next,
         min({{'cost': best.cost + inserts.cost + edits.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END,
               'audit': best.audit || word || letter,
               'lines': list_concat(best.lines, inserts.lines, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                        ELSE [CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END)}})
  FROM ways JOIN told ON ways.conv_id IS NOT DISTINCT FROM told.conv_id AND told.i = ways.i + 1
       JOIN inserts USING (state) JOIN edits USING (after)
  WHERE (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (letter <> 'K' OR edits.r = told.r)
  GROUP BY ways.conv_id, ways.i, next),
ended AS (SELECT ways.conv_id,
                 min({{'cost': best.cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
                       'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                       'lines': list_concat(best.lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS best
          FROM ways JOIN measured ON ways.conv_id IS NOT DISTINCT FROM measured.conv_id AND i = n GROUP BY ways.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN measured ON ids.conv_id IS NOT DISTINCT FROM measured.conv_id
LEFT JOIN ended ON ids.conv_id IS NOT DISTINCT FROM ended.conv_id
"""

#: Words one edit apart by the words with one letter taken out.
OP13 = f"""
WITH RECURSIVE {_CRC_ENTRIES},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents)
         WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, entries),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                        ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT cut.word AS a, cut.n AS n_a, w.word AS b, w.n AS n_b FROM cut JOIN words AS w ON rest = w.word
         UNION SELECT w.word, w.n, cut.word, cut.n FROM cut JOIN words AS w ON rest = w.word
         UNION SELECT x.word, x.n, y.word, y.n FROM cut AS x JOIN cut AS y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
found AS (SELECT a AS word, count(*) AS n_near, min({{'less': -n_b, 'word': b}}) AS best FROM near GROUP BY a),
formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near,
                  CASE WHEN -best.less >= 10 * n THEN best.word END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
           FROM words LEFT JOIN found USING (word)),
chain AS (SELECT word, word AS here, 0 AS steps FROM formed
          UNION ALL SELECT chain.word, form, steps + 1 FROM chain JOIN formed ON here = formed.word WHERE form IS NOT NULL)
SELECT word, form, (SELECT arg_max(here, steps) FROM chain WHERE chain.word = formed.word) AS root, n, n_near, form_n::BIGINT AS form_n
FROM formed
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op5_suffix_dedup": OP5, "op10_sharding": OP10, "op11_secret_scan": OP11, "op12_conversation_repair": OP12, "op13_spelling_variants": OP13}
