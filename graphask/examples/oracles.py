"""Plain SQL (DuckDB) for the registered queries, written without the library."""

from __future__ import annotations

import re

from graphask.examples.star_schema import (
    EDGES_SQL,
    NODES_SQL,
    PHRASINGS_SQL,
    QUESTIONS_SQL,
    SAMPLES_SQL,
    SHORT_PART,
    TABLES,
)
from graphask.functions.answers import ERROR_TEXT, NAME_SEPARATOR, NOT_FOUND_TEXT, TIPS_PREFIX
from graphask.operators.graph import NAMES_PER_PART
from graphask.operators.trees import BOOST_DEPTH, BOOST_RATE, BOOST_ROUNDS, LEAF_PULL, TREE_DEPTH
from graphask.functions.text import FULL_WIDTH, HALF_WIDTH

_HALF_SQL = HALF_WIDTH.replace("'", "''")
_TRAIN = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc'"


_CONVERSION = """
          SELECT s_name AS source, 's' || s_suppkey AS target FROM supplier
          UNION ALL
          SELECT n_name, n_name || ' of ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _normal(text: str) -> str:
    return f"lower(translate({text}, '{FULL_WIDTH}', '{_HALF_SQL}'))"


def _tokens(text: str) -> str:
    spaced = rf"regexp_replace({_normal(text)}, '(\p{{Han}})', ' \1 ', 'g')"
    return rf"list_filter(string_split_regex({spaced}, '[^\p{{L}}\p{{N}}#_]+'), lambda t: t <> '')"


def _views(text: str) -> str:
    return text.format_map({name: name for name in (*TABLES, "phrasings")})


def _parts(keys: str, name: str, separator: str, size: int, source: str) -> str:
    """Sorted lists of ``name`` per ``keys``, in slices of ``size`` names."""
    return f"""
        SELECT {keys}, CAST(place // {size} AS INTEGER) AS part_no,
               CAST((n_names + {size - 1}) // {size} AS INTEGER) AS n_parts, n_names,
               string_agg({name}, '{separator}' ORDER BY place) AS names
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {name}) - 1 AS place,
                     count(*) OVER (PARTITION BY {keys}) AS n_names FROM ({source}))
        GROUP BY {keys}, place // {size}, n_names"""


def _lookups(size: int) -> str:
    asked = """
        SELECT t.template_id, i.name AS slot_name, i.source_name
        FROM templates t JOIN inbound i ON i.rel = t.rel AND i.label = t.label WHERE t.kind = 'inbound'"""
    return f"""
        SELECT t.template_id, f.name AS slot_name, CAST(0 AS INTEGER) AS part_no, CAST(1 AS INTEGER) AS n_parts,
               f.match_count, CASE t.kind WHEN 'record' THEN c.card ELSE f.props.p1 END AS raw_answer
        FROM templates t JOIN first_nodes f ON f.label = t.label JOIN cards c ON c.node_id = f.node_id
        WHERE t.kind <> 'inbound'
        UNION ALL
        SELECT template_id, slot_name, part_no, n_parts, n_names, names
        FROM ({_parts('template_id, slot_name', 'source_name', NAME_SEPARATOR, size, asked)})"""


# Named sub-queries; each may use the ones above it.
_CTES = {
    "nodes": _views(NODES_SQL),
    "edges": _views(EDGES_SQL),
    "phrasings": _views(PHRASINGS_SQL),
    "samples": _views(SAMPLES_SQL),
    "questions": _views(QUESTIONS_SQL),
    "dictionary": """
        SELECT n_name AS word, 'tnation' AS tag, CAST(0 AS INTEGER) AS freq, CAST(0 AS BIGINT) AS load_order
        FROM (SELECT DISTINCT n_name FROM nation)
        UNION ALL SELECT c_name, 'tcust', 0, 1 FROM (SELECT DISTINCT c_name FROM customer)
        UNION ALL SELECT s_name, 'tsupp', 0, 2 FROM (SELECT DISTINCT s_name FROM supplier)
        UNION ALL SELECT p_name, 'tpart', 0, 3 FROM (SELECT DISTINCT p_name FROM part)""",
    "templates": """
        SELECT * FROM (VALUES
          (0, 'tcust segment', 'property', 'customer', 'p1', NULL, 'tcust'),
          (1, 'tpart brand', 'property', 'part', 'p1', NULL, 'tpart'),
          (2, 'based_in tnation', 'inbound', 'nation', NULL, 'based_in', 'tnation'),
          (3, 'tsupp record', 'record', 'supplier', NULL, NULL, 'tsupp')
        ) AS t(template_id, pattern, kind, label, field, rel, slot_tag)""",
    # text
    "lexicon": f"""
        SELECT phrase, len(string_split(phrase, ' ')) AS n_tokens,
               arg_min(word, load_order) AS word, arg_min(tag, load_order) AS tag
        FROM (SELECT *, array_to_string({_tokens('word')}, ' ') AS phrase FROM dictionary)
        GROUP BY phrase""",
    "question_tokens": f"SELECT question_id, {_tokens('text')} AS tokens FROM questions",
    "starts": "SELECT question_id, tokens, unnest(range(len(tokens))) AS start FROM question_tokens",
    "grams": """
        SELECT question_id, start, k AS len, array_to_string(tokens[start + 1 : start + k], ' ') AS phrase
        FROM starts JOIN (SELECT DISTINCT n_tokens AS k FROM lexicon) ON start + k <= len(tokens)""",
    "best": """
        SELECT question_id, start, max(len) AS len, arg_max(word, len) AS word, arg_max(tag, len) AS tag
        FROM grams JOIN lexicon USING (phrase) GROUP BY question_id, start""",
    "walk": """
        SELECT question_id, CAST(0 AS BIGINT) AS pos FROM question_tokens
        UNION ALL
        SELECT w.question_id, w.pos + coalesce(b.len, 1)
        FROM walk w JOIN question_tokens q ON q.question_id = w.question_id
        LEFT JOIN best b ON b.question_id = w.question_id AND b.start = w.pos
        WHERE w.pos < len(q.tokens)""",
    "terms": """
        SELECT w.question_id, CAST(w.pos AS INTEGER) AS pos, coalesce(b.word, q.tokens[w.pos + 1]) AS word, b.tag
        FROM walk w JOIN question_tokens q ON q.question_id = w.question_id
        LEFT JOIN best b ON b.question_id = w.question_id AND b.start = w.pos
        WHERE w.pos < len(q.tokens)""",
    "mentions": """
        SELECT question_id, tag, arg_max(word, pos) AS word FROM terms WHERE tag IS NOT NULL
        GROUP BY question_id, tag""",
    # template choice: naive Bayes over the phrasings
    "sample_words": f"""
        SELECT DISTINCT label, phrasing, unnest({_tokens('sentence')}) AS word FROM samples""",
    "vocabulary": "SELECT DISTINCT word FROM sample_words",
    "sample_theta": """
        SELECT label, word,
               ln(count(s.word) + 1.0) - ln(sum(count(s.word)) OVER (PARTITION BY label)
                                            + (SELECT count(*) FROM vocabulary)) AS theta
        FROM (SELECT DISTINCT label FROM samples) CROSS JOIN vocabulary
        LEFT JOIN sample_words s USING (label, word) GROUP BY label, word""",
    "sample_prior": """
        SELECT label, ln(count(*) + 1.0) - ln((SELECT count(*) FROM samples)
               + (SELECT count(DISTINCT label) FROM samples)) AS prior FROM samples GROUP BY label""",
    "question_hits": """
        SELECT DISTINCT question_id, coalesce(tag, word) AS word FROM terms
        WHERE coalesce(tag, word) IN (SELECT word FROM vocabulary)""",
    "question_scores": """
        SELECT q.question_id, p.label, p.prior + coalesce(sum(t.theta), 0) AS score, count(t.theta) AS n_hits
        FROM questions q CROSS JOIN sample_prior p
        LEFT JOIN question_hits h ON h.question_id = q.question_id
        LEFT JOIN sample_theta t ON t.label = p.label AND t.word = h.word
        GROUP BY q.question_id, p.label, p.prior""",
    "predicted": """
        SELECT question_id, CAST(label AS INTEGER) AS template_id, CAST(n_hits AS INTEGER) AS n_hits
        FROM question_scores
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, label) = 1""",
    "analyzed": """
        SELECT p.question_id, p.template_id, p.n_hits, t.pattern,
               coalesce(m1.word, split_part(t.pattern, ' ', 1)) AS slot1,
               coalesce(m2.word, split_part(t.pattern, ' ', 2)) AS slot2,
               coalesce(m3.word, '') AS slot_name
        FROM predicted p JOIN templates t USING (template_id)
        LEFT JOIN mentions m1 ON m1.question_id = p.question_id AND m1.tag = split_part(t.pattern, ' ', 1)
        LEFT JOIN mentions m2 ON m2.question_id = p.question_id AND m2.tag = split_part(t.pattern, ' ', 2)
        LEFT JOIN mentions m3 ON m3.question_id = p.question_id AND m3.tag = t.slot_tag""",
    # graph
    "asked_names": """
        SELECT DISTINCT t.label, q.gold_name AS name FROM questions q JOIN templates t ON t.template_id = q.gold_template""",
    "first_nodes": """
        SELECT label, name, min(node_id) AS node_id, arg_min(struct_pack(p1 := p1, p2 := p2), node_id) AS props,
               count(*) AS match_count
        FROM nodes GROUP BY label, name""",
    "inbound": """
        SELECT e.rel, m.label, m.name, e.src_id, n.name AS source_name
        FROM edges e JOIN nodes m ON m.node_id = e.dst_id JOIN nodes n ON n.node_id = e.src_id""",
    "targets": """
        SELECT DISTINCT CASE label WHEN 'region' THEN 'in_region' WHEN 'nation' THEN 'based_in' ELSE 'supplies' END AS rel,
               label, name
        FROM nodes WHERE label IN ('region', 'nation', 'part')""",
    "cards": """
        SELECT label, name, node_id,
               name || coalesce(' nation ''' || p1 || '''.', '') || coalesce(' type ''' || p2 || '''.', '') AS card
        FROM nodes""",
    "lookups": _lookups(NAMES_PER_PART),
    "short_lookups": _lookups(SHORT_PART),
    "answered": f"""
        SELECT a.question_id, a.template_id, a.slot1, a.slot2, coalesce(l.part_no, 0) AS part_no,
               coalesce(l.n_parts, 1) AS n_parts, coalesce(l.match_count, 0) AS match_count,
               CASE WHEN a.slot_name <> '' AND coalesce(l.raw_answer, '') NOT IN ('', '\\N') THEN l.raw_answer
                    ELSE '{NOT_FOUND_TEXT}' END AS answer,
               CASE WHEN a.slot_name = '' THEN 'no_slot'
                    WHEN coalesce(l.raw_answer, '') IN ('', '\\N') THEN 'not_found' ELSE 'ok' END AS status
        FROM analyzed a LEFT JOIN lookups l ON l.template_id = a.template_id AND l.slot_name = a.slot_name""",
    # documents
    "document_words": f"""
        SELECT doc_id, lang, unnest({_tokens('text')}) AS word FROM documents""",
    "document_counts": "SELECT doc_id, lang, word, count(*) AS value FROM document_words GROUP BY ALL",
    "document_vocabulary": """
        SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT word FROM document_counts)""",
    "document_hits": "SELECT doc_id, lang, idx, value FROM document_counts JOIN document_vocabulary USING (word)",
    "language_theta": f"""
        SELECT label, idx,
               ln(count(h.idx) + 1.0) - ln(sum(count(h.idx)) OVER (PARTITION BY label)
                                           + (SELECT count(*) FROM document_vocabulary)) AS theta
        FROM (SELECT DISTINCT lang AS label FROM documents WHERE {_TRAIN}) CROSS JOIN document_vocabulary
        LEFT JOIN (SELECT lang AS label, idx FROM document_hits WHERE {_TRAIN}) h USING (label, idx)
        GROUP BY label, idx""",
    "language_prior": f"""
        SELECT lang AS label, ln(count(*) + 1.0) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS prior
        FROM documents WHERE {_TRAIN} GROUP BY lang""",
    "language_scores": """
        SELECT d.doc_id, p.label, p.prior + coalesce(sum(t.theta), 0) AS score
        FROM documents d CROSS JOIN language_prior p
        LEFT JOIN document_hits h ON h.doc_id = d.doc_id
        LEFT JOIN language_theta t ON t.label = p.label AND t.idx = h.idx
        GROUP BY d.doc_id, p.label, p.prior""",
    "language_predicted": """
        SELECT doc_id, label AS prediction FROM language_scores
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1""",
    "quality_hits": """
        SELECT CAST(l.quality + 1 AS INTEGER) AS label, h.idx, sum(h.value) AS value
        FROM document_hits h JOIN labels l USING (doc_id) GROUP BY ALL""",
    "quality_theta": """
        SELECT label, idx,
               ln(coalesce(h.value, 0) + 1.0) - ln(sum(coalesce(h.value, 0)) OVER (PARTITION BY label)
                                                   + (SELECT count(*) FROM document_vocabulary)) AS theta
        FROM (SELECT DISTINCT CAST(quality + 1 AS INTEGER) AS label FROM labels) CROSS JOIN document_vocabulary
        LEFT JOIN quality_hits h USING (label, idx)""",
    "quality_scores": """
        SELECT d.doc_id, p.label, p.prior + coalesce(sum(t.theta * h.value), 0) AS score
        FROM documents d
        CROSS JOIN (SELECT CAST(quality + 1 AS INTEGER) AS label,
                           ln(count(*) + 1.0) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS prior
                    FROM labels GROUP BY quality) p
        LEFT JOIN document_hits h ON h.doc_id = d.doc_id
        LEFT JOIN quality_theta t ON t.label = p.label AND t.idx = h.idx
        GROUP BY d.doc_id, p.label, p.prior""",
}


def _tree_ctes(depth: int) -> dict[str, str]:
    """A decision tree level by level: weights of the nodes, best splits, documents at their children."""
    ctes = {
        "tree_hits": "SELECT DISTINCT doc_id, idx FROM document_hits",
        "tree_points_0": f"SELECT doc_id, lang AS label, {_TRAIN} AS train, CAST(1 AS BIGINT) AS node FROM documents",
    }
    for level in range(depth + 1):
        points, totals, splits = f"tree_points_{level}", f"tree_totals_{level}", f"tree_splits_{level}"
        ctes[totals] = f"SELECT node, label, count(*) AS t FROM {points} WHERE train GROUP BY ALL"
        if level == depth:
            break
        ctes[splits] = f"""
            SELECT node, idx FROM (
              SELECT node, idx, round((n * ln(n) - s - n_in * ln(n_in) + s_in - (n - n_in) * ln(n - n_in)
                                       + (s - t_in) + s_out) / n, 9) AS gain
              FROM (SELECT node, idx, sum(c) AS n_in, sum(c * ln(c)) AS s_in, sum(t * ln(t)) AS t_in,
                           sum(CASE WHEN t > c THEN (t - c) * ln(t - c) ELSE 0 END) AS s_out
                    FROM (SELECT p.node, h.idx, p.label, count(*) AS c
                          FROM {points} p JOIN tree_hits h USING (doc_id) WHERE p.train GROUP BY ALL)
                    JOIN {totals} USING (node, label) GROUP BY node, idx)
              JOIN (SELECT node, sum(t) AS n, sum(t * ln(t)) AS s FROM {totals} GROUP BY node) USING (node)
              WHERE n > n_in)
            WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, idx) = 1"""
        ctes[f"tree_points_{level + 1}"] = f"""
            SELECT p.doc_id, p.label, p.train, 2 * p.node + CASE WHEN h.idx IS NULL THEN 0 ELSE 1 END AS node
            FROM {points} p JOIN {splits} s USING (node) LEFT JOIN tree_hits h ON h.doc_id = p.doc_id AND h.idx = s.idx"""
    every = " UNION ALL ".join(f"SELECT *, {level} AS depth FROM tree_totals_{level}" for level in range(depth + 1))
    asked = " UNION ALL ".join(f"SELECT node, idx FROM tree_splits_{level}" for level in range(depth))
    walked = " UNION ALL ".join(f"SELECT doc_id, label, train, node FROM tree_points_{level}" for level in range(depth + 1))
    ctes["tree_nodes"] = f"""
        SELECT node, CAST(depth AS INTEGER) AS depth, idx, label AS prediction FROM ({every}) LEFT JOIN ({asked}) USING (node)
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC, label) = 1"""
    ctes["tree_predicted"] = f"""
        SELECT doc_id, w.label, train, prediction
        FROM (SELECT doc_id, label, train, max(node) AS node FROM ({walked}) GROUP BY ALL) w JOIN tree_nodes USING (node)"""
    return ctes


def _boost_ctes(rounds: int, depth: int, rate: float, pull: float) -> dict[str, str]:
    """Trees on what each class lacks; a row for each document and class."""
    ctes = {
        "boost_rows_0": f"""
            SELECT doc_id, lang AS own, {_TRAIN} AS train, k.label, CAST(0 AS DOUBLE) AS raw
            FROM documents CROSS JOIN (SELECT DISTINCT lang AS label FROM documents WHERE {_TRAIN}) k"""
    }
    for r in range(rounds):
        ctes[f"boost_lack_{r}"] = f"""
            SELECT doc_id, own, train, label, raw,
                   CASE WHEN own = label THEN 1 ELSE 0 END - exp(raw - top) / sum(exp(raw - top)) OVER (PARTITION BY doc_id) AS g
            FROM (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS top FROM boost_rows_{r})"""
        ctes[f"boost_leaf_{r}_0"] = f"SELECT doc_id, label, train, g, 1 AS node FROM boost_lack_{r}"
        for d in range(depth):
            ctes[f"boost_best_{r}_{d}"] = f"""
                SELECT label, node, idx FROM (
                  SELECT label, node, idx, round(i.g * i.g / (i.n + {pull}) - t.g * t.g / (t.n + {pull})
                         + (t.g - i.g) * (t.g - i.g) / (t.n - i.n + {pull}), 9) AS gain
                  FROM (SELECT label, node, idx, sum(g) AS g, count(*) AS n FROM boost_leaf_{r}_{d} JOIN tree_hits USING (doc_id)
                        WHERE train AND node >= {1 << d} GROUP BY ALL) i
                  JOIN (SELECT label, node, sum(g) AS g, count(*) AS n FROM boost_leaf_{r}_{d} WHERE train GROUP BY ALL) t
                    USING (label, node) WHERE t.n > i.n)
                WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY label, node ORDER BY gain DESC, idx) = 1"""
            ctes[f"boost_leaf_{r}_{d + 1}"] = f"""
                SELECT l.doc_id, l.label, train, g,
                       CASE WHEN b.idx IS NULL THEN l.node WHEN h.idx IS NULL THEN 2 * l.node ELSE 2 * l.node + 1 END AS node
                FROM boost_leaf_{r}_{d} l LEFT JOIN boost_best_{r}_{d} b ON b.label = l.label AND b.node = l.node
                LEFT JOIN tree_hits h ON h.doc_id = l.doc_id AND h.idx = b.idx"""
        ctes[f"boost_rows_{r + 1}"] = f"""
            SELECT doc_id, own, l.train, label, raw + coalesce({rate} * v.g / (v.n + {pull}), 0) AS raw
            FROM boost_lack_{r} JOIN (SELECT doc_id, label, train, node FROM boost_leaf_{r}_{depth}) l USING (doc_id, label)
            LEFT JOIN (SELECT label, node, sum(g) AS g, count(*) AS n FROM boost_leaf_{r}_{depth} WHERE train GROUP BY ALL) v
              USING (label, node)"""
    ctes["boost_predicted"] = f"""
        SELECT doc_id, own AS label, train, label AS prediction FROM boost_rows_{rounds}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, label) = 1"""
    return ctes


_CTES |= _tree_ctes(TREE_DEPTH) | _boost_ctes(BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE, LEAF_PULL)


def _measured(model: str, predicted: str) -> str:
    return f"""
        SELECT '{model}' AS model, count(*) AS n_test, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM {predicted} WHERE NOT train"""


def _with(body: str) -> str:
    """Put the sub-queries that ``body`` needs in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    kept = {name: "MATERIALIZED " if name.startswith(("tree_", "boost_")) else "" for name in _CTES}
    ctes = ",\n".join(f"{name} AS {kept[name]}({_CTES[name].strip()})" for name in _CTES if name in needed)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}" if ctes else body.strip()


_ATTR = """CASE p_type WHEN 'PROMO' THEN p_brand WHEN 'LARGE' THEN p_brand || ' ' || p_size || ' x'
           ELSE p_brand || ' ' || p_size END"""
_ANSWERED = (
    "SELECT question_id, template_id, slot1, slot2, part_no, n_parts, match_count, answer, status FROM answered"
)
_FILLED = """
    SELECT q.question_id,
           coalesce(m1.word, split_part(t.pattern, ' ', 1)) AS slot1,
           coalesce(m2.word, split_part(t.pattern, ' ', 2)) AS slot2
    FROM questions q JOIN templates t ON t.template_id = q.gold_template
    LEFT JOIN mentions m1 ON m1.question_id = q.question_id AND m1.tag = split_part(t.pattern, ' ', 1)
    LEFT JOIN mentions m2 ON m2.question_id = q.question_id AND m2.tag = split_part(t.pattern, ' ', 2)"""
_REACHED = """
    SELECT t.rel, t.label, t.name, i.source_name
    FROM targets t JOIN inbound i ON i.rel = t.rel AND i.label = t.label AND i.name = t.name"""

_BODIES = {
    "src_dictionary": "SELECT c_name AS word, 'tcust' AS tag, CAST(0 AS INTEGER) AS freq, CAST(1 AS BIGINT) AS load_order FROM customer",
    "src_dictionary_all": "SELECT word, tag, freq, load_order FROM dictionary",
    "src_vocabulary": "SELECT CAST(p_partkey AS INTEGER) AS idx, p_name AS word FROM part",
    "src_templates": "SELECT CAST(s_suppkey AS INTEGER) AS template_id, 'tsupp ' || s_name AS pattern FROM supplier",
    "src_samples": """
        SELECT CAST(CASE WHEN line <= 5 THEN doc_id ELSE -1 - doc_id END AS INTEGER) AS label, sentence FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
          FROM documents)
        WHERE sentence <> ''""",
    "src_nodes": "SELECT node_id, label, name, p1, p2 FROM nodes",
    "src_edges": "SELECT src_id, rel, dst_id FROM edges",
    "src_questions": "SELECT question_id, text FROM questions",
    "src_questions_stream": "SELECT question_id, text FROM questions",
    "sink_answers": _ANSWERED,
    "dict_parse_attr": """
        SELECT p_partkey,
               CASE WHEN p_type = 'LARGE' THEN NULL ELSE p_brand END AS tag,
               CAST(CASE p_type WHEN 'LARGE' THEN NULL WHEN 'PROMO' THEN 1 ELSE p_size END AS INTEGER) AS freq,
               CAST(CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 0 ELSE 1 END AS INTEGER) AS valid
        FROM part""",
    "dict_conflict": """
        SELECT p_name AS word, CAST(count(DISTINCT p_type) AS INTEGER) AS n_tags,
               string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tags, arg_min(p_type, p_partkey) AS kept_tag
        FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1""",
    "dict_add": """
        SELECT word, tag, freq, load_order FROM dictionary WHERE tag <> 'tpart'
        UNION ALL
        SELECT p_name, arg_min(p_brand, p_partkey), CAST(arg_min(p_size, p_partkey) AS INTEGER), min(p_partkey)
        FROM part WHERE p_name NOT IN (SELECT word FROM dictionary WHERE tag <> 'tpart') GROUP BY p_name""",
    "dict_upsert": """
        SELECT p_name AS word,
               coalesce(arg_max(p_brand, p_partkey) FILTER (WHERE p_type NOT IN ('PROMO', 'LARGE')),
                        arg_min(p_type, p_partkey)) AS tag,
               CAST(arg_max(CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 0 ELSE p_size END, p_partkey) AS INTEGER) AS freq,
               min(p_partkey) AS load_order
        FROM part GROUP BY p_name
        UNION ALL
        SELECT c_name, arg_min(c_mktsegment, c_custkey), 7, min(c_custkey) FROM customer
        WHERE c_name NOT IN (SELECT p_name FROM part) GROUP BY c_name""",
    "dict_stream": """
        WITH v1 AS (
          SELECT p_name AS word,
                 coalesce(arg_max(p_brand, p_partkey) FILTER (WHERE p_type NOT IN ('PROMO', 'LARGE')),
                          arg_min(p_type, p_partkey)) AS tag,
                 CAST(arg_max(CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 0 ELSE p_size END, p_partkey) AS INTEGER) AS freq,
                 min(p_partkey) AS load_order
          FROM part GROUP BY p_name)
        SELECT *, CAST(1 AS INTEGER) AS version FROM v1
        UNION ALL SELECT *, 2 FROM v1
        UNION ALL
        SELECT c_name, arg_min(c_mktsegment, c_custkey), 7, min(c_custkey), 2 FROM customer
        WHERE c_name NOT IN (SELECT p_name FROM part) GROUP BY c_name""",
    "txt_convert_phrases": f"""
        SELECT question_id, string_agg(coalesce(target, piece), '' ORDER BY place) AS text
        FROM (SELECT question_id, unnest(found) AS piece, generate_subscripts(found, 1) AS place
              FROM (SELECT question_id, regexp_extract_all(text, any_of) AS found
                    FROM questions,
                         (SELECT '(?s)' || string_agg(regexp_escape(source), '|' ORDER BY length(source) DESC) || '|.' AS any_of
                          FROM ({_CONVERSION}))))
        LEFT JOIN ({_CONVERSION}) ON source = piece GROUP BY question_id""",
    "txt_normalize": f"""
        SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, md5({_normal('text')}) AS digest FROM documents
        UNION ALL SELECT 'conversation', conv_id, turn, md5({_normal('text')}) FROM conversations""",
    "txt_tokenize": f"""
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct,
               md5(coalesce(array_to_string(t, ' '), '')) AS digest
        FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""",
    "txt_tag_entities": "SELECT question_id, pos, word, tag FROM terms WHERE tag IS NOT NULL",
    "txt_tag_precedence": """
        SELECT q.question_id,
               arg_min(t.tag, CASE t.tag WHEN 'tsupp' THEN 0 WHEN 'tpart' THEN 1 WHEN 'tnation' THEN 2 ELSE 3 END) AS first_tag
        FROM questions q LEFT JOIN terms t ON t.question_id = q.question_id AND t.tag IS NOT NULL
        GROUP BY q.question_id""",
    "txt_abstract": """
        SELECT question_id, string_agg(coalesce(tag, word), ' ' ORDER BY pos) AS abstract FROM terms GROUP BY question_id""",
    "txt_mention_map": "SELECT question_id, tag, word FROM mentions",
    "txt_fill_template": f"SELECT question_id, slot1 || ' ' || slot2 AS filled FROM ({_FILLED})",
    "txt_split_slots": f"SELECT question_id, slot1, slot2 FROM ({_FILLED})",
    "txt_analyze": "SELECT question_id, template_id, slot1, slot2, n_hits FROM analyzed",
    "feat_binary_bow": "SELECT doc_id, idx FROM document_hits",
    "feat_labeled_points": """
        SELECT h.doc_id, l.quality AS label, h.idx, CAST(1 AS DOUBLE) AS value
        FROM document_hits h JOIN labels l USING (doc_id)""",
    "feat_vectors": """
        SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_dims,
               CAST(len(list_filter(embedding, lambda v: v > 0)) AS INTEGER) AS n_positive,
               round(coalesce(list_sum(list_transform(list_filter(embedding, lambda v: v > 0),
                     lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 0), 6) AS dot
        FROM embeddings""",
    "ml_split": f"SELECT doc_id, CASE WHEN {_TRAIN} THEN 'train' ELSE 'test' END AS part FROM documents",
    "ml_naive_bayes_fit": """
        SELECT label, idx, round(theta, 6) AS log_theta, round(prior, 6) AS log_prior
        FROM language_theta JOIN language_prior USING (label)""",
    "ml_naive_bayes_counts": """
        SELECT doc_id, arg_max(label, rank) AS prediction,
               round(max(CASE WHEN label = 1 THEN p END), 6) AS p_first
        FROM (SELECT doc_id, label, round(score, 9) - label * 1e-12 AS rank,
                     exp(score - max(score) OVER (PARTITION BY doc_id))
                     / sum(exp(score - top)) OVER (PARTITION BY doc_id) AS p
              FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM quality_scores))
        GROUP BY doc_id""",
    "ml_predict": "SELECT doc_id, prediction FROM language_predicted",
    "ml_predict_proba": """
        SELECT doc_id, label, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY doc_id), 6) AS probability
        FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM language_scores)""",
    "ml_accuracy": f"""
        SELECT count(*) AS n_test, round(avg(CASE WHEN p.prediction = d.lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM documents d JOIN language_predicted p USING (doc_id) WHERE NOT ({_TRAIN})""",
    "ml_decision_tree_nodes": "SELECT node, depth, idx, prediction FROM tree_nodes",
    "ml_decision_tree_fit": _measured("decision_tree", "tree_predicted"),
    "ml_boosted_fit": _measured("boosted", "boost_predicted"),
    "ml_select_model": f"""
        SELECT model, n_test, accuracy FROM (
          SELECT 0 AS place, * FROM ({_measured("naive_bayes", f"(SELECT lang AS label, {_TRAIN} AS train, prediction FROM documents JOIN language_predicted USING (doc_id))")})
          UNION ALL SELECT 1, * FROM ({_measured("decision_tree", "tree_predicted")})
          UNION ALL SELECT 2, * FROM ({_measured("boosted", "boost_predicted")}))
        ORDER BY accuracy DESC, place LIMIT 1""",
    "ml_template_lookup": "SELECT question_id, template_id, pattern FROM analyzed",
    "graph_node_scan": "SELECT name, label FROM nodes",
    "graph_property_lookup": """
        SELECT a.label, a.name, 'p1' AS field, f.props.p1 AS value, coalesce(f.match_count, 0) AS match_count
        FROM asked_names a LEFT JOIN first_nodes f ON f.label = a.label AND f.name = a.name""",
    "graph_node_record": """
        SELECT a.label, a.name, f.node_id, f.props.p1 AS p1, f.props.p2 AS p2, coalesce(f.match_count, 0) AS match_count
        FROM asked_names a LEFT JOIN first_nodes f ON f.label = a.label AND f.name = a.name""",
    "graph_inbound_neighbors": """
        SELECT i.rel, i.label, i.name, i.src_id, i.source_name
        FROM targets t JOIN inbound i ON i.rel = t.rel AND i.label = t.label AND i.name = t.name""",
    "graph_clustered": """
        SELECT i.rel, i.label, i.name, i.src_id, i.source_name
        FROM targets t JOIN inbound i ON i.rel = t.rel AND i.label = t.label AND i.name = t.name""",
    "graph_neighbor_lists": f"""
        SELECT rel, label, name, part_no, n_parts, n_names, names
        FROM ({_parts('rel, label, name', 'source_name', ',', SHORT_PART, _REACHED)})""",
    "graph_route": """
        SELECT q.gold_template AS template_id, q.gold_name AS slot_name, coalesce(l.part_no, 0) AS part_no,
               coalesce(l.n_parts, 1) AS n_parts,
               coalesce(l.match_count, 0) AS match_count, l.raw_answer, CAST(1 AS INTEGER) AS well_formed
        FROM (SELECT DISTINCT gold_template, gold_name FROM questions) q
        LEFT JOIN short_lookups l ON l.template_id = q.gold_template AND l.slot_name = q.gold_name""",
    "ans_join_names": f"""
        SELECT t.rel, t.name, l.part_no, l.names AS answer
        FROM targets t
        LEFT JOIN ({_parts('rel, label, name', 'source_name', NAME_SEPARATOR, SHORT_PART, _REACHED)}) l
          ON l.rel = t.rel AND l.label = t.label AND l.name = t.name""",
    "ans_tips": f"""
        SELECT part_no, n_parts, CASE part_no WHEN 0 THEN '{TIPS_PREFIX}' ELSE '' END || names AS tips
        FROM ({_parts('kind', 'c_name', NAME_SEPARATOR, SHORT_PART, "SELECT 'customer' AS kind, c_name FROM customer")})""",
    "ans_image": """
        SELECT page_id, CASE WHEN contains(html, '<img') AND url NOT IN ('', '\\N') THEN
          '<a target="_blank" rel="noopener noreferrer" href="' || url || '"><img src="' || url || '" title="点击查看大图"></a>'
          END AS answer FROM pages""",
    "ans_card": "SELECT node_id, card AS answer FROM cards",
    "ans_not_found": f"""
        SELECT node_id, CASE WHEN label = 'part' AND p2 <> '' THEN p2 ELSE '{NOT_FOUND_TEXT}' END AS answer,
               CASE WHEN label = 'part' AND p2 <> '' THEN 'ok' ELSE 'not_found' END AS status
        FROM nodes""",
    "ans_error": f"""
        SELECT question_id,
               CASE WHEN gold_name = 'Nobody' THEN '{ERROR_TEXT}' WHEN gold_name IS NULL OR gold_name = ''
                    THEN '{NOT_FOUND_TEXT}' ELSE gold_name END AS answer,
               CASE WHEN gold_name = 'Nobody' THEN 'error' WHEN gold_name IS NULL OR gold_name = ''
                    THEN 'not_found' ELSE 'ok' END AS status
        FROM questions""",
    "qa_batch": _ANSWERED,
    "qa_normalized_questions": "SELECT question_id, template_id, slot1, slot2, slot_name FROM analyzed",
    "qa_normalized_answers": """
        SELECT DISTINCT a.template_id, a.slot_name, w.part_no, w.n_parts, w.match_count, w.answer, w.status
        FROM analyzed a JOIN answered w USING (question_id)""",
    "qa_stream": _ANSWERED,
}

ORACLES: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
