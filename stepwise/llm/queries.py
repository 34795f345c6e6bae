"""The registered queries of this subpackage: name to (Spark query, SQL oracle or None)."""

from __future__ import annotations

import public_tokenizers

from stepwise.llm import (
    byte_bpe,
    chat,
    filter_audit,
    fingerprint,
    language,
    mixing,
    near_dup,
    neighbours,
    packing,
    periodic,
    quality,
    token_blocks,
    toxicity,
)
from stepwise.llm.shared import table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op2_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark, sf_dir):
    return chat.link(table(spark, sf_dir, "conversations"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_token_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_blocks.token_files(docs, public_tokenizers.path(TOKENIZER))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op11_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(periodic.find_runs(periodic.with_periods(docs)))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


_SENTENCES = r"""unnest(string_split(regexp_replace(lower(regexp_replace(content, '\s+', ' ', 'g')),
        '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))"""
# Quotations by looking every quoted sentence up; reply chains by recursion.
CONVERSATIONS = rf"""WITH RECURSIVE m AS (
    SELECT row_number() OVER () AS k, conv_id, CAST(turn AS BIGINT) AS turn, role,
        string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM conversations),
l AS (SELECT k, conv_id, turn, i, regexp_replace(line, '^\s*>[>\s]*', '') AS words,
        length(regexp_replace(regexp_extract(line, '^\s*>[>\s]*'), '[^>]', '', 'g')) AS level
    FROM (SELECT k, conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM m)),
o AS (SELECT k, conv_id, turn, max(level) AS quote_levels, regexp_replace(coalesce(
        string_agg(words, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS content
    FROM l GROUP BY k, conv_id, turn),
q AS (SELECT k, conv_id, turn, level, string_agg(words, ' ' ORDER BY i) AS content
    FROM l WHERE level > 0 GROUP BY k, conv_id, turn, level),
own AS (SELECT DISTINCT conv_id, turn, trim(s) AS s FROM (
    SELECT conv_id, turn, {_SENTENCES} AS s FROM o) WHERE trim(s) <> ''),
quoted AS (SELECT conv_id, turn, level, trim(s) AS s FROM (
    SELECT conv_id, turn, level, {_SENTENCES} AS s FROM q) WHERE trim(s) <> ''),
found AS (SELECT conv_id, turn, level, source, count(*) AS n FROM (
        SELECT a.conv_id, a.turn, a.level, a.s, a.nth, max(b.turn) AS source
        FROM (SELECT *, row_number() OVER () AS nth FROM quoted) a
        JOIN own b ON b.conv_id = a.conv_id AND b.s = a.s AND b.turn < a.turn GROUP BY ALL)
    GROUP BY conv_id, turn, level, source),
pa AS (SELECT conv_id, turn, arg_max(source, (n, source)) AS parent FROM (
        SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS outermost FROM found)
    WHERE level = outermost GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn, parent, 1 AS depth, parent AS above FROM pa
    UNION ALL SELECT r.conv_id, r.turn, r.parent, r.depth + 1, pa.parent
    FROM r JOIN pa ON pa.conv_id = r.conv_id AND pa.turn = r.above),
z AS (SELECT conv_id, turn, max(parent) AS parent, max(depth) AS depth, arg_max(above, depth) AS root
    FROM r GROUP BY conv_id, turn)
SELECT o.conv_id, o.turn, m.role, o.content, CAST(o.quote_levels AS INTEGER) AS quote_levels,
    z.parent AS parent_turn, coalesce(z.root, o.turn) AS root_turn,
    CAST(coalesce(z.depth, 0) AS INTEGER) AS depth
FROM o JOIN m ON m.k = o.k LEFT JOIN z ON z.conv_id = o.conv_id AND z.turn = o.turn"""

# All pairs of documents that share a shingle, and everything that links reach.
NEAR_DUPLICATES = """WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w
          WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents
    UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

# Every document against every step of every order.
FILTER_AUDIT = r"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text
    FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS filters, list_aggregate(list_transform([a.i, b.i, c.i, e.i, g.i],
        lambda i: chr(64 + i)), 'string_agg', '') AS filter_order
    FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT *, filters[:step - 1] AS earlier, filters[step] AS f FROM (
    SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS fail,
        len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
        len(list_filter(fails, lambda y: y)) = 1 AS single FROM d, s),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept,
        coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant,
        coalesce(sum(n) FILTER (fail AND single), 0) AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g"""

QUERIES: dict[str, tuple] = {
    "op1_language_id": (op1_language_id, None),
    "op2_near_dup": (op2_near_dup, NEAR_DUPLICATES),
    "op3_fingerprint": (op3_fingerprint, None),
    "op4_quality": (op4_quality, None),
    "op5_chat": (op5_chat, CONVERSATIONS),
    "op6_packing": (op6_packing, None),
    "op7_token_blocks": (op7_token_blocks, None),
    "op8_mixing": (op8_mixing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_neighbours": (op10_neighbours, None),
    "op11_runs": (op11_runs, None),
    "op12_filter_audit": (op12_filter_audit, FILTER_AUDIT),
    "op13_byte_bpe": (op13_byte_bpe, None),
}
