"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: per-line rules via windows and
``string_agg`` instead of the single-pass array expression, sparse dot
products instead of dense kernels. Blocks are named CTEs with dependencies;
:func:`oracle_sql` assembles each query's ``WITH`` list in order.
"""

from __future__ import annotations

import re

from ..functions.text import BGE_QUERY_PREFIX

STRIP = r"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
BLOCKED = "('See also','Notes','External links','Overview','Description','Career','Sources')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _sparse(name: str, src: str, keys: list[str], text: str, dim: int = 256) -> str:
    """Hashing encoder in SQL: ``(keys..., bucket, cnt, w)``."""
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, bucket, cnt, (cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY {k})))::FLOAT AS w
  FROM (SELECT {k}, bucket, count(*)::BIGINT AS cnt FROM (
      SELECT {k}, (('0x' || substr(md5(tok), 1, 4))::INTEGER % {dim})::INTEGER AS bucket
      FROM (SELECT {k}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {src})
      WHERE tok <> '') GROUP BY {k}, bucket))"""


CTES: dict[str, tuple[str, list[str]]] = {}


def _cte(name, deps, sql):
    CTES[name] = (sql, deps)


_cte("_dl", [], r"""_dl AS (
  SELECT doc_id, doc_id % 10 AS m, len(ls) // 2 AS mid, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""")
_cte("articles", ["_dl"], r"""articles AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS text FROM (
    SELECT doc_id, pos, CASE
      WHEN pos = mid AND m = 2 THEN '== ' || repeat('Very ', 20) || '=='
      WHEN pos = 0 AND m = 3 THEN 'This may refer to: ' || line
      WHEN pos = mid AND m = 4 THEN '{' || line || '}'
      WHEN pos = mid AND m = 5 THEN '======== Deep ========'
      WHEN pos = mid AND m = 6 THEN '== ' || repeat('Long ', 12) || '=='
      WHEN pos = mid AND m = 7 THEN '= X ='
      WHEN pos = mid AND m = 8 THEN '== References =='
      WHEN pos = mid AND m = 9 THEN '  ' || line || '  '
      WHEN length(line) BETWEEN 1 AND 40 THEN '== ' || regexp_replace(line, '\.+$', '') || ' =='
      ELSE line END AS l
    FROM _dl) GROUP BY doc_id)""")
_cte("_lc", ["articles"], f"""_lc AS (
  SELECT doc_id, pos, t, length(t) AS n,
    (left(t, 1) = '=' AND right(t, 1) = '=') AS is_head,
    regexp_matches(t, '==\\s*[rR]eferences\\s*==') AS is_ref,
    length(t) - length(replace(t, '==', '')) AS dbl,
    length(t) - length(replace(t, '=', '')) AS eq,
    replace(replace(t, '=', ''), ' ', '') AS sq,
    trim(t, ' =') AS h0
  FROM (SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INTEGER AS pos, {_strip('unnest(ls)')} AS t
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM articles)))""")
_cte("_ls", ["_lc"], f"""_ls AS (
  SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
  FROM (SELECT doc_id, pos, t, n, is_ref, is_head,
    (is_head AND n >= 7 AND n < 100 AND dbl <= 12) AS brk,
    (is_head AND n >= 7 AND n < 100 AND dbl > 12 AND eq > 6 AND sq NOT IN {BLOCKED}) AS app,
    CASE WHEN length(h0) > 0 AND right(h0, 1) <> '.' THEN h0 || '.' ELSE h0 END AS norm,
    (n >= 50 AND NOT (is_head AND NOT (n >= 7 AND n < 100)) AND NOT (left(t, 1) = '{{' AND right(t, 1) = '}}')) AS raw_ok,
    coalesce(pos >= min(CASE WHEN is_ref THEN pos END) OVER (PARTITION BY doc_id), false) AS stopped
  FROM _lc))""")
_cte("_pieces", ["_ls"], """_pieces AS (
  SELECT doc_id, sec, pos, 0 AS sub, norm AS p FROM _ls WHERE NOT stopped AND (brk OR app)
  UNION ALL
  SELECT doc_id, sec, pos, 1 AS sub, t AS p FROM _ls WHERE NOT stopped AND raw_ok)""")
_cte("article_sections", ["_pieces", "articles"], """_nsec AS (
  SELECT doc_id, unnest(range(0, nb::BIGINT + 1)) AS sec
  FROM (SELECT doc_id, max(CASE WHEN NOT stopped THEN sec ELSE 0 END) AS nb FROM _ls GROUP BY doc_id)),
_stext AS (
  SELECT s.doc_id, s.sec, coalesce(string_agg(p.p, chr(10) ORDER BY p.pos, p.sub), '') AS text
  FROM _nsec s LEFT JOIN _pieces p ON p.doc_id = s.doc_id AND p.sec = s.sec GROUP BY s.doc_id, s.sec),
article_sections AS (
  SELECT s.doc_id, s.sec::INTEGER AS sec, s.text, substring(a.text, 1, 100) AS first_sentence
  FROM _stext s JOIN articles a ON a.doc_id = s.doc_id)""")
_cte("kept", ["article_sections"], """kept AS (
  SELECT * FROM article_sections
  WHERE length(text) >= 50 AND NOT contains(lower(substring(text, 1, 100)), 'may refer to'))""")
_cte("ids1", ["kept"], """ids1 AS (
  SELECT (row_number() OVER (ORDER BY doc_id, sec) - 1)::BIGINT AS id1, doc_id, sec, text, first_sentence FROM kept)""")
_cte("corpus", ["ids1"], """corpus AS (
  SELECT (row_number() OVER (ORDER BY id1) - 1)::BIGINT AS id, id1, doc_id, sec, text, first_sentence,
         (id1 // 250)::INTEGER AS file
  FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id1) AS rn FROM ids1) WHERE rn = 1)""")
_cte("questions", [], """_bn AS (SELECT count(*) AS n FROM benchmark),
questions AS (
  SELECT b.item_id AS prompt_id, b.text AS prompt,
    substring(o0.text, 1, 30) AS A, substring(o1.text, 1, 30) AS B,
    CASE WHEN b.item_id % 7 = 0 THEN NULL ELSE substring(o2.text, 1, 30) END AS C,
    substring(o3.text, 1, 30) AS D, substring(o4.text, 1, 30) AS E,
    substring('ABCDE', (b.item_id % 5 + 1)::INTEGER, 1) AS answer
  FROM benchmark b CROSS JOIN _bn
  JOIN benchmark o0 ON o0.item_id = (b.item_id + 0) % _bn.n
  JOIN benchmark o1 ON o1.item_id = (b.item_id + 1) % _bn.n
  JOIN benchmark o2 ON o2.item_id = (b.item_id + 2) % _bn.n
  JOIN benchmark o3 ON o3.item_id = (b.item_id + 3) % _bn.n
  JOIN benchmark o4 ON o4.item_id = (b.item_id + 4) % _bn.n)""")
_cte("_qt", ["questions"], """_qt AS (
  SELECT prompt_id, concat_ws(' ', coalesce(prompt, 'nan'), coalesce(C, 'nan'), coalesce(A, 'nan'),
         coalesce(B, 'nan'), coalesce(D, 'nan'), coalesce(E, 'nan')) AS qt FROM questions)""")
_cte("_qv", ["_qt"], _sparse("_qv", "_qt", ["prompt_id"], "qt")
     + ",\n_qn AS (SELECT prompt_id, sum(w::DOUBLE * w::DOUBLE) AS nn FROM _qv GROUP BY prompt_id)")
_cte("_sv", ["corpus"], _sparse("_sv", "corpus", ["id"], "text")
     + ",\n_sn AS (SELECT c.id, coalesce(sum(v.w::DOUBLE * v.w::DOUBLE), 0) AS nn FROM corpus c"
       " LEFT JOIN _sv v ON v.id = c.id GROUP BY c.id)")
_cte("hits", ["_qv", "_sv"], """_dot AS (
  SELECT q.prompt_id, s.id, sum(q.w::DOUBLE * s.w::DOUBLE) AS dot FROM _qv q JOIN _sv s ON s.bucket = q.bucket
  GROUP BY q.prompt_id, s.id),
_d AS (
  SELECT qn.prompt_id, sn.id, round(greatest(qn.nn + sn.nn - 2 * coalesce(dt.dot, 0), 0), 6) + 0.0 AS dist
  FROM _qn qn CROSS JOIN _sn sn LEFT JOIN _dot dt ON dt.prompt_id = qn.prompt_id AND dt.id = sn.id),
hits AS (
  SELECT prompt_id, rank, id, dist FROM (
    SELECT *, (row_number() OVER (PARTITION BY prompt_id ORDER BY dist, id))::INTEGER AS rank FROM _d)
  WHERE rank <= 20)""")
_cte("selected", ["hits"], """selected AS (SELECT h.id, h.prompt_id, c.file FROM hits h JOIN corpus c ON c.id = h.id)""")
_cte("loaded", ["hits"], """loaded AS (
  SELECT DISTINCT c.id, c.text, c.first_sentence, c.file FROM corpus c WHERE c.id IN (SELECT id FROM hits))""")
_cte("lines", ["loaded"], """lines AS (
  SELECT id AS document_id, (generate_subscripts(ls, 1) - 1)::INTEGER AS pos, unnest(ls) AS text
  FROM (SELECT id, string_split(text, chr(10)) AS ls FROM loaded))""")
_cte("ranked", ["lines", "hits"], _sparse("_lv", "lines", ["document_id", "pos"], "text") + """,
_ln AS (SELECT document_id, pos, sum(w::DOUBLE * w::DOUBLE) AS nn FROM _lv GROUP BY document_id, pos),
_cand AS (SELECT h.prompt_id, l.document_id, l.pos, l.text FROM hits h JOIN lines l ON l.document_id = h.id),
_ldot AS (
  SELECT c.prompt_id, c.document_id, c.pos, sum(q.w::DOUBLE * v.w::DOUBLE) AS dot
  FROM _cand c JOIN _lv v ON v.document_id = c.document_id AND v.pos = c.pos
  JOIN _qv q ON q.prompt_id = c.prompt_id AND q.bucket = v.bucket
  GROUP BY c.prompt_id, c.document_id, c.pos),
_cd AS (
  SELECT c.*, round(greatest(qn.nn + coalesce(ln.nn, 0) - 2 * coalesce(d.dot, 0), 0), 6) + 0.0 AS dist
  FROM _cand c JOIN _qn qn ON qn.prompt_id = c.prompt_id
  LEFT JOIN _ln ln ON ln.document_id = c.document_id AND ln.pos = c.pos
  LEFT JOIN _ldot d ON d.prompt_id = c.prompt_id AND d.document_id = c.document_id AND d.pos = c.pos),
ranked AS (
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY prompt_id ORDER BY dist, document_id, pos))::INTEGER AS rank
                 FROM _cd) WHERE rank <= 35)""")
_cte("context_dataset", ["ranked", "questions"], f"""_ctx AS (
  SELECT prompt_id, string_agg({_strip('text')} || '<SS>', '' ORDER BY rank) AS context FROM ranked GROUP BY prompt_id),
context_dataset AS (
  SELECT q.prompt_id, q.prompt, coalesce(c.context, '') AS context, q.A, q.B, q.C, q.D, q.E, q.answer
  FROM questions q LEFT JOIN _ctx c ON c.prompt_id = q.prompt_id)""")
_cte("_mc", ["context_dataset"], """_mc AS (
  SELECT prompt_id, prompt, context, answer, opts, (generate_subscripts(opts, 1) - 1)::INTEGER AS choice,
         unnest(opts) AS option
  FROM (SELECT prompt_id, prompt, context, answer,
               [coalesce(A, 'None'), coalesce(B, 'None'), coalesce(C, 'None'), coalesce(D, 'None'),
                coalesce(E, 'None')] AS opts FROM context_dataset))""")
_cte("_mca", ["_mc"], """_mca AS (
  SELECT prompt_id, choice,
    '[CLS] ' || array_to_string(list_concat(opts[1:choice], opts[choice + 2:5]), '(o) ') || ' ### ' || context AS first,
    ' ### ' || prompt || ' [SEP] ' || option || ' [SEP]' AS second,
    (instr('ABCDE', answer) - 1)::INTEGER AS label FROM _mc)""")
_cte("_pred", [], """_pred AS (
  SELECT id, label, x, i, max(x) OVER (PARTITION BY id) AS mx,
         max(CASE WHEN i = label THEN x END) OVER (PARTITION BY id) AS s
  FROM (SELECT vec_id AS id, (label % 5)::INTEGER AS label,
               unnest(list_transform(embedding[1:5], lambda v: CASE WHEN isnan(v::DOUBLE) THEN '-inf'::DOUBLE ELSE v::DOUBLE END)) AS x,
               generate_subscripts(embedding[1:5], 1) - 1 AS i
        FROM embeddings)),
_score AS (
  SELECT id, label, 1 + sum(CASE WHEN x > s OR (x = s AND i < label) THEN 1 ELSE 0 END) AS rnk,
         min(CASE WHEN x = mx THEN i END) AS am
  FROM _pred GROUP BY id, label)""")

# Retrieval with two encoders: the blocks above under new names, with the first
# model's question prefix for the search and the second one's for the lines.
_NORM = ",\n{n} AS (SELECT prompt_id, sum(w::DOUBLE * w::DOUBLE) AS nn FROM {v} GROUP BY prompt_id)"
_cte("_qv_b", ["_qt"], _sparse("_qv_b", "_qt", ["prompt_id"], f"'{BGE_QUERY_PREFIX}' || qt") + _NORM.format(n="_qn_b", v="_qv_b"))
_cte("_qv_e", ["_qt"], _sparse("_qv_e", "_qt", ["prompt_id"], "'query: ' || qt", 128) + _NORM.format(n="_qn_e", v="_qv_e"))


def _renamed(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], sql)


_OWN = {n: n + "_2" for n in ("hits", "loaded", "lines", "ranked", "_dot", "_d", "_lv", "_ln", "_cand", "_ldot", "_cd", "_ctx", "context_dataset")}
_SEARCH, _LINES = _OWN | {"_qv": "_qv_b", "_qn": "_qn_b"}, _OWN | {"_qv": "_qv_e", "_qn": "_qn_e"}
_cte("hits_2", ["_qv_b", "_sv"], _renamed(CTES["hits"][0], _SEARCH))
_cte("loaded_2", ["hits_2"], _renamed(CTES["loaded"][0], _OWN))
_cte("lines_2", ["loaded_2"], _renamed(CTES["lines"][0], _OWN))
_cte("ranked_2", ["lines_2", "hits_2", "_qv_e"], _renamed(CTES["ranked"][0].replace(
    "lower(text)", "lower('passage: ' || text)").replace("% 256", "% 128"), _LINES))
_cte("context_dataset_2", ["ranked_2", "questions"], _renamed(CTES["context_dataset"][0], _OWN))

_SHARDS = """_vn AS (SELECT count(*) AS n, count(*) // 16 AS q, count(*) - (count(*) // 16) * 16 AS r FROM embeddings),
_vs AS (
  SELECT e.vec_id AS id, (CASE WHEN e.vec_id < r * (q + 1) THEN e.vec_id // (q + 1)
                          ELSE r + (e.vec_id - r * (q + 1)) // greatest(q, 1) END)::INTEGER AS shard, q, r
  FROM embeddings e CROSS JOIN _vn),
_vsl AS (
  SELECT id, shard, (id - CASE WHEN shard < r THEN shard * (q + 1) ELSE r * (q + 1) + (shard - r) * q END)::BIGINT AS local_id
  FROM _vs)"""

_KNN = """WITH q AS (SELECT vec_id AS prompt_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q.prompt_id, e.vec_id AS id,
        round(list_reduce(list_transform(list_zip(q.qv, e.embedding),
              lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)), lambda a, b: a + b), 6) + 0.0 AS dist
      FROM q CROSS JOIN embeddings e),
r AS (SELECT *, (row_number() OVER (PARTITION BY prompt_id ORDER BY dist, id))::INTEGER AS rank FROM d)
SELECT prompt_id, rank, id, dist FROM r WHERE rank <= 20"""

FINAL: dict[str, tuple[list[str], str]] = {
    "extract_api": ([], """WITH b AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '{"k": 1}' WHEN doc_id % 13 = 0 THEN 'not json'
    ELSE json_object('query', json_object('pages', json_object(doc_id::VARCHAR, json_object('extract', text))))::VARCHAR END AS body
  FROM documents)
SELECT doc_id, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body,
    '$.query.pages."' || json_keys(json_extract(body, '$.query.pages'))[1] || '".extract'), '') ELSE '' END AS text FROM b"""),
    "section_lines": (["_ls"], """SELECT doc_id, pos, t AS line,
  CASE WHEN n = 0 THEN 'empty' WHEN is_ref THEN 'references' WHEN brk THEN 'heading_break'
       WHEN app THEN 'heading_append' WHEN is_head AND NOT (n >= 7 AND n < 100) THEN 'heading_dropped'
       WHEN is_head THEN 'heading_ignored' WHEN n < 50 THEN 'short'
       WHEN left(t, 1) = '{' AND right(t, 1) = '}' THEN 'latex' ELSE 'text' END AS kind,
  CASE WHEN stopped THEN '' ELSE coalesce(concat_ws(chr(10), CASE WHEN brk OR app THEN norm END,
       CASE WHEN raw_ok THEN t END), '') END AS content,
  stopped FROM _ls"""),
    "article_sections": (["article_sections"], "SELECT doc_id, sec, text, first_sentence FROM article_sections"),
    "first_sentence": (["articles"], "SELECT doc_id, substring(text, 1, 100) AS first_sentence FROM articles"),
    "sections_filtered": (["kept"], "SELECT doc_id, sec, text, first_sentence FROM kept"),
    "sections_ids": (["ids1"], "SELECT id1 AS id, doc_id, sec, text, first_sentence, (id1 // 250)::INTEGER AS file FROM ids1"),
    "dedup_exact": (["corpus"], "SELECT id1, doc_id, sec, text FROM corpus"),
    "dedup_stats": (["corpus"], """SELECT file, grouping(file) = 1 AS is_total, count(*)::BIGINT AS original,
  sum(dup)::BIGINT AS duplicated, (count(*) - sum(dup))::BIGINT AS final
FROM (SELECT (i.id1 // 250)::INTEGER AS file, CASE WHEN c.id IS NULL THEN 1 ELSE 0 END AS dup
      FROM ids1 i LEFT JOIN corpus c ON c.id1 = i.id1) GROUP BY ROLLUP (file)"""),
    "dedup_incremental": (["corpus"], "SELECT id, id1, file, text, first_sentence FROM corpus"),
    "reindex_ids": (["corpus"], "SELECT id, id1, file, text, first_sentence FROM corpus"),
    "sections_sharded": (["corpus"], "SELECT id, text, first_sentence, file FROM corpus"),
    "metadata_build": (["corpus"], "SELECT id, file FROM corpus"),
    "corpus_stats": (["corpus"], """SELECT (SELECT count(*) FROM corpus)::BIGINT AS n_sections,
  (SELECT count(*) FROM embeddings)::BIGINT AS n_vectors, (SELECT max(len(embedding)) FROM embeddings)::INTEGER AS dim"""),
    "dev_slice": (["corpus"], """SELECT id, file, text FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS rn FROM corpus) WHERE rn <= 100"""),
    "encode_hash": (["_sv"], "SELECT id, bucket, cnt, w AS weight FROM _sv"),
    "encode_norm": ([], """SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
  (unnest(embedding)::DOUBLE / sqrt(list_reduce(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE),
    lambda a, b: a + b)))::FLOAT AS x FROM embeddings"""),
    "query_text": (["questions"], """SELECT prompt_id, 'query: ' || concat_ws(' ', coalesce(prompt, 'nan'), coalesce(C, 'nan'),
  coalesce(A, 'nan'), coalesce(B, 'nan'), coalesce(D, 'nan'), coalesce(E, 'nan')) AS query_text FROM questions"""),
    "passage_text": (["corpus"], """SELECT id, first_sentence || ' ' || (CASE WHEN sec > 0 THEN split_part(text, chr(10), 1)
  ELSE '' END) || ' ' || 'passage: ' || text AS passage FROM corpus"""),
    "knn_flat": ([], _KNN),
    "knn_sharded": ([], _KNN),
    "knn_pruned": ([], _KNN),
    "knn_bytes": ([], _KNN),
    "articles_by_id": (["loaded"], "SELECT id, text, first_sentence, file FROM loaded"),
    "knn_recall": ([], """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0)::BIGINT AS queries,
  ((SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * least(20, (SELECT count(*) FROM embeddings)))::BIGINT AS wanted,
  true AS enough"""),
    "vector_shards": ([], "WITH " + _SHARDS + "\nSELECT id, shard, local_id FROM _vsl"),
    "vectors_scan": ([], """SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
  unnest(embedding) AS x FROM embeddings"""),
    "shard_offsets": ([], "WITH " + _SHARDS + """,
_sz AS (SELECT shard, count(*)::BIGINT AS n FROM _vs GROUP BY shard)
SELECT shard, n, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM _sz"""),
    "select_articles": (["selected"], "SELECT id, prompt_id, file FROM selected"),
    "hit_files": (["selected"], "SELECT DISTINCT file FROM selected"),
    "load_articles": (["loaded"], "SELECT id, text, first_sentence, file FROM loaded"),
    "split_lines": (["lines"], "SELECT document_id, pos, text FROM lines"),
    "sectionize": (["loaded"], 'SELECT id AS document_id, text, 0::INTEGER AS start, length(text)::INTEGER AS "end" FROM loaded'),
    "rerank_lines": (["ranked"], "SELECT prompt_id, rank, document_id, pos, dist FROM ranked"),
    "context_dataset": (["context_dataset"], "SELECT prompt_id, prompt, context, A, B, C, D, E, answer FROM context_dataset"),
    "context_csv": (["context_dataset"], """SELECT (row_number() OVER (ORDER BY prompt_id) - 1)::BIGINT AS prompt_id,
  prompt, context, A, B, C, D, E, answer FROM context_dataset"""),
    "pred_csv": (["_pred"], """SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS prompt_id,
  substring('ABCDE', (am + 1)::INTEGER, 1) AS pred, substring('ABCDE', (label + 1)::INTEGER, 1) AS label FROM _score"""),
    "dev_prompt": (["questions"], """SELECT prompt_id, prompt, answer FROM questions
WHERE prompt = (SELECT min(prompt) FROM questions) ORDER BY prompt_id LIMIT 1"""),
    "questions_load": (["questions"], "SELECT prompt_id, prompt, A, B, C, D, E, answer FROM questions"),
    "fill_options": (["questions"], """SELECT prompt_id, coalesce(A, 'None') AS A, coalesce(B, 'None') AS B,
  coalesce(C, 'None') AS C, coalesce(D, 'None') AS D, coalesce(E, 'None') AS E FROM questions"""),
    "drop_rows": (["questions"], """SELECT prompt_id, prompt FROM questions
WHERE prompt_id NOT IN (0, 7, 13, 100000)"""),
    "shuffle_rows": (["questions"], """SELECT prompt_id, md5(prompt_id::VARCHAR || ':0') AS shuffle_key,
  row_number() OVER (ORDER BY md5(prompt_id::VARCHAR || ':0'), prompt_id) - 1 AS position FROM questions"""),
    "union_train": (["questions"], """SELECT prompt_id, prompt, answer, 'train' AS source, prompt_id AS row_id FROM questions
UNION ALL SELECT prompt_id, prompt, answer, 'valid' AS source,
  prompt_id + (SELECT max(prompt_id) + 1 FROM questions) AS row_id FROM questions"""),
    "prepare_split": (["questions"], """SELECT row_id, prompt_id, position, prompt, coalesce(A, 'None') AS A, coalesce(B, 'None') AS B,
  coalesce(C, 'None') AS C, coalesce(D, 'None') AS D, coalesce(E, 'None') AS E, answer FROM (
  SELECT *, row_number() OVER (ORDER BY md5(row_id::VARCHAR || ':0')) - 1 AS position FROM (
    SELECT *, prompt_id AS row_id FROM questions WHERE prompt_id NOT IN (0, 7, 13)
    UNION ALL SELECT *, prompt_id + (SELECT max(prompt_id) + 1 FROM questions WHERE prompt_id NOT IN (0, 7, 13)) FROM questions))
WHERE position < 100"""),
    "questions_unlabeled": (["questions"], "SELECT prompt_id, prompt, A, B, C, D, E, 'A' AS answer FROM questions"),
    "sections_scan": (["corpus"], "SELECT id, text, first_sentence, file FROM corpus"),
    "articles_sorted": (["selected"], """SELECT id, prompt_id, file,
  row_number() OVER (ORDER BY file, id, prompt_id) - 1 AS position FROM selected"""),
    "sectionize_sorted": (["loaded"], """SELECT id AS document_id, 0::INTEGER AS start, length(text)::INTEGER AS "end",
  row_number() OVER (ORDER BY id) - 1 AS position FROM loaded"""),
    "query_text_bge": (["questions"], f"""SELECT prompt_id, '{BGE_QUERY_PREFIX}' || concat_ws(' ', coalesce(prompt, 'nan'),
  coalesce(C, 'nan'), coalesce(A, 'nan'), coalesce(B, 'nan'), coalesce(D, 'nan'), coalesce(E, 'nan')) AS query_text FROM questions"""),
    "mc_pairs_shuffled": (["_mc"], """SELECT m.prompt_id, m.choice,
  '[CLS] ' || o.others || ' ### ' || context AS first,
  ' ### ' || prompt || ' [SEP] ' || option || ' [SEP]' AS second, (instr('ABCDE', answer) - 1)::INTEGER AS label
FROM _mc m JOIN (SELECT prompt_id, choice, string_agg(o, '(o) ' ORDER BY md5('0:' || prompt_id::VARCHAR || ':' || choice::VARCHAR || ':' || i::VARCHAR)) AS others
  FROM (SELECT prompt_id, choice, unnest(list_concat(opts[1:choice], opts[choice + 2:5])) AS o, unnest(range(4)) AS i FROM _mc) GROUP BY ALL) o
  ON o.prompt_id = m.prompt_id AND o.choice = m.choice"""),
    "knn_nan": ([], _KNN.replace("WITH q", """WITH bad AS (SELECT vec_id, list_transform(embedding, lambda x, i:
  CASE WHEN vec_id % 7 = 0 AND i = 4 THEN 'nan'::FLOAT ELSE x END) AS embedding FROM embeddings), q""").replace(
        "FROM embeddings WHERE", "FROM bad WHERE").replace("CROSS JOIN embeddings", "CROSS JOIN bad").replace(
        "SELECT prompt_id, rank, id, dist", "SELECT prompt_id, rank, id, CASE WHEN NOT isnan(dist) THEN dist END AS dist")),
    "sink_modes": (["_pred"], """SELECT id, substring('ABCDE', (am + 1)::INTEGER, 1) AS pred,
  substring('ABCDE', (label + 1)::INTEGER, 1) AS label FROM _score"""),
    "sink_outcomes": ([], """SELECT mode, outcome, (SELECT count(*) FROM embeddings)::BIGINT AS n
FROM (VALUES ('overwrite', 'replaced'), ('ignore', 'kept'), ('errorifexists', 'refused')) AS t(mode, outcome)"""),
    "output_named": (["context_dataset"], """SELECT (row_number() OVER (ORDER BY prompt_id) - 1)::BIGINT AS prompt_id, prompt, context,
  'sections_v1.index_sharded__benchmark_e5-base-v2_20_v1.csv' AS output FROM context_dataset"""),
    "dev_slice_500": (["corpus"], """SELECT id, file, text FROM (
  SELECT id, (id1 // 1000)::INTEGER AS file, text, row_number() OVER (PARTITION BY id1 // 1000 ORDER BY id) AS rn FROM corpus) WHERE rn <= 500"""),
    "encode_batches": (["_sv"], "SELECT id, bucket, cnt, w AS weight FROM _sv WHERE id < 768"),
    "context_two_encoders": (["context_dataset_2"], "SELECT prompt_id, prompt, context, A, B, C, D, E, answer FROM context_dataset_2"),
    "mc_pairs": (["_mc"], """SELECT prompt_id, choice, '[CLS] ' || context AS first,
  ' #### ' || prompt || ' [SEP] ' || option || ' [SEP]' AS second, (instr('ABCDE', answer) - 1)::INTEGER AS label FROM _mc"""),
    "mc_pairs_answers": (["_mca"], "SELECT prompt_id, choice, first, second, label FROM _mca"),
    "truncate_pairs": (["_mca"], """SELECT prompt_id, choice,
  CASE WHEN len(string_split(first, ' ')) <= greatest(64 - len(string_split(second, ' ')), 0) THEN first
       ELSE array_to_string(string_split(first, ' ')[1:greatest(64 - len(string_split(second, ' ')), 0)], ' ') END AS first,
  second, label, len(string_split(second, ' ')) > 64 AS over_budget FROM _mca"""),
    "token_lengths": ([], """SELECT lang, count(*)::BIGINT AS n, min(ntok)::INTEGER AS min_tokens, round(avg(ntok), 6) AS avg_tokens,
  max(ntok)::INTEGER AS max_tokens, round(sum(nchar) / greatest(sum(ntok), 1), 6) AS chars_per_token
FROM (SELECT lang, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS ntok,
             length(text) AS nchar FROM documents) GROUP BY lang"""),
    "eval_map3": (["_pred"], """SELECT count(*)::BIGINT AS n,
  round(avg(CASE WHEN rnk <= 3 THEN 1.0 / rnk ELSE 0.0 END), 9) AS map_at_3,
  round(avg(CASE WHEN am = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM _score"""),
    "pred_letters": (["_pred"], """SELECT id, substring('ABCDE', (am + 1)::INTEGER, 1) AS pred,
  substring('ABCDE', (label + 1)::INTEGER, 1) AS label FROM _score"""),
}
FINAL["prepare_split_head"] = (["questions"], FINAL["prepare_split"][1].replace("position < 100", "position < 50"))
FINAL["raw_scan"] = ([], FINAL["extract_api"][1].replace(
    "SELECT doc_id, CASE WHEN json_valid", "SELECT * FROM (SELECT doc_id, CASE WHEN json_valid") + ") WHERE text <> ''")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][1]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def sql_for(name: str) -> str:
    deps, final = FINAL[name]
    if not deps:
        return final
    return "WITH " + ",\n".join(CTES[n][0] for n in _order(deps)) + "\n" + final


def oracle_sql() -> dict[str, str]:
    return {name: sql_for(name) for name in FINAL}
