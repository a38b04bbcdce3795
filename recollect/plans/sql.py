"""The derived views as DuckDB common table expressions."""

PUNCT = r"[!-/:-@\[-`{-~]"

QA = """
qa AS (
  SELECT u.conv_id, u.turn,
         'conv' || u.conv_id || '_q' || u.turn || CASE WHEN (u.conv_id + u.turn) % 5 = 4 THEN '_abs' ELSE '' END AS question_id,
         u.text AS question, a.text AS answer,
         CAST((u.conv_id + u.turn) % 5 + 1 AS INTEGER) AS category,
         CASE (u.conv_id + u.turn) % 6 WHEN 0 THEN 'temporal-reasoning' WHEN 1 THEN 'multi-session'
              WHEN 2 THEN 'knowledge-update' WHEN 3 THEN 'single-session-user'
              WHEN 4 THEN 'single-session-assistant' ELSE 'single-session-preference' END AS question_type
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""

ANSWERS = QA + """,
answers AS (
  SELECT *,
         CASE (conv_id + 2 * turn) % 4 WHEN 0 THEN answer WHEN 1 THEN question
              WHEN 2 THEN 'The  ' || replace(answer, '.', '!!') ELSE 'I don''t know.' END AS generated_answer,
         CASE WHEN conv_id % 7 = 0 THEN 'Unknown' ELSE answer END AS ground_truth_answer
  FROM qa)
"""

CANDIDATES = """,
cand AS (
  SELECT q.question_id, q.conv_id, q.turn, c.turn AS t, 'c' || q.category AS category_name, q.question_type,
         row_number() OVER (PARTITION BY q.question_id ORDER BY md5(q.question_id || ':' || (c.turn - q.turn))) AS rnk,
         CASE WHEN q.turn % 3 <> 0 THEN 3 ELSE 99 END AS k
  FROM qa q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn - q.turn IN (1, -1, 0, 2, 3)),
gold AS (
  SELECT question_id, conv_id || ':' || (turn + o) AS id FROM qa, (SELECT unnest([0, 1]) AS o) WHERE conv_id % 6 <> 5)
"""


def normalized_tokens(value: str) -> str:
    """Token list of a text; articles are dropped as tokens, not with a word boundary."""
    bare = f"regexp_replace(lower({value}), '{PUNCT}', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def candidate_ids(name: str, source: str, rank: str, mode: str, where: str = "TRUE") -> str:
    """CTE (question_id, id, pos): distinct source ids of a ranked candidate list."""
    listed = "" if mode == "union" else " AND t % 3 = 0"
    return f"""{name} AS (
  SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY min(o)) AS pos FROM (
    SELECT question_id, {rank} * 10 AS o, conv_id || ':' || t AS id FROM {source} WHERE t % 3 <> 0 AND {where}
    UNION ALL SELECT question_id, {rank} * 10 + 1, conv_id || ':' || t FROM {source} WHERE {where}{listed}
    UNION ALL SELECT question_id, {rank} * 10 + 2, conv_id || ':' || (t + 1) FROM {source} WHERE {where}{listed})
  GROUP BY question_id, id)"""


def ranking(name: str, ids: str, questions: str = "qa") -> str:
    """CTE of the four retrieval metrics per question from (question_id, id, pos)."""
    return f"""{name} AS (
  SELECT question_id,
         CASE WHEN n_gold = 0 THEN 0.0 ELSE hits / n_gold END AS recall_at_k,
         CASE WHEN n_ids = 0 THEN 0.0 ELSE hits / n_ids END AS precision_at_k,
         CASE WHEN hits = 0 THEN 0.0 ELSE 1.0 / first_hit END AS mrr,
         CASE WHEN least(n_gold, n_ids) = 0 THEN 0.0 ELSE dcg / CASE least(n_gold, n_ids) WHEN 1 THEN 1.0 ELSE 1.0 + 1.0 / log2(3) END END AS ndcg_at_k
  FROM (SELECT q.question_id, coalesce(g.n_gold, 0) AS n_gold, coalesce(i.n_ids, 0) AS n_ids,
               coalesce(i.hits, 0)::DOUBLE AS hits, i.first_hit, coalesce(i.dcg, 0.0) AS dcg
        FROM {questions} q
        LEFT JOIN (SELECT question_id, count(*) AS n_gold FROM gold GROUP BY 1) g USING (question_id)
        LEFT JOIN (SELECT i.question_id, count(*) AS n_ids, count(gold.id) AS hits,
                          min(pos) FILTER (gold.id IS NOT NULL) AS first_hit,
                          sum(1.0 / log2(pos + 1.0)) FILTER (gold.id IS NOT NULL) AS dcg
                   FROM {ids} i LEFT JOIN gold ON gold.question_id = i.question_id AND gold.id = i.id
                   GROUP BY 1) i USING (question_id)))"""


def answer_metrics(prediction: str = "generated_answer", gold: str = "ground_truth_answer", source: str = "answers") -> str:
    """CTE answer_metrics: exact match, token F1 and ROUGE-L, the LCS by dynamic programming."""
    return f"""
tok AS (SELECT question_id, {normalized_tokens(prediction)} AS p, {normalized_tokens(gold)} AS g FROM {source}),
ptok AS (SELECT question_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM tok),
gtok AS (SELECT question_id, unnest(g) AS w, generate_subscripts(g, 1) AS j FROM tok),
lcs(question_id, i, j, v) AS (
  SELECT question_id, 0::BIGINT, j::BIGINT, 0::BIGINT FROM gtok
  UNION ALL
  SELECT question_id, i + 1, j, max(c) OVER (PARTITION BY question_id ORDER BY j) FROM (
    SELECT l.question_id, l.i, l.j,
           greatest(l.v, CASE WHEN p.w = g.w THEN 1 + coalesce(lag(l.v) OVER (PARTITION BY l.question_id ORDER BY l.j), 0) ELSE 0 END) AS c
    FROM lcs l JOIN ptok p ON p.question_id = l.question_id AND p.i = l.i + 1
               JOIN gtok g ON g.question_id = l.question_id AND g.j = l.j)),
overlap AS (
  SELECT question_id, sum(least(np, ng)) AS h FROM
    (SELECT question_id, w, count(*) AS np FROM ptok GROUP BY ALL) JOIN
    (SELECT question_id, w, count(*) AS ng FROM gtok GROUP BY ALL) USING (question_id, w) GROUP BY 1),
counts AS (
  SELECT t.question_id, len(p) AS np, len(g) AS ng, array_to_string(p, ' ') = array_to_string(g, ' ') AS same,
         coalesce(h, 0)::DOUBLE AS h, coalesce(l, 0)::DOUBLE AS l
  FROM tok t LEFT JOIN overlap USING (question_id)
  LEFT JOIN (SELECT question_id, max(v) AS l FROM lcs GROUP BY 1) USING (question_id)),
answer_metrics AS (
  SELECT question_id, same::INTEGER::DOUBLE AS exact_match,
         CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 2 * h / (np + ng) END AS token_f1,
         CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN l = 0 THEN 0.0 ELSE 2 * l / (np + ng) END AS rouge_l
  FROM counts)"""


ABSTAIN = """('i don''t know','i do not know','idk','not mentioned','unknown','not specified','n/a','none',
 'no information','cannot be determined','can''t be determined','not enough information')"""


def abstention(value: str) -> str:
    tail = rf"trim(regexp_replace(lower(trim({value})), '{PUNCT}+$', ''))"
    return f"CASE WHEN {tail} IN {ABSTAIN} THEN '__ABSTAIN__' ELSE {value} END"


def means(metrics: tuple[str, ...], source: str, group: str, keys: str = "") -> str:
    """Means overall and by group in the layout of the reports."""
    cols = ", ".join(f"round(avg({m}), 9) AS {m}" for m in metrics)
    k = f"{keys}, " if keys else ""
    sets = f"GROUPING SETS (({keys}), ({k}{group}))"
    return f"""SELECT {k}CASE WHEN grouping({group}) = 1 THEN 'overall' ELSE 'group' END AS scope,
       {group} AS "group", count(*) AS n, {cols} FROM {source} GROUP BY {sets}"""


# The number of a stretch of 64 turns; 2^31 of them fit into a conversation.
DOCUMENT_KEY = "(conv_id * 2147483648 + turn // 64)"

RUNS = """
runs AS (
  SELECT printf('run-%08d', o_orderkey) AS run_id, o_orderpriority AS benchmark, o_orderstatus AS framework,
         o_orderdate AS modified_at, coalesce(expected, 0) AS expected, coalesce(committed, 0) AS committed,
         o_orderkey, o_custkey, o_totalprice
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS expected, count(*) FILTER (l_linestatus = 'F') AS committed
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""

VECTORS = """
vectors AS (SELECT CAST(vec_id // 100 AS VARCHAR) AS unit_id, printf('v%08d', vec_id) AS vec_key,
                   embedding::DOUBLE[] AS e, label FROM embeddings)
"""

STEPS = "steps AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts, event_type, value, props FROM events)"
