"""DuckDB SQL building blocks for the oracle queries.

They restate each operator's definition independently in SQL over the
pre-registered test tables; ``oracle_sql()`` composes them."""

from gramloom import constants as K
from gramloom.functions.text import NEWLINE_PATTERN, SYMBOL_PATTERN, WS_CLASS
from gramloom.plans.prompts import PROMPT_TURNS

WS = WS_CLASS
NL = NEWLINE_PATTERN.replace("\r", r"\r").replace("\n", r"\n")
SYM = SYMBOL_PATTERN


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalize(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '[{K.NORMALIZE_DELETE}]', '', 'g')")


def strip_symbols(x: str) -> str:
    return f"regexp_replace({x}, '{SYM}', '', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN []::VARCHAR[] ELSE regexp_split_to_array({x}, '{WS}+') END)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cacheable(piece: str, token_id: str | None = None) -> str:
    core = strip_symbols(strip(f"replace({piece}, '{K.SPACE_MARK}', '')"))
    cond = f"({piece} IS NOT NULL AND length({piece}) > 0 AND length({core}) > 0)"
    if token_id is not None:
        cond = f"({cond} AND {token_id} NOT IN ({K.BOS_ID}, {K.EOS_ID}))"
    return cond


RAW_LINES = f"""
raw_docs AS (SELECT doc_id, regexp_split_to_array(text, '{NL}') AS parts FROM documents),
raw_idx AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM raw_docs),
raw_lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM raw_idx)"""

CLEAN_LINES = RAW_LINES + f""",
clean_lines AS (SELECT doc_id, line_no, {strip('line')} AS line FROM raw_lines WHERE length({strip('line')}) > 0),
norm_lines AS (SELECT doc_id, line_no, {normalize('line')} AS line FROM raw_lines WHERE length({normalize('line')}) > 0)"""

# CTE ``vocab`` over all words.
VOCAB = CLEAN_LINES + f""",
vtok AS (SELECT unnest({words('line')}) AS piece FROM clean_lines),
vcounts AS (SELECT piece, count(*) AS cnt FROM vtok
            WHERE piece NOT IN ('{K.UNK_PIECE}', '{K.CONTROL_PIECES[0]}', '{K.CONTROL_PIECES[1]}') GROUP BY piece),
learned AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, piece ASC) + 2 AS INTEGER) AS id, piece,
                   ln(cnt::DOUBLE / sum(cnt) OVER ()) AS score, CAST(cnt AS BIGINT) AS cnt FROM vcounts),
vocab0 AS (SELECT 0 AS id, '{K.UNK_PIECE}' AS piece, 0.0::DOUBLE AS score, 0::BIGINT AS cnt
           UNION ALL SELECT 1, '{K.CONTROL_PIECES[0]}', 0.0, 0
           UNION ALL SELECT 2, '{K.CONTROL_PIECES[1]}', 0.0, 0
           UNION ALL SELECT id, piece, score, cnt FROM learned),
vocab AS (SELECT CAST(id AS INTEGER) AS id, piece, score, cnt, {cacheable('piece', 'id')} AS cacheable FROM vocab0)"""


def ngram_ids(n: int, n_bos: int, eos: bool, src: str, extra: str = "", bos_id: int = K.BOS_ID) -> str:
    """CTE ``g`` with ``w1..wn`` ids (plus ``extra`` columns of ``src``), one
    row per n-gram occurrence, via list positions and joins to ``vocab``."""
    body = f"[{{'s': NULL::INTEGER, 't': x}} for x in {words('line')}]"
    bos = f"[{{'s': {bos_id}::INTEGER, 't': NULL::VARCHAR}} for x in range({n_bos})]"
    parts = f"list_concat({bos}, {body}"
    if eos:
        parts += f", [{{'s': {K.EOS_ID}::INTEGER, 't': NULL::VARCHAR}}]"
    parts += ")"
    ex = f"{extra}, " if extra else ""
    sel = ", ".join(f"p[i + {j}].s AS s{j}, p[i + {j}].t AS t{j}" for j in range(n))
    joins = " ".join(f"LEFT JOIN vlearn v{j} ON g0.t{j} = v{j}.piece" for j in range(n))
    cols = ", ".join(f"coalesce(s{j}, v{j}.id, 0) AS w{j + 1}" for j in range(n))
    return f"""
vlearn AS (SELECT piece, id FROM vocab WHERE id >= 3),
padded AS (SELECT {ex}{parts} AS p FROM {src}),
pidx AS (SELECT {ex}p, unnest(generate_series(1, len(p) - {n - 1})) AS i FROM padded WHERE len(p) >= {n}),
g0 AS (SELECT {ex}{sel} FROM pidx),
g AS (SELECT {ex}{cols} FROM g0 {joins})"""


def prompts_sql(vocab_ready: bool = True) -> str:
    """Accepted user-turn requests, encoded: ``pctx(prompt_id, ids)`` with
    ids = [-1, -1] ++ word ids, and ``pw`` adding w1, w2 and the last id;
    ``ctxpos(prompt_id, pos, id, cacheable)`` lists the context by position
    (1-based, the two start markers first)."""
    return f"""
req AS (SELECT (conv_id::BIGINT * {PROMPT_TURNS} + turn)::BIGINT AS prompt_id, text AS prompt FROM conversations WHERE role = 'user'),
acc AS (SELECT * FROM req WHERE prompt IS NOT NULL AND length({strip('prompt')}) > 0),
ptok0 AS (SELECT prompt_id, {words(strip('prompt'))} AS ws FROM acc),
ptok AS (SELECT prompt_id, unnest(ws) AS piece, generate_subscripts(ws, 1) AS pos FROM ptok0),
penc AS (SELECT prompt_id, pos, coalesce(v.id, 0) AS id FROM ptok LEFT JOIN (SELECT piece, id FROM vocab WHERE id >= 3) v USING (piece)),
pctx AS (SELECT prompt_id, list_concat([{K.BOS_ID}, {K.BOS_ID}], list(id ORDER BY pos)) AS ids FROM penc GROUP BY prompt_id),
pw AS (SELECT prompt_id, ids, ids[len(ids) - 1] AS w1, ids[len(ids)] AS w2, len(ids) AS n FROM pctx),
ctxpos AS (SELECT prompt_id, 1 AS pos, {K.BOS_ID} AS id, false AS cacheable FROM pw
           UNION ALL SELECT prompt_id, 2, {K.BOS_ID}, false FROM pw
           UNION ALL SELECT e.prompt_id, e.pos + 2, e.id, v.cacheable FROM penc e JOIN vocab v ON v.id = e.id)"""


def cache_scores_sql(window: int) -> str:
    """``cs(prompt_id, token_id, score)``: F1 + F2 over ``ctxpos``."""
    return f"""
recent AS (SELECT c.prompt_id, c.pos, c.id FROM ctxpos c JOIN pw USING (prompt_id)
           WHERE c.cacheable AND c.pos > pw.n - {window}),
recent_r AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY pos)::DOUBLE
                    / count(*) OVER (PARTITION BY prompt_id) AS share FROM recent),
rec AS (SELECT prompt_id, id, sum(share) AS r FROM recent_r GROUP BY 1, 2),
freq AS (SELECT prompt_id, id, count(*) AS f FROM ctxpos WHERE cacheable GROUP BY 1, 2),
cs AS (SELECT f.prompt_id, f.id AS token_id, coalesce(rec.r, 0.0) + sqrt(f.f::DOUBLE) AS score
       FROM freq f LEFT JOIN rec USING (prompt_id, id))"""


BIGRAM_IDS = f"""
bpad AS (SELECT list_concat(['{K.BOS_PIECE}'], {words('line')}, ['{K.EOS_PIECE}']) AS p FROM clean_lines),
bidx AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM bpad),
bstr AS (SELECT p[i] AS s1, p[i + 1] AS s2, count(*) AS cnt FROM bidx GROUP BY 1, 2),
bigram_ids AS (
  SELECT CASE WHEN s1 = '{K.BOS_PIECE}' THEN {K.BOS_ID} WHEN s1 = '{K.EOS_PIECE}' THEN {K.EOS_ID} ELSE coalesce(v1.id, 0) END AS w1,
         CASE WHEN s2 = '{K.BOS_PIECE}' THEN {K.BOS_ID} WHEN s2 = '{K.EOS_PIECE}' THEN {K.EOS_ID} ELSE coalesce(v2.id, 0) END AS w2,
         sum(cnt)::BIGINT AS cnt
  FROM bstr LEFT JOIN (SELECT piece, id FROM vocab WHERE id >= 3) v1 ON bstr.s1 = v1.piece
            LEFT JOIN (SELECT piece, id FROM vocab WHERE id >= 3) v2 ON bstr.s2 = v2.piece
  GROUP BY 1, 2)"""

TRIGRAM = ngram_ids(3, 2, True, 'norm_lines') + """,
trigram AS (SELECT w1, w2, w3, count(*)::BIGINT AS cnt FROM g GROUP BY 1, 2, 3)"""

BACKOFF = """
tri_hit AS (SELECT pw.prompt_id, 'trigram' AS source, t.w3, t.cnt FROM pw JOIN trigram t ON t.w1 = pw.w1 AND t.w2 = pw.w2),
bi_hit AS (SELECT pw.prompt_id, 'bigram' AS source, b.w2 AS w3, b.cnt FROM pw JOIN bigram_ids b ON b.w1 = pw.w2
           WHERE NOT EXISTS (SELECT 1 FROM trigram t WHERE t.w1 = pw.w1 AND t.w2 = pw.w2)),
fol AS (SELECT * FROM tri_hit UNION ALL SELECT * FROM bi_hit)"""


def ranked_sql(k: int, alpha: float, temperature: float, gen_len: int, min_len: int) -> str:
    """``ranked(prompt_id, rank, token_id, cnt, probability)``: F3 + F4."""
    return f"""
elig AS (SELECT f.prompt_id, f.w3, f.cnt FROM fol f LEFT JOIN vocab v ON v.id = f.w3
         WHERE f.w3 <> {K.BOS_ID} AND (f.w3 = {K.EOS_ID} OR coalesce(v.cacheable, false))),
topk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY cnt DESC, w3 ASC) AS pos FROM elig),
sc AS (SELECT t.prompt_id, t.w3, t.cnt, t.pos,
              ln(greatest(t.cnt::DOUBLE * (CASE WHEN t.w3 = {K.EOS_ID} THEN
                    (CASE WHEN {gen_len} < {min_len} THEN {K.EOS_EARLY_FACTOR} ELSE {K.EOS_LATE_FACTOR} END) ELSE 1.0 END)
                    * (1.0 + {alpha} * coalesce(cs.score, 0.0)), {K.MIN_WEIGHT})) / greatest({temperature}, {K.MIN_TEMPERATURE}) AS lw
       FROM topk t LEFT JOIN cs ON cs.prompt_id = t.prompt_id AND cs.token_id = t.w3 WHERE t.pos <= {k}),
sc2 AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY prompt_id)) AS e FROM sc),
ranked AS (SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY lw DESC, pos ASC) AS INTEGER) AS rank,
                  w3 AS token_id, cnt, e / sum(e) OVER (PARTITION BY prompt_id) AS probability FROM sc2)"""


PROMPT_BASE = f"""
ptoks AS (SELECT e.prompt_id, list({{'id': e.id, 'c': v.cacheable}} ORDER BY e.pos) AS toks,
                 list(CASE WHEN e.id = 0 THEN '{K.UNK_SURFACE}' ELSE v.piece END ORDER BY e.pos) AS pieces
          FROM penc e JOIN vocab v ON v.id = e.id GROUP BY e.prompt_id),
gbase AS (SELECT prompt_id, list_concat([{{'id': {K.BOS_ID}, 'c': false}}, {{'id': {K.BOS_ID}, 'c': false}}], toks) AS ctx,
                 pieces FROM ptoks)"""


def greedy_sql(max_tokens: int, top_k: int, alpha: float, temperature: float, window: int, min_len: int,
               model: str = "trigram", seed: int | None = None) -> str:
    """Generation (G1) as a recursive CTE over ``pw``/``penc``/``vocab`` and
    ``trigram`` (context = last two ids) or ``bigram_ids`` (context = last
    id): greedy (F6), or with ``seed`` the draw F5 with noise from md5;
    ``gen_out`` holds one finished row per prompt."""
    noise = "0.0" if seed is None else (
        f"(-ln(-ln((('0x' || substr(md5('{seed}-' || s.prompt_id || '-' || s.n || '-' || s.w3), 1, 13))::BIGINT + 0.5) "
        f"/ {2 ** 52}.0)))")
    if model == "bigram":
        src = "(SELECT w1, 0 AS w2, w2 AS w3, cnt FROM bigram_ids)"
        on = "c.w1 = g.ctx[-1].id"
    else:
        src = "trigram"
        on = "c.w1 = g.ctx[-2].id AND c.w2 = g.ctx[-1].id"
    return f"""{PROMPT_BASE},
cands AS (SELECT t.w1, t.w2, t.w3, t.cnt,
                 row_number() OVER (PARTITION BY t.w1, t.w2 ORDER BY t.cnt DESC, t.w3 ASC) AS pos,
                 CASE WHEN t.w3 = {K.EOS_ID} THEN '{K.EOS_PIECE}' WHEN t.w3 = 0 THEN '{K.UNK_SURFACE}' ELSE v.piece END AS piece,
                 coalesce(v.cacheable, false) AS cacheable
          FROM {src} t LEFT JOIN vocab v ON v.id = t.w3
          QUALIFY pos <= {top_k}),
gen(prompt_id, ctx, pieces, n, stop) AS (
  SELECT prompt_id, ctx, pieces, 0, CAST(NULL AS VARCHAR) FROM gbase
  UNION ALL
  SELECT prompt_id,
         CASE WHEN adv THEN list_append(ctx, {{'id': w3, 'c': cacheable}}) ELSE ctx END,
         CASE WHEN adv THEN list_append(pieces, piece) ELSE pieces END,
         n + CASE WHEN adv THEN 1 ELSE 0 END,
         CASE WHEN w3 IS NULL THEN 'miss' WHEN w3 = {K.EOS_ID} THEN 'eos'
              WHEN n + 1 >= {max_tokens} THEN 'max_tokens' END
  FROM (
    SELECT s.*, (s.w3 IS NOT NULL AND s.w3 <> {K.EOS_ID}) AS adv,
           row_number() OVER (PARTITION BY s.prompt_id ORDER BY s.lw + {noise} DESC NULLS LAST, s.pos) AS rk
    FROM (
      SELECT g.prompt_id, g.ctx, g.pieces, g.n, c.w3, c.cnt, c.pos, c.piece, c.cacheable,
             ln(greatest(c.cnt::DOUBLE
                 * (CASE WHEN c.w3 = {K.EOS_ID} THEN (CASE WHEN g.n < {min_len} THEN {K.EOS_EARLY_FACTOR} ELSE {K.EOS_LATE_FACTOR} END) ELSE 1.0 END)
                 * (1.0 + {alpha} * (
                     coalesce(list_sum(list_transform([x.id FOR x IN g.ctx[-{window}:] IF x.c],
                         lambda x, i: CASE WHEN x = c.w3 THEN i / len([y.id FOR y IN g.ctx[-{window}:] IF y.c]) ELSE 0.0 END)), 0.0)
                     + CASE WHEN len(list_filter(g.ctx, lambda x: x.c AND x.id = c.w3)) > 0
                            THEN sqrt(len(list_filter(g.ctx, lambda x: x.c AND x.id = c.w3))) ELSE 0.0 END)),
                 {K.MIN_WEIGHT})) / {temperature} AS lw
      FROM gen g LEFT JOIN cands c ON {on}
      WHERE g.stop IS NULL) s
  ) t WHERE rk = 1
),
gen_out AS (SELECT prompt_id, {strip_symbols("array_to_string(pieces, ' ')")} AS text, n AS n_generated, stop
            FROM gen WHERE stop IS NOT NULL)"""


def word_like(x: str) -> str:
    parts = ", ".join(sql_str(w) for w in K.SINGLE_CHAR_WORDS)
    return (f"(CASE WHEN length({x}) = 0 THEN false WHEN {x} IN ({parts}) THEN true "
            f"WHEN length({x}) >= 2 THEN true ELSE regexp_matches({x}, '^[^\\p{{L}}\\p{{N}}]$') END)")


def tree_depth1_sql(top_k: int, branch: int, alpha: float, temperature: float, window: int,
                    min_len: int, max_sub: int) -> str:
    """Depth-1 prediction tree: root rows plus the first ``branch`` ranked
    children of every root, each grown into a word by at most
    ``max_sub - 1`` further back-off lookups (recursive CTE ``grow``).
    Needs ``ranked`` (root candidates), ``gbase``, ``trigram``,
    ``bigram_ids`` and ``vocab``; defines ``tree1``."""
    cache = (f"coalesce(list_sum(list_transform([x.id FOR x IN s.ctx[-{window}:] IF x.c], "
             f"lambda x, i: CASE WHEN x = c.w3 THEN i / len([y.id FOR y IN s.ctx[-{window}:] IF y.c]) ELSE 0.0 END)), 0.0)"
             f" + CASE WHEN len(list_filter(s.ctx, lambda x: x.c AND x.id = c.w3)) > 0 "
             f"THEN sqrt(len(list_filter(s.ctx, lambda x: x.c AND x.id = c.w3))) ELSE 0.0 END")
    added_text = strip_symbols("array_to_string(s.added, ' ')")
    return f"""
tri_ctx AS (SELECT DISTINCT w1, w2 FROM trigram),
elig_all AS (SELECT 't' AS src, w1 AS k1, w2 AS k2, w3, cnt FROM trigram
             UNION ALL SELECT 'b', w1, -999, w2, cnt FROM bigram_ids),
cand_all AS (SELECT e.src, e.k1, e.k2, e.w3, e.cnt,
                    CASE WHEN e.w3 = {K.EOS_ID} THEN '{K.EOS_PIECE}' WHEN e.w3 = 0 THEN '{K.UNK_SURFACE}' ELSE v.piece END AS piece,
                    coalesce(v.cacheable, false) AS cacheable,
                    row_number() OVER (PARTITION BY e.src, e.k1, e.k2 ORDER BY e.cnt DESC, e.w3 ASC) AS pos
             FROM elig_all e LEFT JOIN vocab v ON v.id = e.w3
             WHERE e.w3 <> {K.BOS_ID} AND (e.w3 = {K.EOS_ID} OR coalesce(v.cacheable, false))
             QUALIFY pos <= {top_k}),
kids AS (SELECT r.prompt_id, r.rank AS choice_rank, r.token_id, r.cnt, r.probability,
                CASE WHEN r.token_id = {K.EOS_ID} THEN '{K.EOS_PIECE}' WHEN r.token_id = 0 THEN '{K.UNK_SURFACE}' ELSE v.piece END AS piece,
                coalesce(v.cacheable, false) AS cacheable
         FROM ranked r LEFT JOIN vocab v ON v.id = r.token_id WHERE r.rank <= {branch}),
grow(prompt_id, choice_rank, token_id, ctx, added, prob, cnt, cum, growing, it, term) AS (
  SELECT k.prompt_id, k.choice_rank, k.token_id,
         CASE WHEN k.token_id = {K.EOS_ID} THEN g.ctx ELSE list_append(g.ctx, {{'id': k.token_id, 'c': k.cacheable}}) END,
         CASE WHEN k.token_id = {K.EOS_ID} THEN []::VARCHAR[] ELSE [k.piece] END,
         k.probability, k.cnt::DOUBLE, -ln(greatest(k.probability, {K.MIN_PROBABILITY})),
         k.token_id <> {K.EOS_ID}, 0, k.token_id = {K.EOS_ID}
  FROM kids k JOIN gbase g USING (prompt_id)
  UNION ALL
  SELECT prompt_id, choice_rank, token_id,
         CASE WHEN ext THEN list_append(ctx, {{'id': w3, 'c': ccache}}) ELSE ctx END,
         CASE WHEN ext THEN list_append(added, cpiece) ELSE added END,
         CASE WHEN ext THEN prob * p ELSE prob END,
         CASE WHEN NOT wl AND w3 IS NOT NULL THEN ccnt::DOUBLE ELSE cnt END,
         CASE WHEN ext THEN cum - ln(greatest(p, {K.MIN_PROBABILITY})) ELSE cum END,
         ext, it + 1, term
  FROM (
    SELECT q.*, (NOT q.wl AND q.w3 IS NOT NULL AND q.w3 <> {K.EOS_ID}) AS ext
    FROM (
      SELECT r.*, r.e / sum(r.e) OVER (PARTITION BY r.prompt_id, r.choice_rank) AS p,
             row_number() OVER (PARTITION BY r.prompt_id, r.choice_rank ORDER BY r.lw DESC NULLS LAST, r.pos) AS rk
      FROM (
        SELECT t.*, exp(t.lw - max(t.lw) OVER (PARTITION BY t.prompt_id, t.choice_rank)) AS e
        FROM (
          SELECT s.prompt_id, s.choice_rank, s.token_id, s.ctx, s.added, s.prob, s.cnt, s.cum, s.it, s.term,
                 {word_like(added_text)} AS wl,
                 c.w3, c.cnt AS ccnt, c.pos, c.piece AS cpiece, c.cacheable AS ccache,
                 ln(greatest(c.cnt::DOUBLE
                     * (CASE WHEN c.w3 = {K.EOS_ID} THEN (CASE WHEN len(s.added) < {min_len} THEN {K.EOS_EARLY_FACTOR} ELSE {K.EOS_LATE_FACTOR} END) ELSE 1.0 END)
                     * (1.0 + {alpha} * ({cache})), {K.MIN_WEIGHT})) / greatest({temperature}, {K.MIN_TEMPERATURE}) AS lw
          FROM grow s
          LEFT JOIN tri_ctx tc ON tc.w1 = s.ctx[-2].id AND tc.w2 = s.ctx[-1].id
          LEFT JOIN cand_all c ON c.src = CASE WHEN tc.w1 IS NULL THEN 'b' ELSE 't' END
                              AND c.k1 = CASE WHEN tc.w1 IS NULL THEN s.ctx[-1].id ELSE s.ctx[-2].id END
                              AND c.k2 = CASE WHEN tc.w1 IS NULL THEN -999 ELSE s.ctx[-1].id END
          WHERE s.growing AND s.it < {max_sub - 1}) t) r) q
    WHERE q.rk = 1) z
),
grown AS (SELECT * FROM grow QUALIFY row_number() OVER (PARTITION BY prompt_id, choice_rank ORDER BY it DESC) = 1),
tree1 AS (
  SELECT prompt_id, 0 AS node_id, NULL::INTEGER AS parent_id, 0 AS depth, 0 AS choice_rank, NULL::INTEGER AS token_id,
         '{K.TREE_ROOT_PIECE}' AS piece, 0.0::DOUBLE AS count, 1.0::DOUBLE AS score, 1.0::DOUBLE AS probability,
         0.0::DOUBLE AS cumulative_score, {strip_symbols("array_to_string(pieces, ' ')")} AS text, false AS is_terminal
  FROM gbase
  UNION ALL
  SELECT w.prompt_id, CAST(w.choice_rank AS INTEGER), 0, 1, CAST(w.choice_rank AS INTEGER), w.token_id,
         CASE WHEN w.term THEN '{K.EOS_PIECE}' ELSE {strip_symbols("array_to_string(w.added, ' ')")} END,
         w.cnt, w.prob, w.prob, w.cum,
         {strip_symbols("array_to_string(list_concat(g.pieces, w.added), ' ')")}, w.term
  FROM grown w JOIN gbase g USING (prompt_id))"""


def tree_sql(top_k: int, branch: int, alpha: float, temperature: float, window: int,
             min_len: int, max_sub: int, max_depth: int) -> str:
    """Prediction trees down to ``max_depth`` as one recursive CTE.  A row of
    ``grown`` is a node in one of three states: ``g`` still grows its word,
    ``n`` is a finished node that may have children, ``t`` ends with the end
    token.  One step gives each ``n`` row its first ``branch`` children and
    each ``g`` row its next piece; the word is finished by a test of its text,
    by a miss, by the end token or after ``max_sub`` pieces.  ``path`` holds
    the choice ranks from the root, so node ids are positions by (depth,
    path).  Needs ``gbase``, ``trigram``, ``bigram_ids`` and ``vocab``;
    defines ``tree``."""
    cache = (f"coalesce(list_sum(list_transform([x.id FOR x IN s.ctx[-{window}:] IF x.c], "
             f"lambda x, i: CASE WHEN x = c.w3 THEN i / len([y.id FOR y IN s.ctx[-{window}:] IF y.c]) ELSE 0.0 END)), 0.0)"
             f" + sqrt(len(list_filter(s.ctx, lambda x: x.c AND x.id = c.w3)))")
    return f"""
tri_ctx AS (SELECT DISTINCT w1, w2 FROM trigram),
elig_all AS (SELECT 't' AS src, w1 AS k1, w2 AS k2, w3, cnt FROM trigram
             UNION ALL SELECT 'b', w1, -999, w2, cnt FROM bigram_ids),
cand_all AS (SELECT e.src, e.k1, e.k2, e.w3, e.cnt,
                    CASE WHEN e.w3 = {K.EOS_ID} THEN '{K.EOS_PIECE}' WHEN e.w3 = 0 THEN '{K.UNK_SURFACE}' ELSE v.piece END AS piece,
                    coalesce(v.cacheable, false) AS cacheable,
                    row_number() OVER (PARTITION BY e.src, e.k1, e.k2 ORDER BY e.cnt DESC, e.w3 ASC) AS pos
             FROM elig_all e LEFT JOIN vocab v ON v.id = e.w3
             WHERE e.w3 <> {K.BOS_ID} AND (e.w3 = {K.EOS_ID} OR coalesce(v.cacheable, false))
             QUALIFY pos <= {top_k}),
grown(prompt_id, path, state, depth, token_id, ctx, pieces, added, prob, cnt, before, cum, it) AS (
  SELECT prompt_id, []::BIGINT[], 'n', 0, NULL::INTEGER, ctx, pieces, []::VARCHAR[],
         1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0
  FROM gbase
  UNION ALL
  SELECT prompt_id,
         CASE WHEN state = 'n' THEN list_append(path, rk) ELSE path END,
         CASE WHEN state = 'n' AND w3 = {K.EOS_ID} THEN 't' WHEN ext THEN 'g' ELSE 'n' END,
         CASE WHEN state = 'n' THEN depth + 1 ELSE depth END,
         CASE WHEN state = 'n' THEN w3 ELSE token_id END,
         CASE WHEN ext THEN list_append(ctx, {{'id': w3, 'c': cacheable}}) ELSE ctx END,
         CASE WHEN ext THEN list_append(pieces, piece) ELSE pieces END,
         CASE WHEN state = 'n' AND ext THEN [piece] WHEN state = 'n' THEN []::VARCHAR[]
              WHEN ext THEN list_append(added, piece) ELSE added END,
         CASE WHEN state = 'n' THEN p WHEN ext THEN prob * p ELSE prob END,
         CASE WHEN w3 IS NOT NULL THEN ccnt::DOUBLE ELSE cnt END,
         CASE WHEN state = 'n' THEN before * prob ELSE before END,
         CASE WHEN state = 'n' OR ext THEN cum - ln(greatest(p, {K.MIN_PROBABILITY})) ELSE cum END,
         CASE WHEN state = 'n' THEN 0 ELSE it + 1 END
  FROM (
    SELECT r.*, (r.w3 IS NOT NULL AND r.w3 <> {K.EOS_ID}) AS ext,
           r.e / sum(r.e) OVER (PARTITION BY r.prompt_id, r.path) AS p,
           row_number() OVER (PARTITION BY r.prompt_id, r.path ORDER BY r.lw DESC NULLS LAST, r.pos) AS rk
    FROM (
      SELECT t.*, exp(t.lw - max(t.lw) OVER (PARTITION BY t.prompt_id, t.path)) AS e
      FROM (
        SELECT s.*, c.w3, c.cnt AS ccnt, c.pos, c.piece, c.cacheable,
               ln(greatest(c.cnt::DOUBLE
                   * (CASE WHEN c.w3 = {K.EOS_ID} THEN
                        (CASE WHEN (CASE WHEN s.state = 'n' THEN s.depth ELSE len(s.added) END) < {min_len}
                              THEN {K.EOS_EARLY_FACTOR} ELSE {K.EOS_LATE_FACTOR} END) ELSE 1.0 END)
                   * (1.0 + {alpha} * ({cache})), {K.MIN_WEIGHT})) / greatest({temperature}, {K.MIN_TEMPERATURE}) AS lw
        FROM (SELECT *, (state = 'n' OR (it < {max_sub - 1} AND NOT {word_like(strip_symbols("array_to_string(added, ' ')"))})) AS look
              FROM grown WHERE state = 'g' OR (state = 'n' AND depth < {max_depth})) s
        LEFT JOIN tri_ctx tc ON tc.w1 = s.ctx[-2].id AND tc.w2 = s.ctx[-1].id
        LEFT JOIN cand_all c ON s.look
                            AND c.src = CASE WHEN tc.w1 IS NULL THEN 'b' ELSE 't' END
                            AND c.k1 = CASE WHEN tc.w1 IS NULL THEN s.ctx[-1].id ELSE s.ctx[-2].id END
                            AND c.k2 = CASE WHEN tc.w1 IS NULL THEN -999 ELSE s.ctx[-1].id END) t) r) q
  WHERE q.rk <= CASE WHEN q.state = 'n' THEN {branch} ELSE 1 END AND (q.state = 'g' OR q.w3 IS NOT NULL)
),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY depth, path) - 1 AS INTEGER) AS node_id
             FROM grown WHERE state <> 'g'),
tree AS (SELECT n.prompt_id, n.node_id, u.node_id AS parent_id, n.depth, CAST(coalesce(n.path[-1], 0) AS INTEGER) AS choice_rank,
                n.token_id,
                CASE WHEN n.depth = 0 THEN '{K.TREE_ROOT_PIECE}' WHEN n.state = 't' THEN '{K.EOS_PIECE}'
                     ELSE {strip_symbols("array_to_string(n.added, ' ')")} END AS piece,
                n.cnt AS count, n.before * n.prob AS score, n.prob AS probability, n.cum AS cumulative_score,
                {strip_symbols("array_to_string(n.pieces, ' ')")} AS text, n.state = 't' AS is_terminal
         FROM numbered n LEFT JOIN numbered u ON u.prompt_id = n.prompt_id AND n.depth > 0 AND u.path = n.path[:-2])"""
