"""Independent DuckDB statements of each registered query's definition (the driver's oracle).

They restate *what* is computed -- from the provided tables and the fixture formulas of FIXTURES.md --
without reusing the Spark expressions.  Shared SQL fragments live here.
"""

from __future__ import annotations

from tessera.operators.chat import SYSTEM_PROMPTS


def u(key: str, tag: str, seed: int = 42) -> str:
    """Keyed uniform draw in DuckDB syntax."""
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{tag}:{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SYSTEM_PROMPTS_SQL = sql_list(SYSTEM_PROMPTS)


def sft_report_sql(max_len: int = 1024, seed: int = 42) -> str:
    """Byte vocabulary: each special marker is one token, every other UTF-8 byte one token.

    Pieces per message: user / system = <|im_start|> role\\n text <|im_end|> \\n; assistant =
    <|im_start|> assistant\\n [<think> \\n \\n </think> \\n \\n] text <|im_end|> \\n.  A span starts after the
    11-token assistant header and runs through the 2-token end marker, clipped at max_len; it exists
    only when its header lies wholly inside the first max_len tokens.
    """
    L = max_len
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text,
         first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first_role
  FROM conversations
), k AS (
  SELECT DISTINCT conv_id, first_role, {u('conv_id', 'sys', seed)} AS u_sys,
         {u('conv_id', 'sysp', seed)} AS u_pick, {u('conv_id', 'think', seed)} AS u_think
  FROM c
), m AS (
  SELECT conv_id, turn, role, text FROM c
  UNION ALL
  SELECT conv_id, -1 AS turn, 'system' AS role,
         {SYSTEM_PROMPTS_SQL}[CAST(floor(u_pick * {len(SYSTEM_PROMPTS)}) AS INTEGER) + 1] AS text
  FROM k WHERE first_role <> 'system' AND u_sys < 0.2
), p AS (
  SELECT m.conv_id, m.turn, m.role,
         CASE WHEN m.role = 'assistant'
              THEN 11 + (CASE WHEN k.u_think <= 0.2 THEN 6 ELSE 0 END) + strlen(ltrim(m.text, chr(10))) + 2
              ELSE 1 + strlen(m.role) + 1 + strlen(m.text) + 2 END AS n_tok,
         (CASE WHEN k.u_think <= 0.2 THEN 6 ELSE 0 END) + strlen(ltrim(m.text, chr(10))) AS body
  FROM m JOIN k USING (conv_id)
), o AS (
  SELECT *, coalesce(sum(n_tok) OVER (PARTITION BY conv_id ORDER BY turn
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM p
), s AS (
  SELECT conv_id, n_tok, role,
         CASE WHEN role = 'assistant' AND off + 11 <= {L} THEN 1 ELSE 0 END AS has_span,
         CASE WHEN role = 'assistant' AND off + 11 <= {L}
              THEN greatest(0, least(off + 12 + body + 1, {L}) - (off + 12) + 1) ELSE 0 END AS sup
  FROM o
)
SELECT conv_id, CAST(sum(n_tok) AS BIGINT) AS n_tokens, CAST(sum(sup) AS BIGINT) AS n_supervised,
       CAST(sum(has_span) AS BIGINT) AS n_spans, CAST(sum(n_tok) > {L} AS BIGINT) AS truncated
FROM s GROUP BY conv_id
"""


# ---- shared SQL fragments ------------------------------------------------------------

from tessera.functions.text import PY_WHITESPACE  # noqa: E402
from tessera.operators.rewards import REP_TOKEN_PATTERN, WORD  # noqa: E402
from tessera.plans.fixtures import CURRENCIES, TOOL_CALL_BAD, TOOL_CALL_RATE  # noqa: E402

WS = "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def r6(x: str, digits: int = 6) -> str:
    """Round, and turn -0.0 into 0.0 (as the Spark side does)."""
    return f"(round({x} + 1e-9, {digits}) + 0.0)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def count_sub(x: str, s: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(s)}, ''))) // {len(s)})"


def rep_penalty(x: str) -> str:
    toks = f"regexp_extract_all(lower({x}), {q(REP_TOKEN_PATTERN)})"
    return (f"(SELECT CASE WHEN n > 0 THEN least(0.5, (n - len(list_distinct(list_transform(range(1, n + 1), "
            f"lambda i: array_to_string(tk[i:i + 2], ' '))))) * 1.0 / n) ELSE 0.0 END "
            f"FROM (SELECT tk, len(tk) - 2 AS n FROM (SELECT {toks} AS tk)))")


def format_score(resp: str, lo: int) -> str:
    n = f"length({strip(resp)})"
    think = f"split_part({resp}, '</think>', 1)"
    tn = f"length({strip(think)})"
    return (f"((CASE WHEN {n} BETWEEN {lo} AND 800 THEN 0.5 ELSE -0.5 END) + "
            f"(CASE WHEN position('</think>' IN {resp}) > 0 THEN "
            f"(CASE WHEN {tn} BETWEEN 20 AND 300 THEN 1.0 ELSE -0.5 END) + "
            f"(CASE WHEN {count_sub(resp, '</think>')} = 1 THEN 0.25 ELSE -0.25 END) ELSE 0.0 END))")


def answer_of(resp: str) -> str:
    return (f"(CASE WHEN position('</think>' IN {resp}) > 0 THEN "
            f"{strip(f'substr({resp}, position({q(chr(60) + "/think>")} IN {resp}) + 8)')} ELSE {strip(resp)} END)")


def numbers(text: str) -> str:
    """Standalone numbers: maximal runs of word characters and dots that are decimal numbers; a sign
    counts when the character before it is not a word character or dot."""
    t = f"replace({text}, ',', '')"
    m = f"regexp_extract_all({t}, '(^|[^{WORD}.])([-+]?)([{WORD}.]+)')"
    tail = f"'([-+]?)([{WORD}.]+)$'"
    return (f"list_transform(list_filter({m}, lambda x: regexp_full_match(regexp_extract(x, {tail}, 2), "
            f"'\\p{{Nd}}+(\\.\\p{{Nd}}+)?')), lambda x: CAST(regexp_extract(x, {tail}, 1) || "
            f"regexp_extract(x, {tail}, 2) AS DOUBLE))")


def gt_matched(text: str, gt: str) -> str:
    s = strip("g")
    sn = f"replace({s}, ',', '')"
    return (f"len(list_filter(list_distinct({gt}), lambda g: ({s} <> '' AND contains(lower({text}), lower({s}))) OR "
            f"(regexp_full_match({sn}, '[-+]?\\p{{Nd}}+(\\.\\p{{Nd}}+)?') AND "
            f"len(list_filter({numbers(text)}, lambda nv: abs(CAST({sn} AS DOUBLE) - nv) < 1e-6)) > 0)))")


ROLLOUTS_CTE = f"""rollouts AS (
  SELECT conv_id AS prompt_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS gen_id, turn,
         (conv_id + turn) % 6 AS mode,
         CASE (conv_id + turn) % 6
           WHEN 0 THEN text
           WHEN 1 THEN substr(text, 1, 60) || '</think>' || substr(text, 61)
           WHEN 2 THEN text || {q(TOOL_CALL_RATE[0])} || {sql_list(CURRENCIES)}[conv_id % 4 + 1] || {q(TOOL_CALL_RATE[1])}
           WHEN 3 THEN text || {q(TOOL_CALL_BAD)}
           WHEN 4 THEN text || ' ' || text || ' ' || text
           ELSE '<tool_call>' || text END AS completion
  FROM conversations WHERE role = 'assistant')"""

TASKS_CTE = """tasks AS (
  SELECT DISTINCT conv_id AS prompt_id,
         CASE conv_id % 3 WHEN 0 THEN ['get_exchange_rate'] WHEN 1 THEN ['get_exchange_rate', 'calculate_math']
              ELSE []::VARCHAR[] END AS tools,
         CASE conv_id % 4 WHEN 0 THEN ['7.21'] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['7.21', '7.21']
              ELSE ['7,210'] END AS gt,
         conv_id % 11 = 0 AS unfinished
  FROM conversations)"""

TOKENS_CTE = """tokens AS (
  SELECT user_id % 40 AS prompt_id, user_id AS gen_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         -(1 + event_id % 97) / 50.0 AS lp_new, -(1 + event_id % 89) / 50.0 AS lp_old,
         -(1 + event_id % 83) / 50.0 AS lp_ref, CAST(event_id % 7 < 6 AS INTEGER) AS mask,
         CAST(event_id % 101 AS DOUBLE) / 100.0 AS v,
         CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = count(*) OVER (PARTITION BY user_id)
              THEN CAST(user_id % 7 AS DOUBLE) / 2.0 ELSE 0.0 END AS reward
  FROM events)"""


PREFIX_TOKENS_CTE = TOKENS_CTE.replace("tokens AS (", "all_tokens AS (", 1) + """,
tokens AS (SELECT * REPLACE (CASE gen_id % 3 WHEN 0 THEN 0 WHEN 1 THEN CAST(pos < 20 AS INTEGER) ELSE 1 END AS mask) FROM all_tokens)"""


def _arg(x: str, key: str) -> tuple[str, str]:
    raw_t = f"json_type({x}, '$.arguments')"
    s = f"json_extract_string({x}, '$.arguments')"
    args = (f"(CASE WHEN {raw_t} = 'VARCHAR' THEN (CASE WHEN json_valid({s}) THEN {s} ELSE '{{}}' END) "
            f"WHEN {raw_t} = 'OBJECT' THEN CAST(json_extract({x}, '$.arguments') AS VARCHAR) ELSE '{{}}' END)")
    return args, key


def _text(arg) -> str:
    return f"json_extract_string({arg[0]}, '$.{arg[1]}')"


def _truthy(arg) -> str:
    t, s = f"json_type({arg[0]}, '$.{arg[1]}')", _text(arg)
    return (f"coalesce(CASE {t} WHEN 'VARCHAR' THEN {s} <> '' WHEN 'BOOLEAN' THEN {s} = 'true' WHEN 'ARRAY' THEN {s} <> '[]' "
            f"WHEN 'OBJECT' THEN {s} <> '{{}}' WHEN 'NULL' THEN false ELSE try_cast({s} AS DOUBLE) <> 0 END, false)")


def _valid_call(x: str, tools: str) -> str:
    name = f"json_extract_string({x}, '$.name')"
    a = lambda k: _truthy(_arg(x, k))
    pred = (f"CASE {name} WHEN 'calculate_math' THEN {a('expression')} "
            f"WHEN 'unit_converter' THEN ({_text(_arg(x, 'value'))} IS NOT NULL AND {a('from_unit')} AND {a('to_unit')}) "
            f"WHEN 'get_current_weather' THEN {a('location')} WHEN 'get_current_time' THEN true "
            f"WHEN 'get_exchange_rate' THEN ({a('from_currency')} AND {a('to_currency')}) "
            f"WHEN 'translate_text' THEN ({a('text')} AND {a('target_language')}) ELSE false END")
    return f"(coalesce(list_contains({tools}, {name}), false) AND coalesce({pred}, false))"


def tool_calls_of(answer: str) -> str:
    bodies = f"list_transform(regexp_extract_all({answer}, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda b: {strip('b')})"
    return f"list_filter({bodies}, lambda b: json_valid(b) AND regexp_full_match(b, '(?s)\\{{.*\\}}'))"


def agent_rewards_sql(turns: bool = False) -> str:
    clip = lambda x: f"greatest(-3.0, least(3.0, {x}))"
    gaps = f"list_transform(answers, lambda y: abs({count_sub('y', '<tool_call>')} - {count_sub('y', '</tool_call>')}))"
    tag = f"(-0.5 * list_sum({gaps}))"
    plain = f"({tag} + {format_score('resp', 5)} - {rep_penalty('plain_answer')})"
    gap = "(abs(n_valid - len(gt)) + greatest(0, n_calls - n_valid))"
    withc = (f"({tag} + (CASE WHEN {gap} = 0 THEN 0.5 ELSE -0.5 * {gap} END) + "
             f"(CASE WHEN len(gt) > 0 THEN 2.5 * n_matched / len(gt) ELSE 0.0 END) - "
             f"(CASE WHEN unfinished THEN 0.5 ELSE 0.0 END) - "
             f"{rep_penalty('CASE WHEN length(final) > 0 THEN final ELSE answer END')})")
    source = ("""src AS (SELECT prompt_id, 0 AS gen_id, list(completion ORDER BY turn) AS turns,
                     string_agg(completion, chr(10) ORDER BY turn) AS completion FROM rollouts GROUP BY prompt_id)""" if turns else
              "src AS (SELECT *, [completion] AS turns FROM rollouts)")
    return f"""
WITH {ROLLOUTS_CTE}, {TASKS_CTE}, {source},
a0 AS (
  SELECT r.prompt_id, r.gen_id, r.completion AS resp, t.tools, t.gt, t.unfinished,
         list_transform(r.turns, lambda z: {answer_of('z')}) AS answers, {answer_of('r.completion')} AS whole
  FROM src r JOIN tasks t USING (prompt_id)
), a AS (SELECT *, answers[-1] AS answer, CASE WHEN position('</think>' IN resp) > 0 THEN whole ELSE answers[-1] END AS plain_answer FROM a0
), b AS (
  SELECT *, flatten(list_transform(answers, lambda y: {tool_calls_of('y')})) AS calls,
         CASE WHEN unfinished THEN '' WHEN position('</tool_call>' IN answer) > 0
              THEN string_split(answer, '</tool_call>')[-1] ELSE answer END AS final
  FROM a
), c AS (
  SELECT *, len(calls) AS n_calls, len(list_filter(calls, lambda x: {_valid_call('x', 'tools')})) AS n_valid,
         CASE WHEN len(calls) > 0 THEN {gt_matched('final', 'gt')} ELSE 0 END AS n_matched
  FROM b
)
SELECT prompt_id, gen_id, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_valid AS BIGINT) AS n_valid,
       CAST(n_matched AS BIGINT) AS n_matched,
       0.0 + round(CAST({clip(f'CASE WHEN n_calls > 0 THEN {withc} ELSE {plain} END')} AS DOUBLE) + 1e-9, 6) AS reward
FROM c
"""


def chat_rewards_sql() -> str:
    return f"""
WITH {ROLLOUTS_CTE},
a AS (
  SELECT r.prompt_id, r.gen_id, r.completion AS resp, {answer_of('r.completion')} AS answer,
         CASE WHEN l.doc_id IS NULL THEN 0.0
              ELSE greatest(-3.0, least(3.0, CAST(l.quality AS DOUBLE) - 5.0 * l.toxic)) END AS score
  FROM rollouts r LEFT JOIN labels l ON l.doc_id = r.prompt_id
), b AS (
  SELECT prompt_id, gen_id, {format_score('resp', 20)} - {rep_penalty('answer')} + score AS reward FROM a
)
SELECT prompt_id, gen_id, 0.0 + round(reward + 1e-9, 6) AS reward,
       0.0 + round((reward - avg(reward) OVER (PARTITION BY prompt_id)) /
             (coalesce(stddev_pop(reward) OVER (PARTITION BY prompt_id), 0) + 1e-4) + 1e-9, 6) AS advantage
FROM b
"""


def gae_whiten_sql(gamma: float = 1.0, lam: float = 0.95, tokens: str = TOKENS_CTE) -> str:
    c = gamma * lam
    return f"""
WITH {tokens},
t0 AS (SELECT * REPLACE (v * mask AS v) FROM tokens),
d AS (
  SELECT *, reward + {gamma} * lead(v, 1, 0.0) OVER (PARTITION BY gen_id ORDER BY pos) - v AS delta FROM t0
), a AS (
  SELECT *, sum(delta * pow({c}, pos)) OVER (PARTITION BY gen_id ORDER BY pos
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow({c}, pos) AS adv FROM d
), m AS (
  SELECT *, sum(adv * mask) OVER () / greatest(sum(mask) OVER (), 1) AS mu FROM a
), s AS (
  SELECT *, sum((adv - mu) * (adv - mu) * mask) OVER () / greatest(sum(mask) OVER (), 1) AS var FROM m
)
SELECT prompt_id, gen_id, CAST(pos AS BIGINT) AS pos, 0.0 + round(adv + 1e-9, 6) AS advantage, 0.0 + round(adv + v + 1e-9, 6) AS ret,
       0.0 + round((adv - mu) * pow(var + 1e-8, -0.5) * mask + 1e-9, 6) AS advantage_white
FROM s
"""


def policy_diagnostics_sql() -> str:
    den = "greatest(sum(mask), 1)"
    return f"""
WITH {TOKENS_CTE}
SELECT prompt_id,
       0.0 + round(sum(exp(lp_new - lp_old) * mask) / {den} + 1e-9, 6) AS mean_ratio,
       0.0 + round(sum((exp(lp_ref - lp_new) - (lp_ref - lp_new) - 1) * mask) / {den} + 1e-9, 6) AS kl_ref,
       0.0 + round(sum(0.5 * (lp_new - lp_old) * (lp_new - lp_old) * mask) / {den} + 1e-9, 6) AS approx_kl,
       0.0 + round(sum(CAST(abs(exp(lp_new - lp_old) - 1) > 0.2 AS DOUBLE) * mask) / {den} + 1e-9, 6) AS clip_frac,
       CAST(sum(mask) AS BIGINT) AS n_tokens
FROM tokens GROUP BY prompt_id
"""


def masked_loss_sql(tokens: str = TOKENS_CTE) -> str:
    prompt = "gen_id AS prompt_id" if tokens is not TOKENS_CTE else "prompt_id"
    return f"""
WITH {tokens},
s AS (SELECT {prompt}, gen_id, sum(-lp_new * mask) AS ls, sum(mask) AS ms FROM tokens GROUP BY prompt_id, gen_id)
SELECT prompt_id,
       0.0 + round(avg(ls / greatest(ms, 1)) + 1e-9, 6) AS seq_mean,
       0.0 + round(avg(CASE WHEN ms > 0 THEN ls / ms END) + 1e-9, 6) AS seq_mean_nonempty,
       0.0 + round(sum(ls) / nullif(sum(ms), 0) + 1e-9, 6) AS token_mean,
       0.0 + round(sum(ls) / (sum(ms) + 1e-8) + 1e-9, 6) AS token_mean_eps
FROM s GROUP BY prompt_id
"""


def policy_loss_sql(beta: float = 0.1) -> str:
    return f"""
WITH {TOKENS_CTE},
seqr AS (SELECT prompt_id, gen_id, sum(reward) AS r FROM tokens GROUP BY prompt_id, gen_id),
adv AS (SELECT prompt_id, gen_id,
               (r - avg(r) OVER (PARTITION BY prompt_id)) / (stddev_pop(r) OVER (PARTITION BY prompt_id) + 1e-4) AS a
        FROM seqr),
t AS (SELECT k.*, adv.a, exp(k.lp_new - k.lp_old) AS ratio,
             exp(k.lp_ref - k.lp_new) - (k.lp_ref - k.lp_new) - 1 AS kl
      FROM tokens k JOIN adv USING (prompt_id, gen_id)),
l AS (SELECT *, -(least(ratio, 5.0) * a * lp_new - {beta} * kl) AS l_cispo,
             -(least(ratio * a, greatest(0.8, least(1.2, ratio)) * a) - {beta} * kl) AS l_grpo,
             greatest(-a * ratio, -a * greatest(0.8, least(1.2, ratio))) AS l_ppo FROM t),
s AS (SELECT prompt_id, gen_id, sum(l_cispo * mask) / greatest(sum(mask), 1) AS c,
             sum(l_grpo * mask) / greatest(sum(mask), 1) AS g, sum(l_ppo * mask) / greatest(sum(mask), 1) AS p
      FROM l GROUP BY prompt_id, gen_id)
SELECT prompt_id, 0.0 + round(avg(c) + 1e-9, 6) AS loss_cispo, 0.0 + round(avg(g) + 1e-9, 6) AS loss_grpo, 0.0 + round(avg(p) + 1e-9, 6) AS loss_ppo
FROM s GROUP BY prompt_id
"""


def ppo_objective_sql(eps: float = 0.2, clip_value: float = 0.2, kl_coef: float = 0.02) -> str:
    n = "greatest(sum(mask), 1)"
    return f"""
WITH {PREFIX_TOKENS_CTE},
t AS (SELECT *, v - 0.5 AS a, exp(lp_new - lp_old) AS r, -lp_new / 2 AS vn, v AS vo, -lp_old / 2 AS g,
             exp(lp_ref - lp_new) - (lp_ref - lp_new) - 1 AS kl FROM tokens)
SELECT prompt_id,
       {r6(f'sum(greatest(-a * r, -a * greatest({1 - eps}, least({1 + eps}, r))) * mask) / {n} + {kl_coef} * sum(kl * mask) / {n}')} AS policy_loss,
       {r6(f'0.5 * sum(greatest(pow(vn - g, 2), pow(greatest(vo - {clip_value}, least(vo + {clip_value}, vn)) - g, 2)) * mask) / {n}')} AS value_loss
FROM t GROUP BY prompt_id
"""


def token_kl_sql() -> str:
    return f"""
WITH {PREFIX_TOKENS_CTE}
SELECT prompt_id, {r6('sum((lp_ref - lp_new) * mask) / greatest(sum(mask), 1)')} AS kl FROM tokens GROUP BY prompt_id
"""


def preference_loss_tokens_sql(beta: float = 0.15) -> str:
    side = lambda c, k: f"sum({c} * mask) FILTER (WHERE gen_id // 40 % 2 = {k})"
    return f"""
WITH {PREFIX_TOKENS_CTE},
p AS (SELECT prompt_id, gen_id // 80 AS pair, {side('lp_new', 0)} AS pc, {side('lp_new', 1)} AS pr, {side('lp_ref', 0)} AS rc, {side('lp_ref', 1)} AS rr
      FROM tokens GROUP BY 1, 2),
m AS (SELECT *, (pc - pr) - (rc - rr) AS margin FROM p WHERE pc IS NOT NULL AND pr IS NOT NULL)
SELECT prompt_id, pair, {r6('margin')} AS margin, {r6(f'ln(1 + exp(-{beta} * margin))')} AS loss FROM m
"""


def tool_calls_api_sql() -> str:
    found = "regexp_extract_all(completion, '(?s)<tool_call>[\\s]*(\\{.*?\\})[\\s]*</tool_call>', 1)"
    ids = f"list_filter(list_transform(range(len({found})), lambda i: CASE WHEN json_valid({found}[i + 1]) THEN 'call_' || i || '|' || coalesce(json_extract_string({found}[i + 1], '$.name'), '') END), lambda x: x IS NOT NULL)"
    bare = "regexp_replace(completion, '(?s)<tool_call>(.*?)</tool_call>', '', 'g')"
    return f"""
WITH {ROLLOUTS_CTE}
SELECT prompt_id, gen_id, CASE WHEN len({ids}) > 0 THEN array_to_string({ids}, ',') ELSE 'none' END AS calls,
       md5({strip(f"CASE WHEN len({tool_calls_of('completion')}) > 0 THEN {bare} ELSE completion END")}) AS text_md5
FROM rollouts
"""


def added_token_count(x: str) -> str:
    """Byte-vocabulary token count: UTF-8 bytes, minus (length-1) per occurrence of an added token."""
    from tessera.functions.tokens import ADDED_TOKENS
    adj = " + ".join(f"{count_sub(x, t)} * {len(t.encode()) - 1}" for t in ADDED_TOKENS)
    return f"(strlen({x}) - ({adj}))"


def doc_token_stats_sql(max_len: int = 1024, reserve: int = 100) -> str:
    n = added_token_count("text")
    return f"""
WITH d AS (SELECT lang, text, {n} AS n FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS BIGINT) AS max_tokens,
       0.0 + round(quantile_cont(n, 0.95) + 1e-9, 6) AS quantile_tokens,
       0.0 + round(avg(CASE WHEN n > 0 THEN length(text) / n END) + 1e-9, 6) AS chars_per_token,
       0.0 + round(avg(CASE WHEN n + {reserve} >= {max_len} THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS truncated_share
FROM d GROUP BY lang
"""


def word_counts_ws_sql() -> str:
    return f"""
SELECT word, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_split_to_array(text, '[' || {WS} || ']+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
"""


def epoch_batches_sql(epochs=(0, 1), world: int = 4, batch_size: int = 8, skip0: int = 1, seed: int = 42) -> str:
    parts = []
    for e in epochs:
        skip = skip0 if e == epochs[0] else 0
        parts.append(f"""
  (WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{seed + e}'), doc_id) - 1 AS pos
              FROM documents),
        n AS (SELECT count(*) AS n FROM p),
        padded AS (SELECT doc_id, pos FROM p UNION ALL
                   SELECT doc_id, pos + n FROM p, n WHERE pos < CAST(ceil(n / {world}) * {world} AS BIGINT) - n),
        s AS (SELECT doc_id, pos, pos % {world} AS shard, pos // {world} AS local_pos FROM padded),
        c AS (SELECT shard, count(*) AS m FROM s GROUP BY shard)
   SELECT {e} AS epoch, doc_id, pos, CAST(shard AS INTEGER) AS shard, local_pos,
          CAST(local_pos // {batch_size} - {skip} AS BIGINT) AS batch_id
   FROM s JOIN c USING (shard)
   WHERE local_pos // {batch_size} >= {skip}
     AND (local_pos // {batch_size} < m // {batch_size} OR m // {batch_size} >= {skip}))""")
    return "\nUNION ALL\n".join(parts)


AUDIO_CHUNKS_CTE = """chunks AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS prob
  FROM events)"""


def speech_events_sql(interrupts: bool, m: int = 2, s: int = 2, lossy: bool = False) -> str:
    """One window after the other per session: the state machine as a recursive query over seq, or over the places of those
    windows that were not lost, which stand for their seq in the end."""
    if lossy:
        whole = speech_events_sql(interrupts, m, s)
        cte, body = whole.split("st AS (", 1)
        cte = cte.replace("w AS (SELECT", "w0 AS (SELECT") + """real AS (SELECT * EXCLUDE (seq), seq AS seq0, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq
  FROM w0 WHERE (seq * 7 + session_id) % 13 <> 5),
w AS (SELECT session_id, seq, loud, reply FROM real),
"""
        head, tail = body.split("SELECT session_id, event, CAST(seg_no", 1)
        return f"""{cte}st AS ({head}SELECT o.session_id, o.event, o.seg_no, a.seq0 AS start_seq, b.seq0 AS end_seq, b.seq0 - a.seq0 + 1 AS n_windows
FROM (SELECT session_id, event, CAST(seg_no{tail}) o
JOIN real a ON a.session_id = o.session_id AND a.seq = o.start_seq JOIN real b ON b.session_id = o.session_id AND b.seq = o.end_seq
"""
    opens, closes = f"(NOT t.open AND w.loud AND t.loud_run + 1 = {m})", f"(t.open AND NOT w.loud AND t.quiet_run + 1 = {s})"
    fires = f"((t.open OR {opens}) AND w.loud AND w.reply AND NOT t.interrupted)"
    extra = "" if not interrupts else "UNION ALL SELECT session_id, 'interrupt', seg_no, seq, seq FROM st WHERE fired"
    return f"""
WITH RECURSIVE {AUDIO_CHUNKS_CTE},
w AS (SELECT session_id, seq, prob > 0.5 AS loud, {'reply' if interrupts else 'false'} AS reply FROM
      (SELECT chunks.*, event_type = 'view' AS reply FROM chunks JOIN
         (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type FROM events)
         USING (session_id, seq))),
st AS (
  SELECT DISTINCT session_id, CAST(-1 AS BIGINT) AS seq, false AS open, 0 AS loud_run, 0 AS quiet_run, false AS spare, CAST(NULL AS BIGINT) AS start,
         0 AS seg_no, false AS interrupted, false AS closed, false AS fired, CAST(NULL AS BIGINT) AS closed_start, 0 AS next_no FROM w
  UNION ALL
  SELECT t.session_id, w.seq, CASE WHEN {opens} THEN true WHEN {closes} THEN false ELSE t.open END,
         CASE WHEN {closes} OR (NOT t.open AND NOT w.loud) THEN 0 WHEN NOT t.open AND w.loud THEN t.loud_run + 1 ELSE t.loud_run END,
         CASE WHEN t.open AND w.loud OR {opens} THEN 0 WHEN t.open AND NOT w.loud THEN t.quiet_run + 1 ELSE t.quiet_run END,
         CASE WHEN {closes} THEN false WHEN NOT t.open AND NOT w.loud THEN true ELSE t.spare END,
         CASE WHEN {opens} THEN w.seq - {m} + 1 - CAST(t.spare AS INTEGER) ELSE t.start END,
         t.next_no, CASE WHEN {closes} THEN false WHEN {fires} THEN true ELSE t.interrupted END,
         {closes}, {fires}, t.start, t.next_no + CAST({closes} AS INTEGER)
  FROM st t JOIN w ON w.session_id = t.session_id AND w.seq = t.seq + 1)
SELECT session_id, event, CAST(seg_no AS INTEGER) AS seg_no, start_seq, end_seq, end_seq - start_seq + 1 AS n_windows FROM (
  SELECT session_id, 'speech_end' AS event, seg_no, closed_start AS start_seq, seq - {s} + 1 AS end_seq FROM st WHERE closed
  {extra}) e
"""


def word_counts_sql() -> str:
    """The pre-token pattern without lookahead: a mark before the last of the blanks that precede a character that is none."""
    blank = r"[\t-\r \x{85}\p{Z}]"
    solid = r"[^\t-\r \x{85}\p{Z}]"
    other = r"[^\t-\r \x{85}\p{Z}\p{L}\p{N}\x01]"
    pattern = "|".join(["''s", "''t", "''re", "''ve", "''m", "''ll", "''d",
                        *[f"\\x01 {c}+|{c}+" for c in (r"\p{L}", r"\p{N}", other)], rf"\x01{blank}", f"{blank}+"])
    return f"""
WITH t AS (SELECT regexp_replace(text, '({blank})({solid})', chr(1) || '\\1\\2', 'g') AS x FROM documents),
p AS (SELECT unnest(regexp_extract_all(x, '{pattern}')) AS w FROM t)
SELECT replace(w, chr(1), '') AS word, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1
"""


def overlap_chunks_sql(size: int = 4, overlap: int = 2) -> str:
    return f"""
WITH {AUDIO_CHUNKS_CTE},
n AS (SELECT session_id, count(*) AS n FROM chunks GROUP BY session_id),
k AS (SELECT session_id, n, unnest(range(1, n // {size} + 2)) AS chunk_no FROM n),
e AS (SELECT session_id, chunk_no,
             CASE WHEN chunk_no <= n // {size} THEN chunk_no * {size} ELSE n END AS e,
             CASE WHEN chunk_no <= n // {size} THEN {size} ELSE n - (n // {size}) * {size} END AS len
      FROM k)
SELECT session_id, CAST(chunk_no AS INTEGER) AS chunk_no,
       CAST(e - len - least({overlap}, e - len) AS BIGINT) AS start_seq, CAST(e - 1 AS BIGINT) AS end_seq,
       CAST(least({overlap}, e - len) AS INTEGER) AS trim
FROM e WHERE len > 0
"""


def history_window_sql(n: int = 4) -> str:
    return f"""
SELECT conv_id, turn, n_hist, coalesce(hist_first, -1) AS hist_first FROM (
  SELECT conv_id, turn, role,
         CAST(count(*) OVER w AS BIGINT) AS n_hist, min(turn) OVER w AS hist_first
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))
WHERE role = 'user'
"""


def incremental_text_sql() -> str:
    """Byte tokens of valid UTF-8 text decode one character at a time, added tokens whole."""
    from tessera.functions.tokens import ADDED_TOKENS
    adj = " + ".join(f"{count_sub('text', t)} * {len(t) - 1}" for t in ADDED_TOKENS)
    return f"""
SELECT conv_id * 1000 + turn AS request_id, CAST(length(text) - ({adj}) AS BIGINT) AS n_pieces, md5(text) AS text_md5
FROM conversations WHERE strlen(text) > 0
"""


# ---- chat / tools / media ---------------------------------------------------------------------

from tessera.operators.rewards import HISTORY_JOIN  # noqa: E402

NL = "chr(10)"
EMPTY_THINK_SQL = f"'<think>' || {NL} || {NL} || '</think>' || {NL} || {NL}"


def render_turn(role: str, text: str, first_role_col: str, turn: str, first_turn: str) -> str:
    """One message of the ChatML template for plain conversations (no tools, no reasoning field)."""
    return (f"CASE WHEN {role} = 'assistant' THEN '<|im_start|>assistant' || {NL} || {EMPTY_THINK_SQL} || "
            f"ltrim({text}, {NL}) || '<|im_end|>' || {NL} "
            f"ELSE '<|im_start|>' || {role} || {NL} || {text} || '<|im_end|>' || {NL} END")


def tool_calls_sql() -> str:
    b = strip("body")
    return f"""
WITH {ROLLOUTS_CTE},
m AS (SELECT prompt_id, gen_id, regexp_extract_all(completion, '(?s)<tool_call>(.*?)</tool_call>', 1) AS bodies FROM rollouts),
c AS (SELECT prompt_id, gen_id, unnest(bodies) AS body, unnest(range(len(bodies))) AS idx FROM m)
SELECT prompt_id, gen_id, CAST(idx AS INTEGER) AS idx, json_extract_string({b}, '$.name') AS name,
       CASE WHEN json_type({b}, '$.arguments') = 'VARCHAR' THEN json_extract_string({b}, '$.arguments')
            ELSE CAST(json_extract({b}, '$.arguments') AS VARCHAR) END AS arguments
FROM c WHERE json_valid({b}) AND regexp_full_match({b}, '(?s)\\{{.*\\}}')
"""


def chat_parse_sql(seed: int = 42) -> str:
    pat = "'(?s)<\\|im_start\\|>(system|user|assistant)\\s+(.*?)<\\|im_end\\|>'"
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations
), p AS (
  SELECT conv_id, max(n_turns) AS n_turns,
         string_agg(CASE WHEN k = 1 AND role = 'system' THEN '<|im_start|>system' || {NL} || text || '<|im_end|>' || {NL}
                         ELSE {render_turn('role', 'text', '', '', '')} END, '' ORDER BY turn)
           || '<|im_start|>assistant' || {NL} || {EMPTY_THINK_SQL} AS prompt
  FROM c GROUP BY conv_id
), m AS (
  SELECT conv_id, n_turns, regexp_extract_all(prompt, {pat}, 1) AS roles,
         list_transform(regexp_extract_all(prompt, {pat}, 2), lambda x: {strip('x')}) AS contents FROM p
), h AS (
  SELECT *, len(roles) AS n,
         array_to_string(list_transform(range(1, len(roles)), lambda i: roles[i] || ': ' || contents[i]), {NL}) AS hist
  FROM m
), x AS (
  SELECT conv_id, n_turns, n, CASE WHEN n = 0 THEN '' WHEN length(hist) > 0 THEN hist || {q(HISTORY_JOIN)} || contents[n]
                                    ELSE contents[n] END AS ctx FROM h
)
SELECT conv_id, CAST(n AS BIGINT) AS n_msgs, CAST(length(ctx) AS BIGINT) AS ctx_len, md5(ctx) AS ctx_md5,
       CAST(greatest(n_turns - 1, 0) AS BIGINT) AS n_prompt_msgs,
       CAST({u('conv_id', 'thinking', seed)} < 0.5 AS INTEGER) AS thinking
FROM x
"""


IMAGE_TURNS_CTE = """tagged AS (
  SELECT conv_id, turn, role,
         CASE WHEN substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1) < '4' THEN '<image>' || text
              WHEN substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1) < '8' THEN text || ' <image> x'
              ELSE text END AS text
  FROM conversations)"""


def image_runs_sql(n: int = 64) -> str:
    return f"""
WITH {IMAGE_TURNS_CTE}
SELECT conv_id, CAST(sum({count_sub('text', '<image>')}) AS BIGINT) AS n_runs,
       CAST({n} * sum({count_sub('text', '<image>')}) AS BIGINT) AS n_pad_tokens
FROM tagged WHERE role <> 'system' GROUP BY conv_id HAVING sum({count_sub('text', '<image>')}) > 0
"""


def image_tags_sql(seed: int = 42) -> str:
    c = strip("replace(text, '<image>', '')")
    uu = u("conv_id * 1000 + turn", "imgtag", seed)
    return f"""
WITH {IMAGE_TURNS_CTE}
SELECT conv_id, turn, md5(CASE WHEN position('<image>' IN text) = 0 THEN text
                               WHEN {uu} < 0.2 THEN '<image>' || {NL} || {c}
                               WHEN {uu} < 0.4 THEN '<image>' || {NL} || {NL} || {c}
                               WHEN {uu} < 0.6 THEN {c} || {NL} || '<image>'
                               ELSE {c} || {NL} || {NL} || '<image>' END) AS tagged_md5
FROM tagged
"""


def exchange_lookup_sql() -> str:
    b = strip("body")
    args = f"CAST(json_extract({b}, '$.arguments') AS VARCHAR)"
    return f"""
WITH {ROLLOUTS_CTE},
m AS (SELECT prompt_id, gen_id, regexp_extract_all(completion, '(?s)<tool_call>(.*?)</tool_call>', 1) AS bodies FROM rollouts),
c AS (SELECT prompt_id, gen_id, unnest(bodies) AS body, unnest(range(len(bodies))) AS idx FROM m),
k AS (SELECT prompt_id, gen_id, idx, json_extract_string({args}, '$.from_currency') AS from_currency,
             json_extract_string({args}, '$.to_currency') AS to_currency
      FROM c WHERE json_valid({b}) AND regexp_full_match({b}, '(?s)\\{{.*\\}}')
        AND json_extract_string({b}, '$.name') = 'get_exchange_rate'),
d AS (SELECT {sql_list(CURRENCIES)}[n_nationkey + 1] AS from_currency, 'CNY' AS to_currency, 7 + n_nationkey / 8.0 AS rate FROM nation WHERE n_nationkey < 3)
SELECT prompt_id, gen_id, CAST(idx AS INTEGER) AS idx, from_currency, to_currency, CAST(coalesce(d.rate, 1.0) AS DOUBLE) AS rate
FROM k LEFT JOIN d USING (from_currency, to_currency)
"""


# ---- selection, audio ------------------------------------------------------------------------

CANDIDATES_CTE = """cand AS (
  SELECT l_orderkey AS grp,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item,
         l_quantity / 10.0 AS score
  FROM lineitem)"""


def top_k_sql(k: int) -> str:
    return f"""
WITH {CANDIDATES_CTE}
SELECT grp, item, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, rank() OVER (PARTITION BY grp ORDER BY score DESC) AS rank FROM cand) WHERE rank <= {k}
"""


def cumulative_mass_sql(p: float) -> str:
    return f"""
WITH {CANDIDATES_CTE},
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY grp)) AS e FROM cand),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY grp) AS prob FROM e),
mb AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY grp ORDER BY score DESC, item ASC
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS mass_before FROM pr)
SELECT grp, item, {r6('prob')} AS prob, {r6('mass_before')} AS mass_before FROM mb WHERE mass_before <= {p}
"""


CODES_CTE = """codes AS (
  SELECT vec_id, pos, CAST(floor(abs(CAST(x AS DOUBLE)) * 8192) AS INTEGER) % 2048 AS code FROM (
    SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings))"""


def audio_roundtrip_sql() -> str:
    return f"""
WITH {CODES_CTE}
SELECT vec_id, CAST(pos // 8 AS INTEGER) AS frame, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes
FROM codes GROUP BY vec_id, pos // 8
"""


WAVE_CTE = """ranked AS (
  SELECT vec_id, label, embedding, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings
), wave AS (
  SELECT label AS clip_id, r * 64 + i AS pos, CAST(x AS DOUBLE) AS amp FROM (
    SELECT label, r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM ranked))"""


def audio_quality_sql(frame: int = 80, hop: int = 40, min_samples: int = 1000) -> str:
    return f"""
WITH {WAVE_CTE},
n AS (SELECT clip_id, count(*) AS n, max(abs(amp)) AS peak FROM wave GROUP BY clip_id),
f AS (SELECT clip_id, unnest(range(0, (n - {frame}) // {hop} + 1)) AS k FROM n WHERE n >= {frame}),
r AS (SELECT f.clip_id, f.k, sqrt(avg(w.amp * w.amp)) AS rms FROM f JOIN wave w
        ON w.clip_id = f.clip_id AND w.pos >= f.k * {hop} AND w.pos < f.k * {hop} + {frame} GROUP BY f.clip_id, f.k
      UNION ALL
      SELECT n.clip_id, 0, sqrt(avg(w.amp * w.amp)) FROM n JOIN wave w USING (clip_id) WHERE n.n < {frame} GROUP BY n.clip_id),
qq AS (SELECT clip_id, quantile_cont(rms, 0.95) AS q95, quantile_cont(rms, 0.2) AS q20 FROM r GROUP BY clip_id)
SELECT clip_id, CAST(n AS BIGINT) AS n_samples, {r6('q95')} AS q95, {r6('q20')} AS q20, {r6('peak')} AS peak,
       CASE WHEN n < {min_samples} THEN 'too_short' WHEN q95 < 0.008 THEN 'too_quiet'
            WHEN q95 > 0 AND q20 / q95 > 0.45 THEN 'noisy' WHEN peak > 0.995 THEN 'clipped' ELSE 'ok' END AS verdict
FROM qq JOIN n USING (clip_id)
"""


def center_features_sql() -> str:
    return """
WITH f AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings),
l AS (SELECT vec_id, label, dim, ln(greatest(abs(CAST(x AS DOUBLE)), 1e-10)) AS lg FROM f)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, 0.0 + round(lg - avg(lg) OVER (PARTITION BY label, dim) + 1e-9, 6) AS centered FROM l
"""


# ---- run metrics ------------------------------------------------------------------------------

def generation_throughput_sql() -> str:
    d = "(epoch_us({x}) - t0)"
    ms = lambda x: f"CAST(round(CAST({d.format(x=x)} AS DECIMAL(20, 0)) / 1000, 1) AS DOUBLE)"
    return f"""
WITH g AS (SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1,
                  min(ts) FILTER (WHERE event_type = 'view') AS tv, min(ts) FILTER (WHERE event_type = 'click') AS tc
           FROM events GROUP BY user_id)
SELECT user_id, CAST(n AS BIGINT) AS n_tokens,
       CASE WHEN t1 > t0 THEN {r6('n / ((t1 - t0) / 1000000.0)')} END AS tokens_per_s,
       {ms('tv')} AS first_text_ms, {ms('tc')} AS first_audio_ms
FROM g
"""


def tool_deltas_sql() -> str:
    """One fragment after the other per user: the length of the list of calls as a recursive query."""
    return """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    CASE WHEN event_id % 5 = 0 OR event_id % 7 = 1 THEN NULL ELSE event_id % 4 END AS idx,
    CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 10) ELSE '' END AS id,
    CASE WHEN event_id % 4 = 1 THEN substr(event_type, 1, 2) ELSE '' END AS name, CASE WHEN event_id % 11 <> 0 THEN event_type ELSE '' END AS args FROM events),
st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS len, CAST(NULL AS BIGINT) AS slot FROM e
  UNION ALL
  SELECT t.user_id, e.k, CASE WHEN e.idx IS NULL THEN t.len + 1 WHEN e.idx >= t.len THEN e.idx + 1 ELSE t.len END,
         CASE WHEN e.idx IS NULL THEN t.len ELSE e.idx END
  FROM st t JOIN e ON e.user_id = t.user_id AND e.k = t.k + 1),
slots AS (SELECT user_id, unnest(range(0, max(len))) AS call_index FROM st GROUP BY user_id),
f AS (SELECT st.user_id, st.slot AS call_index, e.* EXCLUDE (user_id) FROM st JOIN e ON e.user_id = st.user_id AND e.k = st.k)
SELECT user_id, CAST(call_index AS BIGINT) AS call_index, CAST(count(f.k) AS BIGINT) AS n_fragments, coalesce(string_agg(id, '' ORDER BY f.k), '') AS id,
       coalesce(string_agg(name, '' ORDER BY f.k), '') AS name, md5(coalesce(string_agg(args, '' ORDER BY f.k), '')) AS args_md5
FROM slots LEFT JOIN f USING (user_id, call_index) GROUP BY user_id, call_index
"""


def reward_report_sql() -> str:
    inner = chat_rewards_sql()
    return f"""
WITH cr AS ({inner}), {ROLLOUTS_CTE},
j AS (SELECT cr.*, length(r.completion) AS len FROM cr JOIN rollouts r USING (prompt_id, gen_id)),
gs AS (SELECT avg(s) AS mean_group_std FROM (SELECT stddev_pop(reward) AS s FROM j GROUP BY prompt_id))
SELECT {r6('avg(reward)')} AS mean_reward, {r6('avg(advantage)')} AS adv_mean, {r6('stddev_samp(advantage)')} AS adv_std,
       CAST(count(*) AS BIGINT) AS n, {r6('avg(len)')} AS mean_length, {r6('max(gs.mean_group_std)')} AS mean_group_std
FROM j, gs
"""


def preference_loss_sql(beta: float = 0.15) -> str:
    x = f"({beta} * margin)"
    ls = f"(CASE WHEN {x} >= 0 THEN -ln(1 + exp(-{x})) ELSE {x} - ln(1 + exp({x})) END)"
    return f"""
WITH a AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b
           FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, CASE WHEN md5(a) < md5(b) THEN a ELSE b END AS chosen,
             CASE WHEN md5(a) < md5(b) THEN b ELSE a END AS rejected FROM a WHERE b IS NOT NULL),
m AS (SELECT conv_id, turn,
             (-(strlen(chosen) % 97) / 10.0 - -(strlen(rejected) % 89) / 10.0)
             - (-(length(chosen) % 83) / 10.0 - -(length(rejected) % 79) / 10.0) AS margin FROM p)
SELECT conv_id, turn, {r6('margin')} AS margin, {r6('-' + ls)} AS loss FROM m
"""


def step_counts_sql(bs: int = 16, accum: int = 8, epochs: int = 2, skip: int = 1) -> str:
    it = f"greatest(CAST(ceil(count(*) / {bs}) AS BIGINT) - {skip}, 0)"
    return f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST({it} AS BIGINT) AS iters,
       CAST(ceil({it} / {accum}) * {epochs} AS BIGINT) AS optimizer_steps
FROM documents GROUP BY lang
"""


def decode_roundtrip_sql() -> str:
    return "SELECT lang, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_fail FROM documents GROUP BY lang"


def doc_sequences_sql() -> str:
    from tessera.functions.tokens import byte_id_sql
    bid = byte_id_sql("b")
    return f"""
WITH h AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents),
i AS (SELECT doc_id, n, list_transform(range(n), lambda k: CAST(('0x' || substr(hx, 2 * k + 1, 2)) AS INTEGER)) AS bytes FROM h),
t AS (SELECT doc_id, n, list_transform(bytes, lambda b: {bid}) AS ids FROM i)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens,
       CAST(3 + coalesce(list_sum(ids[1:126]), 0) AS BIGINT) AS wrap_sum,
       CAST(greatest(2048 - n, 0) AS BIGINT) AS n_pad,
       CAST(coalesce(list_sum(ids[greatest(n - 255, 1):n]), 0) AS BIGINT) AS left_sum,
       CAST(256 - least(n, 256) AS INTEGER) AS first_pos,
       CAST(least(n, 256) AS BIGINT) AS eos_mask_sum,
       CAST(CASE WHEN n >= 1 AND n < 512 THEN ids[1] WHEN n >= 512 THEN ids[1] - ids[512] ELSE 0 END AS BIGINT) AS shift_delta,
       {r6('coalesce(list_sum(list_transform(ids[greatest(n - 299, 1):n], lambda x: -x / 1000.0)), 0.0)')} AS aligned_sum
FROM t
"""


def pretrain_samples_sql(max_len: int = 512) -> str:
    from tessera.functions.tokens import byte_id_sql
    return f"""
WITH h AS (SELECT doc_id, hex(encode(text)) AS hx, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, list_transform(range(least(n, {max_len - 2})), lambda k: CAST(('0x' || substr(hx, 2 * k + 1, 2)) AS INTEGER)) AS bytes FROM h),
w AS (SELECT doc_id, [1] || list_transform(bytes, lambda b: {byte_id_sql('b')}) || [2] AS ids FROM i),
p AS (SELECT doc_id, ids || list_transform(range({max_len} - len(ids)), lambda k: 0) AS x FROM w)
SELECT doc_id, md5(array_to_string(x, ',')) AS ids_md5, md5(array_to_string(list_transform(x, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ',')) AS labels_md5
FROM p
"""


def preference_pairs_sql(max_len: int = 512, seed: int = 42) -> str:
    from tessera.functions.tokens import TOKEN_ID, byte_id_sql

    def byte_ids(text):
        return (f"list_transform(range(strlen({text})), lambda k: list_transform([CAST(('0x' || substr(hex(encode({text})), 2 * k + 1, 2)) AS INTEGER)], "
                f"lambda b: {byte_id_sql('b')})[1])")

    key = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
    head = f"[{TOKEN_ID['<|im_start|>']}] || {byte_ids(f"('assistant' || {NL})")}"
    breaks = byte_ids(f"({NL} || {NL})")
    think = f"[{TOKEN_ID['<think>']}] || {breaks} || [{TOKEN_ID['</think>']}] || {breaks}"
    cols = []
    for side in ("chosen", "rejected"):
        body = f"((CASE WHEN {u(key, 'think_' + side, seed)} <= 0.2 THEN {think} ELSE [] END) || {byte_ids(f'ltrim({side}, {NL})')})"
        full = f"({head} || {body} || [{TOKEN_ID['<|im_end|>']}] || {byte_ids(NL)})"
        cols.append(f"{full} AS f_{side}, len({body}) AS b_{side}")
    outs = []
    for side in ("chosen", "rejected"):
        ids = f"(f_{side}[1:{max_len}] || list_transform(range(greatest({max_len} - len(f_{side}), 0)), lambda k: 0))"
        mask = f"list_transform(range(2, {max_len + 1}), lambda i: CASE WHEN i >= 12 AND i <= least(13 + b_{side}, {max_len}) THEN 1 ELSE 0 END)"
        outs += [f"md5(array_to_string({ids}[1:{max_len - 1}], ',')) AS x_{side}", f"md5(array_to_string({ids}[2:{max_len}], ',')) AS y_{side}",
                 f"md5(array_to_string({mask}, ',')) AS mask_{side}"]
    return f"""
WITH a AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b
           FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, CASE WHEN md5(a) < md5(b) THEN a ELSE b END AS chosen,
             CASE WHEN md5(a) < md5(b) THEN b ELSE a END AS rejected FROM a WHERE b IS NOT NULL),
f AS (SELECT conv_id, turn, {', '.join(cols)} FROM p)
SELECT conv_id, turn, {', '.join(outs)} FROM f
"""


def pad_to_batch_sql(n_batches: int = 5) -> str:
    pad = lambda c: f"md5(array_to_string({c} || list_transform(range(m - len({c})), lambda k: 0), ','))"
    return f"""
WITH {TOKENS_CTE},
s AS (SELECT gen_id, prompt_id % {n_batches} AS batch, list(pos % 50 + 1 ORDER BY pos) AS ids, list(mask ORDER BY pos) AS mask,
             list(CAST(round(lp_new * 50) AS INTEGER) ORDER BY pos) AS lp FROM tokens GROUP BY prompt_id, gen_id),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM s)
SELECT gen_id, batch, CAST(m AS BIGINT) AS padded_len, {pad('ids')} AS ids_md5, {pad('mask')} AS mask_md5, {pad('lp')} AS logp_md5 FROM w
"""


def supervised_filter_sql(max_len: int = 256) -> str:
    return f"""
SELECT conv_id, n_supervised, 0.0 + round(n_supervised / {float(max_len)} + 1e-9, 6) AS supervised_share
FROM ({sft_report_sql(max_len)}) WHERE n_supervised > 0
"""


def distinct_ngrams_sql() -> str:
    return f"""
WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[' || {WS} || ']+'), lambda x: x <> '') AS w
           FROM documents),
u AS (SELECT lang, unnest(w) AS g FROM w),
b AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
a1 AS (SELECT lang, count(*) AS n1, count(DISTINCT g) AS d1 FROM u GROUP BY lang),
a2 AS (SELECT lang, count(*) AS n2, count(DISTINCT g) AS d2 FROM b GROUP BY lang)
SELECT lang, CAST(n1 AS BIGINT) AS n_words, {r6('d1 / n1')} AS distinct_1, {r6('d2 / n2')} AS distinct_2
FROM a1 LEFT JOIN a2 USING (lang)
"""


def pretrain_mix_sql(share: float = 0.15, seed: int = 42) -> str:
    return f"""
SELECT 'sft' AS source, conv_id AS id, CAST(count(*) AS BIGINT) AS n_parts FROM conversations GROUP BY conv_id
UNION ALL
SELECT 'pretrain', doc_id, CAST(1 AS BIGINT) FROM documents WHERE {u('doc_id', 'mix', seed)} < {share}
"""


def join_logps_sql() -> str:
    return f"""
WITH {TOKENS_CTE}
SELECT gen_id, CAST(count(*) AS BIGINT) AS n, {r6('sum((lp_new - lp_ref) * mask)')} AS sum_new_minus_ref,
       {r6('sum((lp_new - lp_old) * mask)')} AS sum_new_minus_old
FROM tokens GROUP BY gen_id
"""


def pair_random_sql(seed: int = 42) -> str:
    return f"""
WITH p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS rn FROM pages),
n AS (SELECT count(*) AS n FROM pages)
SELECT e.vec_id, p.page_id FROM embeddings e, n
JOIN p ON p.rn = CAST(floor({u('e.vec_id', 'pair', seed)} * n.n) AS BIGINT)
"""


def augment_embeddings_sql(seed: int = 42, rate: int = 32) -> str:
    uu = lambda tag: u("vec_id", tag, seed)
    un = lambda tag: u("(vec_id || '/' || i)", tag, seed)
    hush = rate // 4
    micro = lambda a: f"md5(array_to_string(list_transform({a}, lambda v: CAST(floor(v * 1e6 + 0.5) AS BIGINT)), ','))"
    return f"""
WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, i, x, CASE WHEN {uu('noise_p')} < 0.3
             THEN x + (0.001 + 0.009 * {uu('noise')}) * (sqrt(-2 * ln(1 - {un('noise_r')})) * cos(2 * pi() * {un('noise_t')})) ELSE x END AS y FROM v),
e AS (SELECT vec_id, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y FROM z GROUP BY vec_id),
g AS (SELECT vec_id, x, y, len(x) AS n,
             CASE WHEN {uu('gain_p')} < 0.3 THEN 0.8 + 0.4 * {uu('gain')} ELSE 1.0 END AS gain,
             ({uu('hush_p')} < 0.2 AND len(x) > {rate}) AS hush_on, CAST(floor({uu('hush')} * (len(x) - {hush} + 1)) AS INTEGER) AS h0,
             {uu('ma_p')} < 0.2 AS ma_on, CAST((floor({uu('ma_k')} * 3) * 2 + 3 - 1) / 2 AS INTEGER) AS h,
             {uu('fm_p')} < 0.5 AS f_on, CAST(floor({uu('fm_w')} * 8) + 1 AS INTEGER) AS f,
             ({uu('tm_p')} < 0.5 AND len(x) // 8 > 1) AS t_on, CAST(floor({uu('tm_w')} * least(10, len(x) // 8)) + 1 AS INTEGER) AS t
      FROM e),
g2 AS (SELECT *, CAST(floor({uu('fm_0')} * (8 - f + 1)) AS INTEGER) AS f0,
              CAST(floor({uu('tm_0')} * (n // 8 - t + 1)) AS INTEGER) AS t0,
              list_transform(range(n), lambda i: CASE WHEN hush_on AND i >= h0 AND i < h0 + {hush} THEN 0.0 ELSE y[i + 1] * gain END) AS a FROM g),
s AS (SELECT *, CASE WHEN ma_on THEN list_transform(range(n), lambda i: list_sum(a[greatest(i - h, 0) + 1:least(i + h, n - 1) + 1]) / (2 * h + 1))
                     ELSE a END AS sm FROM g2),
o AS (SELECT vec_id, list_transform(sm, lambda v: greatest(-1.0, least(1.0, v))) AS sig,
             list_transform(range(n), lambda i: CASE WHEN (f_on AND i % 8 >= f0 AND i % 8 < f0 + f) OR (t_on AND i // 8 >= t0 AND i // 8 < t0 + t) THEN 0.0 ELSE x[i + 1] END) AS msk
      FROM s)
SELECT vec_id, {r6('list_sum(sig)')} AS signal_sum, {r6('list_sum(msk)')} AS masked_sum, {micro('sig')} AS signal_md5, {micro('msk')} AS masked_md5 FROM o
"""


def truncate_to_turn_sql(max_len: int = 768, reserve: int = 100, seed: int = 42) -> str:
    """Byte-token size of each rendered message; prefix sums; the latest assistant cut at or before the
    uniformly picked one whose prefix + reserve < max_len, else the first assistant cut."""
    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations
), p AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 11 + 6 + strlen(ltrim(text, {NL})) + 2
                 ELSE 1 + strlen(role) + 1 + strlen(text) + 2 END AS n_tok,
         CASE WHEN role = 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) - 1 END AS a_idx
  FROM c
), s AS (
  SELECT *, sum(n_tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prefix,
         count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS n_asst FROM p
), pick AS (
  SELECT DISTINCT conv_id, CAST(floor({u('conv_id', 'turncut', seed)} * n_asst) AS INTEGER) AS pk FROM s WHERE n_asst > 1
), choice AS (
  SELECT s.conv_id, coalesce(max(k) FILTER (WHERE a_idx <= pk AND prefix + {reserve} < {max_len}),
                             min(k) FILTER (WHERE a_idx = 0)) AS cut_k
  FROM s JOIN pick USING (conv_id) WHERE role = 'assistant' GROUP BY s.conv_id
  UNION ALL SELECT conv_id, max(k) FROM s WHERE n_asst <= 1 GROUP BY conv_id
)
SELECT conv_id, CAST(cut_k AS BIGINT) AS n_kept, CAST(max(prefix) FILTER (WHERE k = cut_k) AS BIGINT) AS n_tokens
FROM choice JOIN s USING (conv_id) GROUP BY conv_id, cut_k
"""


def layered_loss_sql() -> str:
    return f"""
WITH {CODES_CTE},
t AS (SELECT vec_id, pos % 8 AS layer, code AS target FROM codes
      UNION ALL SELECT DISTINCT vec_id, unnest(range(8)) AS layer, 2050 AS target FROM embeddings),
l AS (SELECT vec_id, layer, sum((target % 97) / 97.0 * (1 + 9 * CAST(target = 2050 AS DOUBLE))) AS ws, count(*) AS v
      FROM t GROUP BY vec_id, layer)
SELECT vec_id, {r6('sum(ws / (v + 1e-9)) / 8')} AS audio_loss FROM l GROUP BY vec_id
"""


def eval_prompts_sql(langs=("zh", "en")) -> str:
    lv = ", ".join(f"('{x}')" for x in langs)
    p = f"'<|im_start|>user' || {NL} || text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || {EMPTY_THINK_SQL}"
    return f"""
WITH l(lang) AS (VALUES {lv})
SELECT conv_id, turn, lang, md5({p}) AS prompt_md5, CAST(length({p}) AS BIGINT) AS prompt_len
FROM conversations, l WHERE role = 'user'
"""


def media_prompts_sql() -> str:
    body = ("text || CASE WHEN turn % 3 <> 0 THEN repeat('<|audio_pad|>', CAST(greatest(conv_id % 5, 1) AS INTEGER)) ELSE '' END")
    body = f"({body} || CASE WHEN conv_id % 2 = 0 THEN CASE WHEN {body} <> '' THEN {NL} || {NL} ELSE '' END || repeat('<|image_pad|>', 64) ELSE '' END)"
    p = f"'<|im_start|>user' || {NL} || {body} || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || {EMPTY_THINK_SQL}"
    return f"""
SELECT conv_id, turn, md5({p}) AS prompt_md5, CAST(length({p}) AS BIGINT) AS prompt_len FROM conversations WHERE role = 'user'
"""


def speech_media_sql() -> str:
    return """
WITH l AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS q, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a
           FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, a, CASE WHEN conv_id % 3 <> 0 AND length(q) % 4 <> 0 THEN q END AS q FROM l)
SELECT conv_id, md5(q) AS audio_md5, CAST(coalesce(length(q) % 7, 0) AS BIGINT) AS audio_length,
       CAST(CASE WHEN q IS NULL THEN 0 ELSE greatest(length(q) % 7, 1) END AS BIGINT) AS audio_tokens,
       CASE WHEN conv_id % 5 <> 0 THEN CAST(length(a) AS BIGINT) END AS first_code,
       CASE WHEN conv_id % 2 = 0 THEN 'img' END AS image
FROM m
"""


def audio_placeholders_sql(seed: int = 42) -> str:
    uu = u("conv_id", "audiotag", seed)
    ap = "repeat('<|audio_pad|>', CAST(conv_id % 5 AS INTEGER))"
    return f"""
WITH lu AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN conv_id % 5 = 0 THEN text
                         WHEN {uu} < 0.4 THEN {ap}
                         WHEN {uu} < 0.6 THEN text
                         WHEN {uu} < 0.8 THEN {ap} || {NL} || {NL} || text
                         ELSE text || {NL} || {NL} || {ap} END) AS last_user_md5
FROM lu
"""


def voice_names_sql() -> str:
    norm = f"trim(regexp_replace(name, '[' || {WS} || ']+', ' ', 'g'), ' ')"
    return f"""
WITH c AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN n_name || '  ' || chr(9) || c_custkey || ' '
                           WHEN 2 THEN 'Default' ELSE '  ' END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v AS (SELECT c_custkey, CASE WHEN {norm} = '' THEN 'voice_clone' ELSE {norm} END AS voice FROM c)
SELECT c_custkey, voice,
       CASE WHEN length(voice) > 24 THEN 'too_long' WHEN lower(voice) = 'default' THEN 'reserved'
            WHEN voice IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0) THEN 'taken' ELSE 'ok' END AS verdict
FROM v
"""


def delta_split_sql() -> str:
    """From places in the whole reply: the share of each delta before the tag or before what was sent until it was whole, and after
    the tag and the newlines that stood in the delta that made it whole."""
    return """
WITH t AS (SELECT conv_id * 1000 + turn AS request_id,
    CASE WHEN turn % 5 = 0 THEN '' ELSE 'plan ' || md5(text) || '</think>' || chr(10) || chr(10) END || replace(text, '<', '(') ||
    CASE WHEN turn % 4 = 1 AND turn % 5 <> 0 THEN '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>' ELSE '' END AS w,
    turn % 4 = 1 AND turn % 5 <> 0 AS called FROM conversations),
n AS (SELECT *, length(w) AS n, strpos(w, '</think>') - 1 AS tag FROM t WHERE length(w) > 0),
p AS (SELECT *, CASE WHEN tag < 0 THEN n ELSE least(n, CAST(ceil((tag + 8) / 7.0) AS BIGINT) * 7) END AS seen FROM n),
q AS (SELECT *, CASE WHEN tag < 0 THEN n ELSE greatest(tag, seen - 7) END AS split,
        CASE WHEN tag < 0 THEN n ELSE tag + 8 + length(regexp_extract(substr(w, CAST(tag + 9 AS BIGINT), CAST(seen - tag - 8 AS BIGINT)), '^\\n*')) END AS resume FROM p),
d AS (SELECT *, unnest(range(0, CAST(ceil(n / 7.0) AS BIGINT))) AS seq FROM q),
x AS (SELECT request_id, seq, 'reasoning' AS kind, substr(w, CAST(seq * 7 + 1 AS BIGINT), CAST(greatest(0, least(seq * 7 + 7, split) - seq * 7) AS BIGINT)) AS text FROM d
  UNION ALL
  SELECT request_id, seq, 'content', substr(w, CAST(greatest(seq * 7, resume) + 1 AS BIGINT), CAST(greatest(0, seq * 7 + 7 - greatest(seq * 7, resume)) AS BIGINT)) FROM d)
SELECT request_id, CAST(seq AS BIGINT) AS seq, kind, text FROM x WHERE text <> ''
UNION ALL SELECT request_id, CAST(ceil(n / 7.0) AS BIGINT) - 1, 'tool_call', '{"name": "f", "arguments": {"a": 1}}' FROM q WHERE called
UNION ALL SELECT request_id, CAST(ceil(n / 7.0) AS BIGINT) - 1, 'finish', CASE WHEN called THEN 'tool_calls' ELSE 'stop' END FROM q
"""


def chunk_frames_sql() -> str:
    chunks = overlap_chunks_sql().strip()
    return f"""
WITH o AS ({chunks}),
f AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
        CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS prob FROM events)
SELECT o.session_id, chunk_no, start_seq, end_seq, trim, md5(string_agg(printf('%d:%.2f', seq, prob), ',' ORDER BY seq)) AS frames_md5
FROM o JOIN f ON f.session_id = o.session_id AND f.seq BETWEEN start_seq AND end_seq GROUP BY ALL
"""


def history_messages_sql(n: int = 4) -> str:
    return f"""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, CAST(count(*) OVER w AS BIGINT) AS n_hist,
       md5(coalesce(string_agg(role || ':' || text, '|') OVER w, '')) AS history_md5
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)
"""


def stream_sft_samples_sql(max_len: int = 1024) -> str:
    return f"""
SELECT conv_id, 'sample' AS kind, least(n_tokens, {max_len}) AS n_real, n_supervised FROM ({sft_report_sql(max_len).strip()}) r
UNION ALL SELECT DISTINCT conv_id, 'malformed', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM conversations WHERE conv_id % 10 = 0
"""


def speech_rows_sql(max_len: int = 48, p: float = 0.3) -> str:
    """Position by position: what stands at (layer, pos), in order of priority."""
    spot = "vec_id || ':' || (pos - 0)"
    return f"""
WITH {CODES_CTE},
v AS (SELECT DISTINCT vec_id, 4 + vec_id % 7 AS start, vec_id % 2 = 0 AND vec_id % 11 <> 0 AS spk,
        vec_id % 11 <> 0 AND vec_id % 3 <> 0 AND {u('vec_id', 'ref')} > 0.5 AS use_ref FROM codes),
r AS (SELECT *, CASE WHEN use_ref THEN greatest(CAST(spk AS INTEGER), start - 5) ELSE start END AS ref_start FROM v),
g AS (SELECT *, unnest(range(0, {max_len})) AS pos FROM (SELECT *, unnest(range(0, 8)) AS layer FROM r)),
c AS (SELECT g.*, a.code AS answer, b.code AS ref FROM g
  LEFT JOIN codes a ON a.vec_id = g.vec_id AND a.pos % 8 = g.layer AND a.pos // 8 = g.pos - g.start - g.layer - 1 AND g.vec_id % 11 <> 0
  LEFT JOIN codes b ON b.vec_id = g.vec_id AND b.pos % 8 = g.layer AND b.pos // 8 = g.pos - g.start + 5 AND g.use_ref AND g.pos >= g.ref_start AND g.pos < g.start),
e AS (SELECT *, CASE WHEN vec_id % 11 <> 0 AND pos = start + layer + 1 + 8 THEN 2050 ELSE answer END AS own FROM c),
f AS (SELECT vec_id, layer, pos, coalesce(own, CASE WHEN spk AND ref_start > 0 AND pos = ref_start - 1 THEN 2051 END, (ref + 1) % 2048, 2049) AS x, coalesce(own, -100) AS y FROM e),
s AS (SELECT vec_id, layer, pos, x, lead(y) OVER (PARTITION BY vec_id, layer ORDER BY pos) AS y FROM f),
k AS (SELECT * FROM s WHERE pos < {max_len - 1}),
m AS (SELECT *, max(y) OVER (PARTITION BY vec_id, pos) <> -100 AND {u(spot, 'ssa')} < {p} AS hit FROM k)
SELECT vec_id, md5(string_agg(x, ',' ORDER BY layer, pos)) AS input_md5, md5(string_agg(y, ',' ORDER BY layer, pos)) AS labels_md5,
  md5(string_agg(CASE WHEN hit THEN CAST(floor({u("vec_id || ':' || pos || ':' || layer", 'ssav')} * 2112) AS INTEGER) ELSE x END, ',' ORDER BY layer, pos)) AS sampled_md5
FROM m GROUP BY vec_id
"""


def rollout_assembly_sql() -> str:
    """Turn by turn: the known length as a recursive query."""
    chars = lambda s: f"list_transform(string_split({s}, ''), lambda x: ascii(x))"
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, md5(text) AS h FROM conversations),
t AS (SELECT conv_id, turn, 'ask ' || conv_id || repeat('+', CAST(turn * 20 AS INTEGER)) AS context, substr(h, 1, conv_id % 9 + turn * 3 + 4) AS new, h,
        (conv_id + turn) % 5 <> 4 AS calls FROM o WHERE turn < 3),
x AS (SELECT *, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'short' ELSE context || new || 'obs' || substr(h, 1, 20 - turn * 5) END AS observe FROM t),
st AS (
  SELECT conv_id, CAST(-1 AS BIGINT) AS turn, length(context) AS known, true AS going, '' AS new, '' AS delta, false AS unfinished FROM x WHERE turn = 0
  UNION ALL
  SELECT s.conv_id, x.turn, CASE WHEN x.calls THEN greatest(s.known + length(x.new), length(x.observe)) ELSE s.known + length(x.new) END, x.calls, x.new,
         CASE WHEN x.calls THEN substr(x.observe, CAST(s.known + length(x.new) + 1 AS BIGINT)) ELSE '' END, x.calls AND x.turn = 2
  FROM st s JOIN x ON x.conv_id = s.conv_id AND x.turn = s.turn + 1 WHERE s.going),
p AS (SELECT conv_id, max(CASE WHEN turn = -1 THEN known END) AS n_prompt, bool_or(unfinished) AS unfinished,
        string_agg(new || delta, '' ORDER BY turn) AS said, string_agg(repeat('1', length(new)) || repeat('0', length(delta)), '' ORDER BY turn) AS mask FROM st GROUP BY conv_id)
SELECT conv_id, n_prompt, length(said) AS n_ids, md5(array_to_string({chars('said')}, ',')) AS ids_md5, md5(array_to_string(string_split(mask, ''), ',')) AS mask_md5,
  md5(array_to_string(list_transform(list_zip({chars('said')}, string_split(mask, '')), lambda z: CASE WHEN z[2] = '1' THEN -z[1] ELSE 0 END), ',')) AS logps_md5, unfinished
FROM p
"""


def last_answer_labels_sql() -> str:
    """The supervised tokens of the last message that has a span."""
    body = sft_report_sql()
    head = body[:body.rindex("SELECT conv_id, CAST(sum(n_tok)")].replace("SELECT conv_id, n_tok, role,", "SELECT conv_id, off, n_tok, role,")
    return head + "SELECT conv_id, CAST(coalesce(arg_max(sup, off) FILTER (has_span = 1), 0) AS BIGINT) AS n_supervised FROM s GROUP BY conv_id"
