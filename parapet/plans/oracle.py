"""SQL twins of the registered queries, for checking them with another engine (RE2 regexes, no lookarounds).

Where a Spark pattern looks around, the twin marks the places the lookaround speaks about with private-use characters
first and takes the marks out afterwards.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterable, Sequence

from parapet.functions import fixed
from parapet.operators.pii import OPTIONS
from parapet.operators.spans import SPECIFIC_FIRST
from parapet.plans.queries import policy
from parapet.plans.samples import (FLOW_LIMITS, MARKUP_PATTERNS, PATIENCE, PROMPT_SAMPLES, QUOTA_LIMIT, QUOTA_SECONDS, REPLY_SAMPLES,
                                   SHARED_LIMITS, TENANT_LIMIT)

PATTERN = {kind: (pattern, ignore_case, tag) for kind, _, _, ignore_case, pattern, tag in fixed.PII_DETECTORS}
DEFAULT_KINDS = [kind for kind, on in OPTIONS.values() if on]
ALL_KINDS = [kind for kind, _ in OPTIONS.values()]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts: Iterable[str]) -> str:
    return "[" + ", ".join(q(t) for t in texts) + "]"


def _sampled(text: str, number: str, samples: Sequence[str]) -> str:
    return f"{text} || chr(10) || {_list(samples)}[({number}) % {len(samples)} + 1]"


def _any(lower: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lower}, {q(p.lower())})" for p in phrases) + ")"


def u16(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


# --- personal data -------------------------------------------------------------------------------------------------

RUN, END, PLUS, OPEN, WORD = "", "", "", "", ""
_PHONE = (rf"(?:\+?{RUN}\d{{1,3}}(?:{END}[\s\-.]?[({OPEN}]?{RUN})?\d{{2,4}}|\(?{RUN}\d{{2,4}})"
          rf"(?:{END}\)?[\s\-.]?{RUN})?\d{{3,4}}(?:{END}[\s\-.]{RUN})?\d{{3,4}}{END}")
_NOT_NAMES = "Care|Data|History|Record|File|Status|Info"
_CAPITAL, _SMALL = "[A-ZÁÉÍÓÚÑÜÇ]", "[a-záéíóúñüç]"
_NAME = (rf"(?:[Pp]atient|[Pp]aciente)\s*:?\s*(?:[Nn]ame\s*:?\s*)?{_CAPITAL}{_SMALL}+\s+{WORD}?{_CAPITAL}{_SMALL}+"
         rf"(?:\s+{WORD}?{_CAPITAL}{_SMALL}+){{0,2}}")


def _marked(text: str, kind: str) -> tuple[str, str, str]:
    """Text prepared for a kind's twin pattern, that pattern, and its flags."""
    if kind == "PHONE":
        runs = f"regexp_replace({text}, '(^|\\D)(\\d)', '\\1{RUN}\\2', 'g')"
        runs = f"regexp_replace({runs}, '(\\d)(\\D|$)', '\\1{END}\\2', 'g')"
        return f"replace(replace({runs}, '{END}+', '{END}{PLUS}'), '{END}(', '{END}{OPEN}')", _PHONE, "g"
    if kind == "PATIENT_NAME":
        return f"regexp_replace({text}, '({_NOT_NAMES})', '{WORD}\\1', 'g')", _NAME, "g"
    pattern, ignore_case, _ = PATTERN[kind]
    return text, pattern, "gi" if ignore_case else "g"


def _unmarked(text: str, kind: str) -> str:
    if kind == "PHONE":
        return (f"replace(replace(replace(replace({text}, '{RUN}', ''), '{END}', ''), '{PLUS}', '+'), '{OPEN}', '(')")
    return f"replace({text}, '{WORD}', '')" if kind == "PATIENT_NAME" else text


def redacted(text: str, kind: str) -> str:
    marked, pattern, flags = _marked(text, kind)
    return _unmarked(f"regexp_replace({marked}, {q(pattern)}, {q(PATTERN[kind][2])}, '{flags}')", kind)


def counted(text: str, kind: str) -> str:
    marked, pattern, flags = _marked(text, kind)
    return f"len(regexp_extract_all({marked}, {q(('(?i)' if 'i' in flags else '') + pattern)}))"


def redacted_all(text: str, kinds: Sequence[str]) -> str:
    for kind in kinds:
        text = redacted(text, kind)
    return text


def _steps(source: str, text: str, kinds: Sequence[str]) -> str:
    """CTEs ``p0..pn`` with the count ``n_<kind>`` of every step and the text ``t`` after it."""
    ctes = [f"p0 AS (SELECT *, {text} AS t FROM {source})"]
    for i, kind in enumerate(kinds):
        ctes.append(f"p{i + 1} AS (SELECT * REPLACE ({redacted('t', kind)} AS t), {counted('t', kind)} AS n_{kind} "
                    f"FROM p{i})")
    return ", ".join(ctes)


def _spans(source: str, text: str, kinds: Sequence[str]) -> str:
    """CTEs ending in ``spanned``: ``source`` with ``kept``, the places of what is found, the more specific kind first."""
    ctes = [f"s0 AS (SELECT *, []::STRUCT(a BIGINT, b BIGINT, kind VARCHAR)[] AS kept FROM {source})"]
    for i, kind in enumerate(kinds):
        marked, pattern, flags = _marked(text, kind)
        flags = flags.replace("g", "")
        ctes.append(f"""m{i} AS (SELECT *, list_transform(regexp_extract_all({marked}, {q(pattern)}, 0, '{flags}'),
            lambda m: length({_unmarked('m', kind)})) AS ms, list_transform(regexp_split_to_array({marked}, {q(pattern)}, '{flags}'),
            lambda p: length({_unmarked('p', kind)})) AS ps FROM s{i}),
        s{i + 1} AS (SELECT * EXCLUDE (ms, ps) REPLACE (list_concat(kept, list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{
            'a': (list_sum(ps[1:i]) + coalesce(list_sum(ms[1:i - 1]), 0))::BIGINT,
            'b': (list_sum(ps[1:i]) + list_sum(ms[1:i]))::BIGINT, 'kind': {q(kind)}}}),
            lambda x: len(list_filter(kept, lambda k: k.a < x.b AND x.a < k.b)) = 0)) AS kept) FROM m{i})""")
    return ", ".join(ctes) + f", spanned AS (SELECT * FROM s{len(kinds)})"


# --- inputs --------------------------------------------------------------------------------------------------------

PROMPTS = (f"prompts AS (SELECT doc_id, {_sampled('text', 'doc_id', PROMPT_SAMPLES)} AS prompt, lang, source, n_chars, "
           "text FROM documents)")
TURNS = (f"turns AS (SELECT conv_id, turn, role, {_sampled('text', 'conv_id * 7 + turn', PROMPT_SAMPLES)} AS text "
         "FROM conversations)")
ANSWERS = (f"answers AS (SELECT conv_id, turn, {_sampled('text', 'conv_id * 7 + turn', REPLY_SAMPLES)} AS content "
           "FROM conversations WHERE role = 'assistant')")
_TS_US = "(1704067200000000 + doc_id * 7000000)"
REQUESTS = PROMPTS + f""", requests AS (SELECT doc_id AS request_id, {_TS_US} AS ts_us, prompt,
  CASE WHEN doc_id % 4 = 1 THEN ' ' WHEN doc_id % 4 = 2 THEN 'Answer in ' || lang END AS system_prompt,
  CASE WHEN doc_id % 11 <> 0 THEN 'u' || (doc_id % 37) END AS user_id,
  CASE WHEN doc_id % 13 <> 0 THEN source END AS tenant_id, 'app-' || lang AS application_id,
  CASE WHEN doc_id % 6 = 0 THEN 'summarize' ELSE 'chat' END AS operation,
  CASE doc_id % 10 WHEN 0 THEN 'azure' WHEN 1 THEN 'nobody' WHEN 2 THEN 'azure' END AS requested_provider,
  CASE doc_id % 10 WHEN 0 THEN 'gpt-large' WHEN 1 THEN 'gpt-large' WHEN 2 THEN '  ' END AS requested_model,
  CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5) * 100 + 56 END AS max_tokens,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 8) / 4.0 END::DOUBLE AS temperature,
  CASE WHEN doc_id % 5 = 0 THEN 'High' ELSE 'low' END AS priority, n_chars AS size FROM prompts)"""
REPLIES = f"""replies AS (SELECT doc_id AS request_id, {_sampled('text', 'doc_id', REPLY_SAMPLES)} AS content,
  n_chars // 4 AS prompt_tokens, doc_id % 97 AS completion_tokens,
  CASE WHEN doc_id % 9 = 0 THEN 'upstream timeout' END AS error,
  {_TS_US} + (doc_id % 1000) * 1500 + 250 AS finished_us FROM documents)"""
_CALL = "source || ' says \"call 555-123-4567\"' || chr(10)"
PARTS = PROMPTS + f""", parts AS (
  SELECT doc_id, 0 AS part_idx, 'system' AS role, 'Answer in ' || lang AS text, lang FROM prompts WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 1, 'user', prompt, lang FROM prompts WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 2, 'user', {_CALL}, lang FROM prompts WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 0, 'user', prompt, lang FROM prompts WHERE doc_id % 4 = 1)"""


# --- screens -------------------------------------------------------------------------------------------------------

def _injection(lower: str) -> str:
    roles = " + ".join(f"contains({lower}, {q(k)})::INT" for k in fixed.ROLE_KEYWORDS)
    return (f"CASE WHEN {_any(lower, fixed.INJECTION_PHRASES)} THEN {q(fixed.REASON_INJECTION)} "
            f"WHEN {_any(lower, fixed.STRUCTURAL_MARKERS)} THEN {q(fixed.REASON_STRUCTURAL)} "
            f"WHEN {roles} >= {fixed.ROLE_KEYWORD_LIMIT} THEN {q(fixed.REASON_ROLES)} END")


def _too_long(text: str, limit: int) -> str:
    return (f"CASE WHEN {u16(text)} > {limit} THEN 'Prompt exceeds maximum length of {limit} characters (' || {u16(text)} "
            "|| ').' END")


def _score(lower: str, category: str) -> str:
    words = fixed.RISK_LEXICON[category]
    total = " + ".join(f"CASE WHEN contains({lower}, {q(w)}) THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for w, x in words)
    hits = " + ".join(f"contains({lower}, {q(w)})::INT" for w, _ in words)
    raised = f"({total})"
    for least, factor in fixed.RISK_CLUSTERS:
        raised += f" * (CASE WHEN {hits} >= {least} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"least({raised}, {fixed.RISK_CAP}::DOUBLE)"


def _scores(source: str, text: str) -> str:
    cols = ", ".join(f"{_score('low', c)} AS s{i}" for i, c in enumerate(fixed.RISK_LEXICON))
    return f"scored AS (SELECT *, {cols} FROM (SELECT *, lower({text}) AS low FROM {source}))"


def _flagged(default: float, thresholds: dict, item: str = "{c}") -> str:
    hits = ", ".join(f"CASE WHEN s{i} >= {float(thresholds.get(c, default))}::DOUBLE THEN "
                     + item.format(c=q(c), s=f"s{i}") + " END" for i, c in enumerate(fixed.RISK_LEXICON))
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def _risk_reason(default: float, thresholds: dict) -> str:
    hits = _flagged(default, thresholds)
    return f"CASE WHEN len({hits}) > 0 THEN {q(fixed.REASON_RISK)} || array_to_string({hits}, ', ') END"


def _secret(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN {q(k)}"
                              for k, p, _, _ in fixed.SECRET_KINDS) + " END"


def _chain(source: str, text: str) -> str:
    """CTEs ending in ``chained``: source columns plus ``screen``, ``reason``, ``out`` (the rewritten text)."""
    length = policy().input_screens()[1].limit
    blocklist = [s for s in policy().input_screens() if s.name == "blocked-patterns"][0]
    risk = [s for s in policy().input_screens() if s.name == "semantic"][0]
    return f"""{_scores(source, text)}, early AS (SELECT *, {_too_long(text, length)} AS r1, {_injection('low')} AS r2,
      CASE WHEN {_any('low', blocklist.patterns)} THEN {q(fixed.REASON_BLOCKLIST)} END AS r3,
      {_risk_reason(risk.default_threshold, risk.thresholds)} AS r4 FROM scored),
    cleaned AS (SELECT *, coalesce(r1, r2, r3, r4) AS r14, CASE WHEN coalesce(r1, r2, r3, r4) IS NULL
      THEN {redacted_all(text, DEFAULT_KINDS)} ELSE {text} END AS out FROM early),
    secrets AS (SELECT *, CASE WHEN r14 IS NULL THEN {q(fixed.REASON_SECRET)} || {_secret('out')} END AS r5 FROM cleaned),
    chained AS (SELECT * EXCLUDE (low), coalesce(r14, r5) AS reason, CASE WHEN r1 IS NOT NULL THEN 'max-length'
      WHEN r2 IS NOT NULL THEN 'prompt-injection' WHEN r3 IS NOT NULL THEN 'blocked-patterns'
      WHEN r4 IS NOT NULL THEN 'semantic' WHEN r5 IS NOT NULL THEN 'secret-detection' END AS screen FROM secrets)"""


def _response(text: str) -> tuple[str, str]:
    """Reason and redacted text of the response chain."""
    blocklist = policy().output_screens()[0]
    reason = f"CASE WHEN {_any(f'lower({text})', blocklist.patterns)} THEN {q(fixed.REASON_RESPONSE_BLOCKLIST)} END"
    return reason, _response_text(text)


def _response_text(text: str) -> str:
    clean = redacted_all(text, fixed.RESPONSE_PII_TYPES)
    return f"CASE WHEN {u16(clean)} <> {u16(text)} THEN {clean} ELSE {text} END"


def _verdict(keys: str, source: str, text: str, reason: str, screen: str, with_sql: str = "") -> str:
    return (f"WITH {with_sql}, r AS (SELECT {keys}, {text} AS t, lower({text}) AS low FROM {source}), "
            f"s AS (SELECT {keys}, {reason} AS reason FROM r) "
            f"SELECT {keys}, reason IS NOT NULL AS blocked, CASE WHEN reason IS NOT NULL THEN {q(screen)} END AS screen, "
            "reason FROM s")


# --- routing -------------------------------------------------------------------------------------------------------

_BLANK = "(requested_model IS NULL OR trim(requested_model) = '')"
ROUTED = f"""routed AS (SELECT *, CASE
    WHEN requested_provider IN ('azure', 'openai', 'local') AND NOT {_BLANK} THEN 'requested'
    WHEN {u16('prompt')} > 4000 AND tenant_id IS NOT NULL THEN 'long'
    WHEN priority = 'High' AND coalesce(temperature, -1) <> 0.25 THEN 'priority'
    WHEN coalesce(max_tokens, 0) < 100 AND starts_with(lower(application_id), 'app-e') THEN 'short-answers'
    ELSE 'default' END AS route_rule FROM {{source}}),
  placed AS (SELECT *, CASE route_rule WHEN 'requested' THEN requested_provider WHEN 'long' THEN 'azure'
    WHEN 'priority' THEN 'azure' WHEN 'short-answers' THEN 'local' ELSE 'openai' END AS provider,
    CASE route_rule WHEN 'requested' THEN requested_model WHEN 'long' THEN 'gpt-large' WHEN 'priority' THEN 'gpt-small'
    WHEN 'short-answers' THEN 'tiny' ELSE 'gpt-small' END AS model FROM routed)"""
FALLBACK = """called AS (SELECT * REPLACE (
    CASE WHEN failed AND provider = 'azure' THEN 'openai' WHEN failed AND provider = 'local' THEN 'azure' ELSE provider
    END AS provider, CASE WHEN failed AND provider = 'azure' THEN 'gpt-backup' WHEN failed AND provider = 'local'
    THEN 'gpt-small' ELSE model END AS model), failed AND provider <> 'openai' AS used_fallback,
    failed AND provider = 'openai' AS unresolved,
    CASE WHEN failed AND provider = 'azure' THEN 'fallback:azure->openai'
    WHEN failed AND provider = 'local' THEN 'fallback:local->azure' ELSE '' END AS flags FROM {source})"""


def _routed(source: str = "requests") -> str:
    return ROUTED.replace("{source}", source)


# --- quotas --------------------------------------------------------------------------------------------------------

def _replayed(source: str, key: str, name: str) -> str:
    """CTEs giving ``<name>``: every request of ``source`` with ``key``, window start and number."""
    width = QUOTA_SECONDS * 1_000_000
    return f"""{name}_seq AS (SELECT *, {key} AS quota_key, row_number() OVER (PARTITION BY {key} ORDER BY us, request_id)
      AS rn FROM {source}),
    {name} AS (SELECT *, us AS ws, 1 AS n FROM {name}_seq WHERE rn = 1
      UNION ALL SELECT s.*, CASE WHEN s.us - w.ws >= {width} THEN s.us ELSE w.ws END,
        CASE WHEN s.us - w.ws >= {width} THEN 1 ELSE w.n + 1 END
      FROM {name} w JOIN {name}_seq s ON s.quota_key = w.quota_key AND s.rn = w.rn + 1)"""


def _shared(source: str, key: str, name: str, limits: Sequence[int], seconds: int = QUOTA_SECONDS) -> str:
    """CTEs giving ``<name>`` with ``c`` (the counter after the request) and ``rule`` (the limit that denies it, from 0)."""
    def step(base: str) -> str:
        cases = " ".join(f"WHEN {base} + {i + 1} > {limit} THEN {{}}".format(f"{base} + {i + 1}") for i, limit in enumerate(limits))
        which = " ".join(f"WHEN {base} + {i + 1} > {limit} THEN {i}" for i, limit in enumerate(limits))
        return f"CASE {cases} ELSE {base} + {len(limits)} END AS c, CASE {which} END AS rule"

    fresh = f"s.us - w.ws >= {seconds * 1_000_000}"
    return f"""{name}_seq AS (SELECT *, {key} AS quota_key, row_number() OVER (PARTITION BY {key} ORDER BY us, request_id)
      AS rn FROM {source}),
    {name} AS (SELECT *, us AS ws, {step('0')} FROM {name}_seq WHERE rn = 1
      UNION ALL SELECT s.*, CASE WHEN {fresh} THEN s.us ELSE w.ws END, {step(f"(CASE WHEN {fresh} THEN 0 ELSE w.c END)")}
      FROM {name} w JOIN {name}_seq s ON s.quota_key = w.quota_key AND s.rn = w.rn + 1)"""


EVENTS = ("ev AS (SELECT event_id AS request_id, epoch_us(ts) AS us, user_id, event_type AS tenant_id FROM events)")
_REPLAY = f"""WITH RECURSIVE {EVENTS}, {_replayed('ev', "'rate:user:' || user_id", 'w')}
  SELECT request_id, quota_key, ws AS window_start_us, n::BIGINT AS n, n > {QUOTA_LIMIT} AS denied FROM w"""

_GLOBAL = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT min(us) AS ws FROM ev UNION ALL SELECT min(e.us) FROM o JOIN ev e
    ON e.us >= o.ws + {QUOTA_SECONDS * 1_000_000} HAVING min(e.us) IS NOT NULL),
  w AS (SELECT request_id, ws, row_number() OVER (PARTITION BY ws ORDER BY us, request_id) AS n
    FROM ev ASOF JOIN o ON ev.us >= o.ws)
  SELECT request_id, 'rate:global' AS quota_key, ws AS window_start_us, n, n > {QUOTA_LIMIT} AS denied FROM w"""


# --- audit ---------------------------------------------------------------------------------------------------------

ATTEMPTS = f"""calls AS (SELECT doc_id AS request_id, attempt, CASE WHEN NOT (attempt = 1 AND doc_id % 4 = 0)
    AND NOT (attempt = 2 AND doc_id % 12 = 0) THEN {_sampled('text', 'doc_id + attempt', REPLY_SAMPLES)} END AS content,
  n_chars // 4 + attempt AS prompt_tokens, doc_id % 97 AS completion_tokens,
  CASE WHEN attempt = 1 AND doc_id % 4 = 0 THEN 'upstream timeout' WHEN attempt = 2 AND doc_id % 12 = 0
    THEN 'backup overloaded' END AS error, {_TS_US} + (doc_id % 1000) * 1500 + attempt * 250 AS finished_us
  FROM documents, (VALUES (1), (2)) AS v(attempt) WHERE doc_id % 29 <> 5 AND (attempt = 1 OR doc_id % 4 = 0))"""


def _limited(source: str, name: str) -> str:
    """Requests with ``deny``: the reason of the quota that refuses them, rule group after rule group."""
    apps, everyone = ([n for s, n in FLOW_LIMITS if (s.lower() == "application") == own] for own in (True, False))
    reason = "'Gateway error: Rate limit exceeded for ' || {} || ': ' || {} || ' requests/min'"
    scopes, limits = _list(s for s, _ in FLOW_LIMITS), str([n for _, n in FLOW_LIMITS])
    return f"""keyed AS (SELECT request_id, ts_us AS us, application_id FROM {source}),
    {_shared('keyed', "'rate:app:' || application_id", 'qa', apps, 60)},
    through AS (SELECT request_id, us, application_id FROM qa WHERE rule IS NULL),
    {_shared('through', "'rate:global'", 'qg', everyone, 60)},
    ruled AS (SELECT request_id, rule FROM qa WHERE rule IS NOT NULL UNION ALL SELECT request_id, rule + {len(apps)} FROM qg),
    {name} AS (SELECT r.*, {reason.format(f'{scopes}[rule + 1]', f'{limits}[rule + 1]')} AS deny
      FROM {source} r JOIN ruled USING (request_id))"""


@lru_cache
def _finished(calls: bool = False, quotas: bool = False, timely: str | None = None) -> str:
    reason, text = _response("content")
    chained = _chain('requests', 'prompt')
    if quotas:  # a request denied by a quota is not screened
        chained = f"""{_limited('requests', 'admitted')}, {_chain('admitted', 'prompt')}, verdicts AS (SELECT * REPLACE (
            coalesce(deny, reason) AS reason, CASE WHEN deny IS NULL THEN screen END AS screen,
            CASE WHEN deny IS NULL THEN out ELSE prompt END AS out) FROM chained)"""
    placed = _routed('verdicts' if quotas else 'chained')
    replies = REPLIES if not calls else f"""{ATTEMPTS}, replies AS (SELECT a.*, b.request_id AS next_id,
        b.content AS next_content, b.prompt_tokens AS next_pt, b.error AS next_error, b.finished_us AS next_us
        FROM calls a LEFT JOIN calls b ON b.request_id = a.request_id AND b.attempt = 2 WHERE a.attempt = 1)"""
    if timely:  # a reply is the first call's and, beside an error, the fallback's
        calls = True
        replies = f"""{REPLIES.replace('replies AS', 'said AS')}, replies AS (SELECT s.*, s.request_id AS next_id,
            s.content AS next_content, s.prompt_tokens AS next_pt, NULL::VARCHAR AS next_error, s.finished_us AS next_us
            FROM said s JOIN requests q USING (request_id) WHERE s.finished_us - q.ts_us <= epoch_us(INTERVAL {q(timely)})
            AND request_id % 29 <> 5)"""
    more = ", r.request_id IS NULL AS silent, r.next_id, r.next_content, r.next_pt, r.next_error, r.next_us" if calls else ""
    last = f"""CASE WHEN unresolved THEN error END""" if not calls else """CASE WHEN used_fallback AND provider = 'local'
        THEN 'AI provider ''local'' is not registered.' WHEN used_fallback AND next_id IS NULL THEN 'no reply'
        WHEN used_fallback THEN next_error WHEN unresolved THEN error WHEN silent AND reason IS NULL THEN 'no reply' END"""
    chosen = "" if not calls else """ REPLACE (CASE WHEN used_fallback THEN next_content ELSE content END AS content,
        CASE WHEN used_fallback THEN next_pt ELSE prompt_tokens END AS prompt_tokens,
        CASE WHEN used_fallback THEN next_us ELSE finished_us END AS finished_us)"""
    return f"""{REQUESTS}, {replies}, {chained}, {placed},
    joined AS (SELECT *, reason IS NULL AND error IS NOT NULL AS failed FROM (SELECT p.*, r.content, r.prompt_tokens,
      r.completion_tokens, CASE WHEN provider = 'local' THEN 'AI provider ''local'' is not registered.' ELSE r.error END
      AS error, r.finished_us{more} FROM placed p LEFT JOIN replies r USING (request_id))),
    {FALLBACK.replace('{source}', 'joined')},
    prior AS (SELECT *{chosen}, coalesce(reason, 'Gateway error: ' || {last}) AS r6 FROM called),
    answered AS (SELECT *, CASE WHEN r6 IS NULL THEN {reason} END AS r7, {text} AS reply FROM prior),
    finished AS (SELECT request_id, user_id, tenant_id, application_id, coalesce(r6, r7) IS NOT NULL AS blocked,
      coalesce(r6, r7) AS block_reason, coalesce(screen, CASE WHEN r7 IS NOT NULL THEN 'output-blocked-patterns' END)
      AS screen, flags, used_fallback, ts_us, finished_us, provider AS provider0, model AS model0, reply, prompt_tokens AS pt0,
      completion_tokens AS ct0 FROM answered),
    audit AS (SELECT *, CASE WHEN blocked THEN '' ELSE provider0 END AS provider,
      CASE WHEN blocked THEN '' ELSE model0 END AS model, CASE WHEN blocked THEN '' ELSE reply END AS content,
      CASE WHEN blocked THEN 0 ELSE pt0 END AS prompt_tokens, CASE WHEN blocked THEN 0 ELSE ct0 END AS completion_tokens,
      (finished_us - ts_us) / 1000.0::DOUBLE AS latency_ms, md5(request_id::VARCHAR) AS correlation_id FROM finished)"""


def _conditions() -> str:
    size = u16("prompt")
    return f"""SELECT request_id, coalesce(lower(tenant_id) = 'src1', false) AS eq_text,
      coalesce(max_tokens = 156, false) AS eq_number, false AS eq_null,
      coalesce(lower(requested_model) <> 'gpt-large', true) AS neq_null, coalesce(temperature <> 1, true) AS neq_double,
      {size} > 1000 AS gt_length, size >= 500.5 AS gte_meta, coalesce(max_tokens, 0) < 100 AS lt_null,
      coalesce(temperature, 0) <= 0.5 AS lte_double, contains(lower(application_id), 'p-e') AS contains,
      coalesce(starts_with(lower(user_id), 'u1'), false) AS startswith, true AS "exists", false AS exists_case,
      false AS unknown_op, false AS unknown_field, operation = 'summarize' AS operation FROM requests"""


def _payload(model: bool, stream: bool) -> str:
    user = "json_object('role', 'user', 'content', prompt)"
    system = "json_object('role', 'system', 'content', system_prompt)"
    fields = ["'model', model"] if model else []
    fields += [f"'messages', CASE WHEN system_prompt IS NULL OR trim(system_prompt) = '' THEN json_array({user}) "
               f"ELSE json_array({system}, {user}) END",
               "'max_tokens', coalesce(max_tokens, 1000)", "'temperature', coalesce(temperature, 0.2::DOUBLE)"]
    fields += ["'stream', false"] if stream else []
    return f"json_object({', '.join(fields)})::VARCHAR"


def _stacked(source: str, items: Sequence[tuple[str, str]], keys: str, name: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {q(label)} AS {name}, {column} AS {value} FROM {source} WHERE {column} > 0"
                              for label, column in items)


def statements() -> dict[str, str]:
    _tags = "MAP {" + ", ".join(f"{q(kind)}: {q(PATTERN[kind][2])}" for kind in SPECIFIC_FIRST) + "}"
    categories = list(enumerate(fixed.RISK_LEXICON))
    content = _sampled("text", "doc_id", REPLY_SAMPLES)
    reply_reason, reply_text = _response("content")
    clean = redacted_all("text", DEFAULT_KINDS)
    no_phone = [k for k in DEFAULT_KINDS if k != "PHONE"]
    found = ", ".join(f"CASE WHEN n_{k} > 0 THEN {q(k)} END" for k in DEFAULT_KINDS)
    kinds = f"list_filter([{found}], lambda x: x IS NOT NULL)"
    pii_reason = (f"CASE WHEN len({kinds}) > 0 THEN {q(fixed.REASON_PII)} || array_to_string({kinds}, ', ') || "
                  f"{q(fixed.REASON_PII_TAIL)} END")
    minute = "epoch_us(ts) - epoch_us(ts) % 60000000"
    custom = (f"regexp_replace({redacted_all('prompt', no_phone)}, '\\bID-\\d{{6}}\\b', '[ticket \\0 \\\\ $]', 'gi')")
    own = "CASE WHEN contains(low, 'licen') THEN 'Blocked by input guardrail' END"
    return {
        "chat_explode": f"WITH {PARTS} SELECT doc_id, part_idx, role, text FROM parts",
        "parts_rebuild": f"""WITH {PARTS} SELECT doc_id, string_agg(role || '|' || md5({clean}), ',' ORDER BY part_idx)
            AS messages FROM parts GROUP BY doc_id""",
        "chat_rebuild": f"""WITH {PROMPTS}, p AS (SELECT *, doc_id % 4 AS kind, {redacted_all('prompt', DEFAULT_KINDS)}
            AS clean, {redacted_all(_CALL, DEFAULT_KINDS)} AS call FROM prompts)
            SELECT doc_id, (CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS parts,
            CASE WHEN kind = 0 THEN 'gpt-small' END AS model, CASE WHEN kind = 0 THEN n_chars END AS max_tokens,
            CASE kind WHEN 1 THEN md5(clean) WHEN 2 THEN md5(prompt) END AS prompt_md5,
            CASE kind WHEN 2 THEN md5(json_object('messages', json_array(json_object('role', 'assistant', 'content',
              prompt, 'name', lang)), 'prompt', prompt)::VARCHAR) WHEN 3 THEN md5(prompt) END AS whole_md5,
            CASE kind WHEN 0 THEN 'system|' || md5('Answer in ' || lang) || '|' || lang || ',user|' || md5(clean) || '|'
              || lang || ',assistant|' || md5('write to me@example.com') || '|' || lang || ',user|' || md5(call) || '|'
              || lang WHEN 2 THEN 'assistant|' || md5(prompt) || '|' || lang END AS messages FROM p""",
        "body_screen": f"""WITH {PARTS}, {_chain('parts', 'text')}, v AS (SELECT doc_id, count(*) AS parts,
            bool_or(reason IS NOT NULL) AS blocked, arg_min(reason, part_idx) FILTER (WHERE reason IS NOT NULL) AS reason
            FROM chained GROUP BY doc_id) SELECT doc_id, coalesce(parts, 0) AS parts, coalesce(blocked, false) AS blocked,
            reason FROM documents LEFT JOIN v USING (doc_id)""",
        "custom_scorer": f"""WITH {PARTS}, {_chain('parts', 'text')}, x AS (SELECT *, 100 * (length(out) - length(replace(out, 'e', '')))
            / greatest(length(out), 1) AS share FROM chained), y AS (SELECT *, coalesce(reason, CASE WHEN share >= 14
            THEN 'score ' || floor(share)::BIGINT END) AS final FROM x), v AS (SELECT doc_id, count(*) AS parts,
            bool_or(final IS NOT NULL) AS blocked, arg_min(final, part_idx) FILTER (WHERE final IS NOT NULL) AS reason
            FROM y GROUP BY doc_id) SELECT doc_id, coalesce(parts, 0) AS parts, coalesce(blocked, false) AS blocked,
            reason FROM documents LEFT JOIN v USING (doc_id)""",
        "completion_extract": f"""SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3, 4) THEN {content} END AS content
            FROM documents""",
        "usage_extract": """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 3, 4) THEN n_chars // 4 ELSE 0 END AS prompt_tokens,
            CASE WHEN doc_id % 5 IN (0, 3, 4) THEN doc_id % 97 ELSE 0 END AS completion_tokens FROM documents""",
        "request_normalize": f"""WITH {REQUESTS} SELECT request_id, true AS valid, 'chat' AS operation, md5(prompt)
            AS prompt_md5, NULL::VARCHAR AS system_prompt, user_id, tenant_id, max_tokens, temperature, priority
            FROM requests""",
        "payload_build": f"""WITH {REQUESTS}, {_routed()} SELECT request_id, 'openai' AS flavor,
            md5({_payload(True, False)}) AS payload_md5 FROM placed UNION ALL SELECT request_id, 'azure-openai',
            md5({_payload(False, False)}) FROM placed UNION ALL SELECT request_id, 'ollama', md5({_payload(True, True)})
            FROM placed""",
        "screen_max_length": _verdict("doc_id", "prompts", "prompt", _too_long("t", 4000), "max-length", PROMPTS),
        "screen_injection": _verdict("doc_id", "prompts", "prompt", _injection("low"), "prompt-injection", PROMPTS),
        "screen_blocklist": _verdict(
            "page_id", "pages", "html", f"CASE WHEN {_any('low', MARKUP_PATTERNS)} THEN {q(fixed.REASON_BLOCKLIST)} END",
            "blocked-patterns", "one AS (SELECT 1)"),
        "screen_blocklist_table": f"""WITH {PROMPTS}, entries AS (SELECT DISTINCT lower(upper(substr(text, 20 + doc_id % 50,
            4 + doc_id % 20))) AS entry FROM documents WHERE doc_id % 5 = 0), low AS (SELECT doc_id, lower(prompt) AS low
            FROM prompts), hit AS (SELECT DISTINCT doc_id FROM low JOIN entries ON entry <> '' AND contains(low, entry))
            SELECT doc_id, hit.doc_id IS NOT NULL AS blocked, CASE WHEN blocked THEN 'blocked-patterns' END AS screen,
            CASE WHEN blocked THEN {q(fixed.REASON_BLOCKLIST)} END AS reason FROM prompts LEFT JOIN hit USING (doc_id)""",
        "risk_scores": f"WITH {PROMPTS}, {_scores('prompts', 'prompt')} "
                       + _stacked("scored", [(c, f"s{i}") for i, c in categories], "doc_id", "category", "score"),
        "risk_block": f"""WITH {PROMPTS}, {_scores('prompts', 'prompt')}, r AS (SELECT doc_id,
            {_risk_reason(0.4, {'hate': 0.6})} AS reason FROM scored) SELECT doc_id, reason IS NOT NULL AS blocked,
            CASE WHEN reason IS NOT NULL THEN 'semantic' END AS screen, reason FROM r""",
        "risk_flags": f"""WITH {PROMPTS}, {_scores('prompts', 'prompt')}, f AS (SELECT *,
            {_flagged(0.3, {}, "{c} || ':' || printf('%.2f', {s})")} AS flags FROM scored)
            SELECT doc_id, false AS blocked, CASE WHEN len(flags) > 0 THEN array_to_string(flags, ',') END AS flags,
            CASE WHEN len(flags) > 0 THEN ({' + '.join(f'(s{i} > 0)::INT' for i, _ in categories)})::BIGINT END AS scored,
            CASE WHEN len(flags) > 0 AND s0 > 0 THEN s0 END AS violence FROM f""",
        "pii_redact": f"WITH {PROMPTS} SELECT doc_id, {redacted_all('prompt', DEFAULT_KINDS)} AS prompt FROM prompts",
        "pii_redact_all": f"WITH {PROMPTS} SELECT doc_id, {redacted_all('prompt', ALL_KINDS)} AS prompt FROM prompts",
        "pii_specific": f"""WITH {PROMPTS}, {_spans('prompts', 'prompt', SPECIFIC_FIRST)}, x AS (SELECT doc_id, prompt,
            unnest(list_sort(kept)) AS k FROM spanned), y AS (SELECT doc_id, string_agg(substr(prompt, before + 1,
            k.a - before) || {_tags}[k.kind], '' ORDER BY k.a) || substr(any_value(prompt), max(k.b) + 1) AS prompt
            FROM (SELECT *, coalesce(lag(k.b) OVER (PARTITION BY doc_id ORDER BY k.a), 0) AS before FROM x) GROUP BY doc_id)
            SELECT doc_id, coalesce(y.prompt, p.prompt) AS prompt FROM prompts p LEFT JOIN y USING (doc_id)""",
        "pii_spans": f"""WITH {PROMPTS}, {_spans('prompts', 'prompt', SPECIFIC_FIRST)}, x AS (SELECT doc_id, unnest(kept) AS k
            FROM spanned) SELECT doc_id, k.kind AS type, k.a AS start, k.b AS stop FROM x""",
        "pii_findings": f"WITH {PROMPTS}, {_steps('prompts', 'prompt', ALL_KINDS)} " + _stacked(
            f"p{len(ALL_KINDS)}", [(k, f"n_{k}") for k in ALL_KINDS], "doc_id", "type", "n"),
        "pii_report": f"WITH {PROMPTS}, {_steps('prompts', 'prompt', DEFAULT_KINDS)}, f AS (" + _stacked(
            f"p{len(DEFAULT_KINDS)}", [(k, f"n_{k}") for k in DEFAULT_KINDS], "doc_id", "type", "n")
            + ") SELECT type, sum(n)::BIGINT AS matches, count(*) AS texts FROM f GROUP BY type",
        "pii_block": f"""WITH {PROMPTS}, {_steps('prompts', 'prompt', DEFAULT_KINDS)}, r AS (SELECT *, {pii_reason}
            AS reason FROM p{len(DEFAULT_KINDS)}) SELECT doc_id, reason IS NOT NULL AS blocked, CASE WHEN reason IS NOT
            NULL THEN 'pii-detection' END AS screen, reason, md5(prompt) AS text_md5 FROM r""",
        "pii_custom": f"WITH {PROMPTS} SELECT doc_id, md5({custom}) AS text_md5 FROM prompts",
        "secret_scan": f"WITH {PROMPTS}, k AS (SELECT doc_id, " + ", ".join(
            f"len(regexp_extract_all(prompt, {q(p)})) AS k{i}" for i, (_, p, _, _) in enumerate(fixed.SECRET_KINDS))
            + " FROM prompts) " + _stacked("k", [(k, f"k{i}") for i, (k, *_) in enumerate(fixed.SECRET_KINDS)], "doc_id",
                                          "kind", "n"),
        "custom_screen": f"""WITH {PROMPTS}, r AS (SELECT doc_id, prompt, lower(prompt) AS low FROM prompts), s AS (SELECT
            doc_id, prompt, {_injection('low')} AS r1, {own} AS r2 FROM r) SELECT doc_id, coalesce(r1, r2) IS NOT NULL
            AS blocked, CASE WHEN r1 IS NOT NULL THEN 'prompt-injection' WHEN r2 IS NOT NULL THEN 'license-talk' END
            AS screen, coalesce(r1, r2) AS reason, md5(CASE WHEN coalesce(r1, r2) IS NULL THEN replace(prompt, chr(10),
            ' ') ELSE prompt END) AS text_md5 FROM s""",
        "screen_chain": f"""WITH {PROMPTS}, {_chain('prompts', 'prompt')} SELECT doc_id, reason IS NOT NULL AS blocked,
            screen, reason, md5(out) AS text_md5 FROM chained""",
        "conversation_verdict": f"""WITH {TURNS}, said AS (SELECT * FROM turns WHERE role IN ('user', 'system')),
            {_chain('said', 'text')} SELECT conv_id, count(*) AS parts, bool_or(reason IS NOT NULL) AS blocked,
            min(turn) FILTER (WHERE reason IS NOT NULL) AS blocked_part,
            arg_min(reason, turn) FILTER (WHERE reason IS NOT NULL) AS reason FROM chained GROUP BY conv_id""",
        "screen_response_blocklist": f"""WITH {ANSWERS}, r AS (SELECT *, {reply_reason} AS reason FROM answers)
            SELECT conv_id, turn, reason IS NOT NULL AS blocked, CASE WHEN reason IS NOT NULL THEN
            'output-blocked-patterns' END AS screen, reason FROM r""",
        "response_redact": f"WITH {ANSWERS} SELECT conv_id, turn, {reply_text} AS content FROM answers",
        "response_chain": f"""WITH {ANSWERS}, r AS (SELECT *, {reply_reason} AS reason FROM answers) SELECT conv_id, turn,
            reason IS NOT NULL AS blocked, CASE WHEN reason IS NOT NULL THEN 'output-blocked-patterns' END AS screen,
            reason, md5(CASE WHEN reason IS NULL THEN {reply_text} ELSE content END) AS text_md5 FROM r""",
        "reply_screen": f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3, 4) THEN {content} ELSE '' END
            AS content FROM documents), r AS (SELECT *, {reply_reason} AS reason FROM c) SELECT doc_id,
            reason IS NOT NULL AS blocked, CASE WHEN reason IS NOT NULL THEN 'output-blocked-patterns' END AS screen,
            reason, md5(CASE WHEN reason IS NULL THEN {reply_text} ELSE content END) AS text_md5 FROM r""",
        "reply_rebuild": f"""WITH c AS (SELECT doc_id, doc_id % 5 AS kind, {content} AS content, n_chars // 4 AS used FROM documents),
            r AS (SELECT *, CASE WHEN kind IN (1, 3, 4) THEN {reply_reason} END AS reason, CASE WHEN kind IN (1, 3, 4)
              THEN {reply_text} ELSE content END AS back FROM c), s AS (SELECT *, reason IS NULL AND back = content AS same FROM r)
            SELECT doc_id, CASE WHEN reason IS NULL THEN 200 ELSE 422 END::BIGINT AS status, reason IS NOT NULL AS blocked, same,
            reason AS block_reason, CASE WHEN reason IS NULL AND NOT same THEN 'assistant' END AS role,
            CASE WHEN reason IS NULL AND NOT same THEN md5(back) END AS content_md5,
            CASE WHEN reason IS NULL AND NOT same AND kind <> 1 THEN used::VARCHAR END AS prompt_tokens FROM s""",
        "screen_report": f"""WITH {PROMPTS}, {_chain('prompts', 'prompt')} SELECT source, lang, count(*) AS texts,
            count(*) FILTER (WHERE reason IS NOT NULL) AS blocked,
            count(*) FILTER (WHERE reason IS NULL AND out <> prompt) AS redacted FROM chained
            GROUP BY ROLLUP (source, lang)""",
        "block_reasons": f"""WITH {PROMPTS}, {_chain('prompts', 'prompt')} SELECT screen, reason, count(*) AS texts
            FROM chained WHERE reason IS NOT NULL GROUP BY ALL""",
        "route_conditions": f"WITH {REQUESTS} {_conditions()}",
        "route_requests": f"WITH {REQUESTS}, {_routed()} SELECT request_id, provider, model, route_rule FROM placed",
        "route_fallback": f"""WITH {REQUESTS}, {_routed()}, f AS (SELECT *, request_id % 9 = 0 AS failed FROM placed),
            {FALLBACK.replace('{source}', 'f')} SELECT request_id, provider, model, used_fallback, unresolved, flags
            FROM called""",
        "route_deployment": f"""WITH {REQUESTS}, {_routed()}, f AS (SELECT *, request_id % 9 = 0 AS failed FROM placed),
            {FALLBACK.replace('{source}', 'f')} SELECT request_id, provider, CASE WHEN provider = 'azure' AND model =
            'gpt-large' THEN 'large-eu' WHEN provider = 'azure' AND model = 'gpt-small' THEN 'small-eu' ELSE model END
            AS deployment FROM called""",
        "route_flags": f"""WITH {REQUESTS}, {_scores('requests', 'prompt')}, {_routed('scored')}, f AS (SELECT *, CASE
            WHEN route_rule = 'requested' THEN route_rule WHEN s0 >= 0.3::DOUBLE THEN 'violent' WHEN
            len({_flagged(0.3, {})}) > 0 THEN 'flagged' ELSE route_rule END AS rule FROM placed) SELECT request_id,
            CASE rule WHEN 'violent' THEN 'azure' WHEN 'flagged' THEN 'local' ELSE provider END AS provider,
            CASE rule WHEN 'violent' THEN 'gpt-large' WHEN 'flagged' THEN 'tiny' ELSE model END AS model,
            rule AS route_rule FROM f""",
        "route_report": f"""WITH {REQUESTS}, {_routed()} SELECT provider, model, route_rule, count(*) AS requests
            FROM placed GROUP BY ALL""",
        "quota_keys": f"""WITH {REQUESTS} SELECT request_id, 'rate:user:' || coalesce(user_id, 'anonymous') AS user_key,
            'rate:tenant:' || coalesce(tenant_id, 'default') AS tenant_key, 'rate:app:' || application_id
            AS application_key, 'rate:global' AS other_key FROM requests""",
        "quota_replay": _REPLAY,
        "quota_global": _GLOBAL,
        "quota_stream": _REPLAY,
        "quota_stream_ordered": f"""{_REPLAY} WHERE (us // {QUOTA_SECONDS * 1_000_000} + 1) * {QUOTA_SECONDS * 1_000_000}
            <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM ev)""",
        "quota_multi": f"""WITH RECURSIVE {EVENTS}, {_replayed('ev', "'rate:user:' || user_id", 'w')},
            kept AS (SELECT request_id, us, user_id, tenant_id FROM w WHERE n <= {QUOTA_LIMIT}),
            {_replayed('kept', "'rate:tenant:' || tenant_id", 'v')}, d AS (
            SELECT request_id, 'user' AS scope, {QUOTA_LIMIT} AS lim FROM w WHERE n > {QUOTA_LIMIT} UNION ALL
            SELECT request_id, CASE WHEN n > {TENANT_LIMIT} THEN 'tenant' END, {TENANT_LIMIT} FROM v)
            SELECT request_id, scope IS NOT NULL AS denied, scope AS denied_by, 'Gateway error: Rate limit exceeded for '
            || scope || ': ' || lim || ' requests/min' AS deny_reason FROM d""",
        "quota_shared": f"""WITH RECURSIVE {EVENTS},
            {_shared('ev', "'rate:user:' || user_id", 'w', [n for s, n in SHARED_LIMITS if s.lower() == 'user'])},
            kept AS (SELECT request_id, us, user_id, tenant_id FROM w WHERE rule IS NULL),
            {_shared('kept', "'rate:tenant:' || tenant_id", 'v', [n for s, n in SHARED_LIMITS if s.lower() == 'tenant'])},
            d AS (SELECT request_id, rule FROM w WHERE rule IS NOT NULL UNION ALL SELECT request_id, rule + 2 FROM v),
            named AS (SELECT request_id, {_list(s for s, _ in SHARED_LIMITS)}[rule + 1] AS scope,
              {[n for _, n in SHARED_LIMITS]}[rule + 1] AS lim FROM d)
            SELECT request_id, scope IS NOT NULL AS denied, scope AS denied_by, 'Gateway error: Rate limit exceeded for '
            || scope || ': ' || lim || ' requests/min' AS deny_reason FROM named""",
        "usage_budget": """WITH e AS (SELECT event_id AS request_id, 'rate:tenant:' || event_type AS quota_key,
            strftime(ts, '%Y-%m') AS month, ts, value::DECIMAL(18,6) AS cost, length(props) AS tokens FROM events), s AS (
            SELECT *, sum(cost) OVER w AS spent, sum(tokens) OVER w AS tokens_used FROM e WINDOW w AS (PARTITION BY
            quota_key, month ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING)) SELECT request_id, quota_key, month,
            spent::DOUBLE AS spent, tokens_used::BIGINT AS tokens_used, spent > 5000 AS over_budget FROM s""",
        "audit_build": f"""WITH {_finished()} SELECT request_id, correlation_id, user_id, tenant_id, application_id,
            provider, model, prompt_tokens, completion_tokens, 0.0::DOUBLE AS cost, blocked, block_reason, flags,
            NULL::VARCHAR AS error, ts_us AS started_at_us, finished_us AS finished_at_us, latency_ms FROM audit""",
        "route_attempts": f"""WITH {_finished(True)} SELECT request_id, provider, model, used_fallback, blocked,
            block_reason AS reason, coalesce(prompt_tokens, 0) AS prompt_tokens, flags, md5(coalesce(content, '')) AS content_md5
            FROM audit""",
        "audit_full": f"""WITH RECURSIVE {_finished(True, True)} SELECT request_id, correlation_id, user_id, provider, model,
            coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, blocked,
            block_reason, flags, finished_us AS finished_at_us, latency_ms FROM audit""",
        "audit_table": f"""WITH {_finished()} SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, count(*) AS requests,
            count(*) FILTER (WHERE blocked) AS blocked, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM audit GROUP BY 1""",
        "outcome_rows": f"""WITH {_finished()} SELECT request_id, CASE WHEN blocked THEN 422 ELSE 200 END AS status,
            blocked, screen, md5(content) AS content_md5 FROM audit""",
        "audit_lines": f"""WITH {_finished()} SELECT request_id, 'AI_GATEWAY correlation=' || correlation_id || ' user=' ||
            coalesce(user_id, '(null)') || ' tenant=' || coalesce(tenant_id, '(null)') || ' provider=' || provider ||
            ' model=' || model || ' blocked=' || CASE WHEN blocked THEN 'True' ELSE 'False' END || ' promptTokens=' ||
            prompt_tokens || ' completionTokens=' || completion_tokens || ' cost=0 latencyMs=' ||
            regexp_replace(latency_ms::VARCHAR, '\\.0$', '') || ' flags=' || flags AS line FROM audit""",
        "usage_rollup": f"""WITH {_finished()}, d AS (SELECT *, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day,
            floor(latency_ms)::BIGINT AS ms FROM audit), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id,
            provider, model, day ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id, provider, model, day) AS n
            FROM d) SELECT tenant_id, provider, model, day, count(*) AS requests, count(*) FILTER (WHERE blocked)
            AS blocked, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
            min(ms) FILTER (WHERE rn >= ceil(n * 0.5::DOUBLE)) AS p50_ms,
            min(ms) FILTER (WHERE rn >= ceil(n * 0.95::DOUBLE)) AS p95_ms,
            round(count(*) FILTER (WHERE blocked) / count(*), 6) AS block_rate FROM r GROUP BY ALL""",
        "usage_subtotals": f"""WITH {_finished()}, d AS (SELECT *, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day,
            floor(latency_ms)::BIGINT AS ms FROM audit), """ + ", ".join(
            f"r{n} AS (SELECT {', '.join(k if i < n else 'NULL AS ' + k for i, k in enumerate(('tenant_id', 'provider', 'day')))}, "
            f"{n} AS level, blocked, prompt_tokens, completion_tokens, ms, row_number() OVER (PARTITION BY {by} ORDER BY ms) AS rn, "
            f"count(*) OVER (PARTITION BY {by}) AS n FROM d)"
            for n, by in enumerate(("1", "tenant_id", "tenant_id, provider", "tenant_id, provider, day"))) + """,
            r AS (SELECT * FROM r3 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r0)
            SELECT tenant_id, provider, day, level::BIGINT AS level, count(*) AS requests, count(*) FILTER (WHERE blocked)
            AS blocked, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
            min(ms) FILTER (WHERE rn >= ceil(n * 0.5::DOUBLE)) AS p50_ms,
            min(ms) FILTER (WHERE rn >= ceil(n * 0.95::DOUBLE)) AS p95_ms,
            round(count(*) FILTER (WHERE blocked) / count(*), 6) AS block_rate FROM r GROUP BY tenant_id, provider, day, level""",
        "audit_rerun": f"""WITH {_finished()} SELECT CASE WHEN request_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run,
            strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, count(*) AS requests,
            sum(completion_tokens)::BIGINT AS completion_tokens FROM audit GROUP BY 1, 2""",
        "audit_stream": f"""WITH {_finished(timely=PATIENCE)} SELECT request_id, correlation_id, user_id, provider, model,
            coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, blocked,
            block_reason, flags, finished_us AS finished_at_us, latency_ms FROM audit""",
        "audit_minutes": f"""WITH m AS (SELECT {minute} AS minute_us, count(*) AS requests,
            count(*) FILTER (WHERE event_type = 'error') AS blocked FROM events GROUP BY 1) SELECT *, blocked / requests
            AS block_rate FROM m WHERE minute_us + 60000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
    }
