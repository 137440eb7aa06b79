"""DuckDB SQL for every checked query (the correctness oracle).

Shared derived inputs are common table expressions; ``build(sql)`` prepends
exactly the ones a query references, in dependency order.
"""

from __future__ import annotations

import re

from ..functions import fixed

# Python's str.strip() white space spelled out for RE2 (used by py_strip).
_WS = r"[\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def mtok(x: str) -> str:
    """metric tokens: lower, split on non letter/digit, drop empties."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def wstok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '')"


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _agent_values() -> str:
    rows = [f"({a}, '{ch}')" for a, chs in fixed.AGENT_CHAPTERS.items() for ch in chs]
    return ", ".join(rows)


CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


cte("turns", "SELECT conv_id, turn, role, text, printf('ch%02d', conv_id % 27) AS chapter FROM conversations")
cte("pairs", f"""
SELECT u.conv_id * 1000000 + u.turn AS pair_id, u.conv_id, u.turn, u.chapter,
       {strip('u.text')} AS input_text, {strip('a.text')} AS target_text
FROM turns u JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE lower(u.role) = 'user' AND lower(a.role) = 'assistant'""")
cte("agent_map", f"SELECT * FROM (VALUES {_agent_values()}) t(agent, chapter)")
cte("assigned", "SELECT p.*, m.agent FROM pairs p LEFT JOIN agent_map m ON p.chapter = m.chapter")
cte("sr_keyed", """
SELECT *, md5('196|' || CAST(pair_id AS VARCHAR)) AS split_key,
       row_number() OVER (PARTITION BY agent ORDER BY md5('196|' || CAST(pair_id AS VARCHAR)), pair_id) AS shuffle_rank,
       count(*) OVER (PARTITION BY agent) AS n_in_agent
FROM assigned WHERE agent IS NOT NULL""")
cte("splits", """
SELECT *, CASE WHEN shuffle_rank <= (n_in_agent * 8) // 10 THEN 'train' ELSE 'test' END AS split,
       CASE WHEN shuffle_rank <= (n_in_agent * 8) // 10 THEN shuffle_rank
            ELSE shuffle_rank - (n_in_agent * 8) // 10 END AS split_rank
FROM sr_keyed""")
cte("orch", """
SELECT *, row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, agent, split_rank, pair_id) AS orch_pos,
       count(*) OVER () AS orch_n
FROM splits""")
cte("orch_split", """
SELECT *, CASE WHEN orch_pos <= (orch_n * 8) // 10 THEN 'train' ELSE 'test' END AS orch_split
FROM orch""")


def build(sql: str) -> str:
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str, own: str | None = None) -> None:
        for name in CTES:
            if name == own or name in seen:
                continue
            if re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(CTES[name], name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ordered = [n for n in CTES if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + sql.strip()


QUERIES_SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    QUERIES_SQL[name] = sql


q("qa_pairs", "SELECT pair_id, conv_id, turn, chapter, input_text, target_text FROM pairs")
q("agent_assign", "SELECT pair_id, chapter, coalesce(agent, 0) AS agent FROM assigned")
q("qa_count_by_agent", "SELECT coalesce(agent, 0) AS agent, count(*) AS n_pairs FROM assigned GROUP BY 1")
q("split_random", "SELECT pair_id, agent, split, shuffle_rank, split_rank FROM splits")
q("split_hash", """
SELECT pair_id, CASE WHEN ('0x' || substr(md5('196|' || CAST(pair_id AS VARCHAR)), 1, 8))::BIGINT
                          < (4294967296 * 8) // 10 THEN 'train' ELSE 'test' END AS split
FROM pairs""")
q("split_ordered", """
SELECT pair_id, pos, CASE WHEN pos <= (n * 9) // 10 THEN 'train' ELSE 'test' END AS split
FROM (SELECT pair_id, row_number() OVER (ORDER BY chapter, conv_id, turn, pair_id) AS pos,
             count(*) OVER () AS n FROM pairs)""")
q("orchestrator_union", "SELECT pair_id, agent, split, orch_pos FROM orch")
q("orchestrator_split", """
SELECT pair_id, agent, split, orch_split, orch_split <> split AS moved FROM orch_split""")
q("shard_assign", """
SELECT pair_id, CAST((r - 1) % 4 AS INTEGER) AS shard
FROM (SELECT pair_id, row_number() OVER (ORDER BY md5('196|' || CAST(pair_id AS VARCHAR)), pair_id) AS r,
             count(*) OVER () AS n FROM splits WHERE split = 'train')
WHERE r <= (n // 4) * 4""")
q("fixed_batches", """
SELECT pair_id, agent, CAST((r - 1) // 4 AS BIGINT) AS batch, CAST((r - 1) % 4 AS INTEGER) AS batch_pos
FROM (SELECT pair_id, agent, row_number() OVER (PARTITION BY agent ORDER BY split_rank, pair_id) AS r
      FROM splits WHERE split = 'test')""")


def oracle_sql() -> dict[str, str]:
    return {name: build(sql) for name, sql in QUERIES_SQL.items()}


# ---------------------------------------------------------------------------
# validation and statistics

def _wscount(x: str) -> str:
    return f"len({wstok(x)})"


cte("ex_stats", f"""
SELECT conv_id, count(*) AS n_messages,
       CAST(sum(3 + {_wscount('role')} + {_wscount("coalesce(text, '')")}) + 3 AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN {_wscount('text')} ELSE 0 END) AS BIGINT) AS n_assistant_tokens,
       max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS has_system,
       max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS has_user
FROM conversations GROUP BY conv_id""")

q("missing_roles", """
SELECT count(*) AS n_examples, CAST(sum(1 - has_system) AS BIGINT) AS n_missing_system,
       CAST(sum(1 - has_user) AS BIGINT) AS n_missing_user
FROM ex_stats""")
q("token_estimate", "SELECT conv_id, n_messages, n_tokens, n_assistant_tokens FROM ex_stats")
q("token_limit", f"SELECT count(*) FILTER (WHERE n_tokens > {fixed.MAX_TOKENS_PER_EXAMPLE}) AS n_over_limit, count(*) AS n_examples FROM ex_stats")
q("epoch_plan", f"""
SELECT n_examples, billing_tokens, n_epochs, n_epochs * billing_tokens AS charged_tokens
FROM (SELECT n_examples, billing_tokens,
             CAST(CASE WHEN n_examples * 3 < 100 THEN least(25, floor(100 / n_examples))
                       WHEN n_examples * 3 > 25000 THEN greatest(1, floor(25000 / n_examples))
                       ELSE 3 END AS BIGINT) AS n_epochs
      FROM (SELECT count(*) AS n_examples, CAST(sum(least(n_tokens, {fixed.MAX_TOKENS_PER_EXAMPLE})) AS BIGINT) AS billing_tokens FROM ex_stats))""")


def _dist(col: str, name: str) -> str:
    return f"""SELECT '{name}' AS metric, round(min({col})::DOUBLE, 6) AS min, round(max({col})::DOUBLE, 6) AS max,
       round(avg({col}), 6) AS mean, round(quantile_cont({col}, 0.5), 6) AS median,
       round(quantile_cont({col}, 0.1), 6) AS p10, round(quantile_cont({col}, 0.9), 6) AS p90 FROM ex_stats"""


q("distributions", "\nUNION ALL\n".join([
    _dist("n_messages", "num_messages_per_example"), _dist("n_tokens", "num_total_tokens_per_example"),
    _dist("n_assistant_tokens", "num_assistant_tokens_per_example")]))

cte("chat_lines", """
SELECT pair_id, CASE pair_id % 7
  WHEN 0 THEN json_object('messages', json_array(json_object('role', 'system', 'content', 'Chapter ' || chapter),
                json_object('role', 'user', 'content', input_text), json_object('role', 'assistant', 'content', target_text)))::VARCHAR
  WHEN 1 THEN json_object('messages', json_array(json_object('role', 'user', 'content', input_text),
                json_object('role', 'assistant', 'function_call', 'f')))::VARCHAR
  WHEN 2 THEN json_object('messages', json_array(json_object('role', 'system', 'content', 'Chapter ' || chapter),
                json_object('role', 'user', 'content', input_text, 'weight_x', '1'),
                json_object('role', 'assistant', 'content', target_text)))::VARCHAR
  WHEN 3 THEN json_object('messages', json_array(json_object('role', 'User', 'content', ''),
                json_object('role', 'assistant', 'content', target_text)))::VARCHAR
  WHEN 4 THEN '{"messages":[]}'
  WHEN 5 THEN CAST(turn AS VARCHAR)
  ELSE json_object('messages', json_array(json_object('role', 'system', 'content', 'Chapter ' || chapter),
                json_object('role', 'user', 'content', input_text)))::VARCHAR END AS line
FROM pairs""")
cte("chat_ex", """
SELECT pair_id, line, coalesce(json_type(line) = 'OBJECT', false) AS is_obj,
       CASE WHEN json_type(line) = 'OBJECT' AND json_type(line, '$.messages') = 'ARRAY'
            THEN json_array_length(line, '$.messages') ELSE 0 END AS n_msg
FROM chat_lines""")
cte("chat_msgs", """
SELECT pair_id, unnest(json_extract(line, '$.messages[*]')) AS m FROM chat_ex WHERE is_obj AND n_msg > 0""")
cte("chat_flags", """
SELECT pair_id,
  NOT (list_contains(json_keys(m), 'role') AND list_contains(json_keys(m), 'content')) AS missing_key,
  len(list_filter(json_keys(m), lambda k: k NOT IN ('role', 'content', 'name', 'function_call', 'weight'))) > 0 AS unrec_key,
  coalesce(json_extract_string(m, '$.role') NOT IN ('system', 'user', 'assistant', 'function'), true) AS unrec_role,
  (NOT (coalesce(json_type(m, '$.content') = 'VARCHAR', false) AND coalesce(json_extract_string(m, '$.content') <> '', false))
   AND NOT coalesce(CASE json_type(m, '$.function_call')
        WHEN 'VARCHAR' THEN json_extract_string(m, '$.function_call') <> ''
        WHEN 'OBJECT' THEN json_extract_string(m, '$.function_call') <> '{}'
        WHEN 'ARRAY' THEN json_array_length(m, '$.function_call') > 0
        WHEN 'BOOLEAN' THEN json_extract_string(m, '$.function_call') = 'true'
        WHEN 'NULL' THEN false
        ELSE CAST(json_extract_string(m, '$.function_call') AS DOUBLE) <> 0 END, false))
  OR NOT coalesce(json_type(m, '$.content') = 'VARCHAR', false) AS missing_content,
  coalesce(json_extract_string(m, '$.role') = 'assistant', false) AS is_asst
FROM chat_msgs""")
q("format_errors", """
SELECT kind, count(*) AS n FROM (
  SELECT 'data_type' AS kind FROM chat_ex WHERE NOT is_obj
  UNION ALL SELECT 'missing_messages_list' FROM chat_ex WHERE is_obj AND n_msg = 0
  UNION ALL SELECT 'message_missing_key' FROM chat_flags WHERE missing_key
  UNION ALL SELECT 'message_unrecognized_key' FROM chat_flags WHERE unrec_key
  UNION ALL SELECT 'unrecognized_role' FROM chat_flags WHERE unrec_role
  UNION ALL SELECT 'missing_content' FROM chat_flags WHERE missing_content
  UNION ALL SELECT 'example_missing_assistant_message' FROM
     (SELECT pair_id, bool_or(is_asst) AS a FROM chat_flags GROUP BY pair_id) WHERE NOT a
) GROUP BY kind""")

# ---------------------------------------------------------------------------
# dialogs, chat examples, prompts

q("dialog_history", """
SELECT conv_id, turn, n_history, history_chars, md5(array_to_string(h, chr(30))) AS history_md5
FROM (SELECT conv_id, turn, role,
        count(*) OVER w AS n_history, CAST(sum(length(text)) OVER w AS BIGINT) AS history_chars,
        list(role || ':' || text) OVER w AS h
      FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE role = 'user'""")
cte("dlg_docs", """
SELECT pair_id, to_json([[{'role': 'user', 'content': input_text},
                          {'role': 'assistant', 'content': target_text}]])::VARCHAR AS doc FROM pairs""")
cte("dlg_dialogs", """
SELECT pair_id, unnest(json_extract(doc, '$[*]')) AS dialog,
       unnest(generate_series(0, CAST(json_array_length(doc) AS BIGINT) - 1)) AS dialog_idx FROM dlg_docs""")
q("dialogs_explode", """
SELECT pair_id, CAST(dialog_idx AS INTEGER) AS dialog_idx, CAST(turn AS INTEGER) AS turn,
       json_extract_string(m, '$.role') AS role, json_extract_string(m, '$.content') AS content
FROM (SELECT pair_id, dialog_idx, unnest(json_extract(dialog, '$[*]')) AS m,
             unnest(generate_series(0, CAST(json_array_length(dialog) AS BIGINT) - 1)) AS turn FROM dlg_dialogs)""")
_ch2 = ", ".join(sq(c) for c in fixed.AGENT_CHAPTERS[2])
q("chapter_filter", f"""
SELECT conv_id, turn, path FROM (
  SELECT conv_id, turn, 'qa_pairs/' || chapter || '/conv' || CAST(conv_id AS VARCHAR) || '_qa_pairs.json' AS path
  FROM turns) WHERE len(list_filter([{_ch2}], lambda c: contains(path, c))) > 0""")
q("chat_format", f"""
SELECT pair_id, 3 AS n_messages, {sq(fixed.SYSTEM_PROMPT)} AS system_content, input_text AS user_content,
       target_text AS assistant_content FROM pairs""")
_H, _M, _T = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"


def _render(role: str, content: str) -> str:
    return f"{sq(_H)} || {role} || {sq(_M)} || {content} || {sq(_T)}"


q("chat_render", f"""
SELECT pair_id, {_render("'system'", sq(fixed.SYSTEM_PROMPT))} || {_render("'user'", 'input_text')}
       || {_render("'assistant'", 'target_text')} AS chat_text FROM pairs""")
_ap_head, _ap_tail = fixed.ANSWER_PROMPT.split("{question}")
q("answer_prompt", f"SELECT pair_id, {sq(_ap_head)} || input_text || {sq(_ap_tail)} AS prompt, target_text AS answer FROM pairs")
q("gen_prompt", f"""
SELECT doc_id, 2 AS n_messages, {sq(fixed.SYSTEM_PROMPT)} AS system_prompt,
       {sq(fixed.USER_PROMPT.format(100))} || text || {sq(chr(10) + fixed.KNOWLEDGE_END)} AS user_prompt
FROM documents""")
cte("completions", """
SELECT pair_id, CASE (conv_id + turn) % 4
  WHEN 0 THEN hd || s1
  WHEN 1 THEN hd || s1 || chr(10) || s2 || chr(10) || '(more)'
  WHEN 2 THEN hd || replace(s1, '","content":"', '","content:" "')
  ELSE hd || s1 || chr(10) || '[{''role'':''user'',''content'':''more''}]' END AS content
FROM (SELECT pair_id, conv_id, turn, 'FACT ' || CAST(turn AS VARCHAR) || ':' || chr(10) AS hd,
        to_json([{'role': 'user', 'content': input_text}, {'role': 'assistant', 'content': target_text}])::VARCHAR AS s1,
        to_json([{'role': 'user', 'content': target_text}, {'role': 'assistant', 'content': input_text}])::VARCHAR AS s2
      FROM pairs)""")
q("parse_completion", f"""
SELECT pair_id, CASE WHEN ok THEN len(spans) ELSE -1 END AS n_dialogs,
       CASE WHEN ok THEN json_extract_string({strip('spans[1]')}, '$[0].content') END AS first_question
FROM (SELECT pair_id, spans, coalesce(list_bool_and(list_transform(spans, lambda s: json_valid({strip('s')}))), true) AS ok
      FROM (SELECT pair_id, regexp_extract_all(content, '{fixed.QA_SPAN_PATTERN}', 1) AS spans FROM completions))""")


# ---------------------------------------------------------------------------
# pages, sections, logs
# patterns of this oracle's own: the given pages spell only these entities, quote every href with " and nest no menu
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
             ("&nbsp;", chr(160)), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_NOISE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_MENU_ITEM = r'(?is)<li\b[^>]*>\s*<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>\s*</li>'


def decode(x: str) -> str:
    for ent, ch in _ENTITIES:
        x = f"replace({x}, {sq(ent)}, {sq(ch)})"
    return x


def block_text(x: str) -> str:
    return strip(decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def urljoin(b: str, h: str) -> str:
    return f"""CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h}
 WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {h}
 WHEN starts_with({h}, '/') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {h}
 WHEN starts_with({h}, '#') THEN regexp_replace({b}, '#.*$', '') || {h}
 WHEN starts_with({h}, '?') THEN regexp_replace({b}, '[?#].*$', '') || {h}
 WHEN {h} = '' THEN regexp_replace({b}, '#.*$', '')
 ELSE regexp_replace(regexp_replace({b}, '[?#].*$', ''), '[^/]*$', '') || {h} END"""


cte("pages_clean", f"SELECT page_id, url, regexp_replace(html, {sq(_NOISE)}, '', 'g') AS h FROM pages")
q("page_headings", f"""
SELECT page_id, '# ' || {block_text("regexp_extract(regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")} AS heading
FROM pages_clean""")
cte("toc_items", f"""
SELECT page_id, url, hrefs, names, unnest(generate_series(1, len(hrefs))) AS i
FROM (SELECT page_id, url, regexp_extract_all(menu, {sq(_MENU_ITEM)}, 1) AS hrefs,
             regexp_extract_all(menu, {sq(_MENU_ITEM)}, 2) AS names
      FROM (SELECT page_id, url, regexp_extract(h, '(?is)<nav\\b[^>]*>(.*?)</nav\\s*>', 1) AS menu FROM pages_clean))""")
q("toc_links", f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS chapter_no, 0 AS section_no, {block_text('names[i]')} AS section_name,
       {urljoin('url', 'hrefs[i]')} AS url, printf('ch%02d/sec00.txt', i - 1) AS text_location
FROM toc_items""")
# pages and menus derived from the documents: what they say is known from their pieces, no page is parsed here
cte("handbook_lines", f"""
SELECT doc_id AS page_id, coalesce(source, 'none') AS source,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {strip('l')} <> '') AS ls FROM documents""")
cte("handbook_head", """SELECT page_id, ls, '## ' || source || '’s page — ¬it; &amp;' AS head FROM handbook_lines""")
q("page_text_handbook", f"""
SELECT page_id, array_to_string(list_concat([head], flatten(list_transform(range(0, len(ls)), lambda i:
         CASE WHEN i % 4 = 2 THEN ['• ' || {strip('ls[i + 1]')}, '• more © ' || i] ELSE [{strip('ls[i + 1]')}] END))), chr(10) || chr(10)) AS text
FROM handbook_head""")
q("page_text_nested", f"""
SELECT page_id, array_to_string(list_concat([head], flatten(list_transform(range(0, len(ls)), lambda i:
         CASE WHEN i % 4 = 2 THEN ['• ' || {strip("ls[i + 1] || 'more © ' || i")}, '• more © ' || i]
              WHEN i = 3 THEN [{strip("array_to_string(list_transform(range(3, len(ls)), lambda j: ls[j + 1] || CASE WHEN j % 4 = 2 THEN 'more © ' || j ELSE '' END), '')")}]
              ELSE [{strip('ls[i + 1]')}] END))), chr(10) || chr(10)) AS text
FROM handbook_head""")
cte("menu_chapters", """
SELECT page_id, source, c, CASE WHEN (page_id + c) % 3 = 0 THEN 0 ELSE (page_id + c) % 4 + 1 END AS n
FROM (SELECT doc_id AS page_id, coalesce(source, 'none') AS source, unnest(range(0, doc_id % 5 + 1)) AS c FROM documents WHERE doc_id IS NOT NULL)""")
q("toc_menus", """
SELECT page_id, c::INTEGER AS chapter_no, 'Ch & ' || c || '’' AS chapter_name, 0 AS section_no, 'Ch & ' || c || '’' AS section_name,
       'https://h.org/' || source || '/dir/page' || page_id || '?c=' || c AS url, printf('ch%02d/sec00.txt', c) AS text_location
FROM menu_chapters WHERE n = 0
UNION ALL
SELECT page_id, c::INTEGER, 'Ch & ' || c || '’', (s + (s > 2)::INTEGER)::INTEGER, 'S ' || s,
       CASE s WHEN 1 THEN 'https://h.org/' || source || '/s' || page_id || '/p1?x=1&y' WHEN 2 THEN 'https://h.org/abs/p2'
              WHEN 3 THEN 'https://h.org/' || source || '/dir/rel3.html' ELSE 'https://cdn.org/p4#f' END,
       printf('ch%02d/sec%02d.txt', c, s + (s > 2)::INTEGER)
FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM menu_chapters)
UNION ALL
SELECT page_id, c::INTEGER, 'Ch & ' || c || '’', 3, 'Deep', 'https://h.org/' || source || '/dir/deep', printf('ch%02d/sec03.txt', c)
FROM menu_chapters WHERE n >= 2""")
q("section_topn", "SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id LIMIT 50")
q("chapter_concat", """
SELECT source, doc_id,
       CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset,
       CAST(length(text) + 1 AS INTEGER) AS piece_len
FROM documents""")
_LP = sq(fixed.TRAIN_LOG_PATTERN)
cte("log_lines", """
SELECT CASE event_type WHEN 'click' THEN 'finetune_output_first_agent.log'
                       WHEN 'view' THEN 'finetune_output_second_agent.log'
                       ELSE 'finetune_output_third_agent.log' END AS file_name,
       event_id AS line_no,
       CASE WHEN event_type = 'error' THEN 'ERROR step ' || CAST(event_id AS VARCHAR)
            ELSE 'step ' || CAST(event_id AS VARCHAR) || ' Epoch ' || CAST(user_id % 50 AS VARCHAR)
                 || ': train_perplexity=' || printf('%.4f', 1 + value / 10)
                 || ', train_epoch_loss=' || printf('%.4f', ln(1 + value / 10)) || ' lr=3e-4' END AS value
FROM events""")
cte("log_parsed", f"""
SELECT CASE WHEN contains(file_name, 'first') THEN 'first' WHEN contains(file_name, 'second') THEN 'second'
            ELSE 'third' END AS run, line_no,
       CAST(regexp_extract(value, {_LP}, 1) AS INTEGER) AS epoch,
       CAST(regexp_extract(value, {_LP}, 2) AS DOUBLE) AS perplexity,
       CAST(regexp_extract(value, {_LP}, 3) AS DOUBLE) AS loss
FROM log_lines WHERE regexp_matches(value, {_LP})""")
q("train_log_parse", "SELECT run, line_no, epoch, perplexity, loss FROM log_parsed")
q("train_curve", """
SELECT run, epoch, arg_max(perplexity, line_no) AS perplexity, arg_max(loss, line_no) AS loss
FROM log_parsed GROUP BY run, epoch""")
cte("result_lines", """
SELECT pair_id AS line_no, CASE pair_id % 6
    WHEN 0 THEN 'Total Time: ' || CAST(turn AS VARCHAR) || ' seconds'
    WHEN 1 THEN substring(rec, 1, length(rec) - 2)
    ELSE rec END AS value
FROM (SELECT pair_id, turn, json_object('query', input_text, 'target_text', target_text, 'response', target_text,
                                        'inference_time', turn / 10)::VARCHAR AS rec FROM pairs)""")
q("eval_results_load", """
SELECT line_no AS pair_id, json_extract_string(value, '$.query') AS query,
       json_extract_string(value, '$.target_text') AS target_text,
       CAST(json_extract(value, '$.inference_time') AS DOUBLE) AS inference_time
FROM result_lines
WHERE regexp_matches(value, '^\\s*\\{') AND json_valid(value)""")

# ---------------------------------------------------------------------------
# tokens
_TP = sq(r"\p{L}+|\p{N}+|[^ \t\n\r\f\x0B\p{L}\p{N}]")
cte("tok_src", f"SELECT pair_id, {sq(_ap_head)} || input_text || {sq(_ap_tail)} AS prompt, target_text FROM pairs")
cte("vocab", f"""
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS id
FROM (SELECT token, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(prompt, {_TP})) AS token FROM tok_src
        UNION ALL SELECT unnest(regexp_extract_all(target_text, {_TP})) FROM tok_src) GROUP BY token)""")
q("vocab", "SELECT token, n, id FROM vocab")
cte("tok_parts", f"""
SELECT pair_id, 0 AS part, unnest(regexp_extract_all(p, {_TP})) AS token,
       unnest(generate_series(1, len(regexp_extract_all(p, {_TP})))) AS pos
FROM (SELECT pair_id, {sq(_ap_head)} || input_text || {sq(_ap_tail)} AS p FROM splits)
UNION ALL
SELECT pair_id, 1 AS part, unnest(regexp_extract_all(target_text, {_TP})) AS token,
       unnest(generate_series(1, len(regexp_extract_all(target_text, {_TP})))) AS pos
FROM splits""")
cte("tok_ids", """
SELECT s.pair_id, s.agent, s.split, s.split_rank,
       coalesce(list(t.id ORDER BY t.pos) FILTER (WHERE t.part = 0), []) AS p_ids,
       coalesce(list(t.id ORDER BY t.pos) FILTER (WHERE t.part = 1), []) AS a_ids
FROM splits s LEFT JOIN (SELECT tp.pair_id, tp.part, tp.pos, coalesce(v.id, 0) AS id
                         FROM tok_parts tp LEFT JOIN vocab v ON tp.token = v.token) t ON t.pair_id = s.pair_id
GROUP BY s.pair_id, s.agent, s.split, s.split_rank""")
cte("tok_ex", """
SELECT pair_id, agent, split, split_rank, len(p_ids) + 1 AS n_prompt,
       list_concat([1], p_ids, a_ids, [2]) AS input_ids,
       list_concat(list_transform(range(len(p_ids) + 1), lambda x: -100), a_ids, [2]) AS labels
FROM tok_ids""")
q("mask_labels", """
SELECT pair_id, CAST(len(input_ids) AS INTEGER) AS n_tokens, CAST(n_prompt AS INTEGER) AS n_prompt, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(labels, ',') AS labels FROM tok_ex""")
q("pack_chunks", f"""
SELECT agent, CAST(gpos // {fixed.CONTEXT_LENGTH_SMALL} AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(CAST(tid AS VARCHAR), ',' ORDER BY gpos) AS input_ids,
       string_agg(CAST(lab AS VARCHAR), ',' ORDER BY gpos) AS labels
FROM (SELECT agent, tid, lab, row_number() OVER (PARTITION BY agent ORDER BY split_rank, pair_id, i) - 1 AS gpos,
             count(*) OVER (PARTITION BY agent) AS total
      FROM (SELECT agent, split_rank, pair_id, unnest(input_ids) AS tid, unnest(labels) AS lab,
                   unnest(generate_series(1, len(input_ids))) AS i FROM tok_ex WHERE split = 'train'))
WHERE gpos // {fixed.CONTEXT_LENGTH_SMALL} < (total - 1) // {fixed.CONTEXT_LENGTH_SMALL}
GROUP BY agent, gpos // {fixed.CONTEXT_LENGTH_SMALL}""")
cte("len_batches", """
SELECT pair_id, n_tokens, batch, input_ids, labels,
       row_number() OVER (ORDER BY md5('196|batch|' || CAST(batch AS VARCHAR)), batch) - 1 AS batch_order_raw
FROM (SELECT pair_id, n_tokens, input_ids, labels, CAST((r - 1) // 4 AS BIGINT) AS batch, r, n
      FROM (SELECT pair_id, len(input_ids) AS n_tokens, input_ids, labels,
                   row_number() OVER (ORDER BY len(input_ids), pair_id) AS r, count(*) OVER () AS n
            FROM tok_ex WHERE split = 'train'))
WHERE r <= (n // 4) * 4""")
cte("len_batch_order", """
SELECT batch, row_number() OVER (ORDER BY md5('196|batch|' || CAST(batch AS VARCHAR)), batch) - 1 AS batch_order
FROM (SELECT DISTINCT batch FROM len_batches)""")
q("length_batches", """
SELECT b.pair_id, CAST(b.n_tokens AS INTEGER) AS n_tokens, b.batch, o.batch_order FROM len_batches b JOIN len_batch_order o USING (batch)""")
q("pad_batches", """
SELECT pair_id, batch, CAST(padded_len AS INTEGER) AS padded_len, CAST(padded_len - n_tokens AS INTEGER) AS n_pad,
       CASE WHEN padded_len > n_tokens THEN 2 ELSE input_ids[-1] END AS last_id,
       CASE WHEN padded_len > n_tokens THEN -100 ELSE labels[-1] END AS last_label
FROM (SELECT *, max(n_tokens) OVER (PARTITION BY batch) AS padded_len FROM len_batches)""")

# ---------------------------------------------------------------------------
# retrieval, answering, routing

q("term_vectors", f"""
SELECT pair_id, token, count(*)::DOUBLE AS tf FROM (SELECT pair_id, unnest({mtok('input_text')}) AS token FROM pairs)
GROUP BY pair_id, token""")
cte("emb", """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
       sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm FROM embeddings""")
q("knn_dense", """
SELECT vec_id, rank, nbr_id, round(distance, 6) AS distance FROM (
  SELECT vec_id, nbr_id, distance, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), nbr_id) AS rank
  FROM (SELECT a.vec_id, b.vec_id AS nbr_id,
               1 - CASE WHEN a.nrm * b.nrm > 0 THEN list_dot_product(a.e, b.e) / (b.nrm * a.nrm) ELSE 0 END AS distance
        FROM emb a JOIN emb b ON a.vec_id <> b.vec_id))
WHERE rank <= 3""")


def lexical_knn(prefix: str, qsrc: str, csrc: str, k: int, group: str | None = None) -> None:
    """Register CTEs ``<prefix>_nb(pair_id, nbr_id, distance, rank)``: exact
    lexical cosine kNN of ``qsrc`` questions over ``csrc`` questions."""
    g = f", {group}" if group else ""
    for side, src in (("q", qsrc), ("c", csrc)):
        cte(f"{prefix}_t{side}", f"""
SELECT pair_id, token, count(*)::DOUBLE AS tf
FROM (SELECT pair_id, unnest({mtok('input_text')}) AS token FROM {src}) GROUP BY pair_id, token""")
        cte(f"{prefix}_n{side}", f"""
SELECT s.pair_id{', s.' + group if group else ''}, coalesce(sqrt(sum(t.tf * t.tf)), 0) AS norm
FROM {src} s LEFT JOIN {prefix}_t{side} t ON t.pair_id = s.pair_id GROUP BY s.pair_id{', s.' + group if group else ''}""")
    cte(f"{prefix}_dot", f"""
SELECT a.pair_id AS qid, b.pair_id AS cid, sum(a.tf * b.tf) AS dot
FROM {prefix}_tq a JOIN {prefix}_tc b ON a.token = b.token GROUP BY a.pair_id, b.pair_id""")
    on = f"q.{group} = c.{group}" if group else "TRUE"
    cte(f"{prefix}_nb", f"""
SELECT pair_id, nbr_id, distance, rank FROM (
  SELECT q.pair_id, c.pair_id AS nbr_id,
         1 - CASE WHEN q.norm * c.norm > 0 THEN coalesce(d.dot, 0) / (c.norm * q.norm) ELSE 0 END AS distance,
         row_number() OVER (PARTITION BY q.pair_id ORDER BY
             round(1 - CASE WHEN q.norm * c.norm > 0 THEN coalesce(d.dot, 0) / (c.norm * q.norm) ELSE 0 END, 9),
             c.pair_id) AS rank
  FROM {prefix}_nq q JOIN {prefix}_nc c ON {on}
  LEFT JOIN {prefix}_dot d ON d.qid = q.pair_id AND d.cid = c.pair_id)
WHERE rank <= {k}""")


cte("orch_q", "SELECT pair_id, input_text, target_text FROM orch_split WHERE orch_split = 'test'")
cte("orch_c", "SELECT pair_id, input_text, target_text FROM orch_split WHERE orch_split = 'train'")
lexical_knn("base", "orch_q", "orch_c", 3)
_PRE = sq(fixed.RAG_PREAMBLE)


def echo(prompt: str) -> str:
    """The offline default model in SQL: prompt + ' ' + first context line."""
    return (f"{prompt} || ' ' || split_part(CASE WHEN strpos({prompt}, 'Context:' || chr(10)) > 0 "
            f"THEN substr({prompt}, strpos({prompt}, 'Context:' || chr(10)) + 9) ELSE '' END, chr(10), 1)")


cte("base_ctx", """
SELECT n.pair_id, string_agg(c.target_text, chr(10) ORDER BY n.rank) AS context
FROM base_nb n JOIN orch_c c ON c.pair_id = n.nbr_id GROUP BY n.pair_id""")
cte("base_prompt", f"""
SELECT q.pair_id, q.input_text, q.target_text,
       {_PRE} || x.context || {sq(fixed.RAG_QUESTION_SEP)} || q.input_text || {sq(fixed.RAG_ANSWER_TAG)} AS prompt
FROM orch_q q JOIN base_ctx x ON x.pair_id = q.pair_id""")
cte("base_resp", f"SELECT *, {echo('prompt')} AS response FROM base_prompt")
cte("base_ans", "SELECT *, substring(response, strpos(response, 'Answer:') + 7) AS answer_only FROM base_resp")
q("knn_lexical", "SELECT pair_id, CAST(rank AS INTEGER) AS rank, nbr_id, round(distance, 6) AS distance FROM base_nb")
q("rag_prompt", "SELECT pair_id, prompt FROM base_prompt")
q("rag_answer", "SELECT pair_id, response, answer_only FROM base_ans")
q("answer_only", """
SELECT pair_id, answer_only, substring(target_text, strpos(target_text, 'Answer:') + 7) AS answer_only_missing FROM base_ans""")
q("answer_after_query", "SELECT pair_id, substring(response, strpos(response, input_text) + length(input_text)) AS answer FROM base_ans")
q("eval_join", "SELECT pair_id, input_text AS query, target_text, response FROM base_ans")


def route_call(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'invoke') THEN {strip(f'string_split({x}, {sq(fixed.ROUTER_OUTPUT_MARK)})[-1]')} "
            f"ELSE {sq(fixed.ROUTER_FALLBACK)} END")


def next_agent(call: str, question: str) -> str:
    return (f"CASE WHEN coalesce(length({question}), 0) = 0 THEN 'END' "
            f"WHEN contains(lower({call}), 'agent1') THEN 'agent1' WHEN contains(lower({call}), 'agent2') THEN 'agent2' "
            f"WHEN contains(lower({call}), 'agent3') THEN 'agent3' ELSE 'END' END")


def router_prompt(question: str) -> str:
    return f"{sq(fixed.ROUTER_PROMPT_HEAD)} || {sq(fixed.ROLES_TEXT)} || {question} || {sq(fixed.ROUTER_PROMPT_TAIL)}"


cte("router_out", f"""
SELECT pair_id, input_text, CASE (conv_id + turn) % 5
  WHEN 0 THEN {router_prompt('input_text')} || ' Invoke agent' || CAST(conv_id % 3 + 1 AS VARCHAR)
  WHEN 1 THEN 'Invoke agent' || CAST(conv_id % 3 + 1 AS VARCHAR)
  WHEN 2 THEN 'agent' || CAST(conv_id % 3 + 1 AS VARCHAR) || ' fits. OUTPUT: nothing'
  WHEN 3 THEN 'invoke OUTPUT: agent3 or agent1'
  ELSE 'Invoke OUTPUT: none' END AS router_output
FROM pairs""")
q("route", f"""
SELECT pair_id, agent_call, {next_agent('agent_call', 'input_text')} AS next_agent
FROM (SELECT pair_id, input_text, {route_call('router_output')} AS agent_call FROM router_out)""")

cte("spec_train", "SELECT pair_id, agent, input_text, target_text FROM splits WHERE split = 'train'")
lexical_knn("rtr", "orch_q", "spec_train", 1)
cte("routed", f"""
SELECT q.pair_id, q.input_text, q.target_text, agent_call, {next_agent('agent_call', 'q.input_text')} AS next_agent
FROM orch_q q LEFT JOIN (
  SELECT n.pair_id, {route_call(f"{router_prompt('q2.input_text')} || ' Invoke agent' || CAST(t.agent AS VARCHAR)")} AS agent_call
  FROM rtr_nb n JOIN spec_train t ON t.pair_id = n.nbr_id JOIN orch_q q2 ON q2.pair_id = n.pair_id) r
ON r.pair_id = q.pair_id""")
cte("routed_go", """
SELECT pair_id, input_text, target_text, next_agent, CAST(right(next_agent, 1) AS INTEGER) AS agent
FROM routed WHERE next_agent <> 'END'""")
lexical_knn("spec", "routed_go", "spec_train", 3, group="agent")
cte("spec_ctx", """
SELECT n.pair_id, string_agg(c.target_text, chr(10) ORDER BY n.rank) AS context
FROM spec_nb n JOIN spec_train c ON c.pair_id = n.nbr_id GROUP BY n.pair_id""")
cte("spec_prompt", f"""
SELECT g.pair_id, g.agent, g.input_text, g.target_text, g.next_agent, {_PRE} || x.context || g.input_text AS prompt
FROM routed_go g JOIN spec_ctx x ON x.pair_id = g.pair_id""")
cte("arch_ans", f"""
SELECT pair_id, input_text, target_text, next_agent, {echo('prompt')} AS answer FROM spec_prompt
UNION ALL SELECT pair_id, input_text, target_text, next_agent, input_text AS answer FROM routed WHERE next_agent = 'END'""")
q("rag_prompt_agent", "SELECT pair_id, agent, prompt FROM spec_prompt")
q("routed_answer", "SELECT pair_id, next_agent, answer FROM arch_ans")
q("tool_route", "SELECT pair_id, CASE WHEN contains(answer, 'tool_calls') THEN 'tools' ELSE 'END' END AS tool_route FROM arch_ans")


# ---------------------------------------------------------------------------
# metrics and evaluation summaries

def metric_ctes(prefix: str, src: str, tok=mtok) -> None:
    """``<prefix>_ov(pair_id, c, r, m1..m4)`` clipped n-gram overlap and
    ``<prefix>_me(pair_id, matches, chunks, c, r)`` METEOR alignment for a
    source with columns (pair_id, prediction, reference)."""
    cte(f"{prefix}_tok", f"SELECT pair_id, {tok('prediction')} AS pt, {tok('reference')} AS rt FROM {src}")
    for side, col in (("p", "pt"), ("r", "rt")):
        cte(f"{prefix}_g{side}", f"""
SELECT pair_id, n, gram, count(*) AS cnt FROM (
  SELECT pair_id, n, array_to_string({col}[i:i + n - 1], ' ') AS gram
  FROM (SELECT pair_id, {col}, n, unnest(generate_series(1, len({col}) - n + 1)) AS i
        FROM {prefix}_tok, (VALUES (1), (2), (3), (4)) v(n)))
GROUP BY pair_id, n, gram""")
    cte(f"{prefix}_ov", f"""
SELECT t.pair_id, len(t.pt) AS c, len(t.rt) AS r,
       coalesce(m.m1, 0) AS m1, coalesce(m.m2, 0) AS m2, coalesce(m.m3, 0) AS m3, coalesce(m.m4, 0) AS m4
FROM {prefix}_tok t LEFT JOIN (
  SELECT a.pair_id,
         sum(CASE WHEN a.n = 1 THEN least(a.cnt, b.cnt) ELSE 0 END) AS m1,
         sum(CASE WHEN a.n = 2 THEN least(a.cnt, b.cnt) ELSE 0 END) AS m2,
         sum(CASE WHEN a.n = 3 THEN least(a.cnt, b.cnt) ELSE 0 END) AS m3,
         sum(CASE WHEN a.n = 4 THEN least(a.cnt, b.cnt) ELSE 0 END) AS m4
  FROM {prefix}_gp a JOIN {prefix}_gr b ON a.pair_id = b.pair_id AND a.n = b.n AND a.gram = b.gram
  GROUP BY a.pair_id) m ON m.pair_id = t.pair_id""")
    cte(f"{prefix}_me", f"""
SELECT t.pair_id, len(t.pt) AS c, len(t.rt) AS r, coalesce(x.matches, 0) AS matches, coalesce(x.chunks, 0) AS chunks
FROM {prefix}_tok t LEFT JOIN (
  SELECT pair_id, count(*) AS matches,
         sum(CASE WHEN ph IS NULL OR ph <> hpos - 1 OR pr <> rpos - 1 THEN 1 ELSE 0 END) AS chunks
  FROM (SELECT pair_id, hpos, rpos, lag(hpos) OVER (PARTITION BY pair_id ORDER BY hpos) AS ph,
               lag(rpos) OVER (PARTITION BY pair_id ORDER BY hpos) AS pr
        FROM (SELECT h.pair_id, h.hpos, r.rpos FROM
                (SELECT pair_id, w, hpos, row_number() OVER (PARTITION BY pair_id, w ORDER BY hpos DESC) AS k
                 FROM (SELECT pair_id, unnest(pt) AS w, unnest(generate_series(0, len(pt) - 1)) AS hpos FROM {prefix}_tok)) h
              JOIN
                (SELECT pair_id, w, rpos, row_number() OVER (PARTITION BY pair_id, w ORDER BY rpos DESC) AS k
                 FROM (SELECT pair_id, unnest(rt) AS w, unnest(generate_series(0, len(rt) - 1)) AS rpos FROM {prefix}_tok)) r
              ON h.pair_id = r.pair_id AND h.w = r.w AND h.k = r.k))
  GROUP BY pair_id) x ON x.pair_id = t.pair_id""")


BLEU_SQL = """CASE WHEN c > 0 AND r > 0 THEN
  CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 OR c < 4 THEN 0.0
  ELSE exp((ln(m1 / c) + ln(m2 / (c - 1)) + ln(m3 / (c - 2)) + ln(m4 / (c - 3))) / 4)
       * CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END END END"""


def rouge_sql(n: int) -> str:
    p = f"(m{n} / greatest(greatest(c - {n - 1}, 0), 1))"
    r = f"(m{n} / greatest(greatest(r - {n - 1}, 0), 1))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


METEOR_SQL = """CASE WHEN matches > 0 AND c > 0 AND r > 0 THEN
  ((matches / c) * (matches / r) / (0.9 * (matches / c) + (1 - 0.9) * (matches / r)))
  * (1 - 0.5 * pow(chunks / matches, 3.0)) ELSE 0.0 END"""

cte("bpairs", "SELECT pair_id, answer_only AS prediction, target_text AS reference FROM base_ans")
metric_ctes("bm", "bpairs")
q("bleu", f"SELECT pair_id, round({BLEU_SQL}, 6) AS bleu FROM bm_ov")
q("rouge_n", f"SELECT pair_id, round({rouge_sql(1)}, 6) AS rouge1, round({rouge_sql(2)}, 6) AS rouge2 FROM bm_ov")
q("meteor_exact", f"SELECT pair_id, CAST(matches AS BIGINT) AS matches, CAST(chunks AS BIGINT) AS chunks, round({METEOR_SQL}, 6) AS meteor FROM bm_me")

cte("arm_b", """SELECT pair_id, substring(response, strpos(response, input_text) + length(input_text)) AS prediction,
                       target_text AS reference FROM base_ans""")
cte("arm_a", """SELECT pair_id, substring(answer, strpos(answer, input_text) + length(input_text)) AS prediction,
                       target_text AS reference FROM arch_ans""")
metric_ctes("ab", "arm_b")
metric_ctes("aa", "arm_a")
cte("arm_scores", f"""
SELECT 'baseline' AS arm, pair_id, {METEOR_SQL} AS meteor, c > 0 AND r > 0 AS valid FROM ab_me
UNION ALL SELECT 'architecture', pair_id, {METEOR_SQL}, c > 0 AND r > 0 FROM aa_me""")
q("eval_summary", """
SELECT arm, count(*) FILTER (WHERE valid) AS n_scored, count(*) FILTER (WHERE NOT valid) AS n_invalid,
       round(min(meteor) FILTER (WHERE valid), 6) AS meteor_min, round(max(meteor) FILTER (WHERE valid), 6) AS meteor_max,
       round(avg(meteor) FILTER (WHERE valid), 6) AS meteor_mean,
       round(quantile_cont(meteor, 0.5) FILTER (WHERE valid), 6) AS meteor_median
FROM arm_scores GROUP BY arm""")
q("eval_paired", """
SELECT count(*) AS n_common, round(avg(a.meteor), 6) AS mean_a, round(avg(b.meteor), 6) AS mean_b,
       round(avg(a.meteor - b.meteor), 6) AS mean_diff
FROM (SELECT * FROM arm_scores WHERE arm = 'architecture') a
JOIN (SELECT * FROM arm_scores WHERE arm = 'baseline') b ON a.pair_id = b.pair_id
WHERE a.pair_id NOT IN (SELECT pair_id FROM arm_scores WHERE NOT valid)""")
q("batch_latency", """
SELECT event_id, event_type, batch, round(sum(value) OVER (PARTITION BY event_type, batch) /
                                          count(*) OVER (PARTITION BY event_type, batch), 6) AS latency
FROM (SELECT event_id, event_type, value,
             CAST((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 8 AS BIGINT) AS batch
      FROM events)""")
q("arm_latency", """
SELECT event_type AS arm, count(*) AS n, round(avg(value), 6) AS time_mean, round(min(value), 6) AS time_min,
       round(max(value), 6) AS time_max FROM events GROUP BY event_type""")

# page text: a block's content is text or inline tags (RE2 has no look-ahead;
# on pages whose tags are block or listed inline tags this is the same rule as
# "up to the next block tag")
_INLINE = "b|i|em|strong|br|span|a|u|small|sup|sub|code|font|abbr|mark|s|q|cite|kbd|var|img"
_BLOCK_RE2 = r"(?is)<(h[1-6]|p|li)\b[^>]*>((?:[^<]|</?(?:" + _INLINE + r")\b[^>]*>)*)"
cte("page_blocks", f"""
SELECT page_id, body, regexp_extract_all(body, {sq(_BLOCK_RE2)}, 1) AS tags,
       regexp_extract_all(body, {sq(_BLOCK_RE2)}, 2) AS inners
FROM (SELECT page_id, CASE WHEN regexp_matches(h, '(?is)<article\\b[^>]*>')
                           THEN regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) END AS body
      FROM pages_clean)""")
q("page_text", f"""
SELECT page_id, CASE WHEN body IS NULL THEN {sq(fixed.NOT_FOUND_TEXT)} ELSE array_to_string(list_transform(
         generate_series(1, len(tags)), lambda i:
           CASE WHEN lower(tags[i]) = 'p' THEN {block_text('inners[i]')}
                WHEN lower(tags[i]) = 'li' THEN {sq(fixed.LIST_BULLET)} || {block_text('inners[i]')}
                ELSE repeat('#', CAST(substr(tags[i], 2, 1) AS INTEGER)) || ' ' || {block_text('inners[i]')} END),
         chr(10) || chr(10)) END AS text
FROM page_blocks""")

# ROUGE-L: LCS by a recursive CTE, one dynamic-programming row per reference
# token; row_i[j] = running max of max(row_{i-1}[j], row_{i-1}[j-1] + match)
cte("rl_tok", f"SELECT pair_id, {mtok('prediction')} AS pt, {mtok('reference')} AS rt FROM bpairs")
cte("rl_dp", """
WITH RECURSIVE dp(pair_id, i, rowv) AS (
  SELECT pair_id, 0, list_transform(range(0, len(pt) + 1), lambda x: 0) FROM rl_tok
  UNION ALL
  SELECT pair_id, i + 1, list_concat([0], list_transform(range(1, len(pt) + 1), lambda j: list_max(xs[1:j])))
  FROM (SELECT d.pair_id, d.i, t.pt,
               list_transform(range(1, len(t.pt) + 1), lambda j:
                   greatest(d.rowv[j + 1], d.rowv[j] + CASE WHEN t.pt[j] = t.rt[d.i + 1] THEN 1 ELSE 0 END)) AS xs
        FROM dp d JOIN rl_tok t ON t.pair_id = d.pair_id WHERE d.i < len(t.rt)))
SELECT d.pair_id, d.rowv[len(t.pt) + 1] AS lcs, len(t.pt) AS c, len(t.rt) AS r
FROM dp d JOIN rl_tok t ON t.pair_id = d.pair_id WHERE d.i = len(t.rt)""")
q("rouge_l", """
SELECT pair_id, round(CASE WHEN c > 0 AND r > 0 AND lcs > 0
                           THEN 2 * (lcs / c) * (lcs / r) / ((lcs / c) + (lcs / r)) ELSE 0.0 END, 6) AS rougeL
FROM rl_dp""")


# ---------------------------------------------------------------------------
# edited answers: library tokens, Lsum, staged METEOR, a report with latency

cte("edited", """
SELECT pair_id, input_text AS question, target_text AS reference, turn / 10 + length(target_text) / 1000 AS seconds,
       CASE (conv_id + turn) % 5
         WHEN 0 THEN target_text
         WHEN 1 THEN array_to_string(list_reverse(string_split(target_text, chr(10))), chr(10))
         WHEN 2 THEN regexp_replace(target_text, '([a-z])([ .,])', '\\1s\\2', 'g')
         WHEN 3 THEN array_to_string(list_filter(string_split(target_text, ' '), lambda x, i: (i - 1) % 4 <> 3), ' ')
         ELSE '...' END AS prediction
FROM pairs""")


def tok13a(x: str) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {sq(ent)}, {sq(ch)})"
    for pat, to in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                    (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, {sq(pat)}, {sq(to)}, 'g')"
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '')"


def tok_ascii(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


metric_ctes("el", "edited", tok13a)
metric_ctes("er", "edited", tok_ascii)
q("bleu_library", f"""
SELECT pair_id, b.c, b.r, round(b.bleu, 6) AS bleu, rouge1, rouge2
FROM (SELECT pair_id, CAST(c AS INTEGER) AS c, CAST(r AS INTEGER) AS r, {BLEU_SQL} AS bleu FROM el_ov) b
JOIN (SELECT pair_id, round({rouge_sql(1)}, 6) AS rouge1, round({rouge_sql(2)}, 6) AS rouge2 FROM er_ov) USING (pair_id)""")


def lsum_ctes(prefix: str, src: str) -> None:
    """``<prefix>_score(pair_id, score)``: the table of every pair of sentences by
    a recursive CTE, the walk back by another one, hits united per sentence."""
    lines = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), chr(10)), lambda l: {mtok('l')}), lambda s: len(s) > 0)"
    cte(f"{prefix}_sents", f"SELECT pair_id, {lines('prediction')} AS ps, {lines('reference')} AS rs FROM {src}")
    cte(f"{prefix}_pairs", f"""
SELECT r.pair_id, ri, ci, rt, pt
FROM (SELECT pair_id, unnest(rs) AS rt, unnest(range(len(rs))) AS ri FROM {prefix}_sents) r
JOIN (SELECT pair_id, unnest(ps) AS pt, unnest(range(len(ps))) AS ci FROM {prefix}_sents) p ON p.pair_id = r.pair_id""")
    cte(f"{prefix}_table", f"""
WITH RECURSIVE dp(pair_id, ri, ci, i, rowv) AS (
  SELECT pair_id, ri, ci, 0, list_transform(range(0, len(pt) + 1), lambda x: 0) FROM {prefix}_pairs
  UNION ALL
  SELECT pair_id, ri, ci, i + 1, list_concat([0], list_transform(range(1, len(pt) + 1), lambda j: list_max(xs[1:j])))
  FROM (SELECT d.pair_id, d.ri, d.ci, d.i, t.pt,
               list_transform(range(1, len(t.pt) + 1), lambda j:
                   greatest(d.rowv[j + 1], d.rowv[j] + CASE WHEN t.pt[j] = t.rt[d.i + 1] THEN 1 ELSE 0 END)) AS xs
        FROM dp d JOIN {prefix}_pairs t ON t.pair_id = d.pair_id AND t.ri = d.ri AND t.ci = d.ci WHERE d.i < len(t.rt)))
SELECT pair_id, ri, ci, list(rowv ORDER BY i) AS tab FROM dp GROUP BY pair_id, ri, ci""")
    cte(f"{prefix}_hits", f"""
WITH RECURSIVE walk(pair_id, ri, ci, i, j, hit) AS (
  SELECT pair_id, ri, ci, len(rt), len(pt), 0::BIGINT FROM {prefix}_pairs
  UNION ALL
  SELECT w.pair_id, w.ri, w.ci,
         CASE WHEN p.rt[w.i] = p.pt[w.j] OR NOT t.tab[w.i + 1][w.j] > t.tab[w.i][w.j + 1] THEN w.i - 1 ELSE w.i END,
         CASE WHEN p.rt[w.i] = p.pt[w.j] OR t.tab[w.i + 1][w.j] > t.tab[w.i][w.j + 1] THEN w.j - 1 ELSE w.j END,
         CASE WHEN p.rt[w.i] = p.pt[w.j] THEN w.i ELSE 0 END
  FROM walk w JOIN {prefix}_pairs p ON p.pair_id = w.pair_id AND p.ri = w.ri AND p.ci = w.ci
  JOIN {prefix}_table t ON t.pair_id = w.pair_id AND t.ri = w.ri AND t.ci = w.ci
  WHERE w.i > 0 AND w.j > 0)
SELECT DISTINCT w.pair_id, w.ri, w.hit, p.rt[w.hit] AS token
FROM walk w JOIN {prefix}_pairs p ON p.pair_id = w.pair_id AND p.ri = w.ri AND p.ci = w.ci WHERE w.hit > 0""")
    cte(f"{prefix}_score", f"""
SELECT s.pair_id, n, m, coalesce(h.hits, 0) AS hits,
       CASE WHEN coalesce(h.hits, 0) > 0 THEN 2 * (h.hits / n) * (h.hits / m) / ((h.hits / n) + (h.hits / m)) ELSE 0.0 END AS score
FROM (SELECT pair_id, len(flatten(ps)) AS n, len(flatten(rs)) AS m FROM {prefix}_sents) s
LEFT JOIN (SELECT u.pair_id, sum(least(u.k, c.k)) AS hits
           FROM (SELECT pair_id, token, count(*) AS k FROM {prefix}_hits GROUP BY ALL) u
           JOIN (SELECT pair_id, token, count(*) AS k FROM (SELECT pair_id, unnest(flatten(ps)) AS token FROM {prefix}_sents) GROUP BY ALL) c
           ON c.pair_id = u.pair_id AND c.token = u.token GROUP BY u.pair_id) h ON h.pair_id = s.pair_id""")


lsum_ctes("bls", "bpairs")
q("rouge_lsum", "SELECT pair_id, round(score, 6) AS rougeLsum FROM bls_score")

# Porter's stem by regular expressions over runs of consonants and vowels
_PC, _PV = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^({_PC})?{_PV}{_PC}"          # measure above 0
_M1 = f"^({_PC})?{_PV}{_PC}{_PV}{_PC}"  # above 1
_MEQ1 = f"^({_PC})?{_PV}{_PC}({_PV})?$"
_VOWEL = f"^({_PC})?[aeiouy]"
_CVC = f"^{_PC}[aeiouy][^aeiouwxy]$"


def _cut(n: int) -> str:
    return f"left(s, length(s) - {n})"


def _suffix_case(rules: dict[str, str], test: str) -> str:
    whens = [f"WHEN suffix(s, '{x}') THEN CASE WHEN regexp_matches({_cut(len(x))}, '{test}') THEN {_cut(len(x))} || '{y}' ELSE s END"
             for x, y in sorted(rules.items(), key=lambda kv: -len(kv[0]))]
    return f"CASE {' '.join(whens)} ELSE s END"


_P2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble").split())
_P3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_P4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
_P4_CASE = "CASE " + " ".join(
    f"WHEN suffix(s, '{x}') THEN CASE WHEN regexp_matches({_cut(3 if x[1:] == 'ion' else len(x))}, '{_M1}') THEN {_cut(3 if x[1:] == 'ion' else len(x))} ELSE s END"
    for x in sorted(_P4, key=lambda x: -len(x))) + " ELSE s END"
_PORTER = [
    f"CASE WHEN suffix(s, 'sses') OR suffix(s, 'ies') THEN {_cut(2)} WHEN suffix(s, 'ss') THEN s WHEN suffix(s, 's') THEN {_cut(1)} ELSE s END",
    f"""CASE WHEN suffix(s, 'eed') THEN CASE WHEN regexp_matches({_cut(3)}, '{_M0}') THEN {_cut(1)} ELSE s END
             WHEN suffix(s, 'ed') AND regexp_matches({_cut(2)}, '{_VOWEL}') THEN {_cut(2)} || '#'
             WHEN suffix(s, 'ing') AND regexp_matches({_cut(3)}, '{_VOWEL}') THEN {_cut(3)} || '#' ELSE s END""",
    f"""CASE WHEN NOT suffix(s, '#') THEN s WHEN regexp_matches(s, '(at|bl|iz)#$') THEN {_cut(1)} || 'e'
             WHEN s[-2] = s[-3] AND regexp_matches(s, '[^aeiouylsz]#$') THEN {_cut(2)}
             WHEN regexp_matches({_cut(1)}, '{_CVC}') THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
    f"CASE WHEN suffix(s, 'y') AND regexp_matches({_cut(1)}, '{_VOWEL}') THEN {_cut(1)} || 'i' ELSE s END",
    _suffix_case(_P2, _M0), _suffix_case(_P3, _M0), _P4_CASE,
    f"""CASE WHEN suffix(s, 'e') AND (regexp_matches({_cut(1)}, '{_M1}') OR
             (regexp_matches({_cut(1)}, '{_MEQ1}') AND NOT regexp_matches({_cut(1)}, '{_CVC}'))) THEN {_cut(1)} ELSE s END""",
    f"CASE WHEN suffix(s, 'll') AND regexp_matches(s, '{_M1}') THEN {_cut(1)} ELSE s END",
]
_MTOK = r"[\p{L}\p{N}]+|[^ \t\n\r\f\x0B\p{L}\p{N}]"
cte("ms_tok", f"""
SELECT pair_id, side, unnest(toks) AS w, unnest(range(len(toks))) AS pos FROM (
  SELECT pair_id, 'p' AS side, regexp_extract_all(lower(prediction), {sq(_MTOK)}) AS toks FROM edited
  UNION ALL SELECT pair_id, 'r', regexp_extract_all(lower(reference), {sq(_MTOK)}) FROM edited)""")
_stem_sql = "SELECT DISTINCT w, w AS s FROM ms_tok WHERE regexp_matches(w, '^[a-z][a-z][a-z]+$')"
for _step in _PORTER:
    _stem_sql = f"SELECT w, {_step} AS s FROM ({_stem_sql})"
cte("ms_stem", _stem_sql)
cte("ms_group", f"SELECT DISTINCT w, left(w, 5) AS s FROM (SELECT unnest({mtok('target_text')}) AS w FROM pairs) WHERE length(w) >= 7")
_MS_KEYS = {1: ("ms_tok", "t.w", ""), 2: ("ms_free2", "coalesce(k.s, t.w)", "LEFT JOIN ms_stem k ON k.w = t.w"),
            3: ("ms_free3", "k.s", "JOIN ms_group k ON k.w = t.w")}
for _n, (_src, _key, _join) in _MS_KEYS.items():
    cte(f"ms_ranked{_n}", f"""
SELECT pair_id, side, pos, key, row_number() OVER (PARTITION BY pair_id, side, key ORDER BY pos DESC) AS k
FROM (SELECT t.pair_id, t.side, t.pos, {_key} AS key FROM {_src} t {_join})""")
    cte(f"ms_match{_n}", f"""
SELECT p.pair_id, p.pos AS h, r.pos AS r FROM ms_ranked{_n} p JOIN ms_ranked{_n} r
ON p.side = 'p' AND r.side = 'r' AND p.pair_id = r.pair_id AND p.key = r.key AND p.k = r.k""")
    cte(f"ms_free{_n + 1}", f"""
SELECT t.* FROM {_src} t ANTI JOIN (SELECT pair_id, 'p' AS side, h AS pos FROM ms_match{_n} UNION ALL SELECT pair_id, 'r', r FROM ms_match{_n}) m
ON m.pair_id = t.pair_id AND m.side = t.side AND m.pos = t.pos""")
cte("ms_all", " UNION ALL ".join(f"SELECT pair_id, h, r, {n} AS stage FROM ms_match{n}" for n in _MS_KEYS))
cte("ms_score", """
SELECT e.pair_id, coalesce(p.c, 0) AS c, coalesce(r.r, 0) AS r, coalesce(m.matches, 0) AS matches, coalesce(m.chunks, 0) AS chunks,
       coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3
FROM edited e LEFT JOIN (SELECT pair_id, count(*) AS c FROM ms_tok WHERE side = 'p' GROUP BY pair_id) p ON p.pair_id = e.pair_id
LEFT JOIN (SELECT pair_id, count(*) AS r FROM ms_tok WHERE side = 'r' GROUP BY pair_id) r ON r.pair_id = e.pair_id
LEFT JOIN (SELECT a.pair_id, count(*) AS matches, count(*) FILTER (WHERE b.h IS NULL) AS chunks,
                  count(*) FILTER (WHERE a.stage = 1) AS n1, count(*) FILTER (WHERE a.stage = 2) AS n2,
                  count(*) FILTER (WHERE a.stage = 3) AS n3
           FROM ms_all a LEFT JOIN ms_all b ON b.pair_id = a.pair_id AND b.h = a.h - 1 AND b.r = a.r - 1
           GROUP BY a.pair_id) m ON m.pair_id = e.pair_id""")
q("meteor_stages", f"""
SELECT pair_id, matches, chunks, n1 AS n_exact, n2 AS n_stem, n3 AS n_group, round({METEOR_SQL}, 6) AS meteor FROM ms_score""")

cte("eq_pairs", "SELECT pair_id, question AS prediction, reference FROM edited")
metric_ctes("em", "edited")
metric_ctes("eq", "eq_pairs")
cte("edited_scores", f"""
SELECT 'edited' AS arm, pair_id, seconds, {METEOR_SQL} AS meteor, c > 0 AND r > 0 AS valid FROM em_me JOIN edited USING (pair_id)
UNION ALL SELECT 'question', pair_id, seconds * 2, {METEOR_SQL}, c > 0 AND r > 0 FROM eq_me JOIN edited USING (pair_id)""")
_STATS = ", ".join(f"round({sql} FILTER (WHERE valid), 6) AS {name}_{f}" for c, name in (("meteor", "meteor"), ("seconds", "time"))
                   for f, sql in (("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)")))
q("eval_report", f"""
SELECT arm, count(*) FILTER (WHERE valid) AS n_scored, count(*) FILTER (WHERE NOT valid) AS n_invalid, {_STATS}
FROM edited_scores GROUP BY arm""")
q("eval_report_paired", """
SELECT count(*) AS n_common, round(avg(a.meteor), 6) AS mean_a, round(avg(b.meteor), 6) AS mean_b,
       round(avg(a.meteor - b.meteor), 6) AS mean_diff
FROM (SELECT * FROM edited_scores WHERE arm = 'edited') a
JOIN (SELECT * FROM edited_scores WHERE arm = 'question') b ON a.pair_id = b.pair_id
WHERE a.valid AND b.valid""")
