"""SQL twins of the registered queries, written for DuckDB over the same tables.

Queries without a twin (MLlib K-Means, random projection, hashed text vectors) are checked in the tests.
"""

from __future__ import annotations

from string import Formatter

from .. import fixed_values as V
from ..sources import bindings as B


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(V.WHITESPACE)


def trim(x: str) -> str:
    return f"coalesce(trim({x}, {WS}), '')"


def case(value: str, pairs: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in pairs.items()) + f" ELSE {default} END"


def head(x: str) -> str:
    return f"(substring({x}, 1, 80) || CASE WHEN length({x}) > 80 THEN '...' ELSE '' END)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def trend(p: str = "prev_window_count", c: str = "curr_window_count") -> str:
    return (
        f"CASE WHEN {p} = 0 THEN CASE WHEN {c} > 0 THEN 'Increasing' ELSE 'Stable' END "
        f"WHEN ({c} - {p})::DOUBLE / {p} > 0.25 THEN 'Increasing' WHEN ({c} - {p})::DOUBLE / {p} < -0.25 THEN 'Decreasing' "
        "ELSE 'Stable' END"
    )


def percent(p: str, c: str) -> str:
    return f"floor(({c} - {p})::DOUBLE / {p} * 100 + 0.5)::BIGINT"


def percent_text(p: str = "prev_window_count", c: str = "curr_window_count") -> str:
    return (
        f"CASE WHEN {p} = 0 THEN CASE WHEN {c} > 0 THEN '+100%' ELSE '—' END "
        f"ELSE CASE WHEN {percent(p, c)} > 0 THEN '+' ELSE '' END || {percent(p, c)} || '%' END"
    )


def filled(template: str, **values: str) -> str:
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        parts += [lit(literal)] if literal else []
        parts += [f"{values[field]}::VARCHAR"] if field else []
    return " || ".join(parts)


def first_rule(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(x=x)} THEN {lit(result)}" for test, result in rules) + f" ELSE {lit(default)} END"


def segment(x: str) -> str:
    return first_rule(x, [("regexp_matches({x}, " + lit(p) + ", 'i')", label) for label, p in V.SEGMENTS], "Other")


def themed(x: str, position: int, default: str) -> str:
    tests = [" OR ".join("contains(lower({x}), " + lit(w) + ")" for w in words) for _, words, _ in V.THEMES]
    return first_rule(x, [(t, theme[position]) for t, theme in zip(tests, V.THEMES)], default)


SEGMENT_ORDER = "CASE segment " + " ".join(f"WHEN '{s}' THEN {i}" for i, (s, _) in enumerate(V.SEGMENTS)) + " ELSE 5 END"

KEYED = f"""keyed AS (
  SELECT coalesce(doc_id, vec_id) AS k, text, lang, source, embedding, label
  FROM documents FULL JOIN embeddings ON doc_id = vec_id),
bodies AS (SELECT *, coalesce(nullif({trim('text')}, ''), 'Ticket ' || k) AS body FROM keyed),
tickets AS (
  SELECT md5('TKT-' || k) AS id, 'TKT-' || k AS ticket_id, {head('body')} AS subject, body AS description,
    {case('event_type', B.PRIORITY_OF_EVENT, 'event_type')} AS priority,
    {case('lang', B.TYPE_OF_LANG, "''")} AS ticket_type, coalesce(source, '') AS product_area,
    'Open' AS status, coalesce(source, 'manual') AS source,
    TIMESTAMP '2024-01-31' - to_days(((k * 37) % (25 + 10 * coalesce(label, k % 10)))::INTEGER) AS created_at,
    embedding, k
  FROM bodies LEFT JOIN events ON event_id = k),
members AS (
  SELECT md5('TKT-' || k) AS ticket_id, 'C0' || coalesce(label, k % 10) AS cluster_id,
    round(1 - ((k * 13) % 100) / 1000.0, 3)::DOUBLE AS similarity_score
  FROM keyed),
names(id, name, description) AS (VALUES {", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in B.CLUSTER_NAMES)})"""

ORDER_DESK = """tickets AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders),
members AS (SELECT o_orderkey AS ticket_id, c_nationkey AS cluster_id FROM orders JOIN customer ON o_custkey = c_custkey),
names AS (SELECT n_nationkey AS id, n_name AS name FROM nation)"""


def conditions(rule: str, as_of: str) -> tuple[str, str]:
    middle, start = f"{as_of} - INTERVAL 30 DAYS", f"{as_of} - INTERVAL 60 DAYS"
    prev = f"created_at < {middle}" if rule == "split" else f"created_at >= {start} AND created_at < {middle}"
    curr = f"created_at >= {middle}" + (f" AND created_at <= {as_of}" if rule == "rolling_closed" else "")
    return prev, curr


def counted(rule: str, as_of: str) -> str:
    prev, curr = conditions(rule, as_of)
    return f"""counted AS (
  SELECT n.id, any_value(n.name) AS name, count(m.ticket_id) AS ticket_count,
    count(*) FILTER (WHERE {prev}) AS prev_window_count, count(*) FILTER (WHERE {curr}) AS curr_window_count
  FROM names n LEFT JOIN members m ON m.cluster_id = n.id LEFT JOIN tickets t ON t.id = m.ticket_id GROUP BY n.id)"""


def trends(desk: str, rule: str, as_of: str) -> str:
    return f"""WITH {desk}, {counted(rule, as_of)}
SELECT id AS cluster_id, name, ticket_count, prev_window_count, curr_window_count, {trend()} AS trend,
  {percent_text()} AS pct_change FROM counted"""


TEXT_AS_OF, ORDER_AS_OF = "TIMESTAMP '2024-01-31'", "TIMESTAMP '1998-01-31'"
DESK = f"""{KEYED}, {counted('rolling_closed', TEXT_AS_OF)},
clusters AS (SELECT c.*, n.description, {trend()} AS trend FROM counted c JOIN names n USING (id)),
joined AS (SELECT m.cluster_id, m.similarity_score, t.* FROM members m JOIN tickets t ON t.id = m.ticket_id)"""


def month_view(desk: str, month: str, extra: str = "") -> str:
    return f"WITH {desk}, {month_counts(month, extra)}"


def month_counts(month: str, extra: str = "") -> str:
    start = f"TIMESTAMP '{month}-01'"
    return f"""counted AS (
  SELECT m.cluster_id,
    count(*) FILTER (WHERE created_at >= {start} AND created_at < {start} + INTERVAL 1 MONTH) AS curr_window_count,
    count(*) FILTER (WHERE created_at >= {start} - INTERVAL 1 MONTH AND created_at < {start}) AS prev_window_count
  FROM members m JOIN tickets t ON t.id = m.ticket_id GROUP BY 1)
SELECT cluster_id, name{extra}, curr_window_count AS ticket_count, prev_window_count, curr_window_count,
  {trend()} AS trend, {percent_text()} AS pct_change
FROM counted JOIN names ON names.id = cluster_id WHERE curr_window_count > 0"""


def calendar(desk: str, last: str) -> str:
    return f"""WITH {desk}, months AS (SELECT unnest(generate_series(TIMESTAMP '{last}-01' - INTERVAL 11 MONTHS, TIMESTAMP '{last}-01', INTERVAL 1 MONTH)) AS m)
SELECT strftime(m, '%Y-%m') AS value, strftime(m, '%B %Y') AS label, count(t.id) AS tickets
FROM months LEFT JOIN tickets t ON date_trunc('month', t.created_at) = m GROUP BY m
UNION ALL SELECT 'all', 'All Time', count(*) FROM tickets"""


def refreshed(stale: str) -> str:
    empty = "5, 4, 1, 'Decreasing', '2024-01-01 00:00:00'" if stale == "keep" else "0, 0, 0, 'Stable', '2024-01-31 00:00:00'"
    return f"""WITH {KEYED}, {counted('rolling', TEXT_AS_OF)}
SELECT id, ticket_count, prev_window_count, curr_window_count, {trend()} AS trend, '2024-01-31 00:00:00' AS updated_at
FROM counted WHERE ticket_count > 0
UNION ALL SELECT id, {empty} FROM counted WHERE ticket_count = 0"""


def ranked(order: str, n: int, source: str = "joined") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}) AS rank FROM {source}
  QUALIFY rank <= {n})"""


def examples(order: str) -> str:
    line = f"concat_ws('/', ticket_id, priority, product_area, {stamp('created_at')}, subject)"
    return f"""WITH {DESK}, {ranked(order, 10)},
lists AS (SELECT cluster_id, string_agg({line}, chr(10) ORDER BY rank) AS examples FROM ranked GROUP BY 1)
SELECT c.id, name, trend, ticket_count, prev_window_count, curr_window_count, coalesce(examples, '') AS examples
FROM clusters c LEFT JOIN lists ON cluster_id = c.id"""


def search(q: str, label: str | None = None) -> str:
    only = f"AND trend = '{label}'" if label else ""
    return f"""WITH {DESK}
SELECT id, name, trend, ticket_count, prev_window_count, curr_window_count FROM clusters c
WHERE (contains(lower(name), '{q}') OR contains(lower(description), '{q}')
  OR EXISTS (SELECT 1 FROM joined j WHERE j.cluster_id = c.id AND contains(lower(j.subject), '{q}'))) {only}"""


def date_text(k: str) -> str:
    return f"""CASE {k} % 7 WHEN 0 THEN 'junk' WHEN 1 THEN '' WHEN 2 THEN '2024-02-30' WHEN 3 THEN strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"""


def date_value(k: str) -> str:
    return f"""CASE {k} % 7 WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts)
  WHEN 5 THEN date_trunc('second', ts) - INTERVAL 330 MINUTES WHEN 6 THEN date_trunc('second', ts) END"""


RAW = f"""raw AS (
  SELECT doc_id AS seq, ts,
    CASE WHEN doc_id % 3 = 0 OR doc_id % 11 = 1 THEN '' ELSE 'About ' || source || ' ' || lang || ' ' || n_chars END AS s0,
    CASE WHEN doc_id % 4 = 1 OR doc_id % 11 = 1 THEN '' ELSE {trim('text')} END AS d0,
    {case('event_type', B.PRIORITY_OF_EVENT, 'event_type')} AS p0, lang, source AS src,
    CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE '' END AS r0
  FROM documents LEFT JOIN events ON event_id = doc_id),
cleaned AS (
  SELECT *, CASE WHEN s0 = '' THEN {head('d0')} ELSE s0 END AS subject,
    CASE WHEN d0 = '' THEN s0 ELSE d0 END AS description, {date_value('seq')} AS own_date
  FROM raw WHERE s0 <> '' OR d0 <> '')"""
RAW_KEY = "CASE WHEN r0 <> '' THEN r0 ELSE subject || '|' || description END"


def short_md5(x: str) -> str:
    return f"'CSV-' || substring(md5({x}), 1, 16)"


def sample(table: str, stratum: str, key: str, n: int) -> str:
    return f"""WITH sized AS (SELECT {n} // count(DISTINCT {stratum}) + 1 AS per FROM {table}),
ranked AS (SELECT {key}, {stratum}, md5('42|' || {key}) AS h,
  row_number() OVER (PARTITION BY {stratum} ORDER BY md5('42|' || {key})) AS r FROM {table}),
rounds AS (SELECT *, row_number() OVER (ORDER BY (r >= per), h) AS place FROM ranked, sized WHERE r <= per)
SELECT {key}, {stratum} FROM rounds WHERE place <= {n}"""


MEANS = """means AS (
  SELECT cluster_id, list(v ORDER BY position) AS c FROM (
    SELECT printf('C%02d', label) AS cluster_id, position, avg(x::DOUBLE) AS v
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM embeddings)
    GROUP BY ALL) GROUP BY 1)"""
CENTER = """center AS (
  SELECT list(v ORDER BY position) AS c FROM (
    SELECT position, avg(x::DOUBLE) AS v
    FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM embeddings) GROUP BY ALL))"""
COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], c), 12)"


def assigned(name: str, centroids: str) -> str:
    return f"""{name} AS (
  SELECT vec_id, embedding, cluster_id, {COSINE} AS s FROM embeddings, {centroids}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster_id) = 1)"""


def moved(name: str, assigned_name: str, before: str) -> str:
    return f"""{name}_new AS (
  SELECT cluster_id, list(v ORDER BY position) AS c FROM (
    SELECT cluster_id, position, avg(x::DOUBLE) AS v
    FROM (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM {assigned_name})
    GROUP BY ALL) GROUP BY 1),
{name} AS (SELECT b.cluster_id, coalesce(n.c, b.c) AS c FROM {before} b LEFT JOIN {name}_new n USING (cluster_id))"""


def nearest_of_starts(name: str, centres: str) -> str:
    return f"""{name} AS (
  SELECT start, cluster, vec_id, u, c FROM units, {centres}
  QUALIFY row_number() OVER (PARTITION BY start, vec_id
    ORDER BY round(list_inner_product(u, c) - list_inner_product(c, c) / 2, 12) DESC, cluster) = 1)"""


def means_of_starts(name: str, members: str) -> str:
    return f"""{name} AS (
  SELECT start, cluster, list(v ORDER BY position) AS c FROM (
    SELECT start, cluster, position, avg(x) AS v
    FROM (SELECT start, cluster, unnest(u) AS x, generate_subscripts(u, 1) AS position FROM {members}) GROUP BY ALL) GROUP BY ALL)"""


def moved_starts(name: str, members: str, before: str) -> str:
    return f"""{means_of_starts(name + '_new', members)},
{name} AS (SELECT b.start, b.cluster, coalesce(n.c, b.c) AS c FROM {before} b LEFT JOIN {name}_new n USING (start, cluster))"""


STARTS = f"""WITH units AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / n) AS u
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)),
grouped AS (
  SELECT 0 AS start, dense_rank() OVER (ORDER BY label) - 1 AS cluster, u FROM units
  UNION ALL SELECT 1, vec_id % 10, u FROM units),
{means_of_starts('c0', 'grouped')},
{nearest_of_starts('a1', 'c0')}, {moved_starts('c1', 'a1', 'c0')},
{nearest_of_starts('a2', 'c1')}, {moved_starts('c2', 'a2', 'c1')},
{nearest_of_starts('a3', 'c2')}, {moved_starts('c3', 'a3', 'c2')},
{nearest_of_starts('a4', 'c3')}
SELECT start::INT AS start, cluster::INT AS cluster, count(*) AS members,
  round(sum(list_inner_product(u, u) - 2 * round(list_inner_product(u, c) - list_inner_product(c, c) / 2, 12)), 6) AS cost
FROM a4 GROUP BY ALL"""

NEAREST = f"""WITH {MEANS}, {assigned('best', 'means')}
SELECT vec_id, cluster_id, round(s, 6) AS similarity_score FROM best"""

INCOMING = f"""sent AS (
  SELECT conv_id * 3 AS k, turn AS seq, {head('text')} AS subject, role FROM conversations),
incoming AS (SELECT md5('TKT-' || k) AS id, 'TKT-' || k AS ticket_id, subject, role, k, seq FROM sent)"""

JOB_LOG = f"""starts AS (
  SELECT event_id::VARCHAR AS id, list_value({', '.join(lit(t) for t in V.JOB_TYPES)})[user_id % 4 + 1] AS job_type, ts AS started_at,
    event_type, value, props FROM events),
runs AS (
  SELECT id, job_type, started_at,
    CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE floor(value)::BIGINT END AS tickets_processed,
    CASE event_type WHEN 'error' THEN 'error | payload: ' || substring(props, 1, 500) END AS error_message
  FROM starts)"""

JSON_ROWS = """rows AS (
  SELECT *, CASE role WHEN 'system' THEN 'SYS' ELSE (conv_id * 100 + turn)::VARCHAR END AS ext_id,
    regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS flat,
    (turn % 3 = 2 AND conv_id % 4 = 0) AS broken, (turn % 5 = 4) AS bare
  FROM conversations)"""

ROLLING = f"""SELECT event_type, strftime(day, '%Y-%m-%d') AS day, prev_window_count, curr_window_count,
  {trend()} AS trend, {percent_text()} AS pct_change FROM (
  SELECT event_type, day,
    coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 19 DAYS PRECEDING AND INTERVAL 10 DAYS PRECEDING), 0)::BIGINT AS prev_window_count,
    (sum(n) OVER (w RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS curr_window_count
  FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)
  WINDOW w AS (PARTITION BY event_type ORDER BY day))"""


def rule_counts() -> str:
    rows = [
        ("tickets", f"not_null({c})", f"(SELECT count(*) FROM tickets WHERE {c} IS NULL)")
        for c in ("ticket_id", "subject", "description", "created_at")
    ]
    allowed = ", ".join(lit(p) for p in V.PRIORITIES)
    rows += [
        ("tickets", "enum(priority)", f"(SELECT count(*) FROM tickets WHERE priority NOT IN ({allowed}))"),
        ("tickets", "dimension(embedding)", "(SELECT count(*) FROM tickets WHERE len(embedding) <> 64)"),
        ("issue_clusters", "not_null(name)", "(SELECT count(*) FROM names WHERE name IS NULL)"),
        ("issue_clusters", "enum(trend)", "0"),
        ("issue_clusters", "dimension(centroid_embedding)", "(SELECT count(*) FROM names)"),
    ]
    rows += [
        ("cluster_members", f"not_null({c})", f"(SELECT count(*) FROM members WHERE {c} IS NULL)") for c in ("ticket_id", "cluster_id")
    ]
    rows += [
        (t, f"unique({key})", f"(SELECT count(*) - count(DISTINCT ({key})) FROM {source})")
        for t, key, source in (
            ("tickets", "id", "tickets"), ("tickets", "ticket_id", "tickets"), ("issue_clusters", "id", "names"),
            ("cluster_members", "ticket_id, cluster_id", "members"),
        )
    ]
    rows += [
        ("cluster_members", "foreign_key(ticket_id -> tickets)", "(SELECT count(*) FROM members WHERE ticket_id NOT IN (SELECT id FROM tickets))"),
        ("cluster_members", "foreign_key(cluster_id -> issue_clusters)", "(SELECT count(*) FROM members WHERE cluster_id NOT IN (SELECT id FROM names))"),
        ("cluster_members", "vector missing", "(SELECT count(*) FROM members WHERE ticket_id NOT IN (SELECT md5('TKT-' || vec_id) FROM embeddings))"),
    ]
    return f"WITH {KEYED} " + " UNION ALL ".join(
        f'SELECT {lit(t)} AS "table", {lit(r)} AS rule, {sql}::BIGINT AS violations' for t, r, sql in rows
    )


def oracle() -> dict[str, str]:
    best, newest, by_date = "similarity_score DESC, ticket_id", "created_at DESC, ticket_id", "created_at, ticket_id"
    one_subject = f"uniq AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY cluster_id, subject ORDER BY {newest}) = 1)"
    lines = "string_agg('{bullet} ' || subject, chr(10) ORDER BY rank)"
    alert_values = {"prev": "prev", "curr": "curr", "pct": "pct", "name": "name"}
    sql = {
        "cluster_trends": trends(KEYED, "rolling_closed", TEXT_AS_OF),
        "trends_rolling": trends(KEYED, "rolling", TEXT_AS_OF),
        "trends_split": trends(KEYED, "split", TEXT_AS_OF),
        "order_trends_rolling": trends(ORDER_DESK, "rolling", ORDER_AS_OF),
        "order_trends_closed": trends(ORDER_DESK, "rolling_closed", ORDER_AS_OF),
        "order_trends_split": trends(ORDER_DESK, "split", ORDER_AS_OF),
        "event_trends": f"""SELECT *, {trend()} AS trend, {percent_text()} AS pct_change FROM (
  SELECT event_type,
    count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15') AS prev_window_count,
    count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-25') AS curr_window_count
  FROM events GROUP BY 1)""",
        "event_rolling_trends": ROLLING,
        "stream_daily_trends": ROLLING,
        "stream_windows": f"""SELECT event_type, {stamp('s')} AS window_start, {stamp('s + INTERVAL 10 DAYS')} AS window_end, count(*) AS tickets
FROM (SELECT event_type, date_trunc('day', ts) - to_days(i::INTEGER) AS s FROM events, range(10) r(i)) GROUP BY event_type, s""",
        "month_view": month_view(KEYED, B.MONTH, ", description"),
        "order_month_view": month_view(ORDER_DESK, B.ORDERS_MONTH),
        "month_members": f"""WITH {KEYED} SELECT m.* FROM members m
WHERE ticket_id IN (SELECT id FROM tickets WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01')""",
        "month_calendar": calendar(KEYED, "2024-01"),
        "order_month_calendar": calendar(ORDER_DESK, "2001-10"),
        "refresh_trends": refreshed("zero"),
        "refresh_trends_keep": refreshed("keep"),
        "window_shares": f"""WITH {DESK} SELECT id,
  round(least(prev_window_count::DOUBLE / greatest(ticket_count, 1) * 100, 100), 6) AS prev_share,
  round(least(curr_window_count::DOUBLE / greatest(ticket_count, 1) * 100, 100), 6) AS curr_share FROM clusters""",
        "cluster_listing": f"""WITH {DESK}
SELECT c.id, c.name, c.description, c.trend, c.ticket_count, c.prev_window_count, c.curr_window_count,
  '2024-01-31 00:00:00' AS updated_at, j.id AS ticket_key, j.ticket_id, j.subject AS ticket_subject,
  j.description AS ticket_description, j.priority AS ticket_priority, j.product_area AS ticket_product_area,
  {stamp('j.created_at')} AS ticket_created_at, j.similarity_score
FROM clusters c LEFT JOIN joined j ON j.cluster_id = c.id""",
        "month_listing": f"""WITH {KEYED}, shown AS (WITH {month_counts(B.MONTH, ', description')})
SELECT s.cluster_id AS id, s.name, s.description, s.trend, s.ticket_count, s.prev_window_count, s.curr_window_count,
  '2024-01-31 00:00:00' AS updated_at, t.id AS ticket_key, t.ticket_id, t.subject AS ticket_subject,
  t.description AS ticket_description, t.priority AS ticket_priority, t.product_area AS ticket_product_area,
  {stamp('t.created_at')} AS ticket_created_at, m.similarity_score
FROM shown s JOIN members m ON m.cluster_id = s.cluster_id JOIN tickets t ON t.id = m.ticket_id
WHERE strftime(t.created_at, '%Y-%m') = '{B.MONTH}'""",
        "cluster_examples": examples(best),
        "newest_examples": examples(newest),
        "cluster_search": search("nthend"),
        "cluster_search_subject": search(B.SUBJECT_WORD),
        "cluster_search_indexed": search(B.SUBJECT_WORD),
        "cluster_search_trend": search("fail", "Increasing"),
        "kpis": f"""WITH {DESK} SELECT sum(ticket_count)::BIGINT AS total_tickets, count(*) AS clusters,
  count(*) FILTER (WHERE trend = 'Increasing') AS increasing, count(*) FILTER (WHERE trend = 'Decreasing') AS decreasing FROM clusters""",
        "segment_rollup": f"""WITH {DESK} SELECT *, {SEGMENT_ORDER} AS position FROM (
  SELECT {segment('name')} AS segment, sum(prev_window_count)::BIGINT AS prev, sum(curr_window_count)::BIGINT AS curr FROM clusters GROUP BY 1)""",
        "segment_share": f"""WITH {DESK} SELECT segment, regexp_replace(lower(segment), '[^a-z]', '', 'g') AS key, tickets,
  floor(tickets::DOUBLE / (sum(tickets) OVER ()) * 100 + 0.5)::BIGINT AS pct, {SEGMENT_ORDER} AS position FROM (
  SELECT {segment('name')} AS segment, sum(ticket_count)::BIGINT AS tickets FROM clusters GROUP BY 1)""",
        "subject_segments": f"""WITH {KEYED} SELECT segment, theme, count(*) AS tickets, regexp_replace(lower(segment), '[^a-z]', '', 'g') AS key
FROM (SELECT {segment('description')} AS segment, {themed('description', 0, 'other')} AS theme FROM tickets) GROUP BY ALL""",
        "top_subjects": f"WITH {DESK}, {ranked(by_date, 6)} SELECT cluster_id, ticket_id, subject, rank FROM ranked",
        "unique_subjects": f"WITH {DESK}, {one_subject} SELECT cluster_id, subject, ticket_id FROM uniq",
        "distinct_examples": f"WITH {DESK}, {one_subject}, {ranked(newest, 3, 'uniq')} SELECT cluster_id, subject, ticket_id, rank FROM ranked",
        "tickets_by_source": f"WITH {KEYED} SELECT ticket_id, source, subject FROM tickets WHERE source = 'src7'",
        "ticket_ages": """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago'
  WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' ELSE floor(s / 86400)::BIGINT || 'd ago' END AS age
FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-01-25') / 1e6 - epoch_us(ts) / 1e6 AS s FROM events)""",
        "change_numbers": f"""SELECT o_custkey, prev, curr, {trend('prev', 'curr')} AS trend, {percent_text('prev', 'curr')} AS pct_text,
  CASE WHEN prev > 0 THEN {percent('prev', 'curr')} ELSE 100 END AS alert_pct, floor(curr * 1.3::DOUBLE + 0.5)::BIGINT AS projected
FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS prev, count(*) FILTER (WHERE o_orderstatus = 'O') AS curr
  FROM orders GROUP BY 1)""",
        "clean_tickets": f"""WITH {RAW}
SELECT seq, {short_md5(RAW_KEY)} AS ticket_id, subject, description,
  CASE WHEN p0 IN ('Low', 'Medium', 'High', 'Critical') THEN p0 ELSE 'Medium' END AS priority,
  CASE WHEN lang = 'en' THEN 'Support Request' ELSE lang END AS ticket_type,
  CASE WHEN src = 'src0' THEN 'General' ELSE src END AS product_area,
  'Open' AS status, 'support' AS source,
  {stamp("coalesce(own_date, TIMESTAMP '2024-01-31')")} AS created_at, own_date IS NOT NULL AS dated FROM cleaned""",
        "clean_tickets_month": f"""WITH {RAW}
SELECT seq, {short_md5("'2024-01|' || " + RAW_KEY)} AS ticket_id, {stamp('''
  CASE WHEN own_date IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' THEN own_date
  ELSE TIMESTAMP '2024-01-01' END''')} AS created_at FROM cleaned""",
        "rejected_rows": f"""WITH {RAW}
SELECT seq, 'either' AS rule FROM raw WHERE s0 = '' AND d0 = '' UNION ALL SELECT seq, 'subject' FROM raw WHERE s0 = ''""",
        "stable_ids": f"""WITH d AS (SELECT doc_id, text, {head('text')} AS s, CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR END AS r FROM documents)
SELECT doc_id, {short_md5("s || '|' || text")} AS by_text, {short_md5("coalesce(r, s || '|' || text)")} AS by_raw,
  {short_md5("'2024-01|' || coalesce(r, s || '|' || text)")} AS by_month FROM d""",
        "origin_ids": """SELECT o_orderkey, 'WH-' || o_orderkey AS webhook_id,
  'KT-' || CASE WHEN o_orderkey < 100000 THEN printf('%05d', o_orderkey) ELSE o_orderkey::VARCHAR END AS padded_id,
  'CSV-1700000000000-' || o_orderkey AS upload_id, 'KR-' || o_orderkey AS numbered_id FROM orders""",
        "sequential_ids": f"""WITH {KEYED} SELECT o_orderkey,
  'TKT-' || ((SELECT max(k) FROM keyed) + row_number() OVER (ORDER BY o_orderkey)) AS ticket_id FROM orders""",
        "month_coerce": f"""SELECT event_id, CASE WHEN event_id % 7 >= 3 AND strftime(ts, '%Y-%m') = '2024-01' THEN {date_text('event_id')}
  ELSE '2024-01-01T00:00:00+00:00' END AS kept, CASE WHEN event_id % 7 >= 3 AND strftime(ts, '%Y-%m') = '2023-12' THEN {date_text('event_id')}
  ELSE '2023-12-01T00:00:00+00:00' END AS moved FROM events""",
        "parsed_dates": f"SELECT event_id, {stamp('coalesce(' + date_value('event_id') + ', ' + TEXT_AS_OF + ')')} AS created_at FROM events",
        "embed_text": f"""WITH {KEYED}, parts AS (SELECT ticket_id, {trim('subject')} AS s, {trim('description')} AS d, ticket_type AS t, product_area AS p FROM tickets)
SELECT ticket_id, md5(concat_ws('. ', nullif(s, ''), CASE WHEN d <> '' AND NOT (contains(d, '{{') AND contains(d, '}}')) AND d <> s THEN d END,
    CASE WHEN t NOT IN ('Support Request', '') THEN 'Type: ' || t END, CASE WHEN p NOT IN ('General', '') THEN 'Product: ' || p END)) AS rich,
  md5({trim("s || '. ' || d")}) AS simple, md5({trim("s || ': ' || d")}) AS colon FROM parts""",
        "template_texts": """SELECT event_id, contains(props, '{') AND contains(props, '}') AS is_template,
  concat_ws('. ', event_type, CASE WHEN NOT (contains(props, '{') AND contains(props, '}')) THEN trim(props) END, 'Product: ' || user_id) AS rich FROM events""",
        "placeholder_fill": """SELECT p_partkey, 'Issue with the ' || p_name || '. The ' || p_name || ' is ' || p_type AS description FROM part""",
        "status_map": """SELECT given, CASE WHEN given = 'Closed' THEN 'Closed' ELSE 'Open' END AS status, count(*) AS n FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Open'
    WHEN o_orderpriority = '2-HIGH' THEN 'Pending Customer Response' ELSE o_orderstatus END AS given FROM orders) GROUP BY ALL""",
        "priority_rule": f"""WITH {KEYED} SELECT given, priority, count(*) AS tickets FROM (SELECT priority AS given,
  CASE WHEN priority IN ('Low', 'Medium', 'High', 'Critical') THEN priority ELSE 'Medium' END AS priority FROM tickets) GROUP BY ALL""",
        "dedupe_last": f"""SELECT {short_md5(head('text') + " || '|' || text")} AS ticket_id, doc_id AS seq, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""",
        "dedupe_hot": """SELECT event_type AS ticket_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""",
        "stratified_sample": sample("documents", "source", "doc_id", 150),
        "stratified_sample_large": sample("orders", "o_orderstatus", "o_orderkey", 6000),
        "upsert_tickets": f"""WITH {KEYED}, {INCOMING}, new AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY seq DESC) = 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.ticket_id, o.ticket_id) AS ticket_id, coalesce(n.subject, o.subject) AS subject,
  CASE WHEN n.id IS NOT NULL THEN 'High' ELSE o.priority END AS priority, coalesce(n.role, o.product_area) AS product_area,
  CASE WHEN n.id IS NOT NULL THEN 'support' ELSE o.source END AS source,
  {stamp("CASE WHEN n.k % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE coalesce(o.created_at, TIMESTAMP '2024-02-01') END")} AS created_at
FROM tickets o FULL JOIN new n ON n.ticket_id = o.ticket_id""",
        "upsert_members": f"""WITH {KEYED}, new AS (SELECT md5('TKT-' || vec_id) AS ticket_id,
  CASE WHEN vec_id % 2 = 0 THEN printf('C%02d', label) ELSE 'C10' END AS cluster_id, 0.5::DOUBLE AS similarity_score FROM embeddings)
SELECT * FROM new UNION ALL SELECT ticket_id, cluster_id, similarity_score FROM members m
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.ticket_id = m.ticket_id AND n.cluster_id = m.cluster_id)""",
        "cascade_delete": f"""WITH {KEYED} SELECT m.* FROM members m JOIN tickets t ON t.id = m.ticket_id
WHERE t.priority IN ('Low', 'Medium', 'High', 'Critical') AND cluster_id <> 'C03'""",
        "constraint_report": rule_counts(),
        "duplicate_keys": "SELECT md5(text) AS text_md5, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1",
        "orphan_members": """SELECT l_partkey AS ticket_id, count(*) AS rows FROM lineitem
WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
        "current_jobs": f"WITH {JOB_LOG} SELECT id, job_type, status, error_message, tickets_processed FROM runs",
        "latest_jobs": f"""WITH {JOB_LOG} SELECT id, job_type, status, error_message, tickets_processed, {stamp('started_at')} AS started_at FROM runs
QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY runs.started_at DESC, id) = 1""",
        "cluster_centroids": """SELECT printf('C%02d', label) AS cluster_id, count(*) AS members, position - 1 AS position, round(avg(x::DOUBLE), 6) AS value
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM embeddings) GROUP BY label, position""",
        "nearest_centroid": NEAREST,
        "nearest_centroid_blocks": NEAREST,
        "member_scores": f"""WITH {MEANS} SELECT vec_id, round({COSINE}, 6) AS similarity_score
FROM embeddings JOIN means ON cluster_id = printf('C%02d', label)""",
        "unit_vectors": """SELECT vec_id, 1.0::DOUBLE AS length, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
        "parsed_vectors": """SELECT vec_id, vec_id % 9 <> 0 AS usable, CASE WHEN vec_id % 9 <> 0 THEN round(embedding[4]::DOUBLE, 6) END AS third FROM embeddings""",
        "similar_topk": f"""WITH {MEANS}, scored AS (SELECT cluster_id, vec_id, {COSINE} AS s FROM embeddings, means)
SELECT cluster_id AS query_id, vec_id AS match_id, round(s, 6) AS similarity,
  row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, vec_id) AS rank FROM scored WHERE s > 0.2 QUALIFY rank <= 10""",
        "similar_topk_blocks": """WITH scored AS (SELECT q.vec_id AS query_id, m.vec_id AS match_id,
  round(list_cosine_similarity(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS s FROM embeddings q, embeddings m)
SELECT query_id, match_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, match_id) AS rank
FROM scored QUALIFY rank <= 3""",
        "find_similar": f"""WITH {KEYED}, {CENTER}
SELECT id, ticket_id, subject, priority, {stamp('created_at')} AS created_at, round({COSINE}, 6) AS similarity
FROM tickets, center WHERE {COSINE} > 0.1 ORDER BY {COSINE} DESC, id LIMIT 10""",
        "similar_indexed": f"""WITH {KEYED}, {CENTER}
SELECT id, ticket_id, subject, priority, {stamp('created_at')} AS created_at, round({COSINE}, 6) AS similarity
FROM tickets, center WHERE {COSINE} > 0.1 ORDER BY {COSINE} DESC, id LIMIT 10""",
        "kmeans_starts": STARTS,
        "lloyd_3": f"""WITH {MEANS}, {assigned('a1', 'means')}, {moved('c1', 'a1', 'means')}, {assigned('a2', 'c1')}, {moved('c2', 'a2', 'c1')},
{assigned('a3', 'c2')}, {moved('c3', 'a3', 'c2')}, {assigned('a4', 'c3')}
SELECT vec_id, cluster_id, round(s, 6) AS similarity_score FROM a4""",
        "recluster_totals": f"""WITH {KEYED}
SELECT count(*) AS ticket_count, true AS bounded, count(*) AS members, true AS positive,
  count(*) FILTER (WHERE created_at >= {TEXT_AS_OF} - INTERVAL 60 DAYS AND created_at < {TEXT_AS_OF} - INTERVAL 30 DAYS) AS prev_window_count,
  count(*) FILTER (WHERE created_at >= {TEXT_AS_OF} - INTERVAL 30 DAYS AND created_at <= {TEXT_AS_OF}) AS curr_window_count
FROM tickets WHERE embedding IS NOT NULL""",
        "text_vector_lengths": f"""WITH {KEYED} SELECT ticket_id, 256::BIGINT AS dim,
  CASE WHEN regexp_matches(subject || description, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM tickets""",
        "model_batches": "SELECT doc_id, length(text) AS length, NULL::VARCHAR AS error FROM documents",
        "prompt_rows": f"""WITH {DESK}, {ranked(by_date, 6)}, lists AS (SELECT cluster_id, {lines.format(bullet='-')} AS subjects FROM ranked GROUP BY 1)
SELECT cluster_id, {filled(V.NAME_PROMPT, subjects='subjects')} AS prompt FROM lists""",
        "term_names": f"""WITH {DESK}, words AS (SELECT cluster_id, unnest(string_split_regex(lower(subject), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM joined),
counts AS (SELECT cluster_id, term, count(*) AS tf FROM words WHERE length(term) >= 3 GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
scored AS (SELECT cluster_id, term, round(tf * (ln(((SELECT count(DISTINCT cluster_id) FROM counts) + 1)::DOUBLE / (df + 1)) + 1), 9) AS score FROM counts JOIN spread USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank FROM scored QUALIFY rank <= 3)
SELECT cluster_id, string_agg(upper(term[1]) || term[2:], ' ' ORDER BY rank) AS name,
  'Tickets about ' || string_agg(term, ', ' ORDER BY rank) || '.' AS description FROM top GROUP BY 1""",
        "theme_summary": f"""WITH {DESK}, {ranked(newest, 10)}, lists AS (SELECT cluster_id, {lines.format(bullet='•')} AS subjects FROM ranked GROUP BY 1)
SELECT id AS cluster_id, name, {filled(V.SUMMARY_PROMPT, name='name', subjects="coalesce(subjects, '')")} AS prompt,
  {themed('name', 2, V.OTHER_THEME[1])} AS summary, true AS mock FROM clusters LEFT JOIN lists ON cluster_id = id""",
        "alert_rows": f"""WITH {DESK}, {ranked(newest, 6)},
lists AS (SELECT cluster_id, string_agg('• [' || coalesce(priority, 'Medium') || '] ' || subject, chr(10) ORDER BY rank) AS subjects FROM ranked GROUP BY 1),
facts AS (SELECT id AS cluster_id, name, prev_window_count AS prev, curr_window_count AS curr, coalesce(subjects, '') AS subjects,
  CASE WHEN prev_window_count > 0 THEN {percent('prev_window_count', 'curr_window_count')} ELSE 100 END AS pct,
  floor(curr_window_count * 1.3::DOUBLE + 0.5)::BIGINT AS projected
  FROM clusters LEFT JOIN lists ON cluster_id = id WHERE trend = 'Increasing')
SELECT cluster_id, name, prev, curr, pct, projected, {filled(V.ALERT_PROMPT, subjects='subjects', **alert_values)} AS prompt,
  {filled(V.ALERT_TEMPLATE, projected='projected', rule=lit(V.ALERT_RULE), platform=lit(V.ALERT_PLATFORM), **alert_values)} AS email, true AS mock FROM facts""",
        "csv_ingest": f"""SELECT {short_md5('doc_id::VARCHAR')} AS ticket_id, 'S ' || doc_id AS subject, md5({trim("replace(text, chr(13), ' ')")}) AS description_md5,
  lang AS ticket_type, source AS product_area, 'Medium' AS priority FROM documents""",
        "csv_lines": f"""SELECT {short_md5('o_orderkey::VARCHAR')} AS ticket_id, o_orderpriority AS subject, o_orderstatus || ' says "hi", twice' AS description,
  {stamp('o_orderdate')} AS created_at FROM orders""",
        "json_tickets": f"""WITH {JSON_ROWS}
SELECT conv_id, turn, CASE WHEN NOT broken THEN ext_id END AS id, CASE WHEN broken THEN NULL WHEN bare THEN '' ELSE {head('flat')} END AS subject,
  CASE WHEN NOT broken THEN md5(text) END AS description_md5, CASE WHEN NOT broken THEN role END AS product_area,
  CASE WHEN broken THEN 'Invalid JSON body' WHEN bare THEN '`id` and `subject` are required' END AS error FROM rows""",
        "dead_letters": f"""WITH {JSON_ROWS}, sent AS (SELECT *, CASE WHEN broken THEN '{{oops ' ELSE '' END ||
  to_json(struct_pack(id := ext_id, subject := CASE WHEN bare THEN '' ELSE {head('flat')} END, description := text, product_area := role))::VARCHAR AS payload FROM rows)
SELECT md5(payload) AS id, 'webhook' AS job_type, 'failed' AS status,
  CASE WHEN broken THEN 'Invalid JSON body' ELSE '`id` and `subject` are required' END || ' | payload: ' || substring(payload, 1, 500) AS error_message
FROM sent WHERE broken OR bare""",
        "store_versions": f"""WITH {KEYED}, {INCOMING}
SELECT ticket_id, subject, source, {stamp('created_at')} AS created_at FROM tickets
UNION ALL SELECT ticket_id, subject, 'support', '2024-02-01 00:00:00' FROM incoming""",
        "stream_ingest": f"""WITH {JSON_ROWS}
SELECT DISTINCT 'WH-' || ext_id AS ticket_id, 'Medium' AS priority, 'Open' AS status, 'webhook' AS source, true AS scored
FROM rows WHERE NOT broken AND NOT bare""",
    }
    return sql
