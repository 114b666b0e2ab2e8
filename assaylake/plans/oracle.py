"""The queries of the catalog as SQL over the same tables.

Common table expressions play the part of plans.roles.
"""

from __future__ import annotations

from textwrap import dedent

from .catalog import BIN_WIDTHS, KEYWORDS, TOP, TYPE_WORDS


def _key(column: str) -> str:
    return f"lower(strip_accents({column}))"


def _customer(key: str) -> str:
    return f"'Customer#' || lpad({key}::VARCHAR, 9, '0')"


CTES = {
    # --- accounts
    "users": """
        SELECT c_custkey AS id, c_name AS username, c_custkey || '@example.com' AS email,
               'hash-' || c_custkey AS password_hash, c_mktsegment AS role,
               c_acctbal >= 0 AS is_active,
               TIMESTAMP '2020-01-01' + to_days(c_nationkey) AS created_at,
               CAST(NULL AS TIMESTAMP) AS last_login_at
        FROM customer""",
    "attempts": f"""
        SELECT event_id AS seq,
               CASE WHEN event_type = 'click' THEN upper({_customer('user_id')})
                    WHEN event_type = 'view' THEN replace({_customer('user_id')}, 'u', 'ü')
                    WHEN event_type = 'purchase' THEN lower({_customer('user_id')})
                    WHEN event_type = 'signup' AND value < 5 THEN {_customer('user_id')} || ' '
                    ELSE {_customer('user_id')} END AS username,
               '10.0.0.' || user_id AS ip,
               event_type <> 'error' AS password_ok,
               ts AS created_at
        FROM events""",
    "decided": f"""
        SELECT a.*, u.id AS user_id,
               coalesce(u.id IS NOT NULL AND u.is_active AND a.password_ok, FALSE) AS ok
        FROM attempts a LEFT JOIN users u ON {_key('a.username')} = {_key('u.username')}""",
    "audit": """
        SELECT row_number() OVER (ORDER BY seq) AS id, user_id, username, ip, ok, created_at
        FROM decided""",
    "registrations": f"""
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderpriority = '1-URGENT' THEN {_customer('o_custkey')}
                    WHEN o_orderpriority = '2-HIGH' THEN 'APPLICANT#' || o_custkey
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'applicant#' || o_custkey
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Ápplicant#' || o_custkey
                    WHEN o_totalprice < 20000 THEN repeat('x', 65)
                    ELSE 'Guest#' || o_orderkey END AS username,
               CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'no-address'
                    ELSE o_custkey || '@example.com' END AS email,
               CASE WHEN o_orderstatus = 'O' AND o_totalprice < 40000 THEN NULL
                    ELSE 'hash-' || o_orderkey END AS password_hash,
               o_orderdate AS created_at
        FROM orders""",
    "checked": """
        SELECT *, concat_ws(',',
               CASE WHEN username IS NULL THEN 'username_missing' END,
               CASE WHEN length(username) > 64 THEN 'username_too_long' END,
               CASE WHEN NOT coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'),
                                      FALSE) THEN 'email_invalid' END,
               CASE WHEN length(email) > 255 THEN 'email_too_long' END,
               CASE WHEN password_hash IS NULL THEN 'password_missing' END) AS errors
        FROM registrations""",
    "granted": f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY {_key('username')} ORDER BY seq) AS nth
            FROM checked WHERE errors = '') f
        WHERE nth = 1 AND {_key('username')} NOT IN (SELECT {_key('username')} FROM users)""",
    "patches": f"""
        SELECT event_id AS seq,
               CASE WHEN event_type = 'error' AND value < 20 THEN -1 - event_id
                    ELSE user_id END AS user_id,
               CASE WHEN event_type = 'signup' THEN 'Member#' || user_id
                    WHEN event_type = 'purchase' AND value > 40 THEN 'MEMBER#' || user_id
                    WHEN event_type = 'purchase' THEN 'Shared#' || floor(value)::BIGINT
                    WHEN event_type = 'view' THEN ''
                    WHEN event_type = 'click' AND value > 60 THEN {_customer('user_id')}
                    WHEN event_type = 'click' AND value < 5 THEN upper({_customer('user_id')})
                    WHEN event_type = 'error' AND value > 60 THEN 'customer#000000001'
                    END AS username,
               CASE WHEN event_type = 'click' AND value > 100 THEN 'broken'
                    WHEN event_type IN ('click', 'signup', 'error')
                    THEN 'm' || event_id || '@example.com' END AS email,
               CASE WHEN event_type = 'signup' THEN 'new-' || event_id END AS password_hash,
               CASE WHEN event_type = 'view' AND value > 50 THEN 'admin' END AS role,
               CASE WHEN event_type = 'view' AND value > 30 THEN value > 60 END AS is_active,
               CASE WHEN event_type = 'purchase' THEN ts END AS last_login_at
        FROM events""",
    "known": """
        SELECT p.*, u.username AS own,
               (p.email IS NOT NULL
                AND NOT regexp_matches(p.email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS malformed,
               (u.username IS NOT NULL AND coalesce(p.username, '') <> ''
                AND p.username <> u.username) AS differs
        FROM patches p LEFT JOIN users u ON u.id = p.user_id""",
    "winners": f"""
        SELECT user_id, username FROM (
            SELECT *, row_number() OVER (PARTITION BY {_key('username')} ORDER BY seq) AS nth
            FROM known WHERE differs AND NOT malformed) f
        WHERE nth = 1 AND {_key('username')} NOT IN (SELECT {_key('username')} FROM users)""",
    "patched": """
        SELECT k.*,
               CASE WHEN malformed THEN 422 WHEN own IS NULL THEN 404
                    WHEN differs AND w.user_id IS NULL THEN 400 ELSE 200 END AS status
        FROM known k
        LEFT JOIN winners w ON w.user_id = k.user_id AND w.username = k.username""",
    "deletions": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderstatus = 'P' OR o_totalprice <= 450000
                    THEN -1 - o_orderkey ELSE o_custkey END AS user_id
        FROM orders""",
    "remaining": """
        SELECT * FROM users WHERE id NOT IN (SELECT user_id FROM deletions)""",
    # --- experiments
    "lines": """
        SELECT *, concat_ws('-', 'exp', l_orderkey, l_linenumber, l_partkey, l_suppkey)
                  AS experiment_id
        FROM lineitem""",
    "observations": """
        SELECT experiment_id, p_type AS experiment_type,
               l_quantity::DECIMAL(18, 4) AS temperature,
               round(l_discount * 100)::DECIMAL(18, 4) AS pressure,
               CASE WHEN l_tax > 0 THEN round(l_tax * 100)::DECIMAL(18, 4) END AS duration,
               l_extendedprice::DECIMAL(18, 4) AS outcome,
               l_returnflag = 'N' AS success
        FROM lines JOIN part ON p_partkey = l_partkey""",
    "folded": """
        SELECT experiment_type, outcome::DOUBLE AS label,
               (('0x' || substr(md5(experiment_id), 1, 8))::BIGINT % 5)::INTEGER AS fold
        FROM observations""",
    "long_all": """
        SELECT experiment_id, experiment_type, 'temperature' AS name, temperature AS value,
               outcome, success FROM observations
        UNION ALL
        SELECT experiment_id, experiment_type, 'pressure', pressure, outcome, success
        FROM observations
        UNION ALL
        SELECT experiment_id, experiment_type, 'duration', duration, outcome, success
        FROM observations""",
    "long_given": "SELECT * FROM long_all WHERE value IS NOT NULL",
    "forms": """
        SELECT s_suppkey AS query_id,
               CASE WHEN s_nationkey < 4 THEN 'STANDARD' WHEN s_nationkey < 8 THEN 'MEDIUM'
                    WHEN s_nationkey < 12 THEN 'PROMO' WHEN s_nationkey < 16 THEN 'LARGE'
                    WHEN s_nationkey < 20 THEN 'SMALL' WHEN s_nationkey < 24 THEN 'ECONOMY'
                    ELSE '' END AS experiment_type,
               CASE WHEN s_acctbal < 0 THEN s_nationkey || '-'
                    ELSE s_nationkey || '-'
                         || (s_nationkey + floor(s_acctbal / 200))::BIGINT END
                   AS temperature_range,
               CASE WHEN s_acctbal > 5000 THEN '2-' || floor(s_acctbal / 1000)::BIGINT
                    WHEN s_acctbal > 2000 THEN '' ELSE '-5' END AS pressure_range
        FROM supplier""",
    "bounds": """
        SELECT query_id, experiment_type,
               try_cast(nullif(string_split(temperature_range, '-')[1], '') AS DOUBLE)
                   AS temperature_min,
               try_cast(nullif(string_split(temperature_range, '-')[2], '') AS DOUBLE)
                   AS temperature_max,
               try_cast(nullif(string_split(pressure_range, '-')[1], '') AS DOUBLE)
                   AS pressure_min,
               try_cast(nullif(string_split(pressure_range, '-')[2], '') AS DOUBLE)
                   AS pressure_max
        FROM forms WHERE experiment_type <> ''""",
    "met": """
        SELECT q.query_id, o.experiment_type, o.temperature, o.pressure, o.outcome, o.success
        FROM bounds q JOIN observations o
          ON o.experiment_type = q.experiment_type
         AND (q.temperature_min IS NULL OR o.temperature >= q.temperature_min)
         AND (q.temperature_max IS NULL OR o.temperature <= q.temperature_max)
         AND (q.pressure_min IS NULL OR o.pressure >= q.pressure_min)
         AND (q.pressure_max IS NULL OR o.pressure <= q.pressure_max)""",
    "bins": f"""
        SELECT query_id, experiment_type,
               floor(temperature / {BIN_WIDTHS['temperature']})::BIGINT AS temperature_bin,
               floor(pressure / {BIN_WIDTHS['pressure']})::BIGINT AS pressure_bin,
               count(*) AS n, count(*) FILTER (WHERE success) AS successes,
               sum(outcome)::DOUBLE AS t, sum(outcome::DECIMAL(20, 4) * outcome)::DOUBLE AS s
        FROM met GROUP BY ALL""",
    "scored": """
        SELECT query_id, experiment_type, temperature_bin, pressure_bin, n, successes,
               round(t / n, 4) AS score,
               CASE WHEN n > 1 THEN
                   round(sqrt(greatest(s - t * t / n, 0) / (n - 1)::DOUBLE), 4) END
                   AS score_spread,
               CASE WHEN successes = 0 THEN 0::DOUBLE ELSE
               round((successes / n::DOUBLE + 1.96::DOUBLE * 1.96::DOUBLE / (n::DOUBLE * 2)
                      - sqrt(successes / n::DOUBLE * (1 - successes / n::DOUBLE) / n::DOUBLE
                             + 1.96::DOUBLE * 1.96::DOUBLE / (n::DOUBLE * n::DOUBLE * 4))
                        * 1.96::DOUBLE)
                     / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n::DOUBLE), 6) END AS confidence
        FROM bins""",
    "ranked": f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (
                PARTITION BY query_id
                ORDER BY score DESC, confidence DESC, temperature_bin, pressure_bin)::INTEGER
                AS rank
            FROM scored) r
        WHERE rank <= {TOP}""",
    # --- literature
    "tokens": """
        SELECT doc_id, list_filter(
            string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t
        FROM documents""",
    "written": """
        SELECT doc_id, text FROM documents
        UNION ALL
        SELECT -p_partkey - 1,
               CASE p_size % 3 WHEN 0 THEN 'heat was applied: ' WHEN 1 THEN 'sich ' ELSE '' END
               || p_size || '-' || p_size * 2 || ' °C, ' || p_size * 9 || ' K, ' || p_size * 150
               || '°C at ' || floor(p_retailprice)::BIGINT || ' atm or -' || p_size || ' bar, '
               || p_size * 400 || ' bar; ' || p_size * 3 || '.5 mg/mL, ' || p_size * 2 || ' g/L, 0.'
               || p_size || ' mol/L, ' || p_size || ' %, batch ' || floor(p_retailprice)::BIGINT
               || '0000000.'
        FROM part""",
    "written_tokens": """
        SELECT doc_id, list_filter(
            string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t
        FROM written""",
    "written_typed": "SELECT doc_id, CASE "
    + " ".join(
        f"WHEN list_has_any(t, {list(hints)!r}) THEN '{kind}'"
        for kind, hints in TYPE_WORDS.items()
    )
    + " ELSE 'other' END AS data_type FROM written_tokens",
    "numbers": """
        SELECT doc_id, unnest(m) AS found, generate_subscripts(m, 1) - 1 AS position
        FROM (SELECT doc_id, flatten(list_transform(
                  regexp_extract_all(text, '-?[0-9]+(?:[.][0-9]+)?(?:[-–][0-9]+(?:[.][0-9]+)?)*(?:[ \\t\\r\\n]*[\\p{L}°%]+(?:/\\p{L}+)?)?'),
                  lambda x: list_transform(
                      regexp_extract_all(
                          regexp_extract(x, '^-?[0-9]+(?:[.][0-9]+)?(?:[-–][0-9]+(?:[.][0-9]+)?)*'),
                          '-?[0-9]+(?:[.][0-9]+)?'),
                      lambda n, i: {
                          'number': CASE WHEN i = 1 THEN n ELSE ltrim(n, '-') END,
                          'unit': regexp_extract(x, '([\\p{L}°%]+(?:/\\p{L}+)?)$', 1)}))) AS m
              FROM written) d""",
    "measured": """
        SELECT doc_id, position::BIGINT AS position, found.number::DOUBLE AS value,
               CASE WHEN found.unit IN ('°C', 'K', 'atm', 'bar', 'g/L', 'mg/mL', 'mol/L', '%')
                    THEN found.unit END AS unit
        FROM numbers""",
    "standardised": """
        SELECT *,
               CASE WHEN unit IN ('°C', 'K') THEN 'temperature'
                    WHEN unit IN ('atm', 'bar') THEN 'pressure'
                    WHEN unit IN ('g/L', 'mg/mL') THEN 'concentration'
                    WHEN unit = 'mol/L' THEN 'molarity'
                    WHEN unit = '%' THEN 'share' END AS quantity,
               round(CASE WHEN unit = 'K' THEN value - 273.15::DOUBLE
                     WHEN unit = 'bar' THEN value * 0.986923::DOUBLE
                     WHEN unit IS NOT NULL THEN value END, 6) AS standard
        FROM measured""",
    "labelled": """
        SELECT doc_id, t, CASE WHEN substring(md5(doc_id::VARCHAR), 1, 1) NOT IN ('0', '1', '2', '3')
                               THEN lang END AS data_type
        FROM tokens JOIN documents USING (doc_id)""",
    "type_terms": """
        SELECT data_type, term, count(*) AS n
        FROM (SELECT data_type, unnest(t) AS term FROM labelled WHERE data_type IS NOT NULL) s
        GROUP BY ALL""",
    "typed": "SELECT doc_id, CASE "
    + " ".join(
        f"WHEN list_has_any(t, {list(hints)!r}) THEN '{kind}'"
        for kind, hints in TYPE_WORDS.items()
    )
    + " ELSE 'other' END AS data_type FROM tokens",
    "item_tokens": """
        SELECT item_id, list_filter(
            string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t
        FROM benchmark""",
    "dictionary": """
        SELECT entity, min(item_id) AS item_id FROM (
            SELECT item_id, unnest(list_filter(t, lambda w: length(w) >= 9)) AS entity
            FROM item_tokens
            UNION ALL
            SELECT item_id, unnest(list_transform(range(1, len(t)),
                                                  lambda i: t[i] || ' ' || t[i + 1]))
            FROM item_tokens) e
        GROUP BY entity""",
    "phrases": """
        SELECT entity, min(item_id) AS item_id
        FROM (SELECT item_id, unnest(list_transform(
                  range(0, len(t), 5),
                  lambda i: array_to_string(t[i + 1 : i + 1 + (i // 5) % 5], ' '))) AS entity
              FROM item_tokens) e
        GROUP BY entity""",
    "mentions": """
        SELECT doc_id, unnest(t) AS entity FROM tokens
        UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(t)),
                                             lambda i: t[i] || ' ' || t[i + 1]))
        FROM tokens""",
    "copies": """
        SELECT doc_id, sha256(text) AS text,
               sha256(lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')))) AS key
        FROM documents""",
    # --- feedback
    "feedback": """
        SELECT event_id, json_extract(props, '$.k')::BIGINT AS prediction_id,
               value::DECIMAL(18, 4) AS rating, event_type = 'purchase' AS success
        FROM events""",
    "links": """
        SELECT DISTINCT l_orderkey AS prediction_id, l_partkey AS parameter_id FROM lineitem""",
}


def _with(names: str, body: str) -> str:
    parts = [f"{n} AS ({dedent(CTES[n]).strip()})" for n in names.split()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + dedent(body).strip()


_LOGIN = "users attempts decided"
_PATCH = "users patches known winners patched"
_MATCH = "lines observations forms bounds met"
_RANK = f"{_MATCH} bins scored ranked"
_FIELDS = ("username", "email", "password_hash", "role", "is_active", "last_login_at")
_LAST = ", ".join(
    f"arg_max({f}, seq) FILTER (WHERE {f} IS NOT NULL"
    + (f" AND {f} <> ''" if f == "username" else "")
    + f") AS new_{f}"
    for f in _FIELDS
)
_BOUND = "'^\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$'"
_NUMBER_TEXT = "trim({0}) <> '' AND try_cast(trim({0}) AS DOUBLE) IS NULL"
_VALIDATED = f"""SELECT experiment_id, experiment_type,
                try_cast(trim(temperature) AS DOUBLE) AS temperature,
                try_cast(trim(pressure) AS DOUBLE) AS pressure,
                try_cast(trim(outcome) AS DOUBLE) AS outcome,
                concat_ws(',',
                    CASE WHEN experiment_type = '' THEN 'type_missing' END,
                    CASE WHEN experiment_type NOT IN ('', 'solubility', 'crystallization',
                         'reaction', 'extraction') THEN 'type_unknown' END,
                    CASE WHEN {_NUMBER_TEXT.format('temperature')}
                         THEN 'temperature_unreadable' END,
                    CASE WHEN {_NUMBER_TEXT.format('pressure')}
                         THEN 'pressure_unreadable' END,
                    CASE WHEN try_cast(pressure AS DOUBLE) < 0
                         THEN 'pressure_negative' END,
                    CASE WHEN outcome = '' THEN 'outcome_missing' END,
                    CASE WHEN {_NUMBER_TEXT.format('outcome')}
                         THEN 'outcome_unreadable' END) AS errors
         FROM (SELECT experiment_id,
                  CASE WHEN l_returnflag = 'A' THEN 'solubility'
                       WHEN l_returnflag = 'R' THEN 'reaction'
                       WHEN l_linestatus = 'F' THEN 'crystallization'
                       WHEN l_linenumber > 5 THEN '' ELSE 'distillation' END
                      AS experiment_type,
                  CASE l_linenumber WHEN 7 THEN 'n/a'
                       WHEN 6 THEN ' ' || floor(l_quantity)::BIGINT || ' '
                       ELSE floor(l_quantity)::BIGINT::VARCHAR END AS temperature,
                  CASE WHEN round(l_tax * 100) = 8 THEN '-' ELSE '' END
                      || floor(round(l_discount * 100))::BIGINT AS pressure,
                  CASE WHEN round(l_tax * 100) = 7 THEN ''
                       ELSE floor(l_extendedprice)::BIGINT::VARCHAR END AS outcome
               FROM lines) t"""
_PAGE_TEXT = "html"
for _pattern in (
    "(?is)<script[^>]*>.*?</script>",
    "(?is)<style[^>]*>.*?</style>",
    "(?is)<title[^>]*>.*?</title>",
    "(?s)<!--.*?-->",
    "(?s)<[^>]*>",
):
    _PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '{_pattern}', ' ', 'g')"


def _decoded(text: str) -> str:
    for reference, character in (
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "''"),
        ("&deg;", "°"),
        ("&#176;", "°"),
        ("&#xB0;", "°"),
        ("&micro;", "µ"),
        ("&plusmn;", "±"),
        ("&ndash;", "–"),
        ("&amp;", "&"),
    ):
        text = f"replace({text}, '{reference}', '{character}')"
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_HISTORY = """
        SELECT user_id, event_id AS seq, event_type AS state, ts AS valid_from,
               lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

SQL = {
    "login_decision": _with(
        _LOGIN,
        """SELECT seq, username, user_id, ok, CASE WHEN ok THEN 200 ELSE 401 END AS status
           FROM decided""",
    ),
    "login_audit": _with(f"{_LOGIN} audit", "SELECT * FROM audit"),
    "last_login": _with(
        _LOGIN,
        """SELECT u.id, coalesce(l.at, u.last_login_at) AS last_login_at
           FROM users u LEFT JOIN (SELECT user_id, arg_max(created_at, seq) AS at
                                   FROM decided WHERE ok GROUP BY user_id) l
           ON l.user_id = u.id""",
    ),
    "login_usage_hourly": _with(
        _LOGIN,
        """SELECT date_trunc('hour', created_at)::TIMESTAMP AS window_start,
                  date_trunc('hour', created_at)::TIMESTAMP + INTERVAL 1 HOUR AS window_end,
                  username, count(*) AS attempts, count(*) FILTER (WHERE NOT ok) AS failures
           FROM decided GROUP BY ALL""",
    ),
    "token_expiry": _with(
        _LOGIN,
        """SELECT seq, CASE WHEN ok THEN 200 ELSE 401 END AS status,
                  CASE WHEN ok THEN user_id::VARCHAR END AS subject,
                  CASE WHEN ok THEN created_at + INTERVAL 60 MINUTE END AS expires_at
           FROM decided""",
    ),
    "user_lookup": _with(
        "users",
        """SELECT p_partkey AS seq, p_partkey AS id,
                  CASE WHEN u.id IS NULL THEN 404 ELSE 200 END AS status,
                  u.username, u.email, u.role, u.is_active, u.created_at, u.last_login_at
           FROM part LEFT JOIN users u ON u.id = p_partkey""",
    ),
    "user_lookup_by_name": _with(_LOGIN, "SELECT seq, username, user_id AS id FROM decided"),
    "user_public": _with(
        "users",
        """SELECT id, username, email, role, is_active, created_at, last_login_at FROM users""",
    ),
    "register_accept": _with(
        "users registrations checked granted",
        """SELECT seq, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id,
                  username, email, password_hash, 'user' AS role, TRUE AS is_active, created_at,
                  CAST(NULL AS TIMESTAMP) AS last_login_at
           FROM granted""",
    ),
    "register_reject": _with(
        "users registrations checked granted",
        """SELECT seq, username, CASE WHEN errors <> '' THEN 422 ELSE 400 END AS status, errors
           FROM checked WHERE seq NOT IN (SELECT seq FROM granted)""",
    ),
    "patch_status": _with(_PATCH, "SELECT seq, user_id, username, status FROM patched"),
    "user_patch": _with(
        _PATCH,
        f"""SELECT u.id, coalesce(n.new_username, u.username) AS username,
                  coalesce(n.new_email, u.email) AS email,
                  coalesce(n.new_password_hash, u.password_hash) AS password_hash,
                  coalesce(n.new_role, u.role) AS role,
                  coalesce(n.new_is_active, u.is_active) AS is_active, u.created_at,
                  coalesce(n.new_last_login_at, u.last_login_at) AS last_login_at
           FROM users u LEFT JOIN (SELECT user_id, {_LAST} FROM patched
                                   WHERE status = 200 GROUP BY user_id) n
           ON n.user_id = u.id""",
    ),
    "delete_status": _with(
        "users deletions",
        """SELECT seq, user_id,
                  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1
                            AND user_id IN (SELECT id FROM users) THEN 204 ELSE 404 END
                      AS status
           FROM deletions""",
    ),
    "user_delete": _with(
        "users deletions remaining",
        """SELECT id, username, email, role, is_active, created_at, last_login_at
           FROM remaining""",
    ),
    "audit_after_delete": _with(
        f"{_LOGIN} audit deletions",
        """SELECT id, CASE WHEN user_id IN (SELECT user_id FROM deletions) THEN NULL
                           ELSE user_id END AS user_id, username, ip, ok, created_at
           FROM audit""",
    ),
    "user_history": _HISTORY,
    "history_merge": _HISTORY,
    "range_parse": _with(
        "lines",
        f"""SELECT experiment_id, range_text, min_text, max_text,
                  CASE WHEN regexp_matches(min_text, {_BOUND})
                       THEN try_cast(min_text AS DOUBLE) END AS min_value,
                  CASE WHEN regexp_matches(max_text, {_BOUND})
                       THEN try_cast(max_text AS DOUBLE) END AS max_value,
                  min_text || '-' || max_text AS printed
           FROM (SELECT *, coalesce(string_split(range_text, '-')[1], '') AS min_text,
                        coalesce(string_split(range_text, '-')[2], '') AS max_text
                 FROM (SELECT experiment_id, CASE
                        WHEN l_returnflag = 'A'
                        THEN floor(l_quantity)::BIGINT || '-' || l_suppkey
                        WHEN l_returnflag = 'R' AND l_linestatus = 'O'
                        THEN '-' || floor(l_quantity)::BIGINT || '-' || l_suppkey
                        WHEN l_returnflag = 'R' THEN floor(l_quantity)::BIGINT::VARCHAR
                        WHEN l_linestatus = 'O'
                        THEN floor(l_quantity)::BIGINT || '- ' || l_suppkey || '- x'
                        WHEN l_linenumber > 4 THEN '' ELSE 'warm-hot' END AS range_text
                       FROM lines) t) s""",
    ),
    "upload_names": """
        SELECT p_partkey, array_to_string(listed, '|') AS listed,
               array_to_string([listed[i] FOR i IN range(1, len(listed) + 1)
                                IF i - 1 <> floor(p_size / 10)], '|') AS remaining
        FROM (SELECT p_partkey, p_size, list_concat(['old.csv'], list_filter(
                  [p_name || '.csv', p_brand || '.XLSX', p_type || '.txt', p_name || '.csv'],
                  lambda f: regexp_matches(lower(f), '\\.(csv|xlsx|xls)$'))) AS listed
              FROM part) l""",
    "avatar_initial": "SELECT p_partkey, upper(p_name[1]) AS initial FROM part",
    "json_roundtrip": """
        SELECT event_id, json_valid(body) AS readable,
               CASE WHEN json_valid(body) THEN json_extract(body, '$.k')::BIGINT END AS k,
               CASE WHEN json_valid(body)
                    THEN '{"k":' || json_extract(body, '$.k')::BIGINT || '}' END AS printed
        FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN replace(props, '}', '')
                                    ELSE props END AS body FROM events) b""",
    "experiment_create": """
        SELECT o_orderkey AS seq, o_custkey AS user_id, o_orderpriority AS experiment_type,
               'exp_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END
                   AS experiment_id
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) o""",
    "experiment_list": _with(
        "users lines",
        """SELECT experiment_id, o_custkey AS user_id, p_type AS experiment_type,
                  l_shipdate AS created_at, u.username
           FROM lines JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
           LEFT JOIN users u ON u.id = o_custkey""",
    ),
    "experiment_params": _with(
        "lines observations long_all long_given",
        """SELECT e.experiment_id, e.experiment_type, r.outcome::DOUBLE AS outcome, r.success,
                  p.name, p.value::DOUBLE AS value
           FROM observations e JOIN observations r ON r.experiment_id = e.experiment_id
           JOIN long_given p ON p.experiment_id = e.experiment_id""",
    ),
    "experiment_wide": _with(
        "lines observations",
        """SELECT experiment_id, max(temperature)::DOUBLE AS temperature,
                  max(pressure)::DOUBLE AS pressure, max(duration)::DOUBLE AS duration,
                  CASE WHEN max(duration) IS NULL THEN 2 ELSE 3 END AS n_params
           FROM observations GROUP BY experiment_id""",
    ),
    "param_predictions": _with(
        "links",
        """SELECT prediction_id, parameter_id, o_totalprice AS score, p_brand AS name,
                  p_size::DOUBLE AS value
           FROM links JOIN orders ON o_orderkey = prediction_id
           JOIN part ON p_partkey = parameter_id""",
    ),
    "experiment_validate": _with("lines", _VALIDATED),
    "upload_process": _with("lines", _VALIDATED),
    "orphans": _with(
        "users deletions remaining feedback links",
        """SELECT 'experiment_user' AS relation, o_custkey::VARCHAR AS missing_key,
                  count(*) AS n_rows
           FROM orders WHERE o_custkey NOT IN (SELECT id FROM remaining) GROUP BY ALL
           UNION ALL
           SELECT 'event_user', user_id::VARCHAR, count(*)
           FROM events WHERE user_id NOT IN (SELECT id FROM remaining) GROUP BY ALL
           UNION ALL
           SELECT 'feedback_prediction', prediction_id::VARCHAR, count(*) FROM feedback
           WHERE prediction_id NOT IN (SELECT prediction_id FROM links) GROUP BY ALL
           UNION ALL
           SELECT 'unused_parameter', p_partkey::VARCHAR, count(*) FROM part
           WHERE p_partkey NOT IN (SELECT parameter_id FROM links) GROUP BY ALL""",
    ),
    "dashboard_stats": """
        SELECT c_custkey AS user_id, count(l_orderkey) AS experiments,
               count(*) FILTER (WHERE l_returnflag = 'N') AS successes,
               CASE WHEN count(l_orderkey) > 0 THEN
                   ((200 * count(*) FILTER (WHERE l_returnflag = 'N') + count(l_orderkey))
                    // (2 * count(l_orderkey)))::BIGINT END AS success_rate
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        LEFT JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY c_custkey""",
    "constraint_rows": _with(
        "forms bounds",
        """SELECT query_id, experiment_type, 'temperature' AS param, temperature_min AS min,
                  temperature_max AS max FROM bounds
           UNION ALL
           SELECT query_id, experiment_type, 'pressure', pressure_min, pressure_max
           FROM bounds""",
    ),
    "constraint_match": _with(
        _MATCH,
        """SELECT query_id, experiment_type, temperature::DOUBLE AS temperature,
                  pressure::DOUBLE AS pressure, count(*) AS n,
                  count(*) FILTER (WHERE success) AS successes, sum(outcome)::DOUBLE AS total
           FROM met GROUP BY ALL""",
    ),
    "constraint_totals": _with(
        _MATCH,
        """SELECT b.query_id, b.experiment_type, count(m.query_id) AS n,
                  count(*) FILTER (WHERE m.success) AS successes,
                  round(sum(outcome)::DOUBLE / count(m.query_id), 4) AS mean_outcome,
                  CASE WHEN count(*) FILTER (WHERE m.success) = 0 THEN 0::DOUBLE ELSE
                  round((count(*) FILTER (WHERE m.success) / count(m.query_id)::DOUBLE
                         + 1.96::DOUBLE * 1.96::DOUBLE / (count(m.query_id)::DOUBLE * 2)
                         - sqrt(count(*) FILTER (WHERE m.success) / count(m.query_id)::DOUBLE
                                * (1 - count(*) FILTER (WHERE m.success) / count(m.query_id)::DOUBLE)
                                / count(m.query_id)::DOUBLE
                                + 1.96::DOUBLE * 1.96::DOUBLE
                                / (count(m.query_id)::DOUBLE * count(m.query_id)::DOUBLE * 4))
                           * 1.96::DOUBLE)
                        / (1 + 1.96::DOUBLE * 1.96::DOUBLE / count(m.query_id)::DOUBLE), 6) END
                      AS confidence
           FROM bounds b LEFT JOIN met m ON m.query_id = b.query_id
           GROUP BY b.query_id, b.experiment_type""",
    ),
    "recommend_topk": _with(_RANK, "SELECT * FROM ranked"),
    "prediction_envelope": _with(
        _RANK,
        """SELECT b.query_id, b.experiment_type,
                  coalesce(string_agg(concat_ws(':', rank, temperature_bin, pressure_bin, n),
                                      '|' ORDER BY rank), '') AS predictions,
                  coalesce(max(confidence) FILTER (WHERE rank = 1), 0.0::DOUBLE) AS confidence
           FROM bounds b LEFT JOIN ranked r ON r.query_id = b.query_id
           GROUP BY b.query_id, b.experiment_type""",
    ),
    "param_histogram": _with(
        "lines observations long_all long_given",
        """SELECT experiment_type, name, low, high,
                  CASE WHEN high > low THEN least(
                      floor((value::DOUBLE - low) * 10.0::DOUBLE / (high - low)), 9)::BIGINT + 1
                  ELSE 1 END AS bucket, count(*) AS n
           FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi,
                        lo::DOUBLE AS low, hi::DOUBLE AS high
                 FROM long_given WINDOW w AS (PARTITION BY experiment_type, name)) v
           GROUP BY ALL""",
    ),
    "main_effects": _with(
        "lines observations long_all long_given",
        """SELECT *, row_number() OVER (PARTITION BY experiment_type
                      ORDER BY abs(effect) DESC NULLS LAST, name)::INTEGER AS strength_rank,
                  row_number() OVER (PARTITION BY experiment_type
                      ORDER BY abs(effect) DESC NULLS LAST, name) <= 2 AS selected
           FROM (SELECT experiment_type, name, count(*) FILTER (WHERE up) AS n_high,
                        count(*) FILTER (WHERE NOT up) AS n_low,
                        round((sum(outcome) FILTER (WHERE up))::DOUBLE
                              / count(*) FILTER (WHERE up)
                              - (sum(outcome) FILTER (WHERE NOT up))::DOUBLE
                              / count(*) FILTER (WHERE NOT up), 4) AS effect,
                        round((count(*)::DOUBLE * sum(value::DECIMAL(20, 4) * outcome)::DOUBLE
                               - sum(value)::DOUBLE * sum(outcome)::DOUBLE)
                              / (sqrt(count(*)::DOUBLE * sum(value::DECIMAL(20, 4) * value)::DOUBLE
                                      - sum(value)::DOUBLE * sum(value)::DOUBLE)
                                 * sqrt(count(*)::DOUBLE * sum(outcome::DECIMAL(20, 4) * outcome)::DOUBLE
                                        - sum(outcome)::DOUBLE * sum(outcome)::DOUBLE)), 6)
                            AS correlation
                 FROM (SELECT *, value::DOUBLE >= (min(value) OVER w
                                  + max(value) OVER w)::DOUBLE / 2.0::DOUBLE AS up
                       FROM long_given WINDOW w AS (PARTITION BY experiment_type, name)) h
                 GROUP BY ALL) e""",
    ),
    "normalise": _with(
        "lines observations long_all",
        """SELECT experiment_id, l.experiment_type, l.name, value::DOUBLE AS value,
                  round(coalesce(value::DOUBLE, mean), 6) AS filled,
                  CASE WHEN spread > 0 THEN
                      round((coalesce(value::DOUBLE, mean) - mean) / spread, 6) END AS z_score,
                  CASE WHEN high > low THEN
                      round((coalesce(value::DOUBLE, mean) - low) / (high - low), 6) END
                      AS unit_scale
           FROM long_all l
           JOIN (SELECT experiment_type, name, t / n AS mean, low, high,
                        CASE WHEN n > 1 THEN
                            sqrt(greatest(s - t * t / n, 0) / (n - 1)::DOUBLE) END AS spread
                 FROM (SELECT experiment_type, name, count(value)::DOUBLE AS n,
                              sum(value)::DOUBLE AS t, sum(value::DECIMAL(20, 4) * value)::DOUBLE AS s,
                              min(value)::DOUBLE AS low, max(value)::DOUBLE AS high
                       FROM long_all GROUP BY ALL) a) m
           ON m.experiment_type = l.experiment_type AND m.name = l.name""",
    ),
    "effectiveness": _with(
        "feedback links",
        """SELECT p_brand AS name, floor(p_size / 10)::BIGINT AS value_bin,
                  count(rating) AS ratings, count(*) FILTER (WHERE success) AS successes,
                  round(sum(rating)::DOUBLE / count(rating), 4) AS mean_rating
           FROM feedback f JOIN links l ON l.prediction_id = f.prediction_id
           JOIN part ON p_partkey = l.parameter_id
           GROUP BY ALL""",
    ),
    "feedback_match": _with(
        "feedback",
        """SELECT event_id, prediction_id, o_orderstatus = 'F' AS predicted_success, success,
                  success = (o_orderstatus = 'F') AS matches
           FROM feedback JOIN orders ON o_orderkey = prediction_id""",
    ),
    "lit_search": _with(
        "tokens",
        f"""SELECT doc_id, len(h) AS hits, len(list_distinct(h)) AS keywords
           FROM (SELECT doc_id, list_filter(t, lambda w: w IN ({', '.join(
               repr(k) for k in KEYWORDS)})) AS h FROM tokens) s
           WHERE len(h) > 0
           ORDER BY hits DESC, keywords DESC, doc_id LIMIT 50""",
    ),
    "lit_ranked": _with(
        "tokens",
        f"""SELECT doc_id, count(*) AS keywords,
                  sum(round(ln(1 + (docs - holders + 0.5::DOUBLE) / (holders + 0.5::DOUBLE)) * n * 2.2::DOUBLE
                      / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)), 9)::DECIMAL(20, 9))::DOUBLE AS score
           FROM (SELECT *, count(*) OVER (PARTITION BY term) AS holders
                 FROM (SELECT doc_id, term, len(t) AS length, count(*) AS n
                       FROM (SELECT doc_id, t, unnest(t) AS term FROM tokens) u
                       WHERE term IN ({', '.join(repr(k) for k in KEYWORDS)})
                       GROUP BY doc_id, term, length) g) h
           CROSS JOIN (SELECT count(*) AS docs, sum(len(t))::DOUBLE / count(*) AS mean_length FROM tokens) z
           GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
    ),
    "page_text": f"""
        SELECT page_id, url,
               {_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
               {_decoded(_PAGE_TEXT)} AS text
        FROM pages""",
    "lit_params": _with(
        "written numbers measured standardised",
        "SELECT doc_id, position, value, unit, quantity, standard FROM standardised",
    ),
    "lit_validate": _with(
        "written numbers measured standardised",
        """SELECT doc_id, position, value, concat_ws(',',
                  CASE WHEN value IS NULL THEN 'unreadable' END,
                  CASE WHEN unit IS NULL THEN 'no_unit' END,
                  CASE WHEN abs(value) > 1e9 THEN 'number_too_large' END,
                  CASE WHEN quantity = 'temperature'
                            AND standard NOT BETWEEN -273.15 AND 3000
                       THEN 'temperature_implausible' END,
                  CASE WHEN quantity = 'pressure' AND standard NOT BETWEEN 0 AND 10000
                       THEN 'pressure_implausible' END) AS errors
           FROM standardised""",
    ),
    "lit_entities": _with(
        "tokens item_tokens dictionary mentions",
        """SELECT doc_id, entity, item_id, count(*) AS mentions
           FROM mentions JOIN dictionary USING (entity) GROUP BY ALL""",
    ),
    "lit_longest": _with(
        "tokens item_tokens phrases",
        """SELECT doc_id, entity, item_id, count(*) AS mentions
           FROM (SELECT doc_id, unnest(list_reduce(
                     list_transform(list(m ORDER BY m.position), lambda x: [x]),
                     lambda a, x: CASE WHEN x[1].position >= a[-1].position + a[-1].n
                                       THEN list_concat(a, x) ELSE a END)).entity AS entity
                 FROM (SELECT d.doc_id, {'position': d.position, 'n': max(d.n),
                              'entity': arg_max(d.entity, d.n)} AS m
                       FROM (SELECT doc_id, n, i AS position,
                                    array_to_string(t[i + 1 : i + n], ' ') AS entity
                             FROM (SELECT doc_id, t, unnest(range(len(t))) AS i FROM tokens) w
                             JOIN (SELECT DISTINCT string_split(entity, ' ')[1] AS first,
                                          len(string_split(entity, ' ')) AS n FROM phrases) f
                             ON f.first = t[i + 1] AND i + n <= len(t)) d
                       JOIN phrases p ON p.entity = d.entity
                       GROUP BY d.doc_id, d.position) g
                 GROUP BY doc_id) r
           JOIN phrases USING (entity) GROUP BY ALL""",
    ),
    "lit_dedup": _with(
        "copies",
        """SELECT doc_id, key, copies, text
           FROM (SELECT *, count(*) OVER (PARTITION BY key) AS copies,
                        row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth
                 FROM copies) k
           WHERE nth = 1""",
    ),
    "lit_types": _with("tokens typed", "SELECT doc_id, data_type FROM typed"),
    "lit_type_terms": _with("tokens labelled type_terms", "SELECT * FROM type_terms"),
    "lit_trained": _with(
        "tokens labelled type_terms",
        """SELECT doc_id, data_type, total / 1e6::DOUBLE AS score
           FROM (SELECT doc_id, p.data_type,
                        prior + coalesce(sum(CASE WHEN v.term IS NOT NULL THEN w END), 0) AS total
                 FROM (SELECT doc_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [''] END) AS term FROM labelled) d
                 CROSS JOIN (SELECT data_type, round(ln(count(*) / sum(count(*)) OVER ()) * 1e6::DOUBLE)::BIGINT AS prior
                             FROM labelled WHERE data_type IS NOT NULL GROUP BY ALL) p
                 LEFT JOIN (SELECT DISTINCT term FROM type_terms) v USING (term)
                 LEFT JOIN (SELECT a.term, b.data_type,
                                   round(ln((coalesce(n, 0) + 1) / (total + size)::DOUBLE) * 1e6::DOUBLE)::BIGINT AS w
                            FROM (SELECT DISTINCT term FROM type_terms) a
                            CROSS JOIN (SELECT data_type, sum(n) AS total,
                                               (SELECT count(DISTINCT term) FROM type_terms) AS size
                                        FROM type_terms GROUP BY ALL) b
                            LEFT JOIN type_terms c ON c.term = a.term AND c.data_type = b.data_type) m
                   ON m.term = d.term AND m.data_type = p.data_type
                 GROUP BY doc_id, p.data_type, prior) s
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, data_type) = 1""",
    ),
    "lit_rows": _with(
        "written written_tokens written_typed numbers measured standardised",
        """SELECT doc_id, data_type, quantity AS name, value, unit
           FROM standardised JOIN written_typed USING (doc_id) WHERE unit IS NOT NULL""",
    ),
    "page_values": f"WITH written AS (SELECT page_id AS doc_id, {_decoded(_PAGE_TEXT)} AS text "
    + "FROM pages), "
    + _with(
        "numbers measured standardised",
        "SELECT doc_id AS page_id, position, value, unit, quantity, standard FROM standardised",
    ).removeprefix("WITH "),
    "stream_login": _with(f"{_LOGIN} audit", "SELECT * FROM audit"),
    "baseline_eval": _with(
        "lines observations folded",
        """SELECT 'type_mean' AS model, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse,
                  round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(label), 4) AS r2
           FROM (SELECT f.label, coalesce(m.mean, a.mean) - f.label AS e
                 FROM folded f
                 LEFT JOIN (SELECT experiment_type, avg(label) AS mean FROM folded WHERE fold <> 0
                            GROUP BY ALL) m ON m.experiment_type = f.experiment_type
                 CROSS JOIN (SELECT avg(label) AS mean FROM folded WHERE fold <> 0) a
                 WHERE f.fold = 0) s""",
    ),
    "model_folds": _with(
        "lines observations folded",
        """SELECT experiment_type, fold, count(*) AS n, round(avg(label), 4) AS mean_outcome
           FROM folded GROUP BY ALL""",
    ),
    "stream_last_login": _with(
        _LOGIN,
        """SELECT u.id, coalesce(l.at, u.last_login_at) AS last_login_at
           FROM users u LEFT JOIN (SELECT user_id, arg_max(created_at, seq) AS at
                                   FROM decided WHERE ok GROUP BY user_id) l
           ON l.user_id = u.id""",
    ),
    "stream_dashboard": """
        SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, user_id,
               count(*) AS experiments,
               count(*) FILTER (WHERE event_type = 'purchase') AS successes
        FROM events GROUP BY ALL""",
    "stream_feedback": """
        SELECT json_extract(props, '$.k')::BIGINT AS prediction_id, user_id,
               value::DECIMAL(18, 4)::DOUBLE AS rating, event_type = 'purchase' AS success
        FROM events WHERE event_type <> 'error'""",
    "stream_usage": _with(
        _LOGIN,
        """SELECT date_trunc('hour', created_at)::TIMESTAMP AS window_start,
                  date_trunc('hour', created_at)::TIMESTAMP + INTERVAL 1 HOUR AS window_end,
                  username, count(*) AS attempts,
                  count(*) FILTER (WHERE NOT ok) AS failures
           FROM decided GROUP BY ALL""",
    ),
    "stream_learning": _with(
        "feedback",
        """SELECT n, total, round(my - (b1 * m1 + b2 * m2), 6) AS intercept,
                  round(b1, 6) AS amount, round(b2, 6) AS finished
           FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
                 FROM (SELECT count(*) AS n, sum(rating)::DOUBLE AS total, avg(y) AS my,
                              avg(a) AS m1, avg(d) AS m2, var_pop(a) AS s11, var_pop(d) AS s22,
                              covar_pop(a, d) AS s12, covar_pop(a, y) AS s1y, covar_pop(d, y) AS s2y
                       FROM (SELECT rating, rating::DOUBLE AS y,
                                    (o_totalprice / 100000)::DECIMAL(18, 4)::DOUBLE AS a,
                                    (o_orderstatus = 'F')::INT::DOUBLE AS d
                             FROM feedback JOIN orders ON o_orderkey = prediction_id
                             JOIN events USING (event_id)
                             WHERE event_type <> 'error') r) s) b""",
    ),
}
