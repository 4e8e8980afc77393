"""DuckDB SQL for the catalogue: small helpers, and a library of CTEs that queries draw on."""

from __future__ import annotations

from ..functions import values as V
from ..functions.text import any_of
from ..sources.messages import BRANDS
from ..sources.messages import SQL as MESSAGES
from ..sources.messages import sql_text as q

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), {q(V.URL)}, ' ', 'gi'), '@{WORD}+', ' ', 'g'), '{WS}+', ' ', 'g')))"


def words(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END"


def has_any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in phrases) + ")"


def content(c: str) -> str:
    return f"regexp_matches({c}, '{WORD}')"


def urls(x: str) -> str:
    return f"regexp_extract_all({x}, {q('(?i)' + V.URL)})"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(^|[^0-9])(\+?[0-9][0-9\s().\-]{8,}[0-9])"
NUMBER = r"(^|[^@\w])([0-9]{5,})\b"


def redaction(source: str, column: str, keep: str) -> str:
    """A SELECT with ``keep``, red and the four counts."""
    return f"""
SELECT {keep}, regexp_replace(s3, {q(NUMBER)}, '\\1[NUM]', 'g') AS red, n_url, n_email, n_phone,
       CAST(len(regexp_extract_all(s3, {q(NUMBER)})) AS BIGINT) AS n_number
FROM (SELECT *, regexp_replace(s2, {q(PHONE)}, '\\1[PHONE]', 'g') AS s3, CAST(len(regexp_extract_all(s2, {q(PHONE)})) AS BIGINT) AS n_phone
FROM (SELECT *, regexp_replace(s1, {q(EMAIL)}, '[EMAIL]', 'g') AS s2, CAST(len(regexp_extract_all(s1, {q(EMAIL)})) AS BIGINT) AS n_email
FROM (SELECT *, regexp_replace(s0, {q(V.URL)}, '[URL]', 'gi') AS s1, CAST(len(regexp_extract_all(s0, {q('(?i)' + V.URL)})) AS BIGINT) AS n_url
FROM (SELECT *, {norm(column)} AS s0 FROM {source}))))"""


NAMES = list(V.RULES)
HIT = {n: f"h{k}" for k, n in enumerate(NAMES)}
_hits = ", ".join(f"regexp_matches(clean, {q(V.RULES[n])}) AS {HIT[n]}" for n in NAMES)


def pick(order: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {HIT[n]} THEN {q(n)}" for n in order if n != V.OTHER) + f" ELSE {q(V.OTHER)} END"


def joined(sep: str, but: str | None = None) -> str:
    return f"concat_ws({q(sep)}, " + ", ".join(f"CASE WHEN {HIT[n]}" + (f" AND {but} <> {q(n)}" if but else "") + f" THEN {q(n)} END" for n in NAMES) + ")"


n_hits = "(" + " + ".join(f"CAST({h} AS INT)" for h in HIT.values()) + ")"


def labelled(source: str) -> str:
    return f"""SELECT *, {pick(V.TAXONOMY_ORDER)} AS intent, {pick(V.AGENT_ORDER)} AS agent_intent, {joined(', ')} AS matched, {n_hits} AS n_matched
FROM (SELECT *, {_hits} FROM {source})"""


def assessed(source: str) -> str:
    count = "CASE agent_intent " + " ".join(f"WHEN {q(n)} THEN len(regexp_extract_all(clean, {q(V.RULES[n])}))" for n in NAMES) + " ELSE 1 END"
    strong = "CASE agent_intent " + " ".join(f"WHEN {q(n)} THEN {has_any('clean', V.STRONG_PHRASES[n])}" for n in NAMES) + " ELSE false END"
    return f"""
SELECT *, CASE WHEN points >= 80 THEN 'high' WHEN points >= 55 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN n_matched = 0 THEN 'no keyword rule matched' ELSE concat_ws('; ', 'matched taxonomy rule for ''' || agent_intent || '''',
    CASE WHEN strong THEN 'strong phrase match' END, CASE WHEN n_matched >= 2 THEN 'also matched: ' || {joined(', ', 'agent_intent')} END) END AS evidence,
  CASE WHEN {has_any('clean', V.HUMAN_REQUEST)} THEN 'human' WHEN {has_any('clean', V.LEGAL)} THEN 'legal'
    WHEN agent_intent = 'refund_or_payment' OR {has_any('clean', V.PAYMENT)} THEN 'payment'
    WHEN agent_intent = 'account_or_technical_issue' AND {has_any('clean', V.ACCOUNT)} THEN 'account'
    WHEN {has_any('clean', V.UNRESOLVED)} THEN 'unresolved'
    WHEN agent_intent IN ({', '.join(map(q, V.LIVE_ORDER))}) THEN 'live'
    WHEN agent_intent = {q(V.OTHER)} OR points < 55 THEN 'unclear' ELSE 'none' END AS escalation
FROM (SELECT *, CAST(CASE WHEN n_matched = 0 THEN 30 ELSE least(greatest(
    CASE WHEN strong THEN greatest(72 + 8 * least(n - 1, 2), 88) ELSE 72 + 8 * least(n - 1, 2) END - 6 * least(n_matched - 1, 3), 35), 98) END AS BIGINT) AS points
FROM (SELECT *, greatest({count}, 1) AS n, {strong} AS strong FROM {source}))"""


REASON = "CASE escalation " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in V.REASONS.items()) + " END"
ISO = lambda x: f"coalesce(strftime(try_strptime({x}, '%a %b %d %H:%M:%S +0000 %Y'), '%Y-%m-%dT%H:%M:%S+00:00'), '')"
_brands = ", ".join(q(b.lower()) for b in BRANDS)


def signals(raw: str, c: str) -> dict[str, str]:
    url = f"regexp_matches({raw}, {q('(?i)' + V.URL)})"
    redirect = f"regexp_matches({c}, {q(any_of(V.REDIRECT_PHRASES))})"
    act = f"({url} OR regexp_matches({c}, '[0-9]') OR regexp_matches({c}, {q(rf'\b(?:{any_of(V.ACTIONABLE_TERMS)})\b')}))"
    short = f"({words(c)} <= {V.SHORT_REPLY_WORDS})"
    total = f"(CAST({redirect} AS BIGINT) + CAST({short} AS BIGINT) + CAST(NOT {act} AS BIGINT))"
    return {"valid": f"{c} <> ''", "n_words": f"CAST({words(c)} AS BIGINT)", "has_url": url, "has_redirect": redirect, "has_actionable": act,
            "is_short": short, "signals": total, "is_generic": f"({c} <> '' AND {total} >= 2)"}


_sig = ", ".join(f"{e} AS {k}" for k, e in signals("r.text", "r.clean").items())
_cat = ", ".join(f"CAST(count(*) FILTER (regexp_matches(clean, {q(p)})) AS BIGINT) AS c_{k}" for k, p in V.CATEGORIES.items())
_ks = [f"c_{k}" for k in V.CATEGORIES]
_entropy = " + ".join(f"CASE WHEN {k} > 0 THEN {k} / ({'+'.join(_ks)}) * ln({k} / ({'+'.join(_ks)})) ELSE 0 END" for k in _ks)
_active = " + ".join(f"CASE WHEN {k} / customer_messages >= 0.02 THEN 1 ELSE 0 END" for k in _ks)
_weighted = " + ".join(f"{w} * s_{k}" for k, w in V.WEIGHTS.items())


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}{{2,}}')"


def grams(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term
  FROM (SELECT {key}, {tokens(text)} AS t FROM {source})) GROUP BY ALL"""


def weights(tf: str, df: str, key: str) -> str:
    return f"""SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {tf} JOIN {df} USING (term))"""


CTES: dict[str, tuple[str, list[str]]] = {
    "messages": (MESSAGES, []),
    "typed": (
        f"""SELECT coalesce(try_cast(tweet_id AS BIGINT), 0) AS id, coalesce(try_cast(in_response_to_tweet_id AS BIGINT), 0) AS parent,
  coalesce(inbound = 'True', false) AS inbound, coalesce(author_id, '') AS author, coalesce(created_at, '') AS created_at, coalesce(text, '') AS text,
  {clean('text')} AS clean FROM messages""",
        ["messages"],
    ),
    "asked": ("SELECT * FROM typed WHERE inbound", ["typed"]),
    "labelled": (labelled("asked"), ["asked"]),
    "assessed": (assessed("labelled"), ["labelled"]),
    "replies": (f"SELECT *, lower(author) AS brand FROM typed WHERE NOT inbound AND id > 0 AND lower(author) IN ({_brands})", ["typed"]),
    "nodes": (
        """SELECT id, coalesce(max(CASE WHEN parent BETWEEN 1 AND (SELECT max(id) FROM typed) THEN parent END), id) AS up, bool_or(inbound) AS inbound
  FROM typed WHERE id > 0 GROUP BY id""",
        ["typed"],
    ),
    "walk": (
        "SELECT id, id AS spot, 0 AS n FROM nodes UNION ALL SELECT w.id, e.up, n + 1 FROM walk w JOIN nodes e ON e.id = w.spot WHERE e.up <> w.spot",
        ["nodes"],
    ),
    "roots": ("SELECT id, arg_max(spot, n) AS root FROM walk GROUP BY id", ["walk"]),
    "sizes": (
        """SELECT *, size - n_inbound AS n_outbound, size >= 3 AND n_inbound >= 1 AND size - n_inbound >= 1 AS is_multi_turn
  FROM (SELECT root, count(*) AS size, count(*) FILTER (inbound) AS n_inbound FROM nodes JOIN roots USING (id) GROUP BY root)""",
        ["nodes", "roots"],
    ),
    "there": (
        """SELECT id AS parent, bool_or(inbound) AS p_inbound, any_value(text) AS p_text, any_value(author) AS p_author,
  any_value(created_at) AS p_created_at, any_value(clean) AS p_clean FROM typed WHERE id > 0 GROUP BY id""",
        ["typed"],
    ),
    "outcomes": (
        """SELECT r.*, p_inbound, p_text, p_author, p_created_at, p_clean,
  CASE WHEN NOT parent BETWEEN 1 AND (SELECT max(id) FROM typed) THEN 'no_parent_id' WHEN p_inbound IS NULL THEN 'parent_not_in_data'
       WHEN NOT p_inbound THEN 'reply_to_non_customer' ELSE 'candidate' END AS outcome
  FROM replies r LEFT JOIN there USING (parent)""",
        ["replies", "there"],
    ),
    "cred": (redaction("(SELECT * FROM outcomes WHERE outcome = 'candidate')", "p_text", "id"), ["outcomes"]),
    "bred": (redaction("(SELECT * FROM outcomes WHERE outcome = 'candidate')", "text", "id"), ["outcomes"]),
    "pairs0": (
        f"""SELECT *, CASE WHEN bn = '' THEN 'empty_brand_text' WHEN cn = '' THEN 'empty_customer_text'
    WHEN NOT {content('p_clean')} THEN 'customer_only_mention_or_url' WHEN NOT {content('clean')} THEN 'brand_only_mention_or_url' ELSE '' END AS failed
  FROM (SELECT *, {norm('p_text')} AS cn, {norm('text')} AS bn FROM outcomes WHERE outcome = 'candidate')""",
        ["outcomes"],
    ),
    "pairs1": (
        """SELECT *, failed = '' AND row_number() OVER (PARTITION BY brand, lower(cn), lower(bn), failed = '' ORDER BY id) > 1 AS is_duplicate FROM pairs0""",
        ["pairs0"],
    ),
    "interactions": (
        f"""SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY customer_created_at, brand_tweet_id) AS turn_in_conversation FROM (
  SELECT p.brand, p.brand || '-' || p.id AS pair_id, p.brand || '-conv-' || root AS conversation_id, size AS conversation_message_count,
    is_multi_turn AS is_multi_turn_conversation, parent AS customer_tweet_id, p_author AS customer_author_id, true AS customer_inbound,
    {ISO('p_created_at')} AS customer_created_at, p_text AS customer_text, cn AS customer_normalized_text, cred.red AS customer_redacted_text,
    array_to_string({urls('p_text')}, ' | ') AS customer_urls, p.id AS brand_tweet_id, p.author AS brand_author_id, false AS brand_inbound,
    {ISO('p.created_at')} AS brand_created_at, p.text AS brand_text, bn AS brand_normalized_text, bred.red AS brand_redacted_text,
    array_to_string({urls('p.text')}, ' | ') AS brand_urls, parent AS in_response_to_tweet_id,
    {signals('p.text', 'p.clean')['is_generic']} AS is_generic_reply, is_duplicate, failed = '' AND NOT is_duplicate AS is_usable,
    CASE WHEN is_duplicate THEN 'duplicate' ELSE failed END AS unusable_reason
  FROM pairs1 p JOIN roots USING (id) JOIN sizes USING (root) JOIN cred USING (id) JOIN bred USING (id))""",
        ["pairs1", "roots", "sizes", "cred", "bred"],
    ),
    "pairs": (labelled(f"(SELECT *, {clean('customer_text')} AS clean FROM interactions)"), ["interactions"]),
    "customers": (
        f"""SELECT brand, count(*) AS customer_messages, count(DISTINCT author) AS unique_customers, count(DISTINCT clean) AS distinct_texts,
    count(*) FILTER (regexp_matches(text, {q('(?i)' + V.URL)})) AS url_messages, count(*) FILTER (regexp_matches(text, '@{WORD}+')) AS mention_messages,
    count(*) FILTER (regexp_matches(clean, {q(V.ENGLISH)})) AS english_messages, {_cat}
  FROM (SELECT *, nullif(lower(regexp_extract(text, '(?i)@({'|'.join(BRANDS)})\\b', 1)), '') AS brand FROM asked) WHERE brand IS NOT NULL GROUP BY brand""",
        ["asked"],
    ),
    "entropy": (f"SELECT brand, round(1e-9 + -({_entropy}) / ln({len(_ks)}), 4) AS diversity, CAST({_active} AS BIGINT) AS active_categories FROM customers", ["customers"]),
    "brand_replies": (
        f"""SELECT brand, count(*) AS replies, count(*) FILTER (valid) AS valid_replies, count(*) FILTER (is_generic) AS generic_replies,
    count(*) FILTER (valid AND NOT is_generic) AS meaningful_replies, count(*) FILTER (is_short) AS short_replies, count(*) FILTER (has_url) AS url_replies,
    CAST(greatest(count(*) FILTER (valid) - count(DISTINCT clean) FILTER (valid), 0) AS BIGINT) AS duplicate_replies,
    count(*) FILTER (there_is) AS connected_pairs, count(*) FILTER (usable) AS usable_pairs, count(DISTINCT parent) FILTER (usable) AS answered_messages
  FROM (SELECT *, there_is AND valid AND p_inbound AND p_clean <> '' AS usable FROM (
    SELECT r.brand, r.clean, parent, p_inbound, p_clean, {_sig},
      p_inbound IS NOT NULL AND parent BETWEEN 1 AND (SELECT max(id) FROM typed) AS there_is
    FROM (SELECT *, lower(author) AS brand FROM typed WHERE NOT inbound AND lower(author) IN ({_brands})) r LEFT JOIN there USING (parent))) GROUP BY brand""",
        ["typed", "there"],
    ),
    "talks": (
        """SELECT brand, count(*) AS conversations, count(*) FILTER (is_multi_turn) AS multi_turn, round(1e-9 + avg(size), 3) AS average_length,
    round(1e-9 + quantile_cont(size, 0.5), 3) AS median_length FROM (SELECT DISTINCT brand, root FROM replies JOIN roots USING (id)) JOIN sizes USING (root) GROUP BY brand""",
        ["replies", "roots", "sizes"],
    ),
    "scores": (
        f"""SELECT *, round(1e-9 + {_weighted}, 4) AS selection_score FROM (
  SELECT brand, replies, coalesce(customer_messages, 0) AS customer_messages, usable_pairs, coalesce(conversations, 0) AS conversations,
    coalesce(multi_turn, 0) AS multi_turn_conversations, meaningful_percentage, coalesce(diversity, 0) AS diversity,
    coalesce(active_categories, 0) AS active_categories, english_percentage, usable_pairs AS golden_set_capacity,
    CAST(floor(usable_pairs * {V.TEST_SHARE}) AS BIGINT) AS evaluation_capacity,
    round(1e-9 + meaningful_percentage / 100.0, 4) AS s_groundability, round(1e-9 + least(usable_pairs / {V.USABLE_TARGET}, 1.0), 4) AS s_usable_volume,
    round(1e-9 + coalesce(diversity, 0), 4) AS s_intent_diversity,
    CASE WHEN conversations > 0 THEN round(1e-9 + multi_turn / conversations, 4) ELSE 0.0 END AS s_multi_turn,
    round(1e-9 + greatest(0.0, english_percentage / 100.0 * (1.0 - repeated)), 4) AS s_data_quality,
    round(1e-9 + CASE WHEN usable_pairs >= {V.GOLDEN_TARGET} THEN 1.0 ELSE usable_pairs / {V.GOLDEN_TARGET} END, 4) AS s_golden_capacity,
    round(1e-9 + CASE WHEN replies <= {V.SOFT_REPLIES} THEN 1.0 ELSE 1.0 - 0.5 * least((replies - {V.SOFT_REPLIES}) / {V.HARD_REPLIES - V.SOFT_REPLIES}, 1.0) END, 4) AS s_reproducibility
  FROM (SELECT *, CASE WHEN valid_replies > 0 THEN round(1e-9 + 100.0 * CAST(meaningful_replies AS DOUBLE) / valid_replies, 2) ELSE 0.0 END AS meaningful_percentage,
      CASE WHEN customer_messages > 0 THEN round(1e-9 + 100.0 * CAST(english_messages AS DOUBLE) / customer_messages, 2) ELSE 0.0 END AS english_percentage,
      CASE WHEN valid_replies > 0 THEN round(1e-9 + duplicate_replies / valid_replies, 4) ELSE 0.0 END AS repeated
    FROM brand_replies LEFT JOIN customers USING (brand) LEFT JOIN entropy USING (brand) LEFT JOIN talks USING (brand)))""",
        ["brand_replies", "customers", "entropy", "talks"],
    ),
    "indexed": (
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_normalized_text ORDER BY brand_tweet_id) AS k FROM pairs
  WHERE is_usable AND length(trim(customer_normalized_text)) > 0) WHERE k = 1""",
        ["pairs"],
    ),
    "tf": (grams("indexed", "pair_id", "customer_normalized_text"), ["indexed"]),
    "df": (
        f"""SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM indexed)
  WHERE df >= {V.MIN_DF} AND df <= {V.MAX_DF} * n""",
        ["tf", "indexed"],
    ),
    "postings": (weights("tf", "df", "pair_id"), ["tf", "df"]),
}


_FLAGS = {"short": "is_short", "multi_turn": "is_multi_turn", "ambiguous": "is_ambiguous", "has_url": "has_url"}
_phases = [f"SELECT {k} AS phase, {q('intent:' + n)} AS reason, -1 AS flag, {V.PER_INTENT} AS quota, * FROM pool WHERE intent = {q(n)}" for k, n in enumerate(V.TAXONOMY_ORDER)]
_phases += [
    f"SELECT {100 + k} AS phase, {q('difficulty:' + n)} AS reason, {k + 1} AS flag, {least} AS quota, * FROM pool WHERE {_FLAGS[n]}" for k, (n, least) in enumerate(V.TOP_UPS.items())
]
_flag_list = "[" + ", ".join(f"CAST({_FLAGS[n]} AS INT)" for n in V.TOP_UPS) + "]"

# The golden set one row at a time, as a scan with two lists of what is taken already.
CTES |= {
    "usable": (
        f"""SELECT *, lower(trim(customer_normalized_text)) AS t, lower(trim(brand_normalized_text)) AS reply_key, n_matched >= 2 AS is_ambiguous,
    {words('clean')} <= {V.SHORT_MESSAGE_WORDS} AS is_short, is_multi_turn_conversation OR turn_in_conversation > 1 AS is_multi_turn,
    trim(customer_urls) <> '' AND {content('clean')} AS has_url
  FROM pairs WHERE is_usable AND trim(customer_normalized_text) <> ''""",
        ["pairs"],
    ),
    "numbered": (
        """SELECT brand_tweet_id, row_number() OVER (ORDER BY brand_tweet_id) AS n, dense_rank() OVER (ORDER BY t) AS a, dense_rank() OVER (ORDER BY conversation_id) AS b
  FROM usable WHERE conversation_id IS NOT NULL""",
        ["usable"],
    ),
    "taken": (
        """SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS texts, CAST([] AS BIGINT[]) AS talks, CAST(NULL AS BIGINT) AS got
  UNION ALL SELECT r.n, CASE WHEN fresh THEN list_append(texts, a) ELSE texts END, CASE WHEN fresh THEN list_append(talks, b) ELSE talks END,
    CASE WHEN fresh THEN brand_tweet_id END
  FROM (SELECT w.texts, w.talks, x.*, NOT list_contains(w.texts, x.a) AND NOT list_contains(w.talks, x.b) AS fresh FROM taken w JOIN numbered x ON x.n = w.n + 1) r""",
        ["numbered"],
    ),
    "pool": ("SELECT * FROM usable WHERE brand_tweet_id IN (SELECT got FROM taken WHERE got IS NOT NULL)", ["usable", "taken"]),
    "visits": (
        f"""SELECT phase, reason, flag, quota, brand_tweet_id AS id, dense_rank() OVER (ORDER BY reply_key) AS r, {_flag_list} AS flags,
    row_number() OVER (ORDER BY phase, md5('42-' || brand_tweet_id), brand_tweet_id) AS n FROM ({' UNION ALL '.join(_phases)})""",
        ["pool"],
    ),
    "picked": (
        f"""SELECT CAST(0 AS BIGINT) AS n, -1 AS phase, 0 AS here, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS replies, [0, 0, 0, 0] AS have,
    CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason
  UNION ALL SELECT n, phase, here + CAST(pick AS INT), CASE WHEN pick THEN list_append(ids, id) ELSE ids END, CASE WHEN pick THEN list_append(replies, r) ELSE replies END,
    CASE WHEN pick THEN [have[1] + flags[1], have[2] + flags[2], have[3] + flags[3], have[4] + flags[4]] ELSE have END,
    CASE WHEN open AND (pick OR again) THEN id END, reason
  FROM (SELECT *, open AND NOT again AND NOT list_contains(replies, r) AS pick FROM (
    SELECT *, len(ids) < {V.MOST_GOLDEN} AND CASE WHEN flag < 0 THEN here ELSE have[flag] END < quota AS open, list_contains(ids, id) AS again FROM (
      SELECT v.n, v.phase, v.reason, v.flag, v.quota, v.id, v.r, v.flags, w.ids, w.replies, w.have, CASE WHEN w.phase = v.phase THEN w.here ELSE 0 END AS here
      FROM picked w JOIN visits v ON v.n = w.n + 1)))""",
        ["visits"],
    ),
    "golden": (
        f"""SELECT 'gold-' || lpad(CAST(row_number() OVER (ORDER BY intent, conversation_id, brand_tweet_id) AS VARCHAR), 4, '0') AS golden_id, conversation_id,
    customer_tweet_id AS customer_message_id, brand_tweet_id AS brand_reply_id, customer_text, customer_redacted_text, brand_text AS brand_reply_text,
    brand_redacted_text AS brand_reply_redacted_text, intent, true AS intent_is_provisional, 'provisional_keyword_rule' AS label_method,
    CASE WHEN n_matched = 0 THEN 'no keyword rule matched' WHEN n_matched >= 2 THEN 'keyword rule ''' || intent || '''; also matched ' || {joined(', ', 'intent')}
      ELSE 'keyword rule ''' || intent || '''' END AS label_rule, replace(matched, ', ', ';') AS matched_intents, 'usable_corpus' AS source_split, sampling_reason,
    is_short, is_multi_turn, is_ambiguous, is_generic_reply, has_url, turn_in_conversation, 'pending' AS annotation_status,
    CASE WHEN is_ambiguous AND {joined(', ', 'intent')} <> '' THEN 'ambiguous; also matched: ' || {joined(', ', 'intent')} ELSE '' END AS notes
  FROM pool JOIN (SELECT id, string_agg(DISTINCT reason, ';' ORDER BY reason) AS sampling_reason FROM picked WHERE id IS NOT NULL GROUP BY id) ON id = brand_tweet_id""",
        ["pool", "picked"],
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind a WITH of the CTEs it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTES[name][1]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body
