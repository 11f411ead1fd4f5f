"""DuckDB SQL for the operators that SQL can express: their contracts, stated apart from the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
scan AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
hits AS (SELECT scan.r, scan.i, scan.k, wins.item_id FROM scan JOIN wins ON scan.k = wins.k AND scan.t = wins.t),
spot AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(spot.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(spot.n, 0) > 0 AS contaminated
FROM d LEFT JOIN spot ON d.r = spot.r LEFT JOIN named ON d.r = named.r"""


def _funnel_sql() -> str:
    """Each step by as-of joins: the next row of its kind, and the next excluded row."""
    plans = {"A": (["view", "click", "view", "purchase"], "error"), "B": (["signup", "view", "click", "purchase"], "error"), "C": (["click", "click", "purchase", "view"], "signup")}
    parts = ["e AS (SELECT DISTINCT client_id, kind, arrived_at AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL)"]
    for name, (steps, bad) in plans.items():
        parts.append(f"{name}1 AS (SELECT client_id, t AS t1 FROM e WHERE kind = '{steps[0]}')")
        for k, kind in enumerate(steps[1:], 2):
            met = f"x.t IS NOT NULL AND a.t{k - 1} IS NOT NULL AND x.t - a.t1 <= INTERVAL 5 MINUTE AND (z.t IS NULL OR z.t > x.t)"
            parts.append(
                f"{name}{k} AS (SELECT a.*, CASE WHEN {met} THEN x.t END AS t{k} FROM {name}{k - 1} a"
                f" ASOF LEFT JOIN (SELECT * FROM e WHERE kind = '{kind}') x ON a.client_id = x.client_id AND x.t > a.t{k - 1}"
                f" ASOF LEFT JOIN (SELECT * FROM e WHERE kind = '{bad}') z ON a.client_id = z.client_id AND z.t > a.t{k - 1})"
            )
    whole = " UNION ALL ".join(f"SELECT '{name}' AS funnel, client_id, t1, t2, t3, t4 FROM {name}4" for name in plans)
    quartile = lambda k: f"list_sort(list(epoch_us(t{k}) - epoch_us(t{k - 1})) FILTER (t{k} IS NOT NULL))[(25 * count(t{k}) + 99) // 100]"
    counts = ", ".join(f"count(t{k}) AS n{k}" for k in range(1, 5)) + ", " + ", ".join(f"{quartile(k)} AS t{k}" for k in range(2, 5))
    parts += [
        f"each_attempt AS ({whole})",
        f"g AS (SELECT funnel, client_id, {counts}, CAST(CASE WHEN count(t4) > 0 THEN 4 WHEN count(t3) > 0 THEN 3 WHEN count(t2) > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM each_attempt GROUP BY funnel, client_id)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g"


#: Levels that the statement spells out: enough for three to this power of documents in a source.
LEVELS = 14

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, c: list_reduce(list_prepend(xor(acc, c), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """{name}0 to {name}{levels}: (g, i, h), each level the runs of three of the one below while it has several nodes; and
    {name}p: (g, i, left and right siblings by level) of the leaves."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(1, levels + 1):
        many = f"(SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k - 1})"
        out.append(f"{name}{k} AS (SELECT g, CASE WHEN n > 1 THEN i // 3 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {many} GROUP BY g, n, CASE WHEN n > 1 THEN i // 3 ELSE i END)")
    steps = []
    for k in range(levels):
        run = f"s.g = l.g AND s.i // 3 = (l.i // {3**k}) // 3"
        steps.append(f"coalesce((SELECT string_agg(h, '' ORDER BY i) FROM {name}{k} s WHERE {run} AND s.i < l.i // {3**k}), '') AS l{k}, coalesce((SELECT string_agg(h, '' ORDER BY i) FROM {name}{k} s WHERE {run} AND s.i > l.i // {3**k}), '') AS r{k}")
        steps.append(f"(SELECT count(*) FROM {name}{k} s WHERE s.g = l.g) AS n{k}")
    out.append(f"{name}p AS (SELECT l.g, l.i, {', '.join(steps)} FROM {name}0 l)")
    return out


def _merkle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    leaf = lambda text: f"sha256({head} || {part(text)})"
    step = lambda x, p, k: f"CASE WHEN {p}.n{k} > 1 THEN sha256({p}.l{k} || {x} || {p}.r{k}) ELSE {x} END"
    parts = [
        f"docs AS (SELECT doc_id, source, text, lang, n_chars, {leaf('text')} AS leaf, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents)",
        f"leaves AS (SELECT doc_id, coalesce('s' || source, '') AS g, leaf, {leaf('tampered')} AS found, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs)",
        *_tree_sql("a", "SELECT g, i, leaf AS h FROM leaves", LEVELS),
        *_tree_sql("b", f"SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h FROM a{LEVELS}", 4),
        f"roots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM a{LEVELS})",
        f"f0 AS (SELECT doc_id, leaf, found, roots.h AS subroot, ap AS p, bp AS q, found AS x FROM leaves JOIN ap ON leaves.g = ap.g AND leaves.i = ap.i JOIN roots ON leaves.g = roots.g JOIN bp ON roots.i = bp.i)",
    ]
    for k in range(LEVELS):
        parts.append(f"f{k + 1} AS (SELECT * EXCLUDE (x), {step('x', 'p', k)} AS x FROM f{k})")
    for k in range(4):
        parts.append(f"f{LEVELS + k + 1} AS (SELECT * EXCLUDE (x), {step('x', 'q', k)} AS x FROM f{LEVELS + k})")
    proof = " || ".join([f"CASE WHEN p.n{k} > 1 THEN p.l{k} || p.r{k} ELSE '' END" for k in range(LEVELS)] + [f"CASE WHEN q.n{k} > 1 THEN q.l{k} || q.r{k} ELSE '' END" for k in range(4)])
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT h FROM b4) AS root, sha256({proof}) AS proof_sha256, x AS folded_root, x = (SELECT h FROM b4) AS verified FROM f{LEVELS + 4}"


ORACLE_SQL: dict[str, str] = {"op11_decontamination": DECONTAMINATION, "op12_funnel": _funnel_sql(), "op13_merkle": _merkle_sql()}
