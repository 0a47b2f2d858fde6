"""Reference SQL for the engine's queries: the same semantics written relationally for DuckDB, apart from the Spark plans.

Regular expressions there know ASCII word characters only. Rule patterns are therefore matched on a shadow of the text in
which every other letter, mark or digit is an underscore, of equal length; conditions on accented words spell out their
boundaries.
"""

from __future__ import annotations

import re

from ..functions.spans import MISREAD
from ..operators.ner import HEURISTIC_SCORE, HEURISTICS
from ..sources import catalog, lexicon
from . import fixtures

W = r"\pL\pN_"


def q(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple]) -> str:
    """A VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


def strings(items: list[str]) -> str:
    """A SQL list in brackets."""
    return "(" + ", ".join(map(q, items)) + ")"


def any_of(column: str, items: list[str]) -> str:
    """Whether the column holds any of the items."""
    return "(" + " OR ".join(f"contains({column}, {q(i)})" for i in items) + ")"


def bounded(pattern: str) -> str:
    """A pattern between word boundaries, as a condition."""
    return f"(?:^|[^{W}])(?:{pattern})(?:$|[^{W}])"


_FROM = "".join(lexicon.FOLDED.values())
_TO = "".join(k * len(v) for k, v in lexicon.FOLDED.items())
NORM = f"translate(nfc_normalize(translate(coalesce(text, ''), {q(lexicon.QUOTES_REMOVED)}, '')), {q(_FROM)}, {q(_TO)})"
SHADOW = r"regexp_replace({}, '[^\x00-\x7F\pP\pS\pZ\pC]', '_', 'g')"

DOCS = f"docs AS (SELECT doc_id, text FROM documents UNION ALL {values(fixtures.DOCS + fixtures.EXTRA_DOCS)})"
NORMALIZED = f"""norm AS MATERIALIZED (SELECT doc_id, t, {SHADOW.format("t")} AS a, {SHADOW.format("translate(t, 'ÃãÅåâ', 'QqWw_')")} AS w,
  {SHADOW.format("regexp_replace(regexp_replace(t, '[ÉÈÀÂÎÙÔÇ]', 'E', 'g'), '[À-ÖØ-öø-ÿ]', 'x', 'g')")} AS g
  FROM (SELECT doc_id, {NORM} AS t FROM docs))"""


def _matches(key: str, column: str, pattern: str, options: str) -> str:
    found = f"regexp_matches({column}, {q(pattern)}, {q(options)})"
    return f"SELECT doc_id, {key}, regexp_extract_all({column}, {q(pattern)}, 0, {q(options)}) AS m, string_split_regex({column}, {q(pattern)}, {q(options)}) AS s FROM norm WHERE {found}"


#: Letters of misread texts, and letters that stand for them where words are ASCII.
_MISREAD = ("ÃãÅåâ", "QqWw_")


def _rule(r: catalog.Rule) -> str:
    options = "i" if r.ignore_case else "c"
    if MISREAD in r.anchors:
        return _matches(f"{r.seq} AS rule", "w", r.pattern.translate(str.maketrans(*_MISREAD)), options)
    return _matches(f"{r.seq} AS rule", "a", r.pattern, options)


_PLACES = "(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::INT"


def _found(name: str, selects: list[str], keys: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT doc_id, {keys}, k, {_PLACES} AS b, ({_PLACES} + length(m[k]))::INT AS e
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({" UNION ALL ".join(selects)})))"""


def detection() -> list[str]:
    """CTEs up to ``cand``: doc_id, seq, b, e, x (text), label, source, category, score."""
    rules = catalog.rules("faithful", fixtures.EXTRA_RULES)
    table = [(r.seq, r.label, r.category, int(r.extend_geo)) for r in rules]
    hits = [_rule(r) for r in rules]
    names = [(n, i, "ETAB" if c.startswith("ETAB_") else "ORG", c) for i, (n, c) in enumerate((n, c) for _, entries in sorted(lexicon.GAZETTEERS.items()) for n, c in entries)]
    heuristics = [_matches(f"{q(label)} AS label, {k} AS rule", "a", p, "c") for k, (label, p) in enumerate(HEURISTICS.items())]
    return [
        DOCS,
        NORMALIZED,
        f"rules AS (SELECT * FROM ({values(table)}) r(rule, label, category, geo))",
        _found("hits", hits, "rule"),
        r"""based AS (SELECT h.doc_id, rule, k, b, e, label, category, geo, t, g,
  CASE WHEN geo = 1 THEN regexp_extract(substr(g, e + 1), '^\s*(?:x|au|aux|dans|sur|de|du|des)\s+[A-Z][A-Za-z''\-\s]+\b') ELSE '' END AS p0
  FROM hits h JOIN rules USING (rule) JOIN norm USING (doc_id))""",
        r"""placed AS (SELECT *, substr(t, e + 1, length(p0)) AS p FROM (SELECT * REPLACE (CASE WHEN ltrim(p0, chr(32) || chr(9) || chr(10) || chr(13)) LIKE 'x%' AND NOT regexp_matches(substr(t, e + 1), '^\s*à\s') THEN '' ELSE p0 END AS p0) FROM based))""",
        r"""ruled AS (SELECT doc_id, rule, k, b, e + length(p) AS e, CASE WHEN p = '' THEN substr(t, b + 1, e - b) ELSE substr(t, b + 1, e - b) || ' ' || regexp_replace(p, '^\s+|\s+$', '', 'g') END AS x, label, category, p FROM placed)""",
        f"given AS (SELECT * FROM ({values(fixtures.NER)}) n(doc_id, b, e, label, score))",
        _found("guessed", heuristics, "label, rule"),
        rf"""ner AS (SELECT doc_id, o, b + length(x) - length(regexp_replace(x, '^\s+', '')) AS b, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, label, score FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n.b, n.e, label) AS o, n.b, substr(t, n.b + 1, n.e - n.b) AS x, label, score::DOUBLE AS score FROM given n JOIN norm USING (doc_id)
  UNION ALL SELECT doc_id, 1000 + rule * 100000 + k, n.b, substr(t, n.b + 1, n.e - n.b), label, {HEURISTIC_SCORE}::DOUBLE FROM guessed n JOIN norm USING (doc_id)))""",
        f"names AS (SELECT * FROM ({values(names)}) n(name, i, label, category))",
        f"""split AS (SELECT doc_id, t, name, i, label, category, string_split(lower(t), lower(name)) AS s FROM norm, names WHERE contains(lower(t), lower(name)))""",
        rf"""named AS (SELECT doc_id, i, k, b, b + length(name) AS e, label, category, substr(t, b + 1, length(name)) AS x FROM (
  SELECT *, (list_sum(list_transform(s[1:k], lambda y: length(y))) + (k - 1) * length(name))::INT AS b FROM (SELECT *, unnest(range(1, len(s))) AS k FROM split))
  WHERE NOT regexp_matches(substr(t, b, CASE WHEN b > 0 THEN 1 ELSE 0 END), '[{W}]') AND NOT regexp_matches(substr(t, b + length(name) + 1, 1), '[{W}]'))""",
        """cand AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s1, s2, s3) - 1)::INT AS seq, b::INT AS b, e::INT AS e, x, label, source, category, score FROM (
  SELECT doc_id, 0 AS s1, o AS s2, 0 AS s3, b, b + length(x) AS e, x, label, 'NER' AS source, NULL::VARCHAR AS category, score FROM ner WHERE x <> ''
  UNION ALL SELECT doc_id, 1, rule, k, b, e, x, label, 'RULES', category, 1.0 FROM ruled
  UNION ALL SELECT doc_id, 2, i, k, b, e, x, label, 'GAZETTEER', category, 1.0 FROM named))""",
    ]


STOP = f"lower(substr(t, b + 1, e - b)) NOT IN {strings(lexicon.STOPWORDS)}"
KEPT = f"x NOT IN {strings(lexicon.EXCLUSIONS)} AND lower(x) NOT IN {strings(lexicon.EXCLUSIONS)}"
VALID = rf"""length(x) >= 2 AND x NOT IN {strings(lexicon.FRAGMENTS)}
  AND NOT (label = 'ORG' AND length(x) <= 2 AND regexp_matches(x, '^\pL+$'))
  AND NOT (x IN {strings(lexicon.AMBIGUOUS)} AND label IN ('ORG', 'ETAB'))
  AND NOT {any_of("lower(x)", lexicon.JOB_TITLES)}
  AND NOT (label = 'ORG' AND category IS DISTINCT FROM 'ORG_ENTREPRISE_PRIV' AND lower(x) IN {strings(lexicon.GENERIC_ORGS)})"""

CAPITAL = "[A-ZÉ]"
CHU = rf"(?i)(?:^|[^{W}])(?:CHU|Centre\s+Hospitalier|CHR)\s+(?:de\s+)?{CAPITAL}[{W}'\-]*[{W}]"
ADDRESS = rf"(?:^|[^{W}])(?:rue|avenue|boulevard|bd|impasse|place|pl|chemin|allée)\s+|{bounded(chr(92) + 'd{5}')}|(?:^|[^{W}])\d{{1,4}}(?:bis|ter)?\s+(?:rue|avenue|boulevard|impasse)"
CITY = bounded("|".join(lexicon.CITIES) + r"|paris\s+\d{1,2}")
PERSON = bounded(r"[A-Z][a-z]+ [A-Z][A-Z]+|(?:M\.|Mme|Dr\.) [A-Z][A-Z]+")


def classification() -> list[str]:
    """CTEs ``filt``, ``recl`` and ``disa`` with the fields of ``cand``."""
    context = "\n".join(f"WHEN {any_of('near', w)} THEN {q(t)}" for t, w in lexicon.CONTEXT_TYPES.items())
    key = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
    article = " OR ".join(f"starts_with({key}, {q(a)})" for a in lexicon.ARTICLES)
    typed = "\n".join(f"WHEN starts_with(upper(x), {q(t)}) THEN {q('ETAB_' + t)}" for t in lexicon.NAME_TYPES)
    titles = " OR ".join(f"contains(lower(substr(t, greatest(b - 50, 0) + 1, e + 50 - greatest(b - 50, 0))), {q(title)} || lower(x))" for title in lexicon.TITLES)
    return [
        f"filt AS (SELECT c.*, t FROM cand c JOIN norm USING (doc_id) WHERE {STOP} AND {KEPT} AND {VALID})",
        rf"""ctx AS (SELECT *, source = 'NER' AND label IN ('LOC', 'ORG') AS raw, regexp_extract(substr(t, e + 1, 50), '^\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)*') AS town,
  {any_of(r"upper(substr(t, greatest(b - 15, 0) + 1, least(b, 15)))", lexicon.ADJACENT_TYPES)} AS adj, lower(substr(t, greatest(b - 30, 0) + 1, e + 30 - greatest(b - 30, 0))) AS near FROM filt)""",
        f"""cased AS (SELECT *, CASE
  WHEN NOT raw THEN NULL
  WHEN regexp_matches(x, {q(CHU)}) THEN 'ORG_CHU_CH'
  WHEN regexp_matches(lower(x), {q(ADDRESS)}) AND NOT adj THEN CASE WHEN regexp_matches(x, {q(bounded(chr(92) + "d{5}"))}) THEN 'ADDR_FULL' ELSE 'ADDR_STREET' END
  WHEN regexp_matches(lower(x), {q(CITY)}) AND NOT adj THEN 'LOC_CITY'
  WHEN label = 'LOC' AND CASE {typed} END IS NOT NULL THEN CASE {typed} END
  WHEN label = 'LOC' AND NOT adj AND (({article}) AND NOT {any_of(f"lower({key})", lexicon.ARTICLE_CITIES)} OR {any_of("near", lexicon.HOST_VERBS)} OR {any_of(f"lower({key})", lexicon.PLANTS)})
    AND CASE {context} END IS NOT NULL THEN CASE {context} END
  WHEN label = 'ORG' AND regexp_matches(x, {q(PERSON)}) THEN 'PER'
  WHEN contains(lower(x), 'chu') AND town <> '' AND lower(trim(town)) NOT IN {strings(lexicon.CHU_STOP)} THEN 'longer'
  END AS new, label = 'LOC' AND CASE {typed} END IS NOT NULL AND NOT (regexp_matches(lower(x), {q(CITY)}) AND NOT adj) AS by_type FROM ctx)""",
        r"""recl AS (SELECT doc_id, seq, b, CASE WHEN new = 'longer' THEN e + length(town) ELSE e END AS e, CASE WHEN new = 'longer' THEN x || ' ' || regexp_replace(town, '^\s+|\s+$', '', 'g') ELSE x END AS x,
  CASE WHEN new IS NULL THEN label WHEN new = 'longer' THEN 'ORG_CHU_CH' ELSE new END AS label,
  CASE WHEN new IS NULL THEN source WHEN starts_with(new, 'ETAB_') AND by_type THEN 'NER_ENHANCED' ELSE 'ENHANCED' END AS source,
  CASE WHEN new IS NULL OR new = 'PER' THEN category WHEN new = 'longer' THEN 'ORG_CHU_CH' ELSE new END AS category, score, t, new FROM cased)""",
        f"""disa AS MATERIALIZED (SELECT doc_id, seq, b, e, x, CASE WHEN prof THEN 'PROFESSION' ELSE label END AS label, CASE WHEN prof THEN 'CONTEXTUAL_PROFESSION' ELSE source END AS source,
  CASE WHEN prof THEN 'PROFESSION' ELSE category END AS category, score, t FROM (SELECT *, label = 'PER' AND ({titles}) AS prof FROM recl))""",
    ]


PRIORITY_KEY = """CASE WHEN source = 'MERGED_TYPE_LOC' THEN 'MERGED_TYPE_LOC_ETAB' WHEN source = 'GAZETTEER' THEN 'GAZETTEER_' || label
  WHEN source = 'RULES' THEN 'RULES_' || coalesce(category, label) ELSE 'NER_' || label END"""


def resolution() -> list[str]:
    """CTEs ``fuse`` (with priorities) and ``reso``."""
    is_type = f"(source = 'RULES' AND category IN {strings(lexicon.FUSABLE)})"
    table = values(list(lexicon.PRIORITIES.items()))
    return [
        f"""around AS (SELECT *, {is_type} AS typ, coalesce({is_type} AND lead(label) OVER w IN ('LOC', 'PER') AND lead(source) OVER w = 'NER' AND lead(b) OVER w - e <= {lexicon.FUSION_GAP}, false) AS fus, lead(e) OVER w AS e2, lead(score) OVER w AS score2
  FROM disa WINDOW w AS (PARTITION BY doc_id ORDER BY b, seq))""",
        "taken AS (SELECT *, coalesce(lag(fus) OVER (PARTITION BY doc_id ORDER BY b, seq), false) AS con FROM around)",
        f"""merged AS (SELECT doc_id, seq, b, CASE WHEN fus THEN e2 ELSE e END AS e, CASE WHEN fus THEN substr(t, b + 1, e2 - b) ELSE x END AS x, CASE WHEN fus THEN 'ETAB' ELSE label END AS label,
  CASE WHEN fus THEN 'MERGED_TYPE_LOC' ELSE source END AS source, CASE WHEN fus THEN CASE WHEN starts_with(category, 'ETAB_') THEN category ELSE 'ETAB_' || category END ELSE category END AS category,
  CASE WHEN fus THEN greatest(score, score2) ELSE score END AS score, t FROM taken WHERE NOT con AND (fus OR NOT typ) AND (fus OR category IS NULL OR category NOT IN {strings(lexicon.SERVICES)}))""",
        f"""fuse AS MATERIALIZED (SELECT m.*, {PRIORITY_KEY} AS pkey, coalesce(p.v, CASE source WHEN 'ENHANCED' THEN 4.5 WHEN 'GAZETTEER' THEN 5.0
  WHEN 'RULES' THEN CASE WHEN label IN {strings(lexicon.SENSITIVE)} THEN 4.0 WHEN label = 'ETAB' THEN 3.5 ELSE 3.0 END ELSE CASE WHEN label = 'PER' THEN 2.0 ELSE 1.0 END END)::DOUBLE AS pri
  FROM merged m LEFT JOIN ({table}) p(k, v) ON p.k = {PRIORITY_KEY})""",
        "lined AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, seq) AS i, {'b': b, 'e': e, 'seq': seq, 'p': pri} AS c FROM fuse)",
        f"""fold AS (SELECT doc_id, 1::BIGINT AS i, [c] AS kept FROM lined WHERE i = 1 UNION ALL SELECT l.doc_id, l.i,
  CASE WHEN len(list_filter(kept, lambda k: {_conflict("k", "l.c")} AND CASE WHEN abs((k.e - k.b) - (l.c.e - l.c.b)) > {lexicon.SIMILAR_LENGTH} THEN (k.e - k.b) > (l.c.e - l.c.b) ELSE k.p >= l.c.p END)) > 0 THEN kept
  ELSE list_append(list_filter(kept, lambda k: NOT {_conflict("k", "l.c")}), l.c) END FROM fold f JOIN lined l ON l.doc_id = f.doc_id AND l.i = f.i + 1)""",
        "last AS (SELECT doc_id, arg_max(kept, i) AS kept FROM fold GROUP BY doc_id)",
        "reso AS MATERIALIZED (SELECT f.* FROM fuse f JOIN (SELECT doc_id, unnest(kept).seq AS seq FROM last) k ON k.doc_id = f.doc_id AND k.seq = f.seq)",
    ]


def _conflict(a: str, b: str) -> str:
    shared = f"(least({a}.e, {b}.e) - greatest({a}.b, {b}.b))"
    return f"({shared} > 0 AND least({a}.e - {a}.b, {b}.e - {b}.b) > 0 AND {shared} / least({a}.e - {a}.b, {b}.e - {b}.b) > {lexicon.OVERLAP})"


def rewriting(known: bool = False) -> list[str]:
    """CTEs ``done`` (applied entities), ``alia`` (new aliases) and ``outp``."""
    return _rewriting("reso", "coalesce(category, label)", known)


def _rewriting(source: str, prefix: str, known: bool, dedup: bool = True) -> list[str]:
    earlier = values(fixtures.KNOWN) if known else "SELECT NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT WHERE false"
    first = "QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY b DESC) = 1" if dedup else ""
    joined = "a.doc_id = d.doc_id AND a.original = d.x" if dedup else "a.doc_id = d.doc_id AND a.b = d.b"
    return [
        f"known AS (SELECT * FROM ({earlier}) k(original, alias, prefix, n))",
        f"rights AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, seq DESC) AS r FROM {source})",
        """walk AS (SELECT doc_id, r, b, e, CASE WHEN substr(t, b + 1, e - b) = x THEN b ELSE 2147483647 END AS lim, substr(t, b + 1, e - b) = x AS ok FROM rights WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, n.b, n.e, CASE WHEN n.e <= w.lim AND substr(n.t, n.b + 1, n.e - n.b) = n.x THEN n.b ELSE w.lim END, n.e <= w.lim AND substr(n.t, n.b + 1, n.e - n.b) = n.x
  FROM walk w JOIN rights n ON n.doc_id = w.doc_id AND n.r = w.r + 1)""",
        f"done AS MATERIALIZED (SELECT s.*, {prefix} AS prefix FROM rights s JOIN walk w ON w.doc_id = s.doc_id AND w.r = s.r WHERE ok)",
        f"firsts AS (SELECT * FROM done WHERE x NOT IN (SELECT original FROM known) {first})",
        """alia AS (SELECT f.doc_id, f.b, x AS original, f.prefix, row_number() OVER (PARTITION BY f.doc_id, f.prefix ORDER BY f.b DESC) + coalesce(k.n, 0) AS n
  FROM firsts f LEFT JOIN (SELECT prefix, max(n) AS n FROM known GROUP BY prefix) k ON k.prefix = f.prefix)""",
        f"""repl AS (SELECT d.doc_id, d.b, d.e, d.t, coalesce('<' || a.prefix || '_' || a.n || '>', k.alias) AS alias, lag(d.e, 1, 0) OVER (PARTITION BY d.doc_id ORDER BY d.b) AS tail
  FROM done d LEFT JOIN alia a ON {joined} LEFT JOIN known k ON k.original = d.x)""",
        """outp AS (SELECT n.doc_id, n.t, coalesce(r.head, '') || substr(n.t, coalesce(r.last, 0) + 1) AS o FROM norm n
  LEFT JOIN (SELECT doc_id, string_agg(substr(t, tail + 1, b - tail) || alias, '' ORDER BY b) AS head, max(e) AS last FROM repl GROUP BY doc_id) r USING (doc_id))""",
    ]


def query(ctes: list[str], select: str) -> str:
    """A whole statement."""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


DETECT = detection()
CLASSIFY = [*DETECT, *classification()]
RESOLVE = [*CLASSIFY, *resolution()]
REWRITE = [*RESOLVE, *rewriting()]
COLUMNS = "doc_id, b AS start_pos, e AS end_pos, x AS entity, label, source, category"


def _chunks() -> list[str]:
    """CTEs up to ``off``: chunks of documents with their places, by recursion over sentences."""
    tokens = r"len(regexp_extract_all(s, '\S+'))"
    full = "(p.n >= 400 OR p.n + y.n > 450)"
    ended = "CASE WHEN now LIKE '%.' THEN now ELSE now || '.' END"
    return [
        DOCS,
        NORMALIZED,
        f"sent AS MATERIALIZED (SELECT doc_id, i, s, {tokens} AS n FROM (SELECT doc_id, unnest(string_split(t, '. ')) AS s, generate_subscripts(string_split(t, '. '), 1) AS i FROM norm))",
        f"""pack AS (SELECT doc_id, i, s AS now, n, 1 AS c FROM sent WHERE i = 1
  UNION ALL SELECT y.doc_id, y.i, CASE WHEN {full} THEN y.s ELSE p.now || '. ' || y.s END, CASE WHEN {full} THEN y.n ELSE p.n + y.n END, CASE WHEN {full} THEN p.c + 1 ELSE p.c END
  FROM pack p JOIN sent y ON y.doc_id = p.doc_id AND y.i = p.i + 1)""",
        f"cut AS (SELECT doc_id, c, {ended} AS chunk FROM (SELECT doc_id, c, arg_max(now, i) AS now FROM pack GROUP BY doc_id, c))",
        "off AS (SELECT doc_id, c, chunk, coalesce(sum(length(chunk) + 1) OVER (PARTITION BY doc_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM cut)",
    ]


def chunked() -> str:
    """Chunks of documents."""
    return query(_chunks(), "SELECT doc_id, (c - 1)::INT AS chunk, begun::INT AS start_pos, (begun + length(chunk))::INT AS end_pos, md5(chunk) AS digest FROM off")


def modelled() -> str:
    """The letters that chunks begin with, at their documents' places."""
    word = "regexp_extract(chunk, '^[A-Za-z]+')"
    return query(_chunks(), f"SELECT doc_id, begun::INT AS start_pos, (begun + length({word}))::INT AS end_pos, 'PER' AS label FROM off WHERE {word} <> ''")


def sentenced() -> str:
    """Sentences of documents: what lies between white space that follows a full stop, an exclamation or a question mark.

    Each is sought from the sum of the lengths of those before, which leaves out the white space between them.
    """
    return query(
        [
            DOCS,
            NORMALIZED,
            r"""parts AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS s FROM norm)""",
            """placed AS (SELECT doc_id, t, s[k] AS x, coalesce(list_sum(list_transform(s[1:k-1], lambda y: length(y))), 0)::INT AS far FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM parts))""",
            "found AS (SELECT doc_id, x, far + instr(substr(t, far + 1), x) - 1 AS b FROM placed)",
        ],
        "SELECT doc_id, b::INT AS start_pos, (b + length(x))::INT AS end_pos, md5(x) AS digest FROM found",
    )


def persons() -> str:
    """Whether named entities have the form of a person's name, and a person's surroundings."""
    near = "lower(substr(t, greatest(b - 50, 0) + 1, e + 50 - greatest(b - 50, 0)))"
    forms = "|".join(f"(?:{p})" for p in lexicon.PERSON_FORMS)
    tells = []
    for form in lexicon.PERSON_CONTEXT:
        before, gap, after = form.partition("{}")
        tells.append(f"contains({near}, {q(before)} || lower(x) || {q(after)})" if gap else f"contains({near}, {q(form)})")
    return query(DETECT, f"SELECT doc_id, seq, x AS entity, regexp_matches(x, {q(forms)}) AS person_form, ({' OR '.join(tells)}) AS person_context FROM cand JOIN norm USING (doc_id) WHERE source = 'NER'")


def counted() -> str:
    """How many entities each stage left."""
    stages = {"candidates": "cand", "filtered": "filt", "classified": "disa", "fused": "fuse", "resolved": "reso", "applied": "done"}
    counts = " UNION ALL ".join(f"SELECT {q(k)} AS stage, count(*) AS entities FROM {v}" for k, v in stages.items())
    return query(REWRITE, f"{counts} UNION ALL SELECT 'skipped', (SELECT count(*) FROM reso) - (SELECT count(*) FROM done)")
