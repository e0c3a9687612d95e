"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string says in plain SQL what the Spark query computes, over the same
pre-registered views.  Patterns stay in the common subset of Java regex and
RE2; lambdas use DuckDB's ``lambda x: expr`` form.  Keyed like
``textlake.plans.queries.QUERIES``.
"""

from __future__ import annotations

from textlake.functions import html as H
from textlake.functions import markup as M
from textlake.functions.constants import (DEFAULT_URL_KEY, NON_SESSION_TITLES, NUM_FEATURES,
                                          TOP_RANK_PER_GROUP, TOP_TF_IN_GROUP, TOP_WORDS,
                                          WWW_ALIAS)
from textlake.functions.hashing import C1, C2, FINAL1, FINAL2, SEED
from textlake.functions.references import NAMED, REFERENCE_PATTERN, RENUMBERED, REPLACEMENT
from textlake.functions.text import STRIP_PATTERN
from textlake.functions.urls import (URL_HOST_PATTERN, URL_KEY_PATTERN, URL_LANG_PATTERN,
                                     URL_ORIGIN_PATTERN)
from textlake.plans import params as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def sql_in(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def clean(e: str) -> str:
    kept = f"regexp_replace({e}, '[^a-zA-Z0-9 ]', '', 'g')"
    return f"trim(regexp_replace({kept}, ' {{2,}}', ' ', 'g'))"


def stop(e: str, words=P.STOPWORDS) -> str:
    return (f"array_to_string(list_filter(string_split({e}, ' '), "
            f"lambda w: NOT list_contains({sql_list(words)}, w)), ' ')")


def plural(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, ' '), "
            f"lambda w: regexp_replace(w, 's$', '')), ' ')")


def glue(e: str, phrases=P.FIXTURE_PHRASES) -> str:
    for p in phrases:
        e = f"replace({e}, {q(p)}, {q(p.replace(' ', ''))})"
    return e


def normalize(e: str) -> str:
    return glue(plural(stop(clean(f"lower({e})"))))


def rnd(e: str) -> str:
    return f"round({e}, {P.ROUND})"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(M.BLANKS_PATTERN)}, ' ', 'g'))"


def noise(e: str) -> str:
    return f"regexp_replace({e}, {q(M.NOISE_PATTERN)}, '', 'g')"


# --- pages: tokens, a fold over them, selected nodes, decoded references ---------

SAFE = f"{q(M.PARTING)}, {' || '.join(f'chr({ord(c)})' for c in M.STAND_INS)}"


def _attribute(name: str) -> str:
    value = f"regexp_replace(regexp_extract(x.t, {q(M.attribute_pattern(name))}, 1), {q(M.QUOTES_PATTERN)}, '', 'g')"
    return f"translate({value}, {SAFE})"


def _cut(path: str, mark: str) -> str:
    behind = f"string_split({path}, {mark})[-1]"
    return f"(CASE WHEN contains({path}, {mark}) THEN substr({path}, 1, length({path}) - length({behind}) - length({mark})) ELSE {path} END)"


def node_ctes(source: str, key: str, html: str = "html") -> str:
    """CTE ``node`` (key, n, path, text): every text node of ``source``'s pages with its path."""
    classes = f"regexp_replace({squeeze(_attribute('class'))}, ' ', '.', 'g')"
    code = (f"'/' || x.tag || '#' || {_attribute('id')} || '#.' || CASE WHEN {classes} = '' THEN '' "
            f"ELSE {classes} || '.' END")
    kind = (f"CASE WHEN x.tag = '' THEN CASE WHEN regexp_matches(x.t, '^<.') THEN 'none' ELSE 'text' END "
            f"WHEN starts_with(x.t, '</') THEN 'close' WHEN x.tag IN {sql_in(M.VOID)} OR regexp_matches(x.t, {q(M.SELF_CLOSED_PATTERN)}) "
            f"THEN 'empty' ELSE 'open' END")
    fields = "path := '', nodes := []::STRUCT(path VARCHAR, text VARCHAR)[], kind := {kind}, tag := {tag}, code := {code}, text := {text}"
    start = f"struct_pack({fields.format(kind="'none'", tag="''", code="''", text="''")})"
    base = f"CASE WHEN x.tag IN {sql_in(M.ENDS_PARAGRAPH)} THEN {_cut('s.path', q('/p#'))} ELSE s.path END"
    mark = "('/' || x.tag || '#')"
    path = (f"CASE x.kind WHEN 'text' THEN s.path WHEN 'none' THEN s.path WHEN 'close' THEN {_cut('s.path', mark)} "
            f"ELSE {base} || x.code END")
    step = (f"struct_pack(path := {path}, nodes := CASE WHEN x.kind = 'text' THEN "
            "list_append(s.nodes, struct_pack(path := s.path, text := x.text)) ELSE s.nodes END, "
            "kind := 'none', tag := '', code := '', text := '')")
    return (f"tok AS (SELECT {key}, regexp_extract_all({noise(html)}, {q(M.TOKEN_PATTERN)}) AS ts FROM {source}), "
            f"named AS (SELECT {key}, [struct_pack(tag := translate(lower(regexp_extract(t, {q(M.NAME_PATTERN)}, 1)), {SAFE}), "
            f"t := t) FOR t IN ts] AS xs FROM tok), "
            f"kinds AS (SELECT {key}, [struct_pack(tag := x.tag, kind := {kind}, code := {code}, t := x.t) FOR x IN xs] AS xs FROM named), "
            f"steps AS (SELECT {key}, [struct_pack({fields.format(kind='x.kind', tag='x.tag', code="CASE WHEN x.kind = 'open' THEN x.code ELSE '' END", text='x.t')}) "
            f"FOR x IN xs] AS xs FROM kinds), "
            f"folded AS (SELECT {key}, list_reduce(list_prepend({start}, xs), lambda s, x: {step}).nodes AS nodes FROM steps), "
            f"node AS (SELECT {key}, n, nodes[n].path AS path, nodes[n].text AS text FROM folded, range(1, len(nodes) + 1) r(n))")


def decode_ctes(source: str, keys: str, out: str = "dec") -> str:
    """CTE ``out`` (keys, text): ``source`` with the references in its text decoded."""
    names, signs = sql_list(NAMED), sql_list(NAMED.values())
    renumbered = " ".join(f"WHEN {n} THEN {q(c)}" for n, c in RENUMBERED.items())
    digits = "regexp_replace(name, '^#[xX]?0*|;', '', 'g')"
    number = (f"CASE WHEN NOT starts_with(name, '#') THEN NULL WHEN length({digits}) > 8 THEN 1114112 WHEN {digits} = '' THEN 0 "
              f"WHEN lower(name[2]) = 'x' THEN ('0x' || {digits})::BIGINT ELSE {digits}::BIGINT END")
    return (f"ref AS (SELECT unnest({names}) AS name, unnest({signs}) AS named), "
            f"cutup AS (SELECT {keys}, string_split(text, '&') AS parts FROM {source}), "
            f"piece AS (SELECT {keys}, j, parts[j] AS part, CASE WHEN j = 1 THEN '' ELSE "
            f"regexp_extract(parts[j], {q(REFERENCE_PATTERN)}, 1) END AS name FROM cutup, range(1, len(parts) + 1) r(j)), "
            f"numbered AS (SELECT *, {number} AS number FROM piece), "
            f"signed AS (SELECT {keys}, j, part, name, CASE WHEN number IS NULL THEN named WHEN number > 1114111 OR number BETWEEN 55296 AND 57343 "
            f"THEN {q(REPLACEMENT)} ELSE CASE number {renumbered} ELSE chr(number::INTEGER) END END AS sign FROM numbered LEFT JOIN ref USING (name)), "
            f"{out} AS (SELECT {keys}, string_agg(CASE WHEN j = 1 THEN part WHEN sign IS NULL THEN '&' || part "
            f"ELSE sign || substr(part, length(name) + 1) END, '' ORDER BY j) AS text FROM signed GROUP BY {keys})")


def field_ctes(source: str, key: str, texts: dict[str, list[str]], lists: dict[str, list[str]], html: str = "html") -> str:
    """CTE ``field`` (key, one column for each field): ``texts`` are joined by a blank,
    ``lists`` lower-cased, stripped lists; each is named with its selectors."""
    hit = " UNION ALL ".join(f"SELECT {key}, {q(name)} AS f, {s} AS s, n, text FROM node WHERE regexp_matches(path, {q(M.path_pattern(selector))})"
                             for name, selectors in {**texts, **lists}.items() for s, selector in enumerate(selectors))
    whole = f"SELECT {key}, f, 0 AS s, 0 AS n, {squeeze("string_agg(text, ' ' ORDER BY s, n)")} AS text FROM hit WHERE f IN {sql_in(texts)} GROUP BY {key}, f"
    parts = f" UNION ALL SELECT {key}, f, s, n, text FROM hit WHERE f IN {sql_in(lists)}" if lists else ""
    columns = [f"CASE WHEN {html} IS NOT NULL THEN coalesce((SELECT any_value(text) FROM dec d WHERE d.{key} = p.{key} AND f = {q(name)}), '') END AS {name}"
               for name in texts]
    columns += [f"CASE WHEN {html} IS NOT NULL THEN coalesce((SELECT list({strip_blank('lower(text)')} ORDER BY s, n) FROM dec d WHERE d.{key} = p.{key} "
                f"AND f = {q(name)}), []) END AS {name}" for name in lists]
    return (f"{node_ctes(source, key, html)}, hit AS ({hit}), enc AS ({whole}{parts}), {decode_ctes('enc', f'{key}, f, s, n')}, "
            f"field AS (SELECT {key}, {', '.join(columns)} FROM {source} p)")


def strip_blank(e: str) -> str:
    return f"regexp_replace({e}, {q(STRIP_PATTERN)}, '', 'g')"


def href_ctes(source: str, key: str, html: str = "html") -> str:
    """CTE ``href`` (key, href): the different targets of each page, decoded."""
    raw = f"regexp_replace(x, {q(M.QUOTES_PATTERN)}, '', 'g')"
    return (f"enc AS (SELECT {key}, nth, {raw} AS text FROM (SELECT {key}, xs[nth] AS x, nth FROM (SELECT {key}, "
            f"regexp_extract_all({noise(html)}, {q(H.HREF_PATTERN)}, 1) AS xs FROM {source}), range(1, len(xs) + 1) r(nth))), "
            f"{decode_ctes('enc', f'{key}, nth')}, href AS (SELECT DISTINCT {key}, trim(text) AS href FROM dec)")


def _times(a: str, c: int) -> str:
    return f"((({a})::HUGEINT * {c}) % 4294967296)::BIGINT"


def _rotate(a: str, n: int) -> str:
    return f"(((({a}) << {n}) | (({a}) >> {32 - n})) & 4294967295)"


def murmur3(term: str) -> str:
    """Unsigned 32-bit murmur3 (seed 42) of an ASCII string: first the numbers of
    its four-byte blocks, then one fold over them; the block of the rest is last."""
    byte = lambda at: (f"CASE WHEN {at} <= length({term}) THEN ascii(substr({term}, ({at})::INTEGER, 1)) "  # noqa: E731
                       "ELSE 0 END")
    number = " + ".join(f"({byte(f'4 * i + {j + 1}')}) * {256 ** j}" for j in range(4))
    scrambled = _times("r", C1)
    blocks = (f"[struct_pack(k := {_times(_rotate('x.r', 15), C2)}, whole := x.i < length({term}) // 4) FOR x IN "
              f"[struct_pack(r := {scrambled.replace('(r)', '(y.v)')}, i := y.i) FOR y IN "
              f"[struct_pack(v := ({number})::BIGINT, i := i) FOR i IN range(0, length({term}) // 4 + 1)]]]")
    # folding needs one type: the running hash travels in k
    mixed = "xor(h.k, b.k)"
    step = (f"struct_pack(k := CASE WHEN b.whole THEN ({_rotate(mixed, 13)} * 5 + 3864292196) & 4294967295 "
            f"ELSE {mixed} END, whole := b.whole)")
    folded = (f"list_reduce(list_prepend(struct_pack(k := {SEED}::BIGINT, whole := true), {blocks}), "
              f"lambda h, b: {step}).k")
    return f"xor({folded}, length({term}))"


def murmur_ctes(terms: str) -> str:
    """CTE ``buckets`` (term, bucket) of the CTE ``terms`` (term): the hash's last
    steps, one CTE each since every step uses its input twice."""
    return (f"m0 AS (SELECT term, {murmur3('term')} AS h FROM {terms}), "
            f"m1 AS (SELECT term, {_times('xor(h, h >> 16)', FINAL1)} AS h FROM m0), "
            f"m2 AS (SELECT term, {_times('xor(h, h >> 13)', FINAL2)} AS h FROM m1), "
            f"buckets AS (SELECT term, xor(h, h >> 16) % {NUM_FEATURES} AS bucket FROM m2)")


G = P.GROUP
G2 = P.SECOND_GROUP

RAW = (f"raw AS (SELECT doc_id, {G}, {G2}, split_part(text, chr(10), 1) AS title, "
       f"text AS content FROM documents)")
DOCS = (f"{RAW}, docs AS (SELECT doc_id, {G}, {G2}, {clean('lower(title)')} AS title, "
        f"{clean('lower(content)')} AS content, "
        f"{normalize('(title || chr(32) || content)')} AS body FROM raw)")
TOKS = f"{DOCS}, toks AS (SELECT doc_id, {G}, unnest(string_split(body, ' ')) AS word FROM docs)"


def like_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"{col} LIKE {q(p)}" for p in patterns) + ")"


SESSIONS = (f"{DOCS}, sessions AS (SELECT * FROM docs WHERE {like_any(P.SESSION_LINK, P.SESSION_INCLUDE)}"
            f" AND NOT {like_any('title', P.SESSION_EXCLUDE)})")


def tf_cte(key: str, view: str = DOCS, table: str = "docs") -> str:
    return (f"{view}, tf AS (SELECT {key}, term, count(*) AS tf FROM "
            f"(SELECT {key}, unnest(string_split(body, ' ')) AS term FROM {table}) "
            f"WHERE term <> '' GROUP BY {key}, term), "
            f"dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
            f"m AS (SELECT count(*) AS m FROM (SELECT DISTINCT {key} FROM {table})), "
            f"scores AS (SELECT {key}, tf.term AS term, "
            f"tf.tf * ln((m.m + 1)::DOUBLE / (dfq.df + 1)::DOUBLE) AS score, "
            f"tf.tf::DOUBLE AS tf FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN m)")


def hashed_out(key: str) -> str:
    """Scores by HashingTF bucket; NUM_FEATURES is a power of two, so the
    unsigned hash has the same bucket as the signed one."""
    return (f"WITH {tf_cte(key)}, terms AS (SELECT DISTINCT term FROM tf), {murmur_ctes('terms')}, "
            f"cells AS (SELECT {key}, tf.term AS term, bucket, CAST(sum(tf) OVER (PARTITION BY {key}, bucket) AS BIGINT) "
            "AS btf FROM tf JOIN buckets ON tf.term = buckets.term), "
            f"bd AS (SELECT bucket, count(DISTINCT {key}) AS bdf FROM cells GROUP BY bucket) "
            f"SELECT {key}, term, {rnd('btf * ln((m.m + 1)::DOUBLE / (bd.bdf + 1)::DOUBLE)')} AS score, "
            "btf::DOUBLE AS tf FROM cells JOIN bd ON cells.bucket = bd.bucket CROSS JOIN m")


def scores_out(key: str) -> str:
    return f"WITH {tf_cte(key)} SELECT {key}, term, {rnd('score')} AS score, tf FROM scores"


def top_terms(key: str, view: str = DOCS, table: str = "docs") -> str:
    return (f"WITH {tf_cte(key, view, table)} SELECT {key}, term, {rnd('score')} AS score, rank FROM ("
            f"SELECT {key}, term, score, dense_rank() OVER (PARTITION BY {key} ORDER BY score DESC)"
            f" AS rank FROM scores WHERE score <> 0) WHERE rank <= {TOP_RANK_PER_GROUP}")


SESSION_TOKS = f"{SESSIONS}, toks AS (SELECT {G}, unnest(string_split(body, ' ')) AS word FROM sessions)"


TERMS = sql_in(P.TIMELINE_TERMS)
CAMPS = sql_in(P.CAMP_FIRST + P.CAMP_SECOND)
CAMP_LABEL = (f"CASE WHEN {{w}} IN {sql_in(P.CAMP_FIRST)} THEN {q(P.CAMP_FIRST_LABEL)} "
              f"ELSE {q(P.CAMP_SECOND_LABEL)} END AS technology")
WC_GROUP = f"wc AS (SELECT {G}, word, count(*) AS count FROM toks GROUP BY {G}, word)"
WC_TOTALS = f"t AS (SELECT {G}, CAST(sum(count) AS BIGINT) AS total FROM wc GROUP BY {G})"
TF_TOTALS = f"t AS (SELECT {G}, sum(tf) AS total FROM scores GROUP BY {G})"

PAGE_FIELDS = field_ctes("pages", "page_id", {"title": P.TITLE, "content": P.CONTENT}, {"speakers": P.SPEAKERS})
SPEAKER_COUNTS = (f"{PAGE_FIELDS}, sc AS (SELECT word, count(*) AS count FROM "
                  f"(SELECT unnest(speakers) AS word FROM field) GROUP BY word)")

ALIASED = f"replace(url, {q(WWW_ALIAS[0])}, {q(WWW_ALIAS[1])})"

TARGET = (
    "CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href "
    "WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href "
    "WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href "
    "WHEN starts_with(href, '#') OR href = '' THEN url "
    "ELSE (CASE WHEN regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) = '' "
    "THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' "
    "ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) END) || href END"
)


ORIGIN = f"regexp_extract(target, {q(URL_ORIGIN_PATTERN)}, 1)"
# Path segments folded from the left: '.' adds nothing, '..' takes the last one away.
FOLDED = (
    "list_reduce(list_transform(CASE WHEN parts[-1] IN ('.', '..') THEN list_append(parts, '') ELSE parts END, "
    "lambda p: [p]), lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN "
    "(CASE WHEN len(a) > 1 THEN a[1:len(a) - 1] ELSE a END) ELSE list_concat(a, b) END)"
)


def _host_allowed(host: str) -> str:
    return "(" + " OR ".join(f"({host} = {q(d)} OR ends_with({host}, {q('.' + d)}))"
                             for d in P.LINK_ALLOWED_DOMAINS) + ")"


def json_string(e: str) -> str:
    """A string as JSON text, as Spark writes it."""
    out = f"replace(replace({e}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    for sign, short in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = f"replace({out}, chr({sign}), chr(92) || '{short}')"
    return f"'\"' || {out} || '\"'"


def broken_lines_sql() -> str:
    fields = (("title", "source"), ("content", "text"), ("speakers", None), ("link", "doc_id::VARCHAR"))
    parts = [f"'\"{name}\":' || " + (json_string(e) if e else f"'[' || {json_string('lang')} || ']'") for name, e in fields]
    line = "'{' || " + " || ',' || ".join(parts) + " || '}'"
    return (f"WITH l AS (SELECT *, doc_id % {P.BROKEN_EVERY} AS kind, {line} AS line FROM documents) "
            "SELECT kind < 2 AS broken, CASE WHEN kind >= 2 THEN source END AS title, "
            "CASE WHEN kind >= 2 THEN text WHEN kind = 0 THEN substr(line, 1, length(line) - 2) ELSE '#' || line END AS content, "
            "CASE WHEN kind >= 2 THEN lang END AS speakers, CASE WHEN kind >= 2 THEN doc_id::VARCHAR END AS link FROM l")


def layouts_sql() -> str:
    """One set of selected nodes for all pages; a layout's selectors count for its own site's."""
    site = f"regexp_extract(url, {q(URL_LANG_PATTERN)}, 1)"
    hit = " UNION ALL ".join(
        f"SELECT page_id, {q(field)} AS f, {i} AS s, n, text FROM node JOIN pages USING (page_id) "
        f"WHERE {site} = {q(key)} AND regexp_matches(path, {q(M.path_pattern(selector))})"
        for key, *fields in P.PAGE_LAYOUTS for field, selectors in zip(("title", "content", "speakers"), fields, strict=True)
        for i, selector in enumerate(selectors))
    of = lambda f, e: f"(SELECT {e} FROM dec d WHERE d.page_id = p.page_id AND f = {q(f)})"
    known = f"{site} IN {sql_in(row[0] for row in P.PAGE_LAYOUTS)}"
    texts = ", ".join(f"CASE WHEN {known} THEN coalesce({of(f, 'any_value(text)')}, '') END AS {f}" for f in ("title", "content"))
    items = of("speakers", f"string_agg({strip_blank('lower(text)')}, '|' ORDER BY s, n)")
    return (f"WITH {node_ctes('pages', 'page_id')}, hit AS ({hit}), "
            f"enc AS (SELECT page_id, f, 0 AS s, 0 AS n, {squeeze("string_agg(text, ' ' ORDER BY s, n)")} AS text FROM hit "
            f"WHERE f <> 'speakers' GROUP BY page_id, f UNION ALL SELECT page_id, f, s, n, text FROM hit WHERE f = 'speakers'), "
            f"{decode_ctes('enc', 'page_id, f, s, n')} SELECT page_id, url AS link, {site} AS site_key, {texts}, "
            f"CASE WHEN {known} THEN coalesce({items}, '') END AS speakers FROM pages p")


ORACLES: dict[str, str] = {
    "clean_string": f"SELECT doc_id, {clean('lower(text)')} AS cleaned FROM documents",
    "remove_stopwords": f"SELECT doc_id, {stop(clean('lower(text)'))} AS cleaned FROM documents",
    "strip_plural": f"SELECT doc_id, {plural(stop(clean('lower(text)')))} AS cleaned FROM documents",
    "glue_phrases": f"SELECT doc_id, {glue(clean('lower(text)'))} AS cleaned FROM documents",
    "normalize_text": f"SELECT doc_id, {normalize('text')} AS body FROM documents",
    "normalize_array": (
        "SELECT conv_id, turn, (i - 1)::BIGINT AS pos, parts[i] AS sentence FROM ("
        "SELECT conv_id, turn, list_transform(string_split(text, '.'), "
        f"lambda x: {strip_blank('lower(x)')}) AS parts FROM conversations), "
        "range(1, len(parts) + 1) r(i)"),
    "url_group_key": (f"SELECT page_id, url, regexp_extract({ALIASED}, {q(URL_KEY_PATTERN)}, 1)"
                      " AS year FROM pages"),
    "url_group_key_default": (
        f"SELECT page_id, url, coalesce(nullif(regexp_extract(url, {q(P.URL_DIGITS_PATTERN)}, 1), ''),"
        f" {q(DEFAULT_URL_KEY)}) AS year FROM pages"),
    "page_extract": (f"WITH {PAGE_FIELDS} SELECT page_id, url AS link, title, content, "
                     "array_to_string(speakers, '|') AS speakers FROM pages JOIN field USING (page_id)"),
    "scan_jsonl": (f"WITH {PAGE_FIELDS} SELECT url AS link, title, content, "
                   "array_to_string(speakers, '|') AS speakers FROM pages JOIN field USING (page_id)"),
    "sink_jsonl": f"WITH {DOCS} SELECT doc_id, {G}, body FROM docs",
    "scan_wordlist": ("SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split(p_name, ' '))"
                      " AS w FROM part) WHERE trim(w) <> ''"),
    "preview_nonempty": (f"WITH {DOCS} SELECT doc_id, {G}, title, body FROM docs "
                         f"WHERE content <> '' ORDER BY doc_id LIMIT {P.PREVIEW_ROWS}"),
    "clean_documents": f"WITH {DOCS} SELECT doc_id, {G}, {G2}, title, content, body FROM docs",
    "filter_sessions": f"WITH {SESSIONS} SELECT doc_id, {P.SESSION_LINK}, title FROM sessions",
    "filter_by_group": (f"WITH {DOCS} SELECT {G}, doc_id, title FROM docs "
                        f"WHERE {G} = {q(P.GROUP_VALUE)} ORDER BY title, doc_id"),
    "count_per_group": (f"WITH {SESSIONS} SELECT {G}, count(*) AS count FROM sessions "
                        f"GROUP BY {G} ORDER BY {G}"),
    "word_count": f"WITH {TOKS} SELECT word, count(*) AS count FROM toks GROUP BY word",
    "word_count_per_group": (f"WITH {TOKS} SELECT {G}, word, count(*) AS count FROM toks "
                             f"GROUP BY {G}, word"),
    "array_element_count": f"WITH {SPEAKER_COUNTS} SELECT word, count FROM sc",
    "word_count_topk": (f"WITH {TOKS} SELECT word, count(*) AS count FROM toks GROUP BY word "
                        f"ORDER BY count DESC, word LIMIT {TOP_WORDS}"),
    "word_count_per_group_topk": (
        f"WITH {TOKS} SELECT {G}, word, count(*) AS count FROM toks GROUP BY {G}, word "
        f"ORDER BY count DESC, {G}, word LIMIT {TOP_WORDS}"),
    "array_element_topk": (f"WITH {SPEAKER_COUNTS} SELECT word, count FROM sc "
                           f"ORDER BY count DESC, word LIMIT {TOP_WORDS}"),
    "words_per_group": (f"WITH {DOCS} SELECT {G}, CAST(sum(len(string_split(body, ' '))) AS BIGINT)"
                        f" AS number_of_words FROM docs GROUP BY {G} ORDER BY {G}"),
    "stopwords_anti_join": (
        f"WITH {RAW}, c AS (SELECT {G}, unnest(string_split("
        f"{clean('lower(title || chr(32) || content)')}, ' ')) AS word FROM raw) "
        f"SELECT {G}, word, count(*) AS count FROM c WHERE word NOT IN {sql_in(P.STOPWORDS)} "
        f"GROUP BY {G}, word"),
    "timeline": (f"WITH {TOKS}, {WC_GROUP} SELECT {G}, word, count FROM wc "
                 f"WHERE word IN {TERMS} ORDER BY {G}, count, word"),
    "timeline_relative": (
        f"WITH {TOKS}, {WC_GROUP}, {WC_TOTALS} SELECT w.{G} AS {G}, word, count, "
        f"{rnd('count / total * 100')} AS relative_count FROM wc w LEFT JOIN t ON w.{G} = t.{G} "
        f"WHERE word IN {TERMS} ORDER BY {G}, count, word"),
    "term_groups_relative": (
        f"WITH {TOKS}, {WC_GROUP}, {WC_TOTALS} SELECT w.{G} AS {G}, "
        f"{CAMP_LABEL.format(w='word')}, count, {rnd('count / total * 100')} AS relative_count "
        f"FROM wc w LEFT JOIN t ON w.{G} = t.{G} WHERE word IN {CAMPS}"),
    "corpus_stats": (
        f"WITH {DOCS} SELECT {G}, count(DISTINCT doc_id) AS urls, "
        f"CAST(sum(length(body)) AS BIGINT) AS text_length, "
        f"{rnd('sum(length(body)) / count(DISTINCT doc_id)')} AS avg_document_size "
        f"FROM docs GROUP BY {G} ORDER BY {G}"),
    "corpus_stats_filtered": (
        f"WITH {DOCS} SELECT {G}, count(DISTINCT doc_id) AS urls, "
        f"CAST(sum(length(body)) AS BIGINT) AS text_length, "
        f"{rnd('sum(length(body)) / count(DISTINCT doc_id)')} AS avg_document_size "
        f"FROM docs WHERE {like_any(P.SESSION_LINK, P.STATS_LINK_INCLUDE)} "
        f"GROUP BY {G} ORDER BY {G}"),
    "corpus_stats_by_label": (
        f"WITH {DOCS} SELECT l.quality AS quality, count(DISTINCT d.doc_id) AS urls, "
        f"CAST(sum(length(d.body)) AS BIGINT) AS text_length, "
        f"{rnd('sum(length(d.body)) / count(DISTINCT d.doc_id)')} AS avg_document_size "
        "FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality"),
    "word_count_per_role": (
        f"SELECT role, word, count(*) AS count FROM (SELECT role, "
        f"unnest(string_split({normalize('text')}, ' ')) AS word FROM conversations) "
        "GROUP BY role, word"),
    "document_frequency": f"WITH {tf_cte('doc_id')} SELECT term, df FROM dfq",
    "tfidf_exact": scores_out("doc_id"),
    "tfidf_per_group": scores_out(G),
    "tfidf_per_source": scores_out(G2),
    "top_terms_per_group": top_terms(G),
    "top_terms_per_source": top_terms(G2),
    "top_terms_for_document": (
        f"WITH {tf_cte('doc_id')} SELECT term, {rnd('score')} AS score, tf, doc_id FROM scores "
        f"WHERE doc_id = {P.DOCUMENT_KEY_VALUE} ORDER BY score DESC, term"),
    "tf_timeline": (f"WITH {tf_cte(G)} SELECT {G}, term, tf FROM scores WHERE term IN {TERMS} "
                    f"ORDER BY {G}, tf, term"),
    "tf_timeline_relative": (
        f"WITH {tf_cte(G)}, {TF_TOTALS} SELECT s.{G} AS {G}, term, tf, total, "
        f"{rnd('tf / total')} AS relative_tf FROM scores s LEFT JOIN t ON s.{G} = t.{G} "
        f"WHERE term IN {TERMS} ORDER BY {G}, tf, term"),
    "term_groups_tf": (f"WITH {tf_cte(G)} SELECT {G}, {CAMP_LABEL.format(w='term')}, tf "
                       f"FROM scores WHERE term IN {CAMPS}"),
    "tf_total_per_group": (f"WITH {tf_cte(G)} SELECT {G}, sum(tf) AS total_tf FROM scores "
                           f"GROUP BY {G} ORDER BY {G}"),
    "top_tf_in_group": (f"WITH {tf_cte(G)} SELECT term, tf FROM scores "
                        f"WHERE {G} = {q(P.TOP_TF_GROUP_VALUE)} ORDER BY tf DESC, term "
                        f"LIMIT {TOP_TF_IN_GROUP}"),
    "ml_tokenize": (
        f"WITH {DOCS}, w AS (SELECT doc_id, CASE WHEN body = '' THEN [''] "
        "WHEN rtrim(body, ' ') = '' THEN []::VARCHAR[] "
        "ELSE string_split(rtrim(body, ' '), ' ') END AS words FROM docs) "
        "SELECT doc_id, (i - 1)::BIGINT AS pos, words[i] AS word FROM w, "
        "range(1, len(words) + 1) r(i)"),
    "hash_bucket_audit": (
        f"WITH {tf_cte('doc_id')}, terms AS (SELECT DISTINCT term FROM tf), {murmur_ctes('terms')} "
        "SELECT bucket, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term "
        "FROM buckets GROUP BY bucket HAVING count(*) > 1"),
    "page_anchor_list": (
        f"WITH {PAGE_FIELDS} SELECT page_id, (i - 1)::BIGINT AS pos, speakers[i] AS speaker "
        "FROM field, range(1, len(speakers) + 1) r(i)"),
    "page_gate": (
        f"WITH {node_ctes('pages', 'page_id')}, "
        f"k AS (SELECT page_id, string_agg(text, ' ' ORDER BY n) AS page_key FROM node "
        f"WHERE regexp_matches(path, {q(M.path_pattern(P.GATE_KEY))}) GROUP BY page_id), "
        f"g AS (SELECT page_id, url, regexp_extract(url, {q(URL_LANG_PATTERN)}, 1) AS url_key, coalesce(page_key, '') AS page_key, "
        f"len(regexp_extract_all(html, {q(P.GATE_SLOT_PATTERN)}, 1)) AS slots FROM pages LEFT JOIN k USING (page_id)) "
        "SELECT page_id, url, url_key, page_key FROM g WHERE CASE "
        f"WHEN url_key IN {sql_in(P.GATE_SPECIAL)} THEN slots > 0 "
        "ELSE page_key <> '' AND instr(page_key, url_key) > 0 END"),
    "page_direct_text": (
        f"WITH {field_ctes('pages', 'page_id', {'content': ['article p::text']}, {})} SELECT page_id, content FROM field"),
    "page_corpus_timeline": (
        f"WITH g AS (SELECT page_id, url, html, regexp_extract(url, {q(URL_LANG_PATTERN)}, 1) AS year, "
        f"regexp_extract(html, {q(H.PAGE_LANG_PATTERN)}, 1) AS page_key, "
        f"len(regexp_extract_all(html, {q(P.GATE_SLOT_PATTERN)}, 1)) AS slots FROM pages), "
        "kept AS (SELECT * FROM g WHERE CASE "
        f"WHEN year IN {sql_in(P.GATE_SPECIAL)} THEN slots > 0 "
        "ELSE page_key <> '' AND instr(page_key, year) > 0 END), "
        f"{field_ctes('kept', 'page_id', {'title': P.TITLE, 'content': P.CONTENT}, {})}, "
        "raw AS (SELECT year, url AS link, title, content FROM kept JOIN field USING (page_id)), "
        f"docs AS (SELECT year, link, {clean('lower(title)')} AS title, "
        f"{normalize('(title || chr(32) || content)')} AS body FROM raw), "
        f"sessions AS (SELECT * FROM docs WHERE {like_any('link', P.PAGE_SESSION_INCLUDE)} "
        f"AND NOT {like_any('title', NON_SESSION_TITLES)}), "
        "toks AS (SELECT year, unnest(string_split(body, ' ')) AS word FROM sessions), "
        "wc AS (SELECT year, word, count(*) AS count FROM toks GROUP BY year, word), "
        "t AS (SELECT year, CAST(sum(count) AS BIGINT) AS total FROM wc GROUP BY year) "
        f"SELECT w.year AS year, word, count, {rnd('count / total * 100')} AS relative_count "
        f"FROM wc w LEFT JOIN t ON w.year = t.year WHERE word IN {TERMS}"),
    "page_links": (
        f"WITH {href_ctes('pages', 'page_id')}, l AS (SELECT page_id, url, href FROM href JOIN pages USING (page_id)), "
        f"t AS (SELECT page_id, href, {TARGET} AS target FROM l), "
        f"o AS (SELECT *, {ORIGIN} AS origin, substr(target, length({ORIGIN}) + 1) AS rest FROM t), "
        "p AS (SELECT *, regexp_extract(rest, '^([^?#]*)', 1) AS path FROM o), "
        "s AS (SELECT *, string_split(path, '/') AS parts FROM p), "
        "r AS (SELECT page_id, href, CASE WHEN origin <> '' AND regexp_matches(path, '/[.]{1,2}(/|$)') THEN "
        f"origin || array_to_string({FOLDED}, '/') || substr(rest, length(path) + 1) ELSE target END AS target FROM s) "
        "SELECT page_id, href, target FROM r WHERE "
        f"instr(target, {q(P.LINK_DENY)}) = 0 AND "
        f"{_host_allowed('regexp_extract(target, ' + q(URL_HOST_PATTERN) + ', 1)')}"),
    "page_title": f"WITH {field_ctes('pages', 'page_id', {'title': P.TITLE}, {})} SELECT page_id, title FROM field",
    "page_extract_by_layout": layouts_sql(),
    "tfidf_hashed": hashed_out("doc_id"),
    "tfidf_hashed_vectors": hashed_out("doc_id"),
    "tfidf_hashed_per_group": hashed_out(G),
    "tfidf_cached_features": hashed_out("doc_id"),
    "term_presence": (
        f"WITH {tf_cte('doc_id')}, asked AS (SELECT unnest({sql_list(P.PRESENCE_TERMS)}) AS term), "
        f"terms AS (SELECT term FROM tf UNION SELECT term FROM asked), {murmur_ctes('terms')}, "
        "cells AS (SELECT doc_id, bucket, CAST(sum(tf) AS BIGINT) AS btf FROM tf JOIN buckets USING (term) GROUP BY doc_id, bucket), "
        "bd AS (SELECT bucket, count(*) AS bdf FROM cells GROUP BY bucket) "
        "SELECT d.doc_id AS doc_id, a.term AS term, b.bucket AS bucket, coalesce(btf, 0)::DOUBLE AS tf, "
        f"coalesce({rnd('btf * ln((m.m + 1)::DOUBLE / (bdf + 1)::DOUBLE)')}, 0) AS weight, btf IS NOT NULL AS present "
        "FROM (SELECT doc_id FROM docs) d CROSS JOIN asked a JOIN buckets b USING (term) CROSS JOIN m "
        "LEFT JOIN cells c ON c.doc_id = d.doc_id AND c.bucket = b.bucket LEFT JOIN bd ON bd.bucket = b.bucket"),
    "normalize_text_table": f"SELECT doc_id, {normalize('text')} AS body FROM documents",
    "timeline_materialized": (f"WITH {TOKS}, {WC_GROUP} SELECT {G}, word, count FROM wc "
                              f"WHERE word IN {TERMS} ORDER BY {G}, count, word"),
    "scan_jsonl_broken": broken_lines_sql(),
    "hash_bucket_terms": (
        f"WITH {tf_cte('doc_id')}, terms AS (SELECT DISTINCT term FROM tf), {murmur_ctes('terms')}, "
        "held AS (SELECT bucket, count(*) AS n_terms FROM buckets GROUP BY bucket), "
        "bd AS (SELECT bucket, count(DISTINCT doc_id) AS bdf FROM tf JOIN buckets USING (term) GROUP BY bucket) "
        f"SELECT term, bucket, {rnd('ln((m.m + 1)::DOUBLE / (bdf + 1)::DOUBLE)')} AS weight, n_terms "
        "FROM buckets JOIN held USING (bucket) JOIN bd USING (bucket) CROSS JOIN m"),
    "session_word_count_per_group": (
        f"WITH {SESSION_TOKS} SELECT {G}, word, count(*) AS count FROM toks GROUP BY {G}, word"),
    "session_timeline_relative": (
        f"WITH {SESSION_TOKS}, {WC_GROUP}, {WC_TOTALS} SELECT w.{G} AS {G}, word, count, "
        f"{rnd('count / total * 100')} AS relative_count FROM wc w LEFT JOIN t ON w.{G} = t.{G} "
        f"WHERE word IN {TERMS}"),
    "session_top_terms_per_group": top_terms(G, SESSIONS, "sessions"),
    "sql_normalizer_steps": (
        f"SELECT doc_id, {stop('c')} AS stopped, {plural('c')} AS singular, {glue('c')} AS glued, "
        f"array_to_string(list_transform(string_split(text, '.'), lambda x: {strip_blank('lower(x)')}), '|') AS sentences "
        f"FROM (SELECT doc_id, text, {clean('lower(text)')} AS c FROM documents)"),
    "sql_clean_documents": f"WITH {DOCS} SELECT doc_id, {G}, title, content, body FROM docs",
    "sql_timeline_relative": (
        f"WITH {TOKS}, {WC_GROUP}, {WC_TOTALS} SELECT w.{G} AS {G}, word, count, "
        f"{rnd('count / total * 100')} AS relative_count FROM wc w LEFT JOIN t ON w.{G} = t.{G} "
        f"WHERE word IN {TERMS}"),
    "sql_top_terms": top_terms(G),
    "sql_words_per_group": (
        f"WITH {DOCS} SELECT {G}, CAST(sum(len(string_split(body, ' '))) AS BIGINT) "
        f"AS number_of_words FROM docs GROUP BY {G}"),
}
